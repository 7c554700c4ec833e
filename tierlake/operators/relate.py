"""Joins and merges the engine needs beyond plain equi-joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlake.session import ensure_checkpoint_dir, python_partitions


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: an aggregate with a map-side part, so hot keys don't gather. Ties in ``order`` are broken by the other columns."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_best"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns))


def ancestors(path: Column) -> Column:
    """All ancestors of an absolute path and the path itself, without trailing slashes."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))


def deepest_root(paths: DataFrame, roots: DataFrame, by: list[str], path: str, root: str) -> DataFrame:
    """``paths`` with the longest of ``roots`` at or above each path (null if none), within equal ``by``.

    A path's ancestors (as many as it has segments) are exploded and joined by equality, instead of a prefix comparison of all pairs.
    """
    keyed = paths.select(*by, path).distinct()
    up = keyed.select(*by, path, F.explode(ancestors(F.col(path))).alias(root))
    best = up.join(roots.select(*by, root).distinct(), [*by, root]).groupBy(*by, path).agg(F.max_by(root, F.length(root)).alias(root))
    return paths.join(best, [*by, path], "left")


def at_or_below(path: Column, root: str) -> Column:
    """Whether a path is ``root`` or below it; a mere common prefix is not enough."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def full_diff(expected: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, verdict): ``missing``, ``unexpected``, ``mismatched`` or ``equal`` per key; null values equal each other."""
    a = expected.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = actual.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    verdict = F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "unexpected").when(~F.col("_a").eqNullSafe(F.col("_b")), "mismatched").otherwise("equal")
    return a.join(b, keys, "full").select(*keys, verdict.alias("verdict"))


def all_satisfy(parents: DataFrame, children: DataFrame, key: str, bad: Column) -> DataFrame:
    """(key, ok): whether no child of a parent is ``bad``; a parent without children is ok."""
    worst = children.groupBy(key).agg(F.max(F.coalesce(bad, F.lit(True)).cast("int")).alias("_bad"))
    return parents.select(key).distinct().join(worst, key, "left").select(key, (F.coalesce("_bad", F.lit(0)) == 0).alias("ok"))


def merge_revisions(authority: DataFrame, incoming: DataFrame, key: str, revision: str, body: list[str]) -> DataFrame:
    """(key, outcome): a higher revision wins (``advanced``), a lower is ``stale``, an equal one must agree (``identical`` or ``conflict``), a new key is ``inserted``, one that only the authority has is ``kept``."""
    a = authority.select(key, F.col(revision).alias("_ra"), F.struct(*body).alias("_ba"))
    b = incoming.select(key, F.col(revision).alias("_rb"), F.struct(*body).alias("_bb"))
    outcome = (
        F.when(F.col("_bb").isNull(), "kept").when(F.col("_ba").isNull(), "inserted").when(F.col("_rb") > F.col("_ra"), "advanced").when(F.col("_rb") < F.col("_ra"), "stale").when(F.col("_ba").eqNullSafe(F.col("_bb")), "identical").otherwise("conflict")
    )
    return a.join(b, key, "full").select(key, outcome.alias("outcome"))


def merkle_digest(df: DataFrame, keys: list[str], line: Column, levels: tuple[int, ...] = (5, 3, 1)) -> DataFrame:
    """(keys, digest, n): a digest of a key's distinct lines in order of their hashes, whatever the order of the rows.

    Lines are spread over leaves by the first digits of their SHA-256 (``levels[0]`` of them); a leaf's digest covers its
    sorted hashes, a node of each further level the digests of the nodes with its digits, and a key's digest the nodes of
    the last. A task gathers a leaf of a key, which is a millionth of its lines by default, or 256 nodes.
    """
    hashed = df.select(*keys, F.sha2(line, 256).alias("_h")).distinct()
    node = hashed.groupBy(*keys, F.left("_h", F.lit(levels[0])).alias("_at")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256).alias("_d"), F.count(F.lit(1)).alias("_n"))
    for digits in (*levels[1:], 0):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_d"))), lambda x: F.concat(x["_at"], x["_d"])), "")
        node = node.withColumn("_up", F.left("_at", F.lit(digits))).groupBy(*keys, "_up").agg(F.sha2(joined, 256).alias("_d"), F.sum("_n").alias("_n")).withColumnRenamed("_up", "_at")
    return node.select(*keys, F.col("_d").alias("digest"), F.col("_n").alias("n"))


def merkle_sql(hashes: str, levels: tuple[int, ...] = (5, 3, 1)) -> str:
    """The SQL of :func:`merkle_digest` by source_path, over distinct (source_path, h)."""
    node = f"(select source_path, h[1:{levels[0]}] as leaf, sha256(string_agg(h, '' order by h)) as dg, count(*) as n from ({hashes}) group by 1, 2)"
    for digits in (*levels[1:], 0):
        node = f"(select source_path, left(leaf, {digits}) as leaf, sha256(string_agg(leaf || dg, '' order by leaf)) as dg, cast(sum(n) as bigint) as n from {node} group by 1, 2)"
    return f"(select source_path, dg as digest, n from {node})"


class _Stretch:
    """Windows in the items of a key that a block holds, for every item among the first ``max_items`` at which a window may start."""

    def __init__(self, key: tuple, fits: Callable, max_items: int):
        self.key, self.fits, self.max_items = key, fits, max_items
        self.heads: list[int | None] = []
        self.live: list[list] = []  # number and size of an open window, windows opened, [(start, windows opened more)]

    def add(self, size: int | None) -> None:
        fresh = []
        for x in self.live:
            if self.fits(x[0], x[1], size):
                x[0], x[1] = x[0] + 1, x[1] + size
            else:
                x[0], x[1], x[2] = 1, size, x[2] + 1
                fresh.append(x)
        if len(self.heads) < self.max_items:
            fresh.append([1, size, 1, [(len(self.heads), 0)]])
            self.live.append(fresh[-1])
            self.heads.append(size)
        if len(fresh) > 1:  # windows that start together stay together
            kept = fresh[0]
            for x in fresh[1:]:
                kept[3] += [(start, more + x[2] - kept[2]) for start, more in x[3]]
            self.live = [x for x in self.live if x is kept or all(x is not y for y in fresh)]

    def ends(self) -> list[tuple[int, int, int | None]]:
        """For each start: windows opened, number and size of the last."""
        out = {start: (x[2] + more, x[0], x[1]) for x in self.live for start, more in x[3]}
        return [out[k] for k in range(len(self.heads))]


def _fits(max_items: int, max_size: int) -> Callable:
    return lambda n, total, size: n < max_items and total is not None and size is not None and total + size <= max_size


def _edge_stretches(n_keys: int, max_items: int, max_size: int):
    """The first and the last stretch of a block; rows are (block, keys, size) in order."""
    fits = _fits(max_items, max_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = block = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = row[1:-1]
                if last is None or key != last.key:
                    block, last = row[0], _Stretch(key, fits, max_items)
                    first = first or last
                last.add(row[-1])
        if last is None:
            return
        both = [first] if first is last else [first, last]
        ends = [list(zip(*x.ends(), strict=True)) for x in both]
        keys = [pa.array([x.key[k] for x in both], b.schema.field(k + 1).type) for k in range(n_keys)]
        longs = pa.list_(pa.int64())
        rest = [pa.array([x.heads for x in both], longs), *(pa.array([list(e[k]) for e in ends], longs) for k in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(both), pa.int32()), pa.array(range(len(both)), pa.int32()), *keys, *rest], names=["block", "place", *(f"k{k}" for k in range(n_keys)), "heads", "opened", "n", "total"])

    return run


def _carried(edges: list, n_keys: int, max_items: int, max_size: int) -> dict[int, list]:
    """For each block: the window that is open before it (its ordinal, number and size; None if its first key is new), and whether its last key goes on after it."""
    fits = _fits(max_items, max_size)
    blocks: dict[int, list] = {}
    for r in sorted(edges, key=lambda r: (r["block"], r["place"])):
        blocks.setdefault(r["block"], []).append(r)
    out: dict[int, list] = {}
    before = key = last = None
    for block, stretches in blocks.items():
        first = stretches[0]
        mine = tuple(first[f"k{k}"] for k in range(n_keys))
        goes_on = before is not None and key == mine
        if goes_on:
            out[last][1] = True
        out[block] = [before if goes_on else None, False]
        window, n, total = before if goes_on else (0, max_items, None)
        for j, size in enumerate(first["heads"]):
            if not fits(n, total, size):
                window, n, total = window + first["opened"][j], first["n"][j], first["total"][j]
                break
            n, total = n + 1, total + size
        if len(stretches) > 1:
            window, n, total = (stretches[1][c][0] for c in ("opened", "n", "total"))
            mine = tuple(stretches[1][f"k{k}"] for k in range(n_keys))
        before, key, last = (window, n, total), mine, block
    return out


def _windows(shared, n_keys: int, max_items: int, max_size: int):
    """(keys, window, n, total) of the windows that end in a block."""
    fits = _fits(max_items, max_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, goes_on, types = None, False, None
        window, n, total = 0, 0, None
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * (n_keys + 3)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*(f"k{k}" for k in range(n_keys)), "window", "n", "total"])

        for b in batches:
            types = [*(b.schema.field(k + 1).type for k in range(n_keys)), pa.int32(), pa.int32(), pa.int64()]
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                size = row[-1]
                if key is None:
                    key, (open_, goes_on) = row[1:-1], shared.value[row[0]]
                    window, n, total = open_ or (0, 0, None)
                elif key != row[1:-1]:
                    out.append((*key, window, n, total))
                    key, window, n, total = row[1:-1], 0, 0, None
                if n and fits(n, total, size):
                    n, total = n + 1, total + size
                    continue
                if n:
                    out.append((*key, window, n, total))
                window, n, total = window + 1, 1, size
            yield emit()
        if key is not None and not goes_on:
            out.append((*key, window, n, total))
            yield emit()

    return run


def greedy_windows(df: DataFrame, keys: list[str], order: Column, size: Column, max_items: int, max_size: int) -> DataFrame:
    """(keys, window, n, total): consecutive items put in windows, closed when full by number or size; an item that is too large has its own, and so has one of null size.

    Method: rows are range-partitioned by keys and order, so that a hot key spans many blocks. A pass over each block
    gives, for each of its first ``max_items`` items, where its windows end up if one starts there (windows that start
    together stay together, so this is kept for few at a time); the driver, which gets at most two such rows of
    ``max_items`` numbers a block, carries the open window from block to block, and a second pass closes the windows.
    Both passes read a block as a stream. Ties of the order are taken by size.
    """
    if max_items < 1 or max_size < 1:
        raise ValueError("a window must hold something")
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    names = [f"k{k}" for k in range(len(keys))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(keys, names, strict=True)), order.alias("o"), size.cast("long").alias("s"))
    by = [*names, "o", "s"]
    blocks = rows.repartitionByRange(python_partitions(spark), *by).sortWithinPartitions(*by).select(F.spark_partition_id().alias("block"), *names, "s").checkpoint()
    typed = [f"{k} {blocks.schema[k].dataType.simpleString()}" for k in names]
    edges = blocks.mapInArrow(_edge_stretches(len(keys), max_items, max_size), ", ".join(["block int", "place int", *typed, *(f"{c} array<long>" for c in ("heads", "opened", "n", "total"))])).collect()  # at most two rows a block
    shared = spark.sparkContext.broadcast(_carried(edges, len(keys), max_items, max_size))
    return blocks.mapInArrow(_windows(shared, len(keys), max_items, max_size), ", ".join([*typed, "window int", "n int", "total long"])).toDF(*keys, "window", "n", "total")
