"""Runs of identical or near-identical consecutive events collapsed by pointer doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tierlake.functions.keys import BLANKS, workspace_key
from tierlake.session import ensure_checkpoint_dir

#: White space within reasons, and what may end one besides it (fixed values, Java patterns).
SPACE = r"(?U)\s+"
DIGIT_WORD = r"(?U)[^\s]*[0-9][^\s]*"
END = r"(?U)[\s\p{P}]+$"


def event_label(c: Column) -> Column:
    """An event name without regard to letter case and blanks around it; null is blank."""
    return F.lower(F.btrim(F.coalesce(c, F.lit("")), F.lit(BLANKS)))


def reason_label(c: Column) -> Column:
    """A reason without regard to letter case, the amount of white space, what stands in words with a digit, and white space and punctuation at the end; null is blank."""
    words = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), DIGIT_WORD, "0"), SPACE, " ")
    return F.lower(F.regexp_replace(F.regexp_replace(words, END, ""), "^ ", ""))


def _last_of_stretch(flag: np.ndarray) -> np.ndarray:
    """Pointer of each row to the first row of its stretch; ``flag`` marks rows that continue the row before."""
    ptr = np.arange(len(flag))
    ptr[flag] -= 1
    while True:
        further = ptr[ptr]
        if np.array_equal(further, ptr):
            return ptr
        ptr = further


FRAGMENT = "first_id long, last_id long, first_at double, last_at double, n long, block int, opens boolean, closes boolean"


def _fragments(keep: list[str], schema: pa.Schema):
    """Sorted events of a block to fragments: stretches of like events that do not leave the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        opened, held, last = False, None, None  # held: the fragment that may still go on

        def emit(rows: pa.Table, closes: bool) -> list[pa.RecordBatch]:
            nonlocal opened
            n = rows.num_rows
            mark, end = np.zeros(n, bool), np.zeros(n, bool)
            mark[0], opened = not opened, True
            end[-1] = closes
            cols = {**{c: rows[c] for c in rows.schema.names}, "block": pa.array(np.full(n, block, np.int32)), "opens": pa.array(mark), "closes": pa.array(end)}
            return pa.Table.from_pydict({f.name: cols[f.name] for f in schema}, schema=schema).combine_chunks().to_batches()

        def columns(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            """Codes of the keys, signatures, ids and times, a null time as NaN."""
            codes = b.column("ws").dictionary_encode().indices
            return tuple(x.to_numpy(zero_copy_only=False) for x in (codes, b.column("s1"), b.column("s2"), b.column("id"), b.column("at").fill_null(np.nan)))

        for t in batches:
            if not t.num_rows:
                continue
            ids, s1, s2, idn, at = columns(t)
            like = np.r_[last is not None and (t.column("ws")[0].as_py(), s1[0], s2[0]) == last, (ids[1:] == ids[:-1]) & (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])]
            start = _last_of_stretch(np.r_[False, like[1:]])
            heads = np.flatnonzero(start == np.arange(len(start)))
            ends = np.r_[heads[1:], len(start)] - 1
            n = ends - heads + 1
            frag = pa.Table.from_pydict(
                {"ws": t.column("ws").take(pa.array(heads)), "s1": pa.array(s1[heads]), "s2": pa.array(s2[heads]), "first_id": pa.array(idn[heads]), "last_id": pa.array(idn[ends]), "first_at": pa.array(at[heads], from_pandas=True), "last_at": pa.array(at[ends], from_pandas=True), "n": pa.array(n), **{c: t.column(c).take(pa.array(heads)) for c in keep}}
            )
            if held is not None and like[0]:
                joined = held.to_pylist()[0]
                head = frag.slice(0, 1).to_pylist()[0]
                joined |= {"last_id": head["last_id"], "last_at": head["last_at"], "n": joined["n"] + head["n"]}
                frag = pa.concat_tables([pa.Table.from_pylist([joined], schema=frag.schema), frag.slice(1)])
            elif held is not None:
                frag = pa.concat_tables([held, frag])
            held = frag.slice(frag.num_rows - 1)
            if frag.num_rows > 1:
                yield from emit(frag.slice(0, frag.num_rows - 1), False)
            last = (t.column("ws")[-1].as_py(), s1[-1], s2[-1])
        if held is not None:
            yield from emit(held, True)

    return run


def _double(pointers: DataFrame) -> DataFrame:
    """(node, ptr) with every pointer replaced by the pointer of its target until all reach a node without one."""
    while True:
        further = pointers.alias("a").join(pointers.select(F.col("node").alias("t"), F.col("ptr").alias("next")), F.col("a.ptr") == F.col("t"), "left")
        stepped = further.select("node", F.coalesce("next", "ptr").alias("ptr"), F.col("next").isNotNull().alias("moved")).checkpoint()
        pointers = stepped.select("node", "ptr")
        if stepped.where("moved").isEmpty():
            return pointers


def collapse_runs(
    events: DataFrame,
    *,
    key: str = "workspace_key",
    order: tuple[str, str] = ("at", "id"),
    event: str = "event",
    reason: str = "reason",
    min_run: int = 1,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per run of like consecutive events of a key: (key, first_id, last_id, n_events, first_at, last_at, duration, *keep).

    Method: names and reasons become signatures of 128 bits where they are read; of the rows of an id, brought together
    by id, the first is kept; these are spread by range of (key, time, id), so that a hot key covers many blocks. Within a block, every
    event like its predecessor points to it, and pointers are doubled until all reach the start of their stretch.
    Stretches that touch a block's edge are nodes that point to the stretch before them, if that is like them; these
    pointers are doubled by self-joins, logarithmically many in the number of blocks of the longest run. Whole
    stretches pass through without a further shuffle. ``keep`` are columns taken from a run's first event.

    Defined cases: rows whose key is null, blank or only slashes are left out; keys are taken and given without trailing
    slashes; rows that repeat an id count once, by the earliest time (then the smallest key and signature), and rows
    without an id once each, equal (key, time, signature) aside, with null as first_id or last_id; a null or NaN time
    comes first; ties of time are ordered by id, null first; a null event or reason is a blank one; ``duration`` is null if a time is. ``min_run`` leaves out shorter runs.
    Clashing extra columns are ignored. An empty table gives no rows.
    """
    at, ident = order
    ensure_checkpoint_dir(events.sparkSession)
    name, why = event_label(F.col(event)), reason_label(F.col(reason))
    rows = events.select(
        workspace_key(F.col(key)).alias("ws"),
        F.when(~F.isnan(F.col(at).cast("double")), F.col(at).cast("double")).alias("at"),
        F.col(ident).cast("long").alias("id"),
        F.xxhash64(name, F.lit("|"), why).alias("s1"),
        F.xxhash64(F.lit(11), why, name).alias("s2"),
        *(F.col(c).alias(f"keep_{c}") for c in keep),
    ).where("ws is not null")
    # a row without an id is spread by all that counts of it; ids that repeat without end are cut down before the shuffle
    loose = F.when(F.col("id").isNull(), F.xxhash64("ws", "at", "s1", "s2"))
    first_of_id = W.partitionBy("id", "loose").orderBy(F.col("at").asc_nulls_first(), "ws", "s1", "s2")
    rows = rows.withColumn("loose", loose).withColumn("place", F.row_number().over(first_of_id)).where("place = 1").drop("loose", "place")
    none = F.lit(-(1 << 63)).cast("long")
    rows = rows.withColumn("id", F.coalesce("id", none))
    kept = [(f"keep_{c}", rows.schema[f"keep_{c}"].dataType.simpleString()) for c in keep]
    ddl = "ws string, s1 long, s2 long, " + FRAGMENT + "".join(f", `{c}` {t}" for c, t in kept)
    names = ["ws", "s1", "s2", "first_id", "last_id", "first_at", "last_at", "n", "block", "opens", "closes"]
    typed = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_()]
    arrow = pa.schema([*zip(names, typed, strict=True), *((c, to_arrow_type(rows.schema[c].dataType)) for c, _ in kept)])
    order_by = ("ws", F.col("at").asc_nulls_first(), "id")
    spread = rows.repartitionByRange(*order_by).sortWithinPartitions(*order_by, "s1", "s2")
    pieces = spread.mapInArrow(_fragments([c for c, _ in kept], arrow), ddl)
    if min_run > 1:
        pieces = pieces.where((F.col("n") >= min_run) | F.col("opens") | F.col("closes"))
    pieces = pieces.checkpoint()

    edges = pieces.where("opens or closes")
    # at most two rows a block: a bounded table
    before = W.orderBy("block", F.col("opens").desc())
    node = F.struct("block", "opens")
    linked = edges.select("ws", "s1", "s2", "opens", "closes", node.alias("node"), F.lag(F.struct("ws", "s1", "s2", node.alias("node"), "closes")).over(before).alias("p"))
    like = F.col("opens") & F.col("p.closes") & (F.col("p.ws") == F.col("ws")) & (F.col("p.s1") == F.col("s1")) & (F.col("p.s2") == F.col("s2"))
    pointers = _double(linked.where(like).select("node", F.col("p.node").alias("ptr")).checkpoint())
    roots = edges.withColumn("node", node).join(pointers, "node", "left").withColumn("root", F.coalesce("ptr", "node"))
    head = F.col("root") == F.col("node")
    first = lambda c: F.max(F.when(head, F.col(c))).alias(c)  # noqa: E731 - one row of a root is its head
    end = F.max_by(F.struct("last_id", "last_at"), "node.block")
    joined = roots.groupBy("root").agg(first("ws"), first("first_id"), end.alias("end"), first("first_at"), F.sum("n").alias("n"), *(first(c) for c, _ in kept))
    tail = [c for c, _ in kept]
    whole = pieces.where("not opens and not closes").select("ws", "first_id", "last_id", "first_at", "last_at", "n", *tail)
    result = whole.unionByName(joined.select("ws", "first_id", "end.last_id", "first_at", "end.last_at", "n", *tail))
    if min_run > 1:
        result = result.where(F.col("n") >= min_run)
    return result.select(F.col("ws").alias(key), *(F.nullif(c, none).alias(c) for c in ("first_id", "last_id")), F.col("n").alias("n_events"), "first_at", "last_at", (F.col("last_at") - F.col("first_at")).alias("duration"), *(F.col(f"keep_{c}").alias(c) for c in keep))
