"""Per-entity feature table from events: counts and recency of every event type as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierlake.functions.keys import label, workspace_key

#: Types become columns, so their number is bounded; more are refused.
MAX_TYPES = 4000
#: Events folded at a time, and folded rows held before they are folded with each other.
PARTIAL_ROWS, FOLDED_ROWS = 1 << 17, 1 << 18
BLOCK_ENTITIES = 256


def _runs(values: np.ndarray) -> np.ndarray:
    """Positions at which a new value starts."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]])


def _partial(n_types: int):
    """Events sorted by id to one row per (entity, type) of a task, stretch by stretch; an id's later rows are skipped."""
    width = n_types + 1  # the last slot holds types that are not listed

    def fold(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        keys = pc.dictionary_encode(t["entity"]).combine_chunks()
        code = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64) * width + t["type"].to_numpy()
        at = pc.fill_null(t["at"], np.nan).to_numpy()
        uniq, slot = np.unique(code, return_inverse=True)
        n = np.bincount(slot, minlength=len(uniq)).astype(np.int64)
        timed = ~np.isnan(at)
        last, first = np.full(len(uniq), -np.inf), np.full(len(uniq), np.inf)
        np.maximum.at(last, slot[timed], at[timed])
        np.minimum.at(first, slot[timed], at[timed])
        return pa.RecordBatch.from_arrays(
            [keys.dictionary.take(pa.array(uniq // width)), pa.array((uniq % width).astype(np.int32)), pa.array(n), pa.array(first), pa.array(last)],
            names=["entity", "type", "n", "first", "last"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, seen = [], 0, None
        folded: list[pa.RecordBatch] = []
        limit = FOLDED_ROWS
        for b in batches:
            if not b.num_rows:
                continue
            ids = b["id"].to_numpy(zero_copy_only=False)
            new = np.r_[ids[0] != seen, ids[1:] != ids[:-1]]
            seen = ids[-1]
            held.append(b.filter(pa.array(new)))
            rows += b.num_rows
            if rows >= PARTIAL_ROWS:
                folded.append(fold(held))
                held, rows = [], 0
                if sum(x.num_rows for x in folded) >= limit:
                    folded = _fold_open(folded)
                    # twice what is left, so that each row is folded a constant number of times
                    limit = max(FOLDED_ROWS, 2 * sum(x.num_rows for x in folded))
        if held:
            folded.append(fold(held))
        yield from _fold_open(folded) if len(folded) > 1 else folded

    return run


def _blocks(n_types: int, schema: pa.Schema, block: int):
    """Partial rows sorted by entity to dense blocks (entity x type), by bincount and maximum scatter."""
    width = n_types + 1

    def dense(keys: pa.Array, row: np.ndarray, part: pa.Table) -> pa.RecordBatch:
        size = len(keys) * width
        slot = row * width + part["type"].to_numpy()
        # float64 weights are exact up to 2**53 events of one type
        n = np.bincount(slot, weights=part["n"].to_numpy().astype(np.float64), minlength=size).astype(np.int64).reshape(len(keys), width)
        last, first = np.full(size, -np.inf), np.full(size, np.inf)
        np.maximum.at(last, slot, part["last"].to_numpy())
        np.minimum.at(first, slot, part["first"].to_numpy())
        last, first = last.reshape(n.shape), first.reshape(n.shape)
        whole = lambda x: pa.array(x, mask=np.isinf(x))
        total = [pa.array(n.sum(1)), pa.array((n[:, :n_types] > 0).sum(1).astype(np.int64)), pa.array(n[:, n_types]), whole(first.min(1)), whole(last.max(1))]
        each = [a for k in range(n_types) for a in (pa.array(np.ascontiguousarray(n[:, k])), whole(np.ascontiguousarray(last[:, k])))]
        return pa.RecordBatch.from_arrays([keys, *total, *each], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def drain(everything: bool) -> Iterator[pa.RecordBatch]:
            """Emit whole blocks; the last entity may still go on in the next batch."""
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            codes = pc.dictionary_encode(t["entity"]).combine_chunks()
            row = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.r_[_runs(row), len(row)]
            done = len(starts) - 1 if everything else len(starts) - 2
            for k in range(0, done, block):
                to = min(k + block, done)
                a, b = starts[k], starts[to]
                yield dense(codes.dictionary.slice(k, to - k), row[a:b] - k, t.slice(a, b - a))
            if starts[done] < len(row):
                held.extend(t.slice(starts[done]).to_batches())

        rows = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= PARTIAL_ROWS:
                yield from drain(False)
                rows = sum(x.num_rows for x in held)
                # one entity has at most (types + 1) rows of each task: fold what is open
                if rows >= PARTIAL_ROWS:
                    folded = _fold_open(held)
                    held[:] = folded
                    rows = sum(x.num_rows for x in held)
        if held:
            yield from drain(True)

    return run


def _fold_open(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    t = pa.Table.from_batches(held).group_by(["entity", "type"]).aggregate([("n", "sum"), ("first", "min"), ("last", "max")])
    return t.rename_columns(["entity", "type", "n", "first", "last"]).select(held[0].schema.names).cast(held[0].schema).combine_chunks().to_batches()


def feature_names(types: list[str]) -> list[tuple[str, str]]:
    """Names of the count and the recency column of each type."""
    return [(f"n_{t.lower()}", f"last_{t.lower()}") for t in types]


def entity_features(
    events: DataFrame,
    event_types: DataFrame,
    *,
    entity: str = "workspace_key",
    id_col: str = "id",
    at: str = "at",
    event: str = "event",
    type_col: str = "event",
    block: int = BLOCK_ENTITIES,
) -> DataFrame:
    """One row per entity: ``n_total, n_types, n_unlisted, first_at, last_at`` and ``n_<type>, last_<type>`` of every listed type.

    Method: events are spread by id (so that no entity can be hot) and repeats of an id dropped; there each stretch is
    folded to (entity, type) rows by ``bincount`` and maximum scatter, and the stretches of a task with each other, so
    that a task sends an entity's type once (an entity has at most types x tasks rows); these go to hash buckets of
    entities, where dense blocks of ``block`` entities x types are filled in the same way and emitted as Arrow columns.

    Defined cases: an entity that is null, blank or only slashes gets no row; event names count without regard to letter
    case and blanks around them; a null or unlisted event counts in ``n_total`` and ``n_unlisted``; a null or NaN time
    counts but has no recency (a type without timed events has a null ``last_``); an id that comes with different rows
    counts by its smallest (entity, time, type); events without an id count once each, exact repeats of the whole row aside.
    Other columns are ignored otherwise. An empty table gives no rows.
    """
    spark = events.sparkSession
    names = sorted({r[0] for r in event_types.select(label(F.col(type_col))).distinct().limit(MAX_TYPES + 1).collect() if r[0]})
    if len(names) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types")
    # at most MAX_TYPES rows, checked above
    index = F.broadcast(spark.createDataFrame([(t, k) for k, t in enumerate(names)], "__name string, type int"))

    def typed(df: DataFrame) -> DataFrame:
        return (
            df.select(F.col(id_col).cast("long").alias("id"), workspace_key(F.col(entity)).alias("entity"), F.col(at).cast("double").alias("at"), label(F.col(event)).alias("__name"))
            .where("entity is not null")
            .join(index, "__name", "left")
            .select("id", "entity", F.when(~F.isnan("at"), F.col("at")).alias("at"), F.coalesce("type", F.lit(len(names))).alias("type"))
        )

    # maps and variants can't be compared but as text
    whole = [F.col(f"`{c}`").cast("string").alias(c) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in events.dtypes]
    unnamed = typed(events.where(F.col(id_col).isNull()).select(*whole).distinct()).groupBy("entity", "type")
    unnamed = unnamed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("at"), F.lit(float("inf"))).alias("first"), F.coalesce(F.max("at"), F.lit(float("-inf"))).alias("last"))
    rows = typed(events.where(F.col(id_col).isNotNull()))
    partial = rows.repartition("id").sortWithinPartitions("id", "entity", "at", "type").mapInArrow(_partial(len(names)), "entity string, type int, n long, first double, last double").unionByName(unnamed)
    fields = [("n_total", T.LongType()), ("n_types", T.LongType()), ("n_unlisted", T.LongType()), ("first_at", T.DoubleType()), ("last_at", T.DoubleType())]
    fields += [f for n, last in feature_names(names) for f in ((n, T.LongType()), (last, T.DoubleType()))]
    schema = T.StructType([T.StructField(entity, T.StringType()), *(T.StructField(n, t) for n, t in fields)])
    arrow = pa.schema([(entity, pa.string()), *((n, pa.int64() if isinstance(t, T.LongType) else pa.float64()) for n, t in fields)])
    return partial.repartition("entity").sortWithinPartitions("entity").mapInArrow(_blocks(len(names), arrow, block), schema)
