"""References to records that are missing, deleted or registered later, from signed counts of change deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlake.functions.keys import month

DELTA = "target string, key string, ref_table string, period string, refs long, rows long, removals long, at timestamp"


def _zero(name: str) -> Column:
    return F.lit(0).cast("long").alias(name)


def reference_deltas(df: DataFrame, ref_table: str, target: str, key: Column, at: Column | None, period_at: Column) -> DataFrame:
    """+1 reference to ``key`` of ``target`` a row; ``at`` is the reference's own time, None if it has none."""
    when = at if at is not None else F.lit(None).cast("timestamp")
    return df.select(F.lit(target).alias("target"), key.alias("key"), F.lit(ref_table).alias("ref_table"), month(period_at).alias("period"), F.lit(1).cast("long").alias("refs"), _zero("rows"), _zero("removals"), when.alias("at")).where("key is not null")


def existence_deltas(df: DataFrame, target: str, key: Column, created: Column) -> DataFrame:
    """+1 existence of ``key`` a row, with the time it was created."""
    none = F.lit(None).cast("string")
    return df.select(F.lit(target).alias("target"), key.alias("key"), none.alias("ref_table"), none.alias("period"), _zero("refs"), F.lit(1).cast("long").alias("rows"), _zero("removals"), created.alias("at")).where("key is not null")


def removal_deltas(df: DataFrame, target: Column, key: Column) -> DataFrame:
    """+1 confirmed removal of ``key`` a row."""
    none = F.lit(None).cast("string")
    return df.select(target.alias("target"), key.alias("key"), none.alias("ref_table"), none.alias("period"), _zero("refs"), _zero("rows"), F.lit(1).cast("long").alias("removals"), F.lit(None).cast("timestamp").alias("at")).where("key is not null and target is not null")


STATE = ("target", "key", "ref_table", "period", "at")


def key_counts(deltas: DataFrame) -> DataFrame:
    """Signed counts per (target, key, ref_table, period, at), zeros left out, in the form of deltas: a state that adds up with further deltas in any order."""
    counts = deltas.groupBy(*STATE).agg(*(F.sum(c).alias(c) for c in ("refs", "rows", "removals")))
    return counts.where("refs <> 0 or rows <> 0 or removals <> 0").select(deltas.columns)


def advance_counts(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """A kept state of counts with a batch of changes added.

    A withdrawal (-1) names the time of what it takes back, as every time has its own count; so the earliest reference
    and the latest record are those that are left.
    """
    return key_counts(counts.unionByName(deltas.select(counts.columns)))


def _by_period(counts: DataFrame) -> DataFrame:
    """Sums per (target, key, ref_table, period), with the earliest reference and the latest record that are left."""
    return counts.groupBy("target", "key", "ref_table", "period").agg(
        *(F.sum(c).alias(c) for c in ("refs", "rows", "removals")), F.min(F.when(F.col("refs") > 0, F.col("at"))).alias("first_at"), F.max(F.when(F.col("rows") > 0, F.col("at"))).alias("last_at")
    )


def orphan_references(deltas: DataFrame, *, signed: bool = True) -> DataFrame:
    """The current orphan report of all ``deltas``; see :func:`orphan_report`. Without withdrawals among them (``signed`` false) no count per time is needed, which saves a shuffle."""
    return orphan_report(key_counts(deltas) if signed else deltas)


def orphan_report(counts: DataFrame) -> DataFrame:
    """(ref_table, ref_key, kind, period, n_refs): references whose key does not exist or was created after them.

    ``counts`` is a state of :func:`key_counts`, or deltas none of which withdraws another.

    Method: deltas are added up per (target, key, ref_table, period), which collapses a hot key before it meets its
    target; a key's few count rows are then brought together, and a key with positive references and zero existence
    is ``deleted`` (with a confirmed removal) or ``missing``; an existing key created after the earliest reference of a
    table and period is ``late``.

    Defined cases: null and blank keys are no reference; repeats change counts but no case; a key with several rows is
    late if any was created after the reference; references or rows without a time are never late; counts that add up
    to zero or less are no reference, record or removal. Empty tables give no rows.
    """
    state = _by_period(counts).groupBy("target", "key").agg(
        F.sum("rows").alias("rows"),
        F.sum("removals").alias("removals"),
        F.max(F.when(F.col("rows") > 0, F.col("last_at"))).alias("created"),
        # one entry per referring table and month
        F.collect_list(F.when(F.col("refs") > 0, F.struct("ref_table", "period", "refs", "first_at"))).alias("seen"),
    )
    each = state.where(F.size("seen") > 0).select("key", "rows", "removals", "created", F.inline("seen"))
    kind = F.when(F.col("rows") > 0, F.when(F.col("created") > F.col("first_at"), F.lit("late"))).when(F.col("removals") > 0, F.lit("deleted")).otherwise(F.lit("missing"))
    return each.select("ref_table", F.col("key").alias("ref_key"), kind.alias("kind"), "period", F.col("refs").alias("n_refs")).where("kind is not null")
