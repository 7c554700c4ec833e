"""Ordered scans per key (running sums, row numbers, predecessors, last known values) that split hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    *,
    row_number: str | None = None,
    running_sum: dict[str, str] | None = None,
    previous: dict[str, str] | None = None,
    last_known: dict[str, str] | None = None,
) -> DataFrame:
    """``df`` with columns computed in ascending ``order`` within ``keys``.

    ``running_sum`` (inclusive, nulls count 0), ``previous`` (the row before) and ``last_known`` (last value up to the
    row that is not null) map new columns to columns of ``df``. ``chunk`` must not decrease along the order: windows run
    per key and chunk, so that a hot key is spread over many tasks, and one summary row per key and chunk carries
    what comes in from the chunks before. Keys may be null and make up a key; orders must have no ties that matter.
    """
    running_sum, previous, last_known = running_sum or {}, previous or {}, last_known or {}
    src = df.withColumn("_chunk", chunk)
    here = W.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = here.rowsBetween(W.unboundedPreceding, W.currentRow)
    at = F.struct(*order)

    inner = src.withColumn("_rn", F.row_number().over(here).cast("long"))
    for name, c in running_sum.items():
        inner = inner.withColumn(f"_s_{name}", F.sum(F.coalesce(c, F.lit(0))).over(upto))
    for name, c in previous.items():
        inner = inner.withColumn(f"_p_{name}", F.lag(c).over(here))
    for name, c in last_known.items():
        inner = inner.withColumn(f"_l_{name}", F.last(c, ignorenulls=True).over(upto))

    summary = [F.count(F.lit(1)).alias("_n")]
    summary += [F.sum(F.coalesce(c, F.lit(0))).alias(f"_s_{name}") for name, c in running_sum.items()]
    summary += [F.max_by(F.struct(F.col(c).alias("v")), at).alias(f"_p_{name}") for name, c in previous.items()]
    summary += [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), at)).alias(f"_l_{name}") for name, c in last_known.items()]
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c_rn")]
    carry += [F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_cs_{n}") for n in running_sum]
    carry += [F.last(f"_p_{n}").over(before).alias(f"_cp_{n}") for n in previous]
    carry += [F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_cl_{n}") for n in last_known]
    join_keys = [*keys, "_chunk"]
    carried = src.groupBy(*join_keys).agg(*summary).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(join_keys)), *carry)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(join_keys)]
    both = inner.join(carried, on, "inner")

    out = [F.col(c) for c in df.columns]
    if row_number:
        out.append((F.col("_rn") + F.col("_c_rn")).alias(row_number))
    out += [(F.col(f"_s_{n}") + F.col(f"_cs_{n}")).alias(n) for n in running_sum]
    out += [F.when(F.col("_rn") == 1, F.col(f"_cp_{n}.v")).otherwise(F.col(f"_p_{n}")).alias(n) for n in previous]
    out += [F.coalesce(f"_l_{n}", f"_cl_{n}").alias(n) for n in last_known]
    return both.select(*out)
