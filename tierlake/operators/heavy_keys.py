"""Per-key results where a few keys hold most rows, by value-frequency compression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_frequencies(df: DataFrame, key: Column, value: Column, measure: Column | None = None) -> DataFrame:
    """(key, value, n, total): rows of a key compressed to its distinct values with their frequencies.

    The shuffle is by (key, value), so a hot key spreads over all tasks and a hot value is collapsed before it.
    """
    m = measure if measure is not None else F.lit(None).cast("long")
    return df.select(key.alias("key"), value.alias("value"), m.alias("m")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("total"))


def key_totals(df: DataFrame, key: Column, value: Column, measure: Column | None = None) -> DataFrame:
    """(key, n_rows, n_distinct, mode_rows, total) of every key, exact and without imbalance.

    Method: group by key and value, then by key; the second shuffle carries one row per key and task. ``n_distinct``
    counts values that are not null, ``mode_rows`` is the frequency of the most frequent value that is not null (0 if
    none), ``total`` the sum of ``measure`` (null without one or if all are null). A null key is a key of its own;
    repeated rows count; an empty table gives no rows.
    """
    real = F.col("value").isNotNull()
    return value_frequencies(df, key, value, measure).groupBy("key").agg(
        F.sum("n").alias("n_rows"), F.count("value").alias("n_distinct"), F.max(F.when(real, F.col("n")).otherwise(F.lit(0).cast("long"))).alias("mode_rows"), F.sum("total").alias("total")
    )


def hot_keys(totals: DataFrame, share: float) -> DataFrame:
    """Keys with at least ``share`` of all rows, from the result of :func:`key_totals`."""
    everything = totals.agg(F.sum("n_rows").alias("__all"))
    return totals.join(F.broadcast(everything), F.col("n_rows") >= F.col("__all") * share).drop("__all")  # one row
