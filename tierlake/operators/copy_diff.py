"""Differences between two copies of a dataset by a column-by-bucket checksum matrix."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Coarse buckets, whose matrix reaches the driver, and bounds of the number of fine ones, of which the unequal are broadcast as one bit each.
COARSE = 1 << 10
MIN_BUCKETS, MAX_BUCKETS = COARSE, 1 << 26
#: Rows of both copies a fine bucket.
ROWS_PER_BUCKET = 4


@F.arrow_udf(T.StringType())
def _nfc(text: pa.Array) -> pa.Array:
    if text.null_count == len(text):
        return text
    return pa.array([x if x is None else unicodedata.normalize("NFC", x) for x in text.to_pylist()], pa.string())


def canonical_path(c: Column) -> Column:
    """A path in NFC without empty and ``.`` segments; Python gets a null in place of an ASCII path."""
    composed = F.coalesce(_nfc(F.when(F.length(c) != F.octet_length(c), c)), c)
    parts = F.filter(F.split(composed, "/"), lambda s: ~s.isin("", "."))
    return F.when(composed.rlike(r"(^|/)\.?(/|$)"), F.array_join(parts, "/")).otherwise(composed)


def bucket_count(rows: int) -> int:
    """A power of two giving about ROWS_PER_BUCKET rows a bucket, within the bounds."""
    return min(MAX_BUCKETS, max(MIN_BUCKETS, 1 << max(0, (rows // ROWS_PER_BUCKET).bit_length())))


def _signed_sums(name: str, h: Column) -> list[Column]:
    """Sum of a 64-bit hash over one copy less that over the other, as two halves that cannot overflow."""
    sign = F.when(F.col("side") == 0, F.lit(1).cast("long")).otherwise(F.lit(-1).cast("long"))
    return [F.sum(sign * F.shiftright(h, 32)).alias(f"{name}_hi"), F.sum(sign * h.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{name}_lo")]


def _unequal(name: str) -> Column:
    return (F.col(f"{name}_hi") != 0) | (F.col(f"{name}_lo") != 0)


def checksum_matrix(sides: DataFrame, columns: list[str]) -> DataFrame:
    """(bucket, n, keys, <column>...): for each coarse bucket its rows, and whether the checksums of the keys and of each column differ.

    ``sides`` has (side, kh, <column>...) with a 64-bit key hash. Hashes are added within each task first, so a task
    sends at most COARSE rows of fixed width, whatever it reads.
    """
    sums = [F.count(F.lit(1)).alias("n"), *_signed_sums("keys", F.xxhash64(F.lit(5), "kh"))]
    for c in columns:
        sums += _signed_sums(c, F.xxhash64("kh", F.col(c).isNull(), c))
    coarse = F.shiftrightunsigned("kh", 64 - (COARSE.bit_length() - 1)).cast("int")
    return sides.groupBy(coarse.alias("bucket")).agg(*sums).select("bucket", "n", *(_unequal(n).alias(n) for n in ("keys", *columns)))


def _fine_words(sides: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """(word, bits): the fine buckets whose checksums of whole rows differ, 64 a word."""
    row = F.xxhash64("kh", F.lit(9), *(x for c in columns for x in (F.col(c).isNull(), F.col(c))))
    fine = F.shiftrightunsigned("kh", 64 - bits).cast("int")
    differ = sides.groupBy(fine.alias("bucket")).agg(*_signed_sums("row", row)).where(_unequal("row"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bucket").bitwiseAND(F.lit(63)))
    return differ.groupBy(F.shiftright("bucket", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def copy_differences(
    primary: DataFrame,
    mirror: DataFrame,
    *,
    keys: tuple[str, str] = ("source_path", "relative_path"),
    columns: tuple[str, ...] = ("size_bytes", "mtime_ns"),
) -> DataFrame:
    """Rows only one copy has and fields that differ: (source_path, relative_path, difference).

    ``difference`` is ``missing_in_mirror``, ``missing_in_primary`` or the name of the differing column; one row each.

    Method: a first pass adds up the checksum matrix of COARSE key buckets and every column within each task, so equal
    copies shuffle next to nothing and end there (all columns equal: no rows). Within the unequal coarse buckets a
    second pass adds one hash a row to fine buckets of about ROWS_PER_BUCKET rows of both copies; the unequal ones
    become a bitmap of at most MAX_BUCKETS bits (8 MB, a bound by construction, so it is broadcast), and only their
    rows, and of these only columns that the matrix found unequal, are read again and compared by key. Sums are over
    all rows, so an uneven number of repeats marks a bucket too; the comparison by key then finds its rows equal.
    Building the plan runs the first pass.

    Defined cases: relative paths are compared and given in NFC without empty and ``.`` segments; null keys equal each
    other; null differs from every value but null; repeats are no difference; a key that a copy holds with several
    values differs in a column if one of the values is only in one copy; other columns, and extra columns of any name,
    are ignored. Two empty copies give no rows.
    """
    source, relative = keys
    values = [f"c{i}" for i in range(len(columns))]

    def side(df: DataFrame, tag: int) -> DataFrame:
        return df.select(F.lit(tag).alias("side"), F.col(source).alias("k0"), canonical_path(F.col(relative)).alias("k1"), *(F.col(c).cast("long").alias(v) for c, v in zip(columns, values, strict=True)))

    both = side(primary, 0).unionByName(side(mirror, 1))
    hashed = both.withColumn("kh", F.xxhash64(F.col("k0").isNull(), "k0", F.col("k1").isNull(), "k1"))
    matrix = [r for r in checksum_matrix(hashed.select("side", "kh", *values), values).collect() if any(r[n] for n in ("keys", *values))]  # at most COARSE rows
    index = F.shiftrightunsigned("kh", 64 - (COARSE.bit_length() - 1)).cast("int")

    def marked(column: str | None) -> Column:
        """Whether the coarse bucket of a row is unequal at all, or in a column (a key that is missing shows in all)."""
        words = [0] * (COARSE // 64)
        for r in matrix:
            if column is None or r["keys"] or r[column]:
                words[r["bucket"] >> 6] |= 1 << (r["bucket"] & 63)
        if all(w == (1 << 64) - 1 for w in words):
            return F.lit(True)
        signed = F.array(*(F.lit(w - (1 << 64) if w >> 63 else w).cast("long") for w in words))
        return F.getbit(F.element_at(signed, F.shiftright(index, 6) + 1), index.bitwiseAND(F.lit(63))) == 1

    suspects = hashed.where(marked(None)) if matrix else hashed.limit(0)
    bits = bucket_count(sum(r["n"] for r in matrix) * COARSE // max(1, len(matrix))).bit_length() - 1
    words = _fine_words(suspects.select("side", "kh", *values), values, bits)
    fine = F.shiftrightunsigned("kh", 64 - bits).cast("int")
    # at most MAX_BUCKETS / 64 rows
    read = suspects.join(F.broadcast(words), F.shiftright(fine, 6) == F.col("word")).where(F.getbit("bits", fine.bitwiseAND(F.lit(63))) == 1)
    # each value of each column, once a key: equal ones are counted before they are spread, so that no key is hot
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.when(marked(v), F.col(v)).alias("v")) for i, v in enumerate(values)))
    sets = read.select("k0", "k1", (F.col("side") == 0).alias("a"), (F.col("side") == 1).alias("b"), F.inline(each)).groupBy("k0", "k1", "i", "v").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    uneven = [F.max((F.col("i") == i) & (F.col("a") != F.col("b"))).alias(v) for i, v in enumerate(values)]
    compared = sets.groupBy("k0", "k1").agg(F.max("a").alias("has0"), F.max("b").alias("has1"), *uneven)
    found = [F.when(~F.col("has1"), F.lit("missing_in_mirror")), F.when(~F.col("has0"), F.lit("missing_in_primary"))]
    found += [F.when(F.col("has0") & F.col("has1") & F.col(v), F.lit(c)) for c, v in zip(columns, values, strict=True)]
    return compared.select(F.col("k0").alias(source), F.col("k1").alias(relative), F.explode(F.array_compact(F.array(*found))).alias("difference"))
