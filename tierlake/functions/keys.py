"""Column expressions that bring keys and labels into one notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that may surround a key (fixed value).
BLANKS = " \t\n\r\x0b\x0c 　"


def stripped(c: Column) -> Column:
    """``c`` without white space around it; null if nothing is left."""
    return F.nullif(F.btrim(c, F.lit(BLANKS)), F.lit(""))


def workspace_key(c: Column) -> Column:
    """``c`` without trailing slashes; null if nothing is left."""
    return F.nullif(F.rtrim(c, F.lit("/")), F.lit(""))


def digest_key(c: Column) -> Column:
    """A digest in lower case, without white space around it and without its ``sha256:`` label; null if nothing is left."""
    plain = F.lower(F.btrim(c, F.lit(BLANKS)))
    return F.nullif(F.ltrim(F.when(plain.startswith("sha256:"), F.substring(plain, 8, 1 << 20)).otherwise(plain)), F.lit(""))


def label(c: Column) -> Column:
    """An event name in upper case without white space around it."""
    return F.upper(F.btrim(c, F.lit(BLANKS)))


def iso_instant(c: Column) -> Column:
    """ISO text with an offset as an instant; null if it cannot be read."""
    return c.try_cast("timestamp")


def epoch_instant(c: Column) -> Column:
    """Epoch seconds (double) as an instant; null for null and NaN."""
    return F.when(~F.isnan(c), F.timestamp_seconds(c))


def nanos_instant(c: Column) -> Column:
    """Epoch nanoseconds (long) as an instant, cut to microseconds towards the past."""
    thousand = F.lit(1000).cast("long")
    return F.timestamp_micros(F.call_function("div", c - F.pmod(c, thousand), thousand))


def month(c: Column) -> Column:
    """The UTC month ``yyyy-MM`` of an instant, ``unknown`` for null."""
    return F.coalesce(F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM"), F.lit("unknown"))
