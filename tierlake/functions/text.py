"""Column expressions for lines, sections, mentions and search terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSET_ID = r"(?:logical-v3|v2)-[a-z]+-[a-z]+-[0-9a-z]{6}"
WORKSPACE_PATH = r"/pool/ws/[a-z]+-[a-z]+-[0-9a-z]{6}"


#: A public key for tokens in tests and queries.
TEST_KEY = b"public test key"


def keyed_token(c: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a text (RFC 2104) in hex, computed in the JVM; the padded key is part of the plan."""
    import hashlib

    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(c, "utf-8")), 256))), 256)


def lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, pos, line): one row per line, numbered from 0, without carriage returns."""
    return df.select(*keep, F.posexplode(F.split(F.regexp_replace(text, "\r", ""), "\n")).alias("pos", "line"))


def mentions(text: Column, pattern: str) -> Column:
    """Distinct matches of ``pattern`` in a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))


def occurrences(text: Column, term: str) -> Column:
    """How often ``term`` (in lower case) occurs in ``text`` without regard to case and without overlap."""
    low = F.lower(text)
    return F.floor((F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / len(term)).cast("long")


def slug(text: Column, width: int = 28) -> Column:
    """Lower-case ASCII words joined by ``-``, cut to ``width``."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit(width))


def search_terms(text: Column, most: int = 48) -> Column:
    """Distinct search units of a query: ASCII words of three and more characters, and trigrams of CJK runs."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{3,})"), F.lit(1))
    runs = F.regexp_extract_all(text, F.lit("([぀-ヿ一-鿿]{3,})"), F.lit(1))
    grams = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 2), lambda i: F.substring(r, i, F.lit(3)))))
    return F.slice(F.array_distinct(F.concat(words, grams)), 1, most)
