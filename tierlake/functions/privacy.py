"""Findings that a text should not carry outside: families of patterns from public standards, an allow-list and a deny-list, line by line."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierlake.sources.formats import Refused

_L, _R = "(?:^|[^0-9A-Za-z_.-])", "(?:$|[^0-9A-Za-z_-])"  # what may stand before and after a word
_OCTET = "[0-9]{1,3}"


class Family(NamedTuple):
    """A pattern whose first group is the finding, texts one of which a line must hold, and what is allowed (a pattern)."""

    pattern: str
    guards: tuple[str, ...]
    allowed: str = ""


#: Families of findings; bounded repetitions, so that no line costs more than its length (fixed values).
FAMILIES = {
    # RFC 5321 lengths; the names of RFC 2606 are allowed
    "email": Family(_L + r"([A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,4}\.[A-Za-z]{2,24})" + _R, ("@",), r"@(?:[a-z0-9-]+\.)*example\.(?:com|org|net|invalid)$"),
    "remote_login": Family(r"(?:^|[\s\"'(=])([a-z][a-z0-9_-]{0,31}@[a-z0-9][a-z0-9-]{0,62})(?:$|[\s:\"'),;])", ("@",), "^(?:root|user|runner)@localhost$"),
    "home_path": Family(r"(/(?:home|Users)/[A-Za-z0-9_-][A-Za-z0-9._-]{0,31})", ("/home/", "/Users/"), "/(?:user|runner|shared|Shared)$"),
    # RFC 1918 and RFC 6598
    "private_ip": Family(_L + f"((?:10\\.{_OCTET}|192\\.168|172\\.(?:1[6-9]|2[0-9]|3[01])|100\\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7]))\\.{_OCTET}\\.{_OCTET})(?:$|[^0-9A-Za-z_.])", (".",)),
    # any other address but those of RFC 5737, loopback and unspecified
    "address": Family(_L + f"({_OCTET}\\.{_OCTET}\\.{_OCTET}\\.{_OCTET})(?:$|[^0-9A-Za-z_.])", (".",), r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.|127\.|0\.0\.0\.0$)"),
    "mac_address": Family(_L + "([0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5})(?:$|[^0-9A-Za-z_:-])", (":",), "^(?:00:){5}00$"),
    # ISO 8601 calendar dates
    "date": Family(_L + "((?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]))(?:$|[^0-9A-Za-z_-]|T[0-9])", ("-",)),
    "hash": Family(_L + "([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})" + _R, ()),
    # RFC 9562
    "uuid": Family(_L + "([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})" + _R, ("-",), "^[0-]+$"),
    # E.164 with its plus sign
    "phone": Family(r"(?:^|[^0-9A-Za-z+])(\+[1-9][0-9]{7,14})(?:$|[^0-9A-Za-z])", ("+",)),
    # RFC 7468
    "private_key": Family("(-----BEGIN (?:[A-Z]{1,12} ){0,2}PRIVATE KEY-----)", ("-----BEGIN",)),
    # RFC 7519
    "web_token": Family(r"(eyJ[A-Za-z0-9_-]{10,1000}\.eyJ[A-Za-z0-9_-]{10,1000})", ("eyJ",)),
    "process": Family("(?:^|[^0-9A-Za-z_])(pid=[0-9]{1,10})(?:$|[^0-9A-Za-z_])", ("pid=",)),
}


def _none_of(allowed: str) -> Callable[[Column], Column]:
    return lambda x: ~x.rlike(allowed)


def findings(line: Column, deny: tuple[str, ...] = (), *, release: bool = False) -> Column:
    """Array of (family, n) of a line, those with findings only; ``denied`` counts words of ``deny`` that it holds, without regard to case.

    A family's pattern is only tried on lines that hold one of its guards. A release scan is refused without a deny-list:
    a missing list must not pass. A null line has no findings.
    """
    if release and not deny:
        raise Refused("a release scan needs a deny-list")
    counts = []
    for name, f in FAMILIES.items():
        found = F.regexp_extract_all(line, F.lit(f.pattern), F.lit(1))
        n = F.size(F.filter(found, _none_of(f.allowed)) if f.allowed else found)
        if f.guards:
            guard = F.contains(line, F.lit(f.guards[0]))
            for g in f.guards[1:]:
                guard = guard | F.contains(line, F.lit(g))
            n = F.when(guard, n).otherwise(0)
        counts.append(F.struct(F.lit(name).alias("family"), n.cast("long").alias("n")))
    low = F.lower(line)
    words = [F.contains(low, F.lit(w.lower())).cast("long") for w in deny]
    if words:
        counts.append(F.struct(F.lit("denied").alias("family"), sum(words[1:], words[0]).alias("n")))
    return F.filter(F.array(*counts), lambda x: x["n"] > 0)


def findings_sql(lines: str, keys: str, deny: tuple[str, ...] = ()) -> str:
    """The SQL of (keys, family, n) of a table of lines."""
    quoted = lambda x: x.replace("'", "''")
    parts = []
    for name, f in FAMILIES.items():
        found = f"regexp_extract_all(line, '{quoted(f.pattern)}', 1)"
        if f.allowed:
            found = f"list_filter({found}, lambda x: not regexp_matches(x, '{quoted(f.allowed)}'))"
        parts.append(f"select {keys}, '{name}' as family, cast(len({found}) as bigint) as n from l")
    if deny:
        parts.append(f"select {keys}, 'denied', {' + '.join(f'''contains(lower(line), '{quoted(w.lower())}')::bigint''' for w in deny)} from l")
    return f"with l as materialized (select * from {lines} where line <> '') select * from ({' union all '.join(parts)}) where n > 0"
