"""Queries of the general data-pipeline problems (p1, p2, p3, p5) with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.functions.keys import digest_key, epoch_instant, iso_instant, nanos_instant, stripped
from tierlake.operators.copy_diff import copy_differences
from tierlake.operators.entity_features import entity_features, feature_names
from tierlake.operators.heavy_keys import hot_keys, key_totals
from tierlake.operators.orphans import existence_deltas, orphan_references, reference_deltas, removal_deltas
from tierlake.sources.tables import table

#: Event families with the same fifteen endings, and the events of the family `page` (fixed values).
FAMILIES = "batch blob capacity capsule catalog handle index lease ledger manifest mount probe quota restore route semantic snapshot stage upload version".split()
ENDINGS = "QUEUED STARTED RETRIED PASSED FAILED DEFERRED SKIPPED EXPIRED RESUMED VERIFIED REFUSED MERGED TRIMMED SEALED REPLAYED".split()
PAGE_EVENTS = """SYNC TOUCH LEASE_RELEASED PIN UNPIN CLASSIFY DIRTY SEMANTIC_STALE SEMANTIC_ANNOTATED SEMANTIC_SYNC_FAILED SEMANTIC_SYNC_RECOVERED
RESTORE_PASS MATERIALIZED TREE_LIVENESS_PROBE TEMPERATURE_RECONCILE EVICT_BLOCKED EVICT_UNBLOCKED ARCHIVE_BLOCKED ARCHIVE_UNBLOCKED EVICTED
ASSET_RELOCATED ASSET_RELOCATE_COALESCED SYNC_WINDOW_OPENED SYNC_WINDOW_CLOSED""".split()
HOT_SHARE = 0.02


def p1_features(spark: SparkSession, d: str) -> DataFrame:
    return entity_features(table(spark, d, "pager_events"), table(spark, d, "event_types"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return copy_differences(table(spark, d, "asset_files"), table(spark, d, "asset_files_mirror"))


def _totals(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "asset_files": key_totals(table(spark, d, "asset_files"), F.col("source_path"), stripped(F.col("asset_id")), F.col("size_bytes")),
        "object_sources": key_totals(table(spark, d, "object_sources"), F.col("source_path"), digest_key(F.col("digest"))),
    }


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    parts = [t.select(F.lit(n).alias("table_name"), F.col("key").alias("source_path"), "n_rows", "n_distinct", "mode_rows", F.col("total").alias("sum_size_bytes")) for n, t in _totals(spark, d).items()]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [hot_keys(t, HOT_SHARE).select(F.lit(n).alias("table_name"), F.col("key").alias("source_path")) for n, t in _totals(spark, d).items()]
    return parts[0].unionByName(parts[1])


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    verified, updated = iso_instant(F.col("last_verified_at")), epoch_instant(F.col("updated_at"))
    receipts = table(spark, d, "gc_receipts").where("state = 'RECYCLE_CONFIRMED'")
    removed = F.when(F.col("subject_kind") == "object", digest_key(F.col("subject_id"))).otherwise(stripped(F.col("subject_id")))
    parts = [
        reference_deltas(table(spark, d, "object_sources"), "object_sources", "object", digest_key(F.col("digest")), verified, verified),
        reference_deltas(table(spark, d, "pages"), "pages", "asset", stripped(F.col("cloud_asset_id")), updated, updated),
        reference_deltas(table(spark, d, "asset_files"), "asset_files", "asset", stripped(F.col("asset_id")), None, nanos_instant(F.col("mtime_ns"))),
        existence_deltas(table(spark, d, "objects"), "object", digest_key(F.col("digest")), iso_instant(F.col("created_at"))),
        existence_deltas(table(spark, d, "assets"), "asset", stripped(F.col("asset_id")), epoch_instant(F.col("indexed_at_epoch"))),
        removal_deltas(receipts, F.when(F.col("subject_kind").isin("object", "asset"), F.col("subject_kind")), removed),
    ]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(_deltas(spark, d), signed=False).select("ref_table", "ref_key", "kind", "period")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, kind and month."""
    return orphan_references(_deltas(spark, d), signed=False).groupBy("ref_table", "kind", "period").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n_refs").alias("n_refs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_features, p2_found, p3_found, p3_totals, p5_found, p5_report)}


_DIGEST = "nullif(trim(regexp_replace(lower(trim({0}, {1})), '^sha256:', '')), '')"
_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(32) || chr(160) || chr(12288)"


def _digest(c: str) -> str:
    return _DIGEST.format(c, _BLANKS)


def _stripped(c: str) -> str:
    return f"nullif(trim({c}, {_BLANKS}), '')"


def _p1_sql() -> str:
    types = sorted([f"{f.upper()}_{e}" for f in FAMILIES for e in ENDINGS] + PAGE_EVENTS)
    each = ",\n".join(f"count(*) filter (where ev = '{t}') as {n}, max(\"at\") filter (where ev = '{t}') as {last}" for t, (n, last) in zip(types, feature_names(types), strict=True))
    return f"""
with once as (
  select id, min(rtrim(workspace_key, '/')) as workspace_key, min("at") as "at", min(upper(trim(event, {_BLANKS}))) as ev
  from pager_events where nullif(rtrim(workspace_key, '/'), '') is not null group by id)
select workspace_key, count(*) as n_total, count(distinct case when ev in (select event from event_types) then ev end) as n_types,
  count(*) filter (where ev is null or ev not in (select event from event_types)) as n_unlisted, min("at") as first_at, max("at") as last_at,
{each}
from once group by workspace_key"""


_P2_SQL = """
with side as (
  select 0 as s, source_path, relative_path, size_bytes, mtime_ns from asset_files
  union all select 1, source_path, relative_path, size_bytes, mtime_ns from asset_files_mirror),
canon as (
  select distinct s, source_path, array_to_string(list_filter(string_split(nfc_normalize(relative_path), '/'), lambda x: x not in ('', '.')), '/') as relative_path, size_bytes, mtime_ns from side),
a as (select * from canon where s = 0), b as (select * from canon where s = 1),
j as (
  select coalesce(a.source_path, b.source_path) as source_path, coalesce(a.relative_path, b.relative_path) as relative_path, a.s as a_s, b.s as b_s,
    a.size_bytes is distinct from b.size_bytes as d_size, a.mtime_ns is distinct from b.mtime_ns as d_mtime
  from a full join b on a.source_path = b.source_path and a.relative_path = b.relative_path)
select source_path, relative_path, 'missing_in_mirror' as difference from j where b_s is null
union all select source_path, relative_path, 'missing_in_primary' from j where a_s is null
union all select source_path, relative_path, 'size_bytes' from j where a_s is not null and b_s is not null and d_size
union all select source_path, relative_path, 'mtime_ns' from j where a_s is not null and b_s is not null and d_mtime"""

_P3_SQL = f"""
with v as (
  select 'asset_files' as table_name, source_path, {_stripped("asset_id")} as value, size_bytes from asset_files
  union all select 'object_sources', source_path, {_digest("digest")}, null from object_sources),
f as (select table_name, source_path, value, count(*) as n from v group by all)
select t.table_name, t.source_path, t.n_rows, t.n_distinct, m.mode_rows, t.sum_size_bytes
from (select table_name, source_path, count(*) as n_rows, count(distinct value) as n_distinct, cast(sum(size_bytes) as bigint) as sum_size_bytes from v group by all) t
join (select table_name, source_path, cast(max(case when value is null then 0 else n end) as bigint) as mode_rows from f group by all) m
  on t.table_name = m.table_name and t.source_path is not distinct from m.source_path"""

_P3_FOUND_SQL = f"""
select table_name, source_path from (
  select 'asset_files' as table_name, source_path, count(*) as n, sum(count(*)) over () as total from asset_files group by source_path
  union all select 'object_sources', source_path, count(*), sum(count(*)) over () from object_sources group by source_path)
where n >= {HOT_SHARE} * total"""

_P5 = f"""
with refs as (
  select 'object_sources' as ref_table, 'object' as target, {_digest("digest")} as ref_key, cast(last_verified_at as timestamptz) as own, cast(last_verified_at as timestamptz) as seen from object_sources
  union all select 'pages', 'asset', {_stripped("cloud_asset_id")}, to_timestamp(updated_at), to_timestamp(updated_at) from pages
  union all select 'asset_files', 'asset', {_stripped("asset_id")}, null, make_timestamptz(mtime_ns // 1000) from asset_files),
there as (
  select 'object' as target, {_digest("digest")} as ref_key, max(cast(created_at as timestamptz)) as created from objects group by all
  union all select 'asset', {_stripped("asset_id")}, max(to_timestamp(indexed_at_epoch)) from assets group by all),
gone as (
  select distinct subject_kind as target, case subject_kind when 'object' then {_digest("subject_id")} else {_stripped("subject_id")} end as ref_key
  from gc_receipts where state = 'RECYCLE_CONFIRMED'),
cases as (
  select r.ref_table, r.ref_key, coalesce(strftime(r.seen at time zone 'UTC', '%Y-%m'), 'unknown') as period,
    case when t.ref_key is null and g.ref_key is not null then 'deleted' when t.ref_key is null then 'missing' when t.created > r.own then 'late' end as kind
  from refs r left join there t on r.target = t.target and r.ref_key = t.ref_key left join gone g on r.target = g.target and r.ref_key = g.ref_key
  where r.ref_key is not null)
"""

_P5_FOUND_SQL = _P5 + "select distinct ref_table, ref_key, kind, period from cases where kind is not null"

_P5_REPORT_SQL = (
    _P5
    + """, per as (select ref_table, ref_key, period, max(kind) as kind, count(*) as n from cases group by all)
select ref_table, kind, period, count(*) as n_keys, cast(sum(n) as bigint) as n_refs from per where kind is not null group by all"""
)


def oracle_sql() -> dict[str, str]:
    return {"p1_features": _p1_sql(), "p2_found": _P2_SQL, "p3_found": _P3_FOUND_SQL, "p3_totals": _P3_SQL, "p5_found": _P5_FOUND_SQL, "p5_report": _P5_REPORT_SQL}
