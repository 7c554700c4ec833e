"""Filters, joins, aggregates and set operations over the storage tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.functions.keys import digest_key, iso_instant, stripped
from tierlake.operators import relate
from tierlake.operators.copy_diff import canonical_path
from tierlake.plans.registry import Registry
from tierlake.sources.formats import split_valid
from tierlake.sources.tables import table

R = Registry()
#: The clock of every query: 2026-07-01T00:00:00Z.
NOW = 1782864000.0
DAY = 86400.0
ROOT = "/pool/ws/dusky-loom"
PROOF_STATES = ("CLOUD_CONFIRMED", "FAILED", "REGISTERED", "UPLOADING")
PAGE_STATES = ("HOT", "WARM", "COLD", "PINNED", "ISOLATED", "UNKNOWN")
MIN_COPIES = {"REGENERABLE": 1, "CLOUD_ACCEPTED": 1, "VALUABLE": 2, "IRREPLACEABLE": 3}
WINDOW_ITEMS, WINDOW_BYTES = 8, 64 << 20


def once(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """A table's columns without repeated rows."""
    return table(spark, d, name).select(*columns).distinct()


_DIG = "nullif(trim(regexp_replace(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '^sha256:', '')), '')"


def _dig(c: str) -> str:
    return _DIG.format(c)


# --- scans and sinks -----------------------------------------------------------------------------------------------------


@R.query(
    "q_s2_catalog",
    """select asset_id, host, rtrim(original_path, '/') as path, coalesce(redundancy_class, 'UNCLASSIFIED') as redundancy_class,
      coalesce(cloud_verified, false) and coalesce(restore_verified, false) and coalesce(snapshot_verified, false) as proven,
      host || '|' || rtrim(original_path, '/') in (select rtrim(workspace_key, '/') from pager_events where upper(trim(event)) = 'RESTORE_PASS' and workspace_key is not null) as restore_passed
    from (select distinct asset_id, host, original_path, redundancy_class, cloud_verified, restore_verified, snapshot_verified from assets) where asset_id is not null""",
)
def catalog(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue rows with defaults and whether a restore of the place has passed; rows without an id are skipped."""
    flags = ("cloud_verified", "restore_verified", "snapshot_verified")
    proven = [F.coalesce(c, F.lit(False)) for c in flags]
    rows = once(spark, d, "assets", "asset_id", "host", "original_path", "redundancy_class", *flags).where("asset_id is not null")
    passed = table(spark, d, "pager_events").where("workspace_key is not null").where(F.upper(F.trim("event")) == "RESTORE_PASS").select(F.rtrim("workspace_key", F.lit("/")).alias("place"), F.lit(True).alias("passed")).distinct()
    rows = rows.withColumn("path", F.rtrim("original_path", F.lit("/"))).withColumn("place", F.concat("host", F.lit("|"), "path")).join(passed, "place", "left")
    return rows.select("asset_id", "host", "path", F.coalesce("redundancy_class", F.lit("UNCLASSIFIED")).alias("redundancy_class"), (proven[0] & proven[1] & proven[2]).alias("proven"), F.coalesce("passed", F.lit(False)).alias("restore_passed"))


@R.query(
    "q_s4_incremental",
    """with a as (select source_path, count(*) as n, sum(size_bytes) as s, max(mtime_ns) as t from asset_files group by 1),
      b as (select source_path, count(*) as n, sum(size_bytes) as s, max(mtime_ns) as t from asset_files_mirror group by 1)
    select coalesce(a.source_path, b.source_path) as source_path,
      case when b.source_path is null then 'new' when a.source_path is null then 'vanished' when a.n = b.n and a.s is not distinct from b.s and a.t is not distinct from b.t then 'unchanged' else 'changed' end as status
    from a full join b on a.source_path = b.source_path""",
)
def incremental(spark: SparkSession, d: str) -> DataFrame:
    """Which manifests an incremental ingest must read again, by their fingerprint (rows, bytes, newest time)."""
    stat = lambda n: table(spark, d, n).groupBy("source_path").agg(F.struct(F.count(F.lit(1)), F.sum("size_bytes"), F.max("mtime_ns")).alias("stat"))
    verdict = relate.full_diff(stat("asset_files_mirror"), stat("asset_files"), ["source_path"], "stat")
    names = F.when(F.col("verdict") == "missing", "vanished").when(F.col("verdict") == "unexpected", "new").when(F.col("verdict") == "equal", "unchanged").otherwise("changed")
    return verdict.select("source_path", names.alias("status"))


@R.query("q_s7_exact_one", "select cloud_relpath, count(*) as n from (select distinct cloud_relpath, digest from objects) group by 1 having count(*) <> 1")
def exact_one(spark: SparkSession, d: str) -> DataFrame:
    """Point lookups that don't find exactly one row."""
    return once(spark, d, "objects", "cloud_relpath", "digest").groupBy("cloud_relpath").agg(F.count(F.lit(1)).alias("n")).where("n <> 1")


@R.query(
    "q_s13_disk_sample",
    """select host, storage_pool, count(*) as n, count(size_bytes) as n_sized, coalesce(cast(sum(size_bytes) as bigint), 0) as used_bytes, coalesce(bool_and(coalesce(size_bytes, 0) >= 0), true) as ok
    from (select distinct workspace_key, host, storage_pool, size_bytes from pages) group by 1, 2""",
)
def disk_sample(spark: SparkSession, d: str) -> DataFrame:
    return (
        once(spark, d, "pages", "workspace_key", "host", "storage_pool", "size_bytes")
        .groupBy("host", "storage_pool")
        .agg(F.count(F.lit(1)).alias("n"), F.count("size_bytes").alias("n_sized"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("used_bytes"), F.coalesce(F.bool_and(F.coalesce("size_bytes", F.lit(0)) >= 0), F.lit(True)).alias("ok"))
    )


@R.query(
    "q_s15_heartbeats",
    f"""select rtrim(workspace_key, '/') as workspace_key, max("at") as last_at, max("at") >= {NOW} - 30 * {DAY} as alive from pager_events
    where workspace_key is not null and upper(trim(event)) = 'TOUCH' group by 1""",
)
def heartbeats(spark: SparkSession, d: str) -> DataFrame:
    beats = table(spark, d, "pager_events").where("workspace_key is not null").where(F.upper(F.trim("event")) == "TOUCH")
    return beats.groupBy(F.rtrim("workspace_key", F.lit("/")).alias("workspace_key")).agg(F.max("at").alias("last_at"), (F.max("at") >= NOW - 30 * DAY).alias("alive"))


@R.query(
    "q_k3_export",
    """select id, to_json(struct_pack(event := event, id := id, reason := reason, workspace_key := workspace_key))::varchar as line from (select distinct id, event, reason, workspace_key from pager_events)""",
)
def export_events(spark: SparkSession, d: str) -> DataFrame:
    """Canonical JSON of each event, keys sorted, nulls kept; a sink orders it by id."""
    rows = once(spark, d, "pager_events", "id", "event", "reason", "workspace_key")
    return rows.select("id", F.to_json(F.struct("event", "id", "reason", "workspace_key"), {"ignoreNullFields": "false"}).alias("line"))


@R.query(
    "q_k4_semantics",
    """select p.workspace_key, p.semantic_summary, p.semantic_revision, e.n from (select distinct workspace_key, semantic_summary, semantic_revision from pages where semantic_revision > 0) p
    join (select rtrim(workspace_key, '/') as workspace_key, count(distinct id) as n from pager_events where upper(trim(event)) = 'SEMANTIC_ANNOTATED' group by 1) e using (workspace_key)""",
)
def semantics(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "pager_events").where(F.upper(F.trim("event")) == "SEMANTIC_ANNOTATED").select(F.rtrim("workspace_key", F.lit("/")).alias("workspace_key"), "id")
    n = notes.distinct().groupBy("workspace_key").agg(F.count("id").alias("n"))
    return once(spark, d, "pages", "workspace_key", "semantic_summary", "semantic_revision").where("semantic_revision > 0").join(n, "workspace_key")


# --- filters -------------------------------------------------------------------------------------------------------------


@R.query(
    "q_f1_lookup",
    """with t as (select distinct trim(asset_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) as target from asset_files where trim(asset_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) <> '' union select rtrim(workspace_key, '/') from pager_events where workspace_key is not null),
      p as (select distinct workspace_key, path, trim(cloud_asset_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) as cloud_asset_id from pages)
    select distinct target, workspace_key from t join p on t.target = p.workspace_key or t.target = p.path or t.target = p.cloud_asset_id""",
)
def lookup(spark: SparkSession, d: str) -> DataFrame:
    """Pages by key, path or asset: three equi-joins instead of a disjunctive one."""
    files = table(spark, d, "asset_files").select(stripped(F.col("asset_id")).alias("target"))
    events = table(spark, d, "pager_events").select(F.rtrim("workspace_key", F.lit("/")).alias("target"))
    targets = files.unionByName(events).where("target is not null").distinct()
    pages = once(spark, d, "pages", "workspace_key", "path", "cloud_asset_id")
    names = pages.select("workspace_key", F.explode(F.array_distinct(F.array("workspace_key", "path", stripped(F.col("cloud_asset_id"))))).alias("target")).where("target is not null")
    return targets.join(names, "target").select("target", "workspace_key").distinct()


@R.query("q_f2_stale_pages", "select distinct workspace_key, semantic_stale_task from pages where annotation_status <> 'CURRENT' and (semantic_stale_task is null or semantic_stale_task <> '')")
def stale_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").where("annotation_status <> 'CURRENT'").select("workspace_key", "semantic_stale_task")
    return rows.where("semantic_stale_task is null or semantic_stale_task <> ''").distinct()


def uploads(df: DataFrame, states: list[str] | None = None, smallest: int | None = None) -> DataFrame:
    """Filters that are only applied if given."""
    if states:
        df = df.where(F.col("cloud_state").isin(states))
    if smallest is not None:
        df = df.where(F.col("plain_bytes") >= smallest)
    return df


@R.query("q_f4_dynamic_filter", "select distinct digest, plain_bytes from objects where cloud_state in ('REGISTERED', 'FAILED') and plain_bytes >= 1024")
def dynamic_filter(spark: SparkSession, d: str) -> DataFrame:
    return uploads(table(spark, d, "objects"), ["REGISTERED", "FAILED"], 1024).select("digest", "plain_bytes").distinct()


@R.query("q_f5_prefix", f"select host, count(*) as n from object_sources where starts_with(source_path, '{ROOT}/') group by 1")
def prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "object_sources").where(F.col("source_path").startswith(f"{ROOT}/")).groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@R.query("q_f6_at_or_below", f"select distinct workspace_key, path from pages where path = '{ROOT}' or starts_with(path, '{ROOT}/') or path = '/pool/ws' or starts_with(path, '/pool/ws/')")
def below(spark: SparkSession, d: str) -> DataFrame:
    inside = relate.at_or_below(F.col("path"), ROOT) | relate.at_or_below(F.col("path"), "/pool/ws/")
    return table(spark, d, "pages").where(inside).select("workspace_key", "path").distinct()


@R.query("q_f7_like", "select source_path, count(*) as n from asset_files where relative_path ilike '%LEDGER%.parquet' group by 1")
def like(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "asset_files").where(F.col("relative_path").ilike("%LEDGER%.parquet")).groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))


@R.query(
    "q_f8_violations",
    f"""with p as (select distinct workspace_key, host, path, state, local_present, redundancy_class from pages), s as (select distinct {_dig('digest')} as digest from object_sources)
    select 'state_domain' as rule, count(*) as n from p where state is null or state not in {PAGE_STATES}
    union all select 'key_form', count(*) from p where workspace_key <> host || '|' || path
    union all select 'key_unique', count(*) from (select workspace_key from p group by 1 having count(*) > 1)
    union all select 'presence_domain', count(*) from p where local_present not in (-1, 0, 1)
    union all select 'source_without_object', count(*) from s where digest is not null and digest not in (select digest from objects)""",
)
def violations(spark: SparkSession, d: str) -> DataFrame:
    """Broken invariants by rule, zero where all holds."""
    p = once(spark, d, "pages", "workspace_key", "host", "path", "state", "local_present", "redundancy_class")
    n = lambda rule, df: df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"))
    sources = table(spark, d, "object_sources").select(digest_key(F.col("digest")).alias("digest")).where("digest is not null").distinct()
    parts = [
        n("state_domain", p.where(F.col("state").isNull() | ~F.col("state").isin(*PAGE_STATES))),
        n("key_form", p.where(F.col("workspace_key") != F.concat("host", F.lit("|"), "path"))),
        n("key_unique", p.groupBy("workspace_key").count().where("count > 1")),
        n("presence_domain", p.where(~F.col("local_present").isin(-1, 0, 1))),
        n("source_without_object", sources.join(table(spark, d, "objects").select("digest"), "digest", "left_anti")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@R.query(
    "q_f10_path_classes",
    r"""select class, count(*) as n from (select distinct source_path, relative_path,
      case when regexp_matches(relative_path, '(^|/)\.[^/.]') then 'hidden' when regexp_matches(relative_path, '(^|/)(tmp|scratch|cache|logs)(/|$)') then 'scratch' when regexp_matches(relative_path, '\.(log|md|txt)$') then 'text' else 'data' end as class
      from asset_files) group by 1""",
)
def path_classes(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("relative_path")
    kind = F.when(p.rlike(r"(^|/)\.[^/.]"), "hidden").when(p.rlike("(^|/)(tmp|scratch|cache|logs)(/|$)"), "scratch").when(p.rlike(r"\.(log|md|txt)$"), "text").otherwise("data")
    return once(spark, d, "asset_files", "source_path", "relative_path").groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@R.query(
    "q_f13_ttl",
    f"""select distinct receipt_id, subject_id from gc_receipts where state <> 'RECYCLE_CONFIRMED' and epoch(cast(recorded_at as timestamptz)) >= {NOW} - 180 * {DAY}""",
)
def ttl(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that are still in force: the cut-off itself is."""
    at = F.unix_micros(iso_instant(F.col("recorded_at"))) / 1e6
    return table(spark, d, "gc_receipts").where((F.col("state") != "RECYCLE_CONFIRMED") & (at >= NOW - 180 * DAY)).select("receipt_id", "subject_id").distinct()


@R.query(
    "q_f14_refusals",
    r"""select code, count(*) as n from (select distinct id, regexp_extract(regexp_replace(reason, '^(\s|transport [a-z]+ after [0-9]+s )+', ''), '(REFUSE_[A-Z_]+|rc=[0-9]+|timed out|read-only)', 1) as code from pager_events) where code <> '' group by 1""",
)
def refusals(spark: SparkSession, d: str) -> DataFrame:
    """The leaf code of a refusal after its transport wrapper is taken off."""
    leaf = F.regexp_replace("reason", r"^(\s|transport [a-z]+ after [0-9]+s )+", "")
    codes = table(spark, d, "pager_events").select("id", F.regexp_extract(leaf, "(REFUSE_[A-Z_]+|rc=[0-9]+|timed out|read-only)", 1).alias("code")).distinct()
    return codes.where("code <> ''").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@R.query(
    "q_f15_validators",
    r"""select problem, count(*) as n from (
      select digest, host, source_path, unnest([case when not regexp_matches(digest, '^[0-9a-f]{64}$') then 'digest' end, case when not starts_with(source_path, '/') then 'relative' end,
        case when regexp_matches(source_path, '(^|/)\.\.(/|$)') then 'parent' end, case when not regexp_matches(host, '^[a-z][a-z0-9-]*$') then 'host' end]) as problem
      from (select distinct digest, host, source_path from object_sources)) where problem is not null group by 1""",
)
def validators(spark: SparkSession, d: str) -> DataFrame:
    digest, path, host = F.col("digest"), F.col("source_path"), F.col("host")
    checks = [F.when(~digest.rlike("^[0-9a-f]{64}$"), "digest"), F.when(~path.startswith("/"), "relative"), F.when(path.rlike(r"(^|/)\.\.(/|$)"), "parent"), F.when(~host.rlike("^[a-z][a-z0-9-]*$"), "host")]
    return once(spark, d, "object_sources", "digest", "host", "source_path").select(F.explode(F.array_compact(F.array(*checks))).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@R.query(
    "q_f16_gates",
    """select gate, count(*) as n, count(*) filter (where ok) as n_ok from (
      select digest, unnest(['confirmed', 'encrypted', 'grown', 'hashed', 'placed']) as gate,
        unnest([coalesce(cloud_state = 'CLOUD_CONFIRMED', false), encrypted_bytes is not null, coalesce(encrypted_bytes > plain_bytes, false), coalesce(length(encrypted_sha256) = 64, false), coalesce(starts_with(cloud_relpath, 'objects/'), false)]) as ok
      from (select distinct digest, cloud_state, encrypted_bytes, plain_bytes, encrypted_sha256, cloud_relpath from objects)) group by 1""",
)
def gates(spark: SparkSession, d: str) -> DataFrame:
    """Named checks unpivoted, with how many objects pass each."""
    o = once(spark, d, "objects", "digest", "cloud_state", "encrypted_bytes", "plain_bytes", "encrypted_sha256", "cloud_relpath")
    checks = {"confirmed": F.col("cloud_state") == "CLOUD_CONFIRMED", "encrypted": F.col("encrypted_bytes").isNotNull(), "grown": F.col("encrypted_bytes") > F.col("plain_bytes"), "hashed": F.length("encrypted_sha256") == 64, "placed": F.col("cloud_relpath").startswith("objects/")}
    each = F.array(*(F.struct(F.lit(k).alias("gate"), F.coalesce(c, F.lit(False)).alias("ok")) for k, c in checks.items()))
    return o.select(F.inline(each)).groupBy("gate").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"))


# --- joins ---------------------------------------------------------------------------------------------------------------

_SRC = f"(select distinct {_dig('digest')} as digest, host, source_path, source_state from object_sources)"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "object_sources").select(digest_key(F.col("digest")).alias("digest"), "host", "source_path", "source_state").distinct()


@R.query("q_j1_distinct_objects", f"select distinct o.digest, o.plain_bytes from objects o join {_SRC} s on o.digest = s.digest")
def distinct_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects that have a source: a semi-join rather than a join and distinct."""
    return once(spark, d, "objects", "digest", "plain_bytes").join(_sources(spark, d).select("digest"), "digest", "left_semi")


@R.query("q_j2_left_outer", "select f.source_path, count(*) as n, count(a.asset_id) as n_known from (select distinct source_path, relative_path, nullif(trim(asset_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '') as asset_id from asset_files) f left join (select distinct asset_id from assets) a on f.asset_id = a.asset_id group by 1")
def left_outer(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "asset_files").select("source_path", "relative_path", stripped(F.col("asset_id")).alias("asset_id")).distinct()
    known = once(spark, d, "assets", "asset_id").withColumn("known", F.lit(1))
    return files.join(known, "asset_id", "left").groupBy("source_path").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("n_known"))


@R.query(
    "q_j3_star",
    """with f as (select nullif(trim(asset_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '') as asset_id, count(*) as n, sum(size_bytes) as b from (select distinct source_path, relative_path, asset_id, size_bytes from asset_files) group by 1),
      a as (select distinct asset_id, host from assets), p as (select distinct trim(cloud_asset_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) as asset_id, state from pages where trim(cloud_asset_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) <> ''),
      g as (select distinct trim(subject_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) as asset_id from gc_receipts where subject_kind = 'asset' and state = 'RECYCLE_CONFIRMED')
    select a.host, p.state, cast(sum(f.n) as bigint) as n_files, cast(sum(f.b) as bigint) as n_bytes, count(g.asset_id) as n_removed from f join a using (asset_id) join p using (asset_id) left join g using (asset_id) group by 1, 2""",
)
def star(spark: SparkSession, d: str) -> DataFrame:
    files = once(spark, d, "asset_files", "source_path", "relative_path", "asset_id", "size_bytes").groupBy(stripped(F.col("asset_id")).alias("asset_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("b"))
    pages = table(spark, d, "pages").select(stripped(F.col("cloud_asset_id")).alias("asset_id"), "state").where("asset_id is not null").distinct()
    gone = table(spark, d, "gc_receipts").where("subject_kind = 'asset' and state = 'RECYCLE_CONFIRMED'").select(stripped(F.col("subject_id")).alias("asset_id")).distinct().withColumn("gone", F.lit(1))
    joined = files.join(once(spark, d, "assets", "asset_id", "host"), "asset_id").join(pages, "asset_id").join(gone, "asset_id", "left")
    return joined.groupBy("host", "state").agg(F.sum("n").alias("n_files"), F.sum("b").alias("n_bytes"), F.count("gone").alias("n_removed"))


@R.query("q_j4_semi", f"select distinct host, source_path from {_SRC} where digest in (select digest from objects where cloud_state = 'FAILED')")
def semi(spark: SparkSession, d: str) -> DataFrame:
    failed = table(spark, d, "objects").where("cloud_state = 'FAILED'").select("digest")
    return _sources(spark, d).join(failed, "digest", "left_semi").select("host", "source_path").distinct()


@R.query("q_j5_exists", "select distinct asset_id from assets a where exists (select 1 from pages p where trim(p.cloud_asset_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) = a.asset_id and p.host = a.host)")
def exists(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(stripped(F.col("cloud_asset_id")).alias("asset_id"), "host")
    return once(spark, d, "assets", "asset_id", "host").join(pages, ["asset_id", "host"], "left_semi").select("asset_id").distinct()


@R.query(
    "q_j6_universal",
    """select a.asset_id, coalesce(max(case when f.size_bytes > 0 and f.mtime_ns is not null then 0 when f.x is null then 0 else 1 end), 0) = 0 as ok
    from (select distinct asset_id from assets) a left join (select trim(asset_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) as asset_id, size_bytes, mtime_ns, 1 as x from asset_files) f using (asset_id) group by 1""",
)
def universal(spark: SparkSession, d: str) -> DataFrame:
    """Assets all of whose files have a size and a time; an asset without files is vacuously ok."""
    files = table(spark, d, "asset_files").select(stripped(F.col("asset_id")).alias("asset_id"), "size_bytes", "mtime_ns")
    return relate.all_satisfy(table(spark, d, "assets"), files, "asset_id", ~(F.col("size_bytes") > 0) | F.col("mtime_ns").isNull())


@R.query("q_j7_inner", "select distinct p.workspace_key, p.state, a.asset_id, a.size_bytes from pages p join assets a on trim(p.cloud_asset_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) = a.asset_id")
def inner(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("workspace_key", "state", stripped(F.col("cloud_asset_id")).alias("asset_id")).distinct()
    return pages.join(once(spark, d, "assets", "asset_id", "size_bytes"), "asset_id").distinct()


@R.query(
    "q_j9_reconcile",
    """with p as (select distinct host, path, size_bytes, workspace_key from pages), a as (select distinct host, rtrim(original_path, '/') as path, size_bytes, asset_id from assets)
    select coalesce(p.host, a.host) as host, coalesce(p.path, a.path) as path, case when a.asset_id is null then 'page_only' when p.workspace_key is null then 'asset_only' else 'matched' end as side, coalesce(p.size_bytes, a.size_bytes, 0) as size_bytes
    from p full join a on p.host = a.host and p.path = a.path""",
)
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "pages", "host", "path", "size_bytes", "workspace_key").withColumnRenamed("size_bytes", "p_size")
    a = table(spark, d, "assets").select("host", F.rtrim("original_path", F.lit("/")).alias("path"), F.col("size_bytes").alias("a_size"), "asset_id").distinct()
    side = F.when(F.col("asset_id").isNull(), "page_only").when(F.col("workspace_key").isNull(), "asset_only").otherwise("matched")
    return p.join(a, ["host", "path"], "full").select("host", "path", side.alias("side"), F.coalesce("p_size", "a_size", F.lit(0)).alias("size_bytes"))


_J10 = "with a as (select source_path, sum(size_bytes) as v from (select distinct source_path, relative_path, size_bytes from asset_files) group by 1), b as (select source_path, sum(size_bytes) as v from (select distinct source_path, relative_path, size_bytes from asset_files_mirror) group by 1), j as (select case when b.source_path is null then 'missing' when a.source_path is null then 'unexpected' when a.v is distinct from b.v then 'mismatched' else 'equal' end as verdict, coalesce(a.source_path, b.source_path) as source_path from a full join b on a.source_path = b.source_path) "


def _audit(spark: SparkSession, d: str) -> DataFrame:
    total = lambda n: once(spark, d, n, "source_path", "relative_path", "size_bytes").groupBy("source_path").agg(F.sum("size_bytes").alias("v"))
    return relate.full_diff(total("asset_files"), total("asset_files_mirror"), ["source_path"], "v")


@R.query("q_j10_full_diff", _J10 + "select source_path, verdict from j")
def full_diff(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d)


@R.query("q_j11_diff_totals", _J10 + "select verdict, count(*) as n from j group by 1")
def diff_totals(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@R.query(
    "q_j12_deepest_root",
    """with p as (select distinct host, source_path from object_sources), r as (select distinct host, path as root from pages),
      u as (select host, source_path, '/' || array_to_string(list_slice(list_filter(string_split(source_path, '/'), lambda s: s <> ''), 1, i), '/') as root from (select host, source_path, unnest(range(1, len(string_split(source_path, '/')) + 1)) as i from p)),
      m as (select host, source_path, max_by(root, length(root)) as root from u join r using (host, root) group by 1, 2)
    select p.host, p.source_path, m.root from p left join m using (host, source_path)""",
)
def deepest_root(spark: SparkSession, d: str) -> DataFrame:
    """The longest registered root at or above each source, on the same host."""
    roots = table(spark, d, "pages").select("host", F.col("path").alias("root"))
    return relate.deepest_root(once(spark, d, "object_sources", "host", "source_path"), roots, ["host"], "source_path", "root").select("host", "source_path", "root")


@R.query(
    "q_j13_latest_proof",
    f"""with s as (select {_dig('digest')} as digest, cast(last_verified_at as timestamptz) as t, source_state, host, source_path from object_sources),
      l as (select digest, source_state from (select *, row_number() over (partition by digest order by t desc nulls last, source_state desc, host desc, source_path desc) as rn from s) where rn = 1),
      v as (select digest, max(t) as t from s where source_state = 'HASH_VERIFIED' group by 1)
    select l.digest, l.source_state as last_state, epoch(v.t) as last_verified from l left join v using (digest)""",
)
def latest_proof(spark: SparkSession, d: str) -> DataFrame:
    """Last-then-filter and filter-then-last differ: the state of the last row, and the time of the last proof."""
    s = table(spark, d, "object_sources").select(digest_key(F.col("digest")).alias("digest"), iso_instant(F.col("last_verified_at")).alias("at"), "source_state", "host", "source_path")
    last = relate.latest(s, ["digest"], ["at", "source_state", "host", "source_path"]).select("digest", F.col("source_state").alias("last_state"))
    proof = s.where("source_state = 'HASH_VERIFIED'").groupBy("digest").agg((F.unix_micros(F.max("at")) / 1e6).alias("last_verified"))
    return last.join(proof, "digest", "left")


@R.query(
    "q_j14_fallback",
    """with p as (select distinct workspace_key, host, path, nullif(trim(cloud_asset_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '') as asset_id from pages), a as (select distinct asset_id, host, rtrim(original_path, '/') as path, redundancy_class from assets)
    select p.workspace_key, coalesce(x.redundancy_class, y.redundancy_class) as redundancy_class, case when x.asset_id is not null then 'id' when y.asset_id is not null then 'path' else 'none' end as found_by
    from p left join a x on p.asset_id = x.asset_id left join a y on p.host = y.host and p.path = y.path""",
)
def fallback(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("workspace_key", "host", "path", stripped(F.col("cloud_asset_id")).alias("asset_id")).distinct()
    a = table(spark, d, "assets").select("asset_id", "host", F.rtrim("original_path", F.lit("/")).alias("path"), "redundancy_class").distinct()
    by_id = a.select("asset_id", F.col("redundancy_class").alias("rx"), F.lit(True).alias("x"))
    by_path = a.select("host", "path", F.col("redundancy_class").alias("ry"), F.lit(True).alias("y"))
    joined = p.join(by_id, "asset_id", "left").join(by_path, ["host", "path"], "left")
    return joined.select("workspace_key", F.coalesce("rx", "ry").alias("redundancy_class"), F.when(F.col("x"), "id").when(F.col("y"), "path").otherwise("none").alias("found_by"))


@R.query(
    "q_j15_precedence",
    """with u as (select host, rtrim(original_path, '/') as path, asset_id, 1 as rank from assets where starts_with(asset_id, 'v2-') and coalesce(cloud_verified, false) union all select host, rtrim(original_path, '/'), asset_id, 2 from assets where starts_with(asset_id, 'logical-v3-')
      union all select host, path, workspace_key, 3 from pages)
    select host, path, asset_id as winner, rank from (select *, row_number() over (partition by host, path order by rank, asset_id) as rn from u) where rn = 1""",
)
def precedence(spark: SparkSession, d: str) -> DataFrame:
    """Rows of three kinds merged by precedence: a confirmed first kind, else the second, else a placeholder."""
    a = table(spark, d, "assets").select("host", F.rtrim("original_path", F.lit("/")).alias("path"), F.col("asset_id").alias("winner"), "cloud_verified")
    first = a.where(F.col("winner").startswith("v2-") & F.coalesce("cloud_verified", F.lit(False))).withColumn("rank", F.lit(1))
    second = a.where(F.col("winner").startswith("logical-v3-")).withColumn("rank", F.lit(2))
    third = table(spark, d, "pages").select("host", "path", F.col("workspace_key").alias("winner"), F.lit(None).cast("boolean").alias("cloud_verified"), F.lit(3).alias("rank"))
    best = first.unionByName(second).unionByName(third).groupBy("host", "path").agg(F.min(F.struct("rank", "winner")).alias("b"))
    return best.select("host", "path", "b.winner", "b.rank")


@R.query("q_j17_enrich", "select f.asset_id, f.n, a.host, a.local_state from (select nullif(trim(asset_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '') as asset_id, count(*) as n from asset_files where relative_path ilike '%ledger%' group by 1) f left join (select distinct asset_id, host, local_state from assets) a using (asset_id)")
def enrich(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "asset_files").where(F.col("relative_path").ilike("%ledger%")).groupBy(stripped(F.col("asset_id")).alias("asset_id")).agg(F.count(F.lit(1)).alias("n"))
    return hits.join(once(spark, d, "assets", "asset_id", "host", "local_state"), "asset_id", "left").select("asset_id", "n", "host", "local_state")


@R.query(
    "q_j18_overlaps",
    """with p as (select distinct host, source_path as path from object_sources union select distinct host, path from pages)
    select a.host, a.path as outer_path, count(*) as n_inside from p a join p b on a.host = b.host and starts_with(b.path, a.path || '/') group by 1, 2""",
)
def overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Paths that contain others on the same host, by exploded ancestors instead of comparing all pairs."""
    p = once(spark, d, "object_sources", "host", "source_path").toDF("host", "path").union(once(spark, d, "pages", "host", "path")).distinct()
    inside = p.select("host", F.col("path").alias("inner_path"), F.explode(relate.ancestors(F.col("path"))).alias("path")).where("path <> inner_path")
    return inside.join(p, ["host", "path"]).groupBy("host", F.col("path").alias("outer_path")).agg(F.count(F.lit(1)).alias("n_inside"))


@R.query("q_j19_pending", "select count(*) as n_pending from (select distinct subject_kind, lower(trim(subject_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) as s from gc_receipts) q left join (select distinct subject_kind, lower(trim(subject_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) as s, 'y' as done from gc_receipts where state = 'RECYCLE_CONFIRMED') c using (subject_kind, s) where coalesce(done, '') <> 'y'")
def pending(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "gc_receipts").select("subject_kind", F.lower(stripped(F.col("subject_id"))).alias("s"), "state")
    done = r.where("state = 'RECYCLE_CONFIRMED'").select("subject_kind", "s").distinct().withColumn("done", F.lit("y"))
    return r.select("subject_kind", "s").distinct().join(done, ["subject_kind", "s"], "left").where("coalesce(done, '') <> 'y'").agg(F.count(F.lit(1)).alias("n_pending"))


@R.query("q_j20_not_one", "select a.asset_id, count(p.workspace_key) as n from (select distinct asset_id from assets) a left join (select distinct workspace_key, trim(cloud_asset_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) as asset_id from pages) p using (asset_id) group by 1 having count(p.workspace_key) <> 1")
def not_one(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("workspace_key", stripped(F.col("cloud_asset_id")).alias("asset_id")).distinct()
    return once(spark, d, "assets", "asset_id").join(pages, "asset_id", "left").groupBy("asset_id").agg(F.count("workspace_key").alias("n")).where("n <> 1")


@R.query(
    "q_j21_evidence",
    """with a as (select distinct asset_id, restore_verified from assets), f as (select trim(asset_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) as asset_id, count(*) as n from asset_files group by 1), g as (select distinct trim(subject_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) as asset_id from gc_receipts where subject_kind = 'asset')
    select a.asset_id, case when g.asset_id is not null then 'recycled' when f.n is null then 'no_manifest' when coalesce(a.restore_verified, false) then 'ready' else 'pending' end as status from a left join f using (asset_id) left join g using (asset_id)""",
)
def evidence(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "asset_files").groupBy(stripped(F.col("asset_id")).alias("asset_id")).agg(F.count(F.lit(1)).alias("n"))
    gone = table(spark, d, "gc_receipts").where("subject_kind = 'asset'").select(stripped(F.col("subject_id")).alias("asset_id")).distinct().withColumn("gone", F.lit(True))
    status = F.when(F.col("gone"), "recycled").when(F.col("n").isNull(), "no_manifest").when(F.coalesce("restore_verified", F.lit(False)), "ready").otherwise("pending")
    return once(spark, d, "assets", "asset_id", "restore_verified").join(n, "asset_id", "left").join(gone, "asset_id", "left").select("asset_id", status.alias("status"))


# --- aggregates ----------------------------------------------------------------------------------------------------------

_PAGES = "(select distinct workspace_key, host, path, state, storage_pool, local_present, size_bytes, last_access, last_write, updated_at, access_count, tree_recent, tree_probed_at, semantic_revision, content_fingerprint from pages)"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "pages", "workspace_key", "host", "path", "state", "storage_pool", "local_present", "size_bytes", "last_access", "last_write", "updated_at", "access_count", "tree_recent", "tree_probed_at", "semantic_revision", "content_fingerprint")


@R.query("q_a1_counts", f"select state, host, count(*) as n from {_PAGES} where storage_pool = 'MANAGED' group by 1, 2")
def counts(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where("storage_pool = 'MANAGED'").groupBy("state", "host").agg(F.count(F.lit(1)).alias("n"))


@R.query("q_a2_bytes_by_state", "select cloud_state, count(*) as n, coalesce(cast(sum(encrypted_bytes) as bigint), 0) as n_bytes from (select distinct digest, cloud_state, encrypted_bytes from objects) group by 1")
def bytes_by_state(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "objects", "digest", "cloud_state", "encrypted_bytes").groupBy("cloud_state").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("encrypted_bytes"), F.lit(0)).alias("n_bytes"))


@R.query("q_a3_entry_bytes", f"select coalesce(cast(sum(o.plain_bytes) as bigint), 0) as entry_bytes, coalesce((select cast(sum(plain_bytes) as bigint) from (select distinct digest, plain_bytes from objects where digest in (select digest from {_SRC}))), 0) as distinct_bytes from {_SRC} s join (select distinct digest, plain_bytes from objects) o using (digest)")
def entry_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes over entries and over distinct objects: both are kept, since they disagree where an object is shared."""
    per = _sources(spark, d).groupBy("digest").agg(F.count(F.lit(1)).alias("k")).join(once(spark, d, "objects", "digest", "plain_bytes"), "digest")
    return per.agg(F.coalesce(F.sum(F.col("plain_bytes") * F.col("k")), F.lit(0)).alias("entry_bytes"), F.coalesce(F.sum("plain_bytes"), F.lit(0)).alias("distinct_bytes"))


@R.query("q_a4_closed_domain", f"select s.state, count(p.workspace_key) as n from (select unnest({list(PAGE_STATES)}) as state) s left join {_PAGES} p on p.state = s.state group by 1")
def closed_domain(spark: SparkSession, d: str) -> DataFrame:
    """Counts over a closed domain, zeros included."""
    domain = spark.createDataFrame([(s,) for s in PAGE_STATES], "state string")
    return domain.join(_pages(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


@R.query("q_a5_distinct_group", f"select host, source_state, count(*) as n from (select distinct digest, host, source_state from {_SRC}) group by 1, 2")
def distinct_group(spark: SparkSession, d: str) -> DataFrame:
    return _sources(spark, d).select("digest", "host", "source_state").distinct().groupBy("host", "source_state").agg(F.count(F.lit(1)).alias("n"))


@R.query("q_a6_conditional_sum", f"select source_state, host, count(*) as n, count(*) filter (where starts_with(source_path, '{ROOT}/')) as n_inside, cast(sum(case when starts_with(source_path, '/pool/') then length(source_path) else 0 end) as bigint) as path_chars from {_SRC} group by 1, 2")
def conditional_sum(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("source_path")
    return _sources(spark, d).groupBy("source_state", "host").agg(F.count(F.lit(1)).alias("n"), F.count_if(p.startswith(f"{ROOT}/")).alias("n_inside"), F.sum(F.when(p.startswith("/pool/"), F.length(p)).otherwise(0)).alias("path_chars"))


@R.query("q_a7_pool_bytes", f"select storage_pool, coalesce(cast(sum(size_bytes) filter (where local_present = 1) as bigint), 0) as local_bytes, cast(floor(0.15 * coalesce(sum(size_bytes), 0)) as bigint) as stop_bytes, cast(floor(0.10 * coalesce(sum(size_bytes), 0)) as bigint) as low_bytes from {_PAGES} group by 1")
def pool_bytes(spark: SparkSession, d: str) -> DataFrame:
    total = F.coalesce(F.sum("size_bytes"), F.lit(0))
    share = lambda x: F.floor(F.lit(x).cast("decimal(3,2)") * total).cast("long")  # noqa: E731 - exact, as no double holds 0.15
    return _pages(spark, d).groupBy("storage_pool").agg(F.coalesce(F.sum(F.when(F.col("local_present") == 1, F.col("size_bytes"))), F.lit(0)).alias("local_bytes"), share(0.15).alias("stop_bytes"), share(0.10).alias("low_bytes"))


@R.query("q_a9_upload_plan", "select count(*) as n, coalesce(cast(sum(plain_bytes) as bigint), 0) as total, coalesce(min(plain_bytes), 0) as smallest, coalesce(max(plain_bytes), 0) as largest from (select distinct digest, plain_bytes from objects where cloud_state = 'REGISTERED')")
def upload_plan(spark: SparkSession, d: str) -> DataFrame:
    o = once(spark, d, "objects", "digest", "plain_bytes", "cloud_state").where("cloud_state = 'REGISTERED'")
    zero = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    return o.agg(F.count(F.lit(1)).alias("n"), zero(F.sum("plain_bytes"), "total"), zero(F.min("plain_bytes"), "smallest"), zero(F.max("plain_bytes"), "largest"))


@R.query("q_a11_rollup", f"select host, state, count(*) as n, coalesce(cast(sum(size_bytes) as bigint), 0) as n_bytes, cast(grouping(host) * 2 + grouping(state) as bigint) as level from {_PAGES} group by rollup(host, state)")
def rollup(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).rollup("host", "state").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"), F.grouping_id("host", "state").alias("level"))


@R.query("q_a12_tree_times", "select source_path, count(*) as n, min(mtime_ns) as oldest, max(mtime_ns) as newest, cast(sum(size_bytes) as bigint) as n_bytes from (select distinct source_path, relative_path, mtime_ns, size_bytes from asset_files) group by 1")
def tree_times(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "asset_files", "source_path", "relative_path", "mtime_ns", "size_bytes").groupBy("source_path").agg(F.count(F.lit(1)).alias("n"), F.min("mtime_ns").alias("oldest"), F.max("mtime_ns").alias("newest"), F.sum("size_bytes").alias("n_bytes"))


@R.query("q_a13_disk_need", f"select host, cast(sum(size_bytes) as bigint) as need, max(size_bytes) as largest, array_to_string(list_sort(list(distinct storage_pool)), '+') as pools from {_PAGES} group by 1")
def disk_need(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).groupBy("host").agg(F.sum("size_bytes").alias("need"), F.max("size_bytes").alias("largest"), F.array_join(F.array_sort(F.collect_set("storage_pool")), "+").alias("pools"))


@R.query("q_a14_receipt_totals", "select subject_kind, state, count(*) as n, coalesce(cast(sum(encrypted_bytes) as bigint), 0) as n_bytes, cast(sum(len(cast(superseded_versions_json as varchar[]))) as bigint) as n_versions from (select distinct receipt_id, subject_kind, state, encrypted_bytes, superseded_versions_json from gc_receipts) group by 1, 2")
def receipt_totals(spark: SparkSession, d: str) -> DataFrame:
    r = once(spark, d, "gc_receipts", "receipt_id", "subject_kind", "state", "encrypted_bytes", "superseded_versions_json")
    versions = F.size(F.from_json("superseded_versions_json", "array<string>"))
    return r.groupBy("subject_kind", "state").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("encrypted_bytes"), F.lit(0)).alias("n_bytes"), F.sum(versions).alias("n_versions"))


@R.query("q_a15_rate", f"select host, coalesce(100.0 * count(*) filter (where content_fingerprint is not null) / nullif(count(*), 0), 100.0)::double as rate from {_PAGES} group by 1")
def rate(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).groupBy("host").agg(F.coalesce(F.lit(100.0) * F.count("content_fingerprint") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(100.0)).alias("rate"))


@R.query(
    "q_a17_manifest_digest",
    "select source_path, digest, n from " + relate.merkle_sql("select distinct source_path, sha256(relative_path || '|' || coalesce(size_bytes::varchar, '') || '|' || coalesce(mtime_ns::varchar, '')) as h from asset_files"),
)
def manifest_digest(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws("|", "relative_path", F.coalesce(F.col("size_bytes").cast("string"), F.lit("")), F.coalesce(F.col("mtime_ns").cast("string"), F.lit("")))
    return relate.merkle_digest(table(spark, d, "asset_files"), ["source_path"], line)


@R.query(
    "q_a18_merge_outcomes",
    """with a as (select trim(cloud_asset_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) as asset_id, max(semantic_revision) as r, max(host) as h from pages where trim(cloud_asset_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) <> '' group by 1), b as (select asset_id, max(semantic_revision) as r, max(host) as h from assets group by 1)
    select case when b.asset_id is null then 'kept' when a.asset_id is null then 'inserted' when b.r > a.r then 'advanced' when b.r < a.r then 'stale' when a.h = b.h then 'identical' else 'conflict' end as outcome, count(*) as n from a full join b on a.asset_id = b.asset_id group by 1""",
)
def merge_outcomes(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "pages").select(stripped(F.col("cloud_asset_id")).alias("asset_id"), "semantic_revision", "host").where("asset_id is not null").groupBy("asset_id").agg(F.max("semantic_revision").alias("r"), F.max("host").alias("h"))
    b = table(spark, d, "assets").groupBy("asset_id").agg(F.max("semantic_revision").alias("r"), F.max("host").alias("h"))
    return relate.merge_revisions(a, b, "asset_id", "r", ["h"]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@R.query(
    "q_a19_liveness",
    f"""select count(*) as considered, count(*) filter (where tree_probed_at is null or tree_probed_at < {NOW} - 30 * {DAY}) as stale, count(*) filter (where tree_probed_at >= {NOW} - 30 * {DAY}) as probed, count(*) filter (where tree_recent = 1) as live from {_PAGES} where local_present <> 0""",
)
def liveness(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("tree_probed_at")
    fresh = at >= NOW - 30 * DAY
    return _pages(spark, d).where("local_present <> 0").agg(F.count(F.lit(1)).alias("considered"), F.count_if(at.isNull() | ~fresh).alias("stale"), F.count_if(fresh).alias("probed"), F.count_if(F.col("tree_recent") == 1).alias("live"))


@R.query(
    "q_a20_durations",
    r"""select unit, count(*) as n, cast(sum(v) as bigint) as total from (select distinct id, cast(regexp_extract(reason, 'in ([0-9]+)(ms|s)', 1) as bigint) as v, regexp_extract(reason, 'in ([0-9]+)(ms|s)', 2) as unit from pager_events where regexp_matches(reason, 'in [0-9]+(ms|s)')) group by 1""",
)
def durations(spark: SparkSession, d: str) -> DataFrame:
    pattern = "in ([0-9]+)(ms|s)"
    rows = table(spark, d, "pager_events").where(F.col("reason").rlike(pattern)).select("id", F.regexp_extract("reason", pattern, 1).cast("long").alias("v"), F.regexp_extract("reason", pattern, 2).alias("unit")).distinct()
    return rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


# --- set operations ------------------------------------------------------------------------------------------------------


@R.query(
    "q_u1_garbage",
    f"""with c as (select {_dig('subject_id')} as digest, count(*) as n_receipts from (select distinct receipt_id, subject_id from gc_receipts where subject_kind = 'object') group by 1)
    select * from c where digest not in (select digest from {_SRC} where digest is not null and source_state <> 'MISSING')""",
)
def garbage(spark: SparkSession, d: str) -> DataFrame:
    """Removal candidates that nothing present refers to."""
    c = once(spark, d, "gc_receipts", "receipt_id", "subject_id", "subject_kind").where("subject_kind = 'object'").groupBy(digest_key(F.col("subject_id")).alias("digest")).agg(F.count(F.lit(1)).alias("n_receipts"))
    return c.join(_sources(spark, d).where("source_state <> 'MISSING'").select("digest"), "digest", "left_anti")


@R.query("q_u2_intersect", "select trim(cloud_asset_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) as asset_id from pages where cloud_verified = 1 intersect select asset_id from assets where cloud_verified")
def intersect(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "pages").where("cloud_verified = 1").select(stripped(F.col("cloud_asset_id")).alias("asset_id"))
    return a.intersect(table(spark, d, "assets").where("cloud_verified").select("asset_id"))


@R.query(
    "q_u3_union_arrays",
    "select distinct workspace_key, array_to_string(list_sort(list_distinct(list_concat(cast(semantic_keywords_json as varchar[]), cast(semantic_pending_files_json as varchar[])))), ',') as terms from pages",
)
def union_arrays(spark: SparkSession, d: str) -> DataFrame:
    parsed = [F.from_json(c, "array<string>") for c in ("semantic_keywords_json", "semantic_pending_files_json")]
    return table(spark, d, "pages").select("workspace_key", F.array_join(F.array_sort(F.array_union(*parsed)), ",").alias("terms")).distinct()


@R.query(
    "q_u4_union_kinds",
    """select 'page' as kind, host as name, count(*) as n from (select distinct workspace_key, host from pages) group by 2 union all select 'asset', host, count(*) from (select distinct asset_id, host from assets) group by 2
    union all select 'source', host, count(*) from (select distinct digest, host, source_path from object_sources) group by 2""",
)
def union_kinds(spark: SparkSession, d: str) -> DataFrame:
    parts = [once(spark, d, t, *c).groupBy(F.col("host").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(k)) for k, t, c in (("page", "pages", ("workspace_key", "host")), ("asset", "assets", ("asset_id", "host")), ("source", "object_sources", ("digest", "host", "source_path")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("kind", "name", "n")


@R.query(
    "q_u5_coverage",
    f"with a as (select distinct digest from {_SRC} where digest is not null), b as (select distinct digest from objects) select (select count(*) from (select * from a except select * from b)) as only_sources, (select count(*) from (select * from b except select * from a)) as only_objects",
)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whether two key sets are equal: what only one of them has, from one pass over both."""
    a = _sources(spark, d).select("digest", F.lit(1).alias("a"), F.lit(0).alias("b")).where("digest is not null")
    b = table(spark, d, "objects").select("digest", F.lit(0).alias("a"), F.lit(1).alias("b"))
    each = a.unionByName(b).groupBy("digest").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.agg(F.count_if(F.col("b") == 0).alias("only_sources"), F.count_if(F.col("a") == 0).alias("only_objects"))


@R.query("q_u6_first_kept", "select workspace_key, min(id) as first_id from (select rtrim(workspace_key, '/') as workspace_key, id from pager_events where workspace_key is not null) group by 1")
def first_kept(spark: SparkSession, d: str) -> DataFrame:
    """Ordered removal of repeats that keeps the first."""
    return table(spark, d, "pager_events").where("workspace_key is not null").groupBy(F.rtrim("workspace_key", F.lit("/")).alias("workspace_key")).agg(F.min("id").alias("first_id"))


@R.query("q_u7_unknown", "select distinct rtrim(workspace_key, '/') as workspace_key from pager_events where workspace_key is not null and rtrim(workspace_key, '/') not in (select workspace_key from pages)")
def unknown(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "pager_events").where("workspace_key is not null").select(F.rtrim("workspace_key", F.lit("/")).alias("workspace_key")).distinct()
    return seen.join(table(spark, d, "pages").select("workspace_key"), "workspace_key", "left_anti")



# --- snapshots, validation and indexes -----------------------------------------------------------------------------------

@R.query(
    "q_s3_validated",
    r"""with s as (select distinct workspace_key, host, path, semantic_revision, content_fingerprint, semantic_keywords_json from pages),
      f as (select unnest([case when coalesce(workspace_key <> host || '|' || path, true) then 'key' end, case when coalesce(semantic_revision < 1, true) then 'revision' end,
        case when not coalesce(regexp_matches(content_fingerprint, '^[0-9a-f]{64}$'), false) then 'fingerprint' end, case when not coalesce(json_valid(semantic_keywords_json) and starts_with(semantic_keywords_json, '['), false) then 'keywords' end]) as failed from s)
    select failed, count(*) as n from f where failed is not null group by 1""",
)
def validated(spark: SparkSession, d: str) -> DataFrame:
    """Rows refused by a validated scan, by the check they fail; a check that is null fails."""
    rows = once(spark, d, "pages", "workspace_key", "host", "path", "semantic_revision", "content_fingerprint", "semantic_keywords_json")
    words = F.col("semantic_keywords_json")
    checks = {
        "key": F.col("workspace_key") == F.concat("host", F.lit("|"), "path"),
        "revision": F.col("semantic_revision") >= 1,
        "fingerprint": F.col("content_fingerprint").rlike("^[0-9a-f]{64}$"),
        "keywords": F.try_parse_json(words).isNotNull() & words.startswith("["),
    }
    _, refused = split_valid(rows, checks)
    return refused.select(F.explode("failed").alias("failed")).groupBy("failed").agg(F.count(F.lit(1)).alias("n"))


_CANON = "array_to_string(list_filter(string_split(nfc_normalize(relative_path), '/'), lambda s: s not in ('', '.')), '/')"


@R.query(
    "q_s8_tree",
    f"""with f as (select distinct {_CANON} as p, size_bytes from asset_files), u as (select array_to_string(list_slice(string_split(p, '/'), 1, i), '/') as dir, size_bytes from (select p, size_bytes, unnest(range(1, len(string_split(p, '/')))) as i from f))
    select dir, count(*) as n_files, cast(sum(size_bytes) as bigint) as n_bytes from u group by 1""",
)
def tree(spark: SparkSession, d: str) -> DataFrame:
    """Files and bytes at and below every directory of a snapshot."""
    f = table(spark, d, "asset_files").select(canonical_path(F.col("relative_path")).alias("p"), "size_bytes").distinct()
    parts = F.split("p", "/")
    deep = f.where(F.size(parts) > 1).select("size_bytes", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("dir"))
    return deep.groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("n_bytes"))


def _leaf_sql(t: str) -> str:
    return relate.merkle_sql(f"select distinct source_path, sha256({_CANON} || '|' || coalesce(size_bytes::varchar, '')) as h from {t}")


@R.query(
    "q_k6_verify",
    f"select coalesce(a.source_path, b.source_path) as source_path, case when b.digest is null then 'missing' when a.digest is null then 'unexpected' when a.digest = b.digest then 'equal' else 'mismatched' end as verdict from {_leaf_sql('asset_files')} a full join {_leaf_sql('asset_files_mirror')} b on a.source_path = b.source_path",
)
def verify(spark: SparkSession, d: str) -> DataFrame:
    """Manifests of two systems verified by one digest each."""
    line = F.concat_ws("|", canonical_path(F.col("relative_path")), F.coalesce(F.col("size_bytes").cast("string"), F.lit("")))
    digest = lambda n: relate.merkle_digest(table(spark, d, n), ["source_path"], line).select("source_path", "digest")
    return relate.full_diff(digest("asset_files"), digest("asset_files_mirror"), ["source_path"], "digest")


@R.query(
    "q_k8_changed",
    """with a as (select nullif(trim(asset_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '') as asset_id, count(*) as n, sum(size_bytes) as b from asset_files group by 1), m as (select nullif(trim(asset_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '') as asset_id, count(*) as n, sum(size_bytes) as b from asset_files_mirror group by 1)
    select a.asset_id, a.n from a left join m on a.asset_id = m.asset_id and a.n = m.n and a.b is not distinct from m.b where a.asset_id is not null and m.asset_id is null""",
)
def changed(spark: SparkSession, d: str) -> DataFrame:
    """What a replica must be sent: assets whose fingerprint it does not have."""
    stat = lambda n: table(spark, d, n).groupBy(stripped(F.col("asset_id")).alias("asset_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("b"))
    a, m = stat("asset_files").where("asset_id is not null"), stat("asset_files_mirror").select(F.col("asset_id").alias("id"), F.col("n").alias("m"), F.col("b").alias("c"))
    return a.join(m, (F.col("asset_id") == F.col("id")) & (F.col("n") == F.col("m")) & F.col("b").eqNullSafe(F.col("c")), "left_anti").select("asset_id", "n")


@R.query(
    "q_f9_root_class",
    """with p as (select distinct host, source_path from object_sources), x as (select distinct host, path from pages where storage_pool = 'ISOLATED')
    select class, count(*) as n from (select case when p.host <> 'orchard' then 'external' when exists (select 1 from x where x.host = p.host and (p.source_path = x.path or starts_with(p.source_path, x.path || '/'))) then 'isolated' when starts_with(p.source_path, '/pool/') then 'managed' else 'other' end as class from p) group by 1""",
)
def root_class(spark: SparkSession, d: str) -> DataFrame:
    """Paths classified by host, by roots with exceptions and by prefix, first match first."""
    roots = table(spark, d, "pages").where("storage_pool = 'ISOLATED'").select("host", F.col("path").alias("root"))
    p = relate.deepest_root(once(spark, d, "object_sources", "host", "source_path"), roots, ["host"], "source_path", "root")
    kind = F.when(F.col("host") != "orchard", "external").when(F.col("root").isNotNull(), "isolated").when(F.col("source_path").startswith("/pool/"), "managed").otherwise("other")
    return p.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@R.query(
    "q_f11_members",
    """with r as (select distinct path as root from pages where state = 'WARM'), s as (select distinct source_path from object_sources)
    select source_path from s where exists (select 1 from r where s.source_path = r.root or starts_with(s.source_path, r.root || '/'))""",
)
def members(spark: SparkSession, d: str) -> DataFrame:
    """Paths at or below any of a set of roots: a semi-join on exploded ancestors."""
    roots = table(spark, d, "pages").where("state = 'WARM'").select(F.col("path").alias("up"))
    s = once(spark, d, "object_sources", "source_path")
    return s.select("source_path", F.explode(relate.ancestors(F.col("source_path"))).alias("up")).join(roots, "up", "left_semi").select("source_path").distinct()


@R.query(
    "q_a8_histogram",
    f"select state, age, count(*) as n from (select distinct workspace_key, state, case when updated_at >= {NOW} - 30 * {DAY} then 'month' when updated_at >= {NOW} - 365 * {DAY} then 'year' else 'older' end as age from pages) group by 1, 2",
)
def histogram(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("updated_at")
    age = F.when(at >= NOW - 30 * DAY, "month").when(at >= NOW - 365 * DAY, "year").otherwise("older")
    return table(spark, d, "pages").select("workspace_key", "state", age.alias("age")).distinct().groupBy("state", "age").agg(F.count(F.lit(1)).alias("n"))


@R.query(
    "q_j8_index_hits",
    """with t as (select distinct source_path, relative_path, unnest(string_split_regex(lower(relative_path), '[^a-z0-9]+')) as token from asset_files)
    select source_path, relative_path from t where token in ('index', 'notes', 'md') group by 1, 2 having count(distinct token) = 3""",
)
def index_hits(spark: SparkSession, d: str) -> DataFrame:
    """Files found through postings of their path's tokens, all terms required."""
    terms = ("index", "notes", "md")
    tokens = F.array_distinct(F.split(F.lower("relative_path"), "[^a-z0-9]+"))
    postings = table(spark, d, "asset_files").select("source_path", "relative_path", F.explode(tokens).alias("token"))
    hits = postings.where(F.col("token").isin(*terms)).groupBy("source_path", "relative_path").agg(F.count_distinct("token").alias("n"))
    return hits.where(F.col("n") == len(terms)).select("source_path", "relative_path")


def queries():
    return R.queries()


def oracle_sql():
    return R.oracle_sql()
