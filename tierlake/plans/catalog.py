"""The catalogue projection, gated and tiered searches, and checks that need several tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.functions import text as TX
from tierlake.functions.keys import digest_key, stripped
from tierlake.functions.privacy import findings, findings_sql
from tierlake.operators import relate
from tierlake.plans.registry import Registry
from tierlake.plans.relational import _dig, once
from tierlake.plans.sequences import top_k
from tierlake.plans.texts import _ASSET, _LINES, _MENTIONS, _PATH, doc_lines, mentions
from tierlake.sources.tables import table

R = Registry()
_TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"
#: Words that must not leave, and what is looked for in several kinds of records.
DENY = ("dusky-loom", "curator")
NEEDLE = "kiln"
#: Words by which a line says that what it names is not there any more.
ABSENT = "removed|deleted|renamed|moved|gone"


@R.query(
    "q_k5_catalog",
    f"""with a as (select distinct asset_id, lower(host) as host, rtrim(original_path, '/') as path, local_state, coalesce(cloud_verified, false) as cloud, size_bytes, classification_reason as reason, starts_with(asset_id, 'v2-') as old
        from assets where starts_with(asset_id, 'v2-') or starts_with(asset_id, 'logical-v3-')),
      r as (select *, case when not old then 2 when cloud then 1 else 3 end as rank from a),
      w as (select * from (select *, row_number() over (partition by host, path order by rank, asset_id) as rn, bool_or(rank = 3) over (partition by host, path) and rank = 2 as superseded from r) where rn = 1),
      f as (select {_TRIM.format('asset_id')} as asset_id, count(*) as n_files, sum(size_bytes) as n_bytes from (select distinct source_path, relative_path, asset_id, size_bytes from asset_files) group by 1),
      p as (select distinct workspace_key, lower(host) as host, path, {_TRIM.format('cloud_asset_id')} as asset_id, local_present, struct_pack(r := semantic_revision, w := workspace_key) as o, struct_pack(r := semantic_revision, s := semantic_summary, k := semantic_keywords_json) as s from pages),
      x as (select asset_id, arg_max(s, o) as s from p where asset_id <> '' group by 1), y as (select host, path, arg_max(s, o) as s, max(local_present) as present from p group by 1, 2),
      j as (select w.*, coalesce(f.n_files, 0) as n_files, cast(f.n_bytes as bigint) as n_bytes, coalesce(x.s, y.s) as s, coalesce(y.present = 1, w.local_state <> 'cloud_only', false) as here,
        case when x.s is not null then 'id' when y.s is not null then 'path' else 'none' end as found_by
        from w left join f on w.asset_id = f.asset_id left join x on w.asset_id = x.asset_id left join y on w.host = y.host and w.path = y.path)
    select asset_id, host, path, case when old then 'v2' else 'v3' end as kind, case when cloud then 'confirmed' else 'pending' end as cloud_state, case when here and cloud then 'replicated' when cloud then 'cloud_only' else 'local' end as local_state,
      coalesce(size_bytes, n_bytes, 0) as size_bytes, n_files, array_to_string(list_sort(list_distinct(list_concat([asset_id, regexp_extract(path, '[^/]*$')], case when reason <> '' then [reason] else [] end, coalesce(cast(s.k as varchar[]), [])))), '|') as keywords,
      coalesce(s.r, 0) as semantic_revision, coalesce(s.s, reason) as summary, found_by, superseded from j""",
)
def catalog_projection(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue: both kinds of assets in one row a place, with the sums of their files and their meaning.

    A confirmed asset of the older kind comes first, then the newer kind, then an older one without proof, which the
    newer kind supersedes. The meaning is that of the page naming the asset, else of the page at its place, the highest
    revision first.
    """
    old, cloud = F.col("asset_id").startswith("v2-"), F.coalesce("cloud_verified", F.lit(False))
    a = table(spark, d, "assets").where(old | F.col("asset_id").startswith("logical-v3-"))
    a = a.select("asset_id", F.lower("host").alias("host"), F.rtrim("original_path", F.lit("/")).alias("path"), F.when(~old, 2).when(cloud, 1).otherwise(3).alias("rank"), old.alias("old"), cloud.alias("cloud"), "local_state", "size_bytes", F.col("classification_reason").alias("reason")).distinct()
    best = a.groupBy("host", "path").agg(F.min(F.struct("rank", "asset_id", "old", "cloud", "local_state", "size_bytes", "reason")).alias("b"), F.bool_or(F.col("rank") == 3).alias("placeholder"))
    w = best.select("host", "path", "b.*", (F.col("placeholder") & (F.col("b.rank") == 2)).alias("superseded"))
    files = once(spark, d, "asset_files", "source_path", "relative_path", "asset_id", "size_bytes").groupBy(stripped(F.col("asset_id")).alias("asset_id")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("n_bytes"))
    pages = table(spark, d, "pages").select("workspace_key", F.lower("host").alias("host"), "path", stripped(F.col("cloud_asset_id")).alias("asset_id"), "local_present", "semantic_revision", "semantic_summary", "semantic_keywords_json")
    meaning = F.max(F.struct(F.col("semantic_revision").alias("r"), "workspace_key", F.col("semantic_summary").alias("s"), F.col("semantic_keywords_json").alias("k")))
    by_id = pages.where("asset_id is not null").groupBy("asset_id").agg(meaning.alias("x"))
    by_path = pages.groupBy("host", "path").agg(meaning.alias("y"), F.max("local_present").alias("present"))
    j = w.join(files, "asset_id", "left").join(by_id, "asset_id", "left").join(by_path, ["host", "path"], "left")
    s = lambda c: F.when(F.col("x").isNotNull(), F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))
    here = F.coalesce(F.col("present") == 1, F.col("local_state") != "cloud_only", F.lit(False))
    words = F.array_compact(F.array("asset_id", F.regexp_extract("path", "([^/]*)$", 1), F.when(F.col("reason") != "", F.col("reason"))))
    words = F.array_union(words, F.coalesce(F.from_json(s("k"), "array<string>"), F.array().cast("array<string>")))
    return j.select(
        "asset_id", "host", "path", F.when(F.col("old"), "v2").otherwise("v3").alias("kind"), F.when(F.col("cloud"), "confirmed").otherwise("pending").alias("cloud_state"),
        F.when(here & F.col("cloud"), "replicated").when(F.col("cloud"), "cloud_only").otherwise("local").alias("local_state"),
        F.coalesce("size_bytes", "n_bytes", F.lit(0)).alias("size_bytes"), F.coalesce("n_files", F.lit(0)).alias("n_files"), F.array_join(F.array_sort(words), "|").alias("keywords"),
        F.coalesce(s("r"), F.lit(0)).alias("semantic_revision"), F.coalesce(s("s"), "reason").alias("summary"),
        F.when(F.col("x").isNotNull(), "id").when(F.col("y").isNotNull(), "path").otherwise("none").alias("found_by"), "superseded",
    )


@R.query("q_k5_manifest", f"select {_TRIM.format('f.asset_id')} || chr(9) || f.relative_path || chr(9) || coalesce(f.size_bytes::varchar, '') || chr(9) || 'file' as line from (select distinct asset_id, relative_path, size_bytes from asset_files) f where {_TRIM.format('f.asset_id')} in (select asset_id from assets where cloud_verified)")
def catalog_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Tab-separated lines of the files of confirmed assets."""
    confirmed = table(spark, d, "assets").where("cloud_verified").select("asset_id")
    f = table(spark, d, "asset_files").select(stripped(F.col("asset_id")).alias("asset_id"), F.col("asset_id").alias("raw"), "relative_path", "size_bytes").distinct().join(confirmed, "asset_id", "left_semi")
    return f.select(F.concat_ws("\t", "asset_id", "relative_path", F.coalesce(F.col("size_bytes").cast("string"), F.lit("")), F.lit("file")).alias("line"))


@R.query("q_l8_privacy", findings_sql(_LINES, "doc_id, pos", DENY))
def privacy(spark: SparkSession, d: str) -> DataFrame:
    """Findings of every line by family, with the allow-lists of the families and a deny-list."""
    lines = doc_lines(spark, d).where("line <> ''")
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.inline(findings(F.col("line"), DENY, release=True)))


@R.query(
    "q_s3_two_bodies",
    f"""select digest, host, source_path, count(*) as n_bodies from (select distinct {_dig('digest')} as digest, host, source_path, source_state, last_verified_at from object_sources) group by 1, 2, 3 having count(*) > 1""",
)
def two_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Keys that come with different bodies, which a validated scan refuses."""
    rows = table(spark, d, "object_sources").select(digest_key(F.col("digest")).alias("digest"), "host", "source_path", "source_state", "last_verified_at").distinct()
    return rows.groupBy("digest", "host", "source_path").agg(F.count(F.lit(1)).alias("n_bodies")).where("n_bodies > 1")


@R.query(
    "q_j16_child_refs",
    f"""with m as (select distinct doc_id, regexp_replace(name, '^~', '/pool') as path from (select doc_id, unnest(regexp_extract_all(text, '(?:/pool|~)/ws/[A-Za-z0-9._/-]*[A-Za-z0-9]')) as name from documents where text is not null)),
      u as (select doc_id, path, '/' || array_to_string(list_slice(list_filter(string_split(path, '/'), lambda s: s <> ''), 1, i), '/') as root from (select doc_id, path, unnest(range(1, len(string_split(path, '/')) + 1)) as i from m)),
      r as (select distinct asset_id, rtrim(original_path, '/') as root from assets)
    select doc_id, asset_id, bool_or(path <> u.root) as child_ref, bool_or(path = u.root) as exact from u join r on u.root = r.root group by 1, 2""",
)
def child_references(spark: SparkSession, d: str) -> DataFrame:
    """Assets whose path, or a path below it, is named in a text, whole segments only and ``~`` standing for the pool."""
    named = mentions(spark, d, "(?:/pool|~)/ws/[A-Za-z0-9._/-]*[A-Za-z0-9]").select("doc_id", F.regexp_replace("name", "^~", "/pool").alias("path")).distinct()
    roots = table(spark, d, "assets").select("asset_id", F.rtrim("original_path", F.lit("/")).alias("root")).distinct()
    up = named.select("doc_id", "path", F.explode(relate.ancestors(F.col("path"))).alias("root"))
    return up.join(roots, "root").groupBy("doc_id", "asset_id").agg(F.bool_or(F.col("path") != F.col("root")).alias("child_ref"), F.bool_or(F.col("path") == F.col("root")).alias("exact"))


@R.query(
    "q_l4_dead_references",
    f"""select name, count(distinct doc_id) as n_docs from (select doc_id, unnest(regexp_extract_all(line, '{_PATH}')) as name from {_LINES} where not regexp_matches(lower(line), '(^|[^a-z])({ABSENT})($|[^a-z])'))
    where name not in (select rtrim(original_path, '/') from assets) group by 1""",
)
def dead_references(spark: SparkSession, d: str) -> DataFrame:
    """Named paths that no asset has, but for lines that say so."""
    lines = doc_lines(spark, d).where(F.contains("line", F.lit("/pool/ws/"))).where(~F.lower("line").rlike(f"(^|[^a-z])({ABSENT})($|[^a-z])"))
    named = lines.select("doc_id", F.explode(TX.mentions(F.col("line"), _PATH)).alias("name")).groupBy("name").agg(F.count_distinct("doc_id").alias("n_docs"))
    return named.join(table(spark, d, "assets").select(F.rtrim("original_path", F.lit("/")).alias("name")), "name", "left_anti")


@R.query(
    "q_r4_gated",
    f"""with s as (select source_path, count(*) as n, sum(size_bytes) as b from (select distinct source_path, relative_path, size_bytes from asset_files) group by 1), m as (select source_path, count(*) as n, sum(size_bytes) as b from (select distinct source_path, relative_path, size_bytes from asset_files_mirror) group by 1),
      g as (select s.source_path, m.source_path is not null and s.n = m.n and s.b is not distinct from m.b as current from s left join m on s.source_path = m.source_path),
      h as (select distinct 'index' as found_in, source_path, relative_path from asset_files_mirror where contains(lower(relative_path), '{NEEDLE}') and source_path in (select source_path from g where current)
        union select distinct 'local', source_path, relative_path from asset_files where contains(lower(relative_path), '{NEEDLE}') and source_path in (select source_path from g where not current))
    select found_in, source_path, count(*) as n_hits from h group by 1, 2""",
)
def gated_search(spark: SparkSession, d: str) -> DataFrame:
    """A search of an index that is asked only for manifests it holds as they are; the others are searched themselves."""
    stat = lambda n: once(spark, d, n, "source_path", "relative_path", "size_bytes").groupBy("source_path").agg(F.struct(F.count(F.lit(1)), F.sum("size_bytes")).alias("stat"))
    gate = relate.full_diff(stat("asset_files"), stat("asset_files_mirror"), ["source_path"], "stat").where("verdict <> 'unexpected'").select("source_path", (F.col("verdict") == "equal").alias("current"))
    hits = lambda n, where: table(spark, d, n).where(F.contains(F.lower("relative_path"), F.lit(NEEDLE))).select(F.lit(where).alias("found_in"), "source_path", "relative_path")
    both = hits("asset_files_mirror", "index").unionByName(hits("asset_files", "local")).join(gate, "source_path").where((F.col("found_in") == "index") == F.col("current"))
    return both.distinct().groupBy("found_in", "source_path").agg(F.count(F.lit(1)).alias("n_hits"))


_HITS = f"""with h as (select 'workspace' as kind, workspace_key as name, 60 as score from (select distinct workspace_key, path from pages) where contains(path, '{NEEDLE}')
      union all select 'asset', asset_id, case when bool_or(coalesce(cloud_verified, false)) then 60 else 25 end from assets where contains(asset_id, '{NEEDLE}') group by 2
      union all select 'file', source_path, cast(25 + 5 * least(count(*), 20) as int) from (select distinct source_path, relative_path from asset_files where contains(relative_path, '{NEEDLE}')) group by 2
      union all select 'runbook', doc_id::varchar, cast(25 + 5 * least(k, 20) as int) from (select doc_id, (length(low) - length(replace(low, '{NEEDLE}', ''))) // {len(NEEDLE)} as k from (select doc_id, lower(text) as low from documents where kind = 'runbook')) where k > 0
      union all select 'object', digest, cast(case when bool_or(source_state = 'HASH_VERIFIED') then 60 else 25 end + 5 * least(count(*), 20) - case when bool_and(source_state = 'MISSING') then 20 else 0 end as int)
        from (select distinct {_dig('digest')} as digest, host, source_path, source_state from object_sources where contains(source_path, '{NEEDLE}')) where digest is not null group by 2)
    """


@R.query("q_r6_unified", _HITS + "select row_number() over (order by score desc, kind, name) as rank, kind, name, score from h order by rank limit 100")
def unified(spark: SparkSession, d: str) -> DataFrame:
    """Hits of five kinds in one ranking: confirmed ones higher, several hits of one record more, missing ones lower."""
    hit = lambda c: F.contains(c, F.lit(NEEDLE))
    shaped = lambda df, kind, name: df.select(F.lit(kind).alias("kind"), name.alias("name"), F.col("score").cast("int"))
    several = lambda n: 25 + 5 * F.least(n, F.lit(20))
    ws = once(spark, d, "pages", "workspace_key", "path").where(hit("path")).withColumn("score", F.lit(60))
    assets = table(spark, d, "assets").where(hit("asset_id")).groupBy("asset_id").agg(F.when(F.bool_or(F.coalesce("cloud_verified", F.lit(False))), 60).otherwise(25).alias("score"))
    files = once(spark, d, "asset_files", "source_path", "relative_path").where(hit("relative_path")).groupBy("source_path").agg(several(F.count(F.lit(1))).alias("score"))
    books = table(spark, d, "documents").where("kind = 'runbook'").select("doc_id", TX.occurrences(F.col("text"), NEEDLE).alias("k")).where("k > 0").withColumn("score", several(F.col("k")))
    sources = table(spark, d, "object_sources").where(hit("source_path")).select(digest_key(F.col("digest")).alias("digest"), "host", "source_path", "source_state").where("digest is not null").distinct()
    state = F.col("source_state")
    score = F.when(F.bool_or(state == "HASH_VERIFIED"), 60).otherwise(25) + 5 * F.least(F.count(F.lit(1)), F.lit(20)) - F.when(F.bool_and(state == "MISSING"), 20).otherwise(0)
    objects = sources.groupBy("digest").agg(score.alias("score"))
    parts = [shaped(ws, "workspace", F.col("workspace_key")), shaped(assets, "asset", F.col("asset_id")), shaped(files, "file", F.col("source_path")), shaped(books, "runbook", F.col("doc_id").cast("string")), shaped(objects, "object", F.col("digest"))]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    return top_k(hits, 100, F.desc("score"), F.asc("kind"), F.asc("name")).select("rank", "kind", "name", "score")


_PLACES = "(select distinct host, rtrim(original_path, '/') as path, regexp_extract(rtrim(original_path, '/'), '[^/]*$') as name from assets)"


@R.query(
    "q_r7_resolve",
    f"""with t as (select distinct name as target from {_MENTIONS.format(_PATH)} union select distinct regexp_replace(name, '^(logical-v3|v2)-', '') from {_MENTIONS.format(_ASSET)} union select distinct regexp_extract(name, '([a-z]+-[a-z]+)-[0-9a-z]+$', 1) from {_MENTIONS.format(_ASSET)}),
      p as (select *, string_split(name, '-') as w from {_PLACES}),
      c as (select path as target, 1 as tier, host, path from p union all select name, 2, host, path from p
        union all select array_to_string(w[i:j], '-'), 3, host, path from (select *, unnest(range(i, len(w) + 1)) as j from (select *, unnest(range(1, len(w) + 1)) as i from p)) where not (i = 1 and j = len(w)))
    select target, (min(struct_pack(t := tier, k := case when host = 'orchard' then 0 else 1 end, h := host, p := path))).t as tier, (min(struct_pack(t := tier, k := case when host = 'orchard' then 0 else 1 end, h := host, p := path))).h as host,
      (min(struct_pack(t := tier, k := case when host = 'orchard' then 0 else 1 end, h := host, p := path))).p as path from t join c using (target) where target <> '' group by 1""",
)
def resolve(spark: SparkSession, d: str) -> DataFrame:
    """Named targets resolved to a place: by its path, else its name, else words within its name, the preferred host first.

    Words within a name are its contiguous words, so the last tier is an equality too; each name's best place is found before the join.
    """
    assets, paths = mentions(spark, d, _ASSET), mentions(spark, d, _PATH)
    targets = paths.select(F.col("name").alias("target")).unionByName(assets.select(F.regexp_replace("name", "^(logical-v3|v2)-", "").alias("target"))).unionByName(assets.select(F.regexp_extract("name", "([a-z]+-[a-z]+)-[0-9a-z]+$", 1).alias("target"))).where("target <> ''").distinct()
    places = table(spark, d, "assets").select("host", F.rtrim("original_path", F.lit("/")).alias("path")).distinct().withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    w = F.split("name", "-")
    inner = F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(F.lit(1), F.size(w) - i + 1), lambda n: F.array_join(F.slice(w, i, n), "-"))))
    named = lambda c, tier: F.struct(c.alias("target"), F.lit(tier).alias("tier"))
    every = F.concat(F.array(named(F.col("path"), 1), named(F.col("name"), 2)), F.transform(F.filter(inner, lambda x: x != F.col("name")), lambda x: named(x, 3)))
    best = F.min(F.struct("tier", F.when(F.col("host") == "orchard", 0).otherwise(1).alias("k"), "host", "path"))
    known = places.select("host", "path", F.inline(every)).groupBy("target").agg(best.alias("b"))
    return targets.join(known, "target").select("target", "b.tier", "b.host", "b.path")


def _short(words: tuple[str, ...]) -> Column:
    """Whether a text holds all ``words`` without regard to case."""
    wanted = F.lit(True)
    for w in words:
        wanted = wanted & F.contains(F.lower("text"), F.lit(w))
    return wanted


@R.query("q_r3_short_terms", "select doc_id, n_chars from documents where contains(lower(text), 'gb') and contains(lower(text), 'as') and text is not null")
def short_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of less than three characters have no trigram, so they are looked for in the texts, without a rank."""
    return table(spark, d, "documents").where("text is not null").where(_short(("gb", "as"))).select("doc_id", "n_chars")


def queries():
    return R.queries()


def oracle_sql():
    return R.oracle_sql()
