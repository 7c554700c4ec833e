"""Functions, search, graph and text-scan queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.functions import text as TX
from tierlake.functions.keys import stripped
from tierlake.operators import relate
from tierlake.plans.registry import Registry
from tierlake.plans.relational import NOW, once
from tierlake.plans.sequences import events, top_k
from tierlake.sources.tables import table

R = Registry()
#: Search terms, their weights by field, and rules of domains in their order (fixed values).
KEYWORDS = ("kiln", "quarry", "sensor")
TERMS = ("lease", "snapshot", "drill")
WEIGHTS = {"path": 14, "semantic_summary": 12, "semantic_keywords_json": 10, "host": 8, "reason": 5}
DOMAINS = (("audio", "audio|recording"), ("imagery", "frames|tiles|masks|clips"), ("model", "model|checkpoint|vector"), ("record", "ledger|sheet|notes"))

_LINES = r"""(select doc_id, kind, i - 1 as pos, ls[i] as line from (select doc_id, kind, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, kind, string_split(replace(text, chr(13), ''), chr(10)) as ls from documents where text is not null)))"""
_ASSET, _PATH = TX.ASSET_ID, TX.WORKSPACE_PATH


def doc_lines(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return TX.lines(table(spark, d, "documents").where("text is not null"), "text", "doc_id", *keep)


# --- scalar functions ----------------------------------------------------------------------------------------------------


@R.query("q_c1_strings", "select distinct workspace_key, upper(host) as host, split_part(workspace_key, '|', 2) as tail, left(reason, 12) as head, lower(trim(coalesce(reason, ''))) as norm, replace(path, '/pool', '~') as alias from pages")
def strings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("workspace_key", F.upper("host").alias("host"), F.split_part("workspace_key", F.lit("|"), F.lit(2)).alias("tail"), F.left("reason", F.lit(12)).alias("head"), F.lower(F.trim(F.coalesce("reason", F.lit("")))).alias("norm"), F.replace("path", F.lit("/pool"), F.lit("~")).alias("alias")).distinct()


@R.query(
    "q_c2_paths",
    r"""select distinct source_path, regexp_replace(source_path, '/[^/]*$', '') as dir, regexp_extract(source_path, '[^/]*$') as base, len(list_filter(string_split(source_path, '/'), lambda s: s <> '')) as depth, starts_with(source_path, '/') as absolute, regexp_extract(source_path, '\.([a-z0-9]+)$', 1) as ext from object_sources""",
)
def paths(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("source_path")
    return table(spark, d, "object_sources").select(p, F.regexp_replace(p, "/[^/]*$", "").alias("dir"), F.regexp_extract(p, "([^/]*)$", 1).alias("base"), F.size(F.filter(F.split(p, "/"), lambda s: s != "")).cast("long").alias("depth"), p.startswith("/").alias("absolute"), F.regexp_extract(p, r"\.([a-z0-9]+)$", 1).alias("ext")).distinct()


@R.query("q_c3_labels", r"select distinct workspace_key, left(regexp_replace(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 28) || '-' || left(sha256(host || '|' || path), 16) as label from pages")
def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("workspace_key", F.concat(TX.slug(F.col("path")), F.lit("-"), F.left(F.sha2(F.concat("host", F.lit("|"), "path"), 256), F.lit(16))).alias("label")).distinct()


@R.query("q_c4_dependency_names", r"select distinct relative_path, lower(regexp_extract(relative_path, '^\s*([A-Za-z0-9_.-]+)', 1)) as name from asset_files")
def dependency_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "asset_files").select("relative_path", F.lower(F.regexp_extract("relative_path", r"^\s*([A-Za-z0-9_.-]+)", 1)).alias("name")).distinct()


@R.query("q_c5_regex", f"select doc_id, cast(len(regexp_extract_all(text, '{_ASSET}')) as bigint) as n_assets, regexp_extract(text, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) as first_date, regexp_matches(text, '(^|[^A-Za-z0-9_])GB($|[^A-Za-z0-9_])') as has_gb from documents where text is not null")
def regexes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_count("text", F.lit(_ASSET)).cast("long").alias("n_assets"), F.regexp_extract("text", "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).alias("first_date"), F.col("text").rlike("(^|[^A-Za-z0-9_])GB($|[^A-Za-z0-9_])").alias("has_gb"))


@R.query(
    "q_c6_terms",
    """with t as (select doc_id, list_concat(regexp_extract_all(lower(text), '[a-z0-9]{3,}'), flatten(list_transform(regexp_extract_all(text, '[぀-ヿ一-鿿]{3,}'), lambda r: list_transform(range(1, length(r) - 1), lambda i: substring(r, i, 3))))) as all_terms from documents where text is not null)
    select doc_id, cast(least(len(list_distinct(all_terms)), 48) as bigint) as n_terms from t""",
)
def terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(TX.search_terms(F.col("text"))).cast("long").alias("n_terms"))


_PAD = {n: "".join(f"\\x{(b ^ x):02X}" for b in TX.TEST_KEY.ljust(64, b"\0")) for n, x in (("inner", 0x36), ("outer", 0x5C))}


@R.query("q_c7_hashes", f"select distinct workspace_key, sha256(workspace_key) as sha_256, sha1(workspace_key) as sha_1, md5(workspace_key) as md_5, sha256('{_PAD['outer']}'::blob || unhex(sha256('{_PAD['inner']}'::blob || encode(workspace_key)))) as token, left(sha256(workspace_key), 2) as bucket from pages")
def hashes(spark: SparkSession, d: str) -> DataFrame:
    """Digests and a keyed token; the key here is public, a real one must not be part of a plan that is shown."""
    k = F.col("workspace_key")
    return table(spark, d, "pages").select(k, F.sha2(k, 256).alias("sha_256"), F.sha1(k).alias("sha_1"), F.md5(k).alias("md_5"), TX.keyed_token(k, TX.TEST_KEY).alias("token"), F.left(F.sha2(k, 256), F.lit(2)).alias("bucket")).distinct()


@R.query("q_c8_json", """select id, case when json_valid(metadata_json) then metadata_json->>'$.bytes' end as bytes, case when json_valid(metadata_json) then metadata_json->>'$.lease_hours' end as hours, json_valid(metadata_json) as valid from (select distinct id, metadata_json from pager_events)""")
def json(spark: SparkSession, d: str) -> DataFrame:
    """Fields of JSON text, null where it is cut off."""
    raw = F.col("metadata_json")
    valid = F.try_parse_json(raw).isNotNull()
    return once(spark, d, "pager_events", "id", "metadata_json").select("id", F.when(valid, F.get_json_object(raw, "$.bytes")).alias("bytes"), F.when(valid, F.get_json_object(raw, "$.lease_hours")).alias("hours"), valid.alias("valid"))


@R.query(
    "q_c9_times",
    """select distinct digest, epoch(cast(created_at as timestamptz)) as created, strftime(cast(created_at as timestamptz) at time zone 'UTC', '%Y-%m-%d') as day, cast(date_diff('day', cast(cast(created_at as timestamptz) at time zone 'UTC' as date), cast(cast(updated_at as timestamptz) at time zone 'UTC' as date)) as bigint) as days from objects""",
)
def times(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("created_at").try_cast("timestamp"), F.col("updated_at").try_cast("timestamp")
    return table(spark, d, "objects").select("digest", (F.unix_micros(a) / 1e6).alias("created"), F.date_format(a, "yyyy-MM-dd").alias("day"), F.datediff(b.cast("date"), a.cast("date")).cast("long").alias("days")).distinct()


@R.query("q_c10_math", "select distinct digest, cast(floor(plain_bytes / 1048576.0) as bigint) as mib, greatest(plain_bytes, coalesce(encrypted_bytes, 0)) as larger, abs(coalesce(encrypted_bytes, plain_bytes) - plain_bytes) <= 64 as close, plain_bytes % 1024 as rest from objects")
def math(spark: SparkSession, d: str) -> DataFrame:
    p, e = F.col("plain_bytes"), F.col("encrypted_bytes")
    return table(spark, d, "objects").select("digest", F.floor(p / 1048576.0).alias("mib"), F.greatest(p, F.coalesce(e, F.lit(0))).alias("larger"), (F.abs(F.coalesce(e, p) - p) <= 64).alias("close"), (p % 1024).alias("rest")).distinct()


@R.query("q_c11_nulls", "select distinct workspace_key, coalesce(nullif(last_access, 0), updated_at) as seen, coalesce(nullif(reason, ''), 'none') as reason, local_present = 0 as absent, local_present <> 0 as not_absent from pages")
def nulls(spark: SparkSession, d: str) -> DataFrame:
    """A default that also replaces zero and the empty text; three-valued presence."""
    return table(spark, d, "pages").select("workspace_key", F.coalesce(F.nullif("last_access", F.lit(0.0)), "updated_at").alias("seen"), F.coalesce(F.nullif("reason", F.lit("")), F.lit("none")).alias("reason"), (F.col("local_present") == 0).alias("absent"), (F.col("local_present") != 0).alias("not_absent")).distinct()


@R.query("q_c12_arrays", "select distinct workspace_key, cast(len(k) as bigint) as n, list_contains(k, 'frames') as has_frames, array_to_string(list_sort(list_transform(k, lambda x: upper(x))), '|') as upper_terms, len(list_filter(k, lambda x: length(x) < 5)) > 0 as some_short from (select workspace_key, cast(semantic_keywords_json as varchar[]) as k from pages)")
def arrays(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("semantic_keywords_json", "array<string>")
    return table(spark, d, "pages").select("workspace_key", F.size(k).cast("long").alias("n"), F.array_contains(k, "frames").alias("has_frames"), F.array_join(F.array_sort(F.transform(k, F.upper)), "|").alias("upper_terms"), F.exists(k, lambda x: F.length(x) < 5).alias("some_short")).distinct()


@R.query("q_c13_enums", "select distinct workspace_key, case redundancy_class when 'REGENERABLE' then 1 when 'CLOUD_ACCEPTED' then 1 when 'VALUABLE' then 2 when 'IRREPLACEABLE' then 3 end as copies from pages")
def enums(spark: SparkSession, d: str) -> DataFrame:
    from tierlake.plans.relational import MIN_COPIES

    pick: Column | None = None
    for name, n in MIN_COPIES.items():
        pick = F.when(F.col("redundancy_class") == name, n) if pick is None else pick.when(F.col("redundancy_class") == name, n)
    return table(spark, d, "pages").select("workspace_key", pick.alias("copies")).distinct()


@R.query("q_c14_redaction", f"""select doc_id, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not regexp_matches(line, 'REFUSE_|pid=')), '')) as digest, count(*) filter (where regexp_matches(line, 'REFUSE_|pid=')) as n_dropped from {_LINES} where kind = 'receipt' group by 1""")
def redaction(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a blocked pattern dropped, the rest joined again in order; within a text, so no shuffle."""
    ls = F.split(F.regexp_replace("text", "\r", ""), "\n")
    keep = F.filter(ls, lambda x: ~x.rlike("REFUSE_|pid="))
    return table(spark, d, "documents").where("text is not null and kind = 'receipt'").select("doc_id", F.sha2(F.array_join(keep, "\n"), 256).alias("digest"), (F.size(ls) - F.size(keep)).cast("long").alias("n_dropped"))


@R.query("q_c15_pairs", f"select action, cast(count(*) as bigint) as n, cast(sum(hours) as bigint) as hours from (select regexp_extract(line, 'action=([A-Z_]+)', 1) as action, cast(regexp_extract(line, 'lease=([0-9]+)h', 1) as bigint) as hours from {_LINES} where regexp_matches(line, '^[0-9TZ:-]+ INFO  page=[^ ]+ action=[A-Z_]+ lease=[0-9]+h$')) group by 1")
def pairs(spark: SparkSession, d: str) -> DataFrame:
    """``key=value`` texts as maps."""
    ls = doc_lines(spark, d).where(F.col("line").rlike("^[0-9TZ:-]+ INFO  page=[^ ]+ action=[A-Z_]+ lease=[0-9]+h$"))
    kv = F.str_to_map(F.regexp_replace("line", "^[^ ]+ INFO  ", ""), F.lit(" "), F.lit("="))
    return ls.select(kv.alias("kv")).groupBy(F.col("kv")["action"].alias("action")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.rtrim(F.col("kv")["lease"], F.lit("h")).cast("long")).alias("hours"))


# --- scans of texts ------------------------------------------------------------------------------------------------------


@R.query("q_s1_json_lines", f"select cast(count(*) as bigint) as n, cast(sum(cast(json_extract(line, '$.free_gib') as bigint)) as bigint) as free_gib, count(distinct line->>'$.asset_id') as n_assets from {_LINES} where line like '{{\"asset_id\":%' and json_valid(line)")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    parsed = doc_lines(spark, d).where(F.col("line").startswith('{"asset_id":')).select(F.from_json("line", "asset_id string, free_gib long, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("j"))
    return parsed.where("j._corrupt is null").agg(F.count(F.lit(1)).alias("n"), F.sum("j.free_gib").alias("free_gib"), F.count_distinct("j.asset_id").alias("n_assets"))


@R.query(
    "q_s5_positional",
    r"select state, count(*) as n, count(distinct label) as n_labels from (select line[5] as state, line[2] as label from (select string_split(line, chr(9)) as line from " + _LINES + r" where not starts_with(line, '#')) where len(line) = 5) group by 1",
)
def positional(spark: SparkSession, d: str) -> DataFrame:
    f = doc_lines(spark, d).where(~F.col("line").startswith("#")).select(F.split("line", "\t").alias("f")).where(F.size("f") == 5)
    return f.groupBy(F.col("f")[4].alias("state")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("f")[1]).alias("n_labels"))


_SECTIONED = f"(select *, last_value(case when starts_with(line, '## ') then trim(substring(line, 4)) end ignore nulls) over (partition by doc_id order by pos rows unbounded preceding) as section from {_LINES} where kind = 'handoff')"


def sectioned(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, section, body): each text's sections as arrays of lines, folded within the row, so no shuffle."""
    ls = F.split(F.regexp_replace("text", "\r", ""), "\n")
    blocks = F.split(F.concat(F.lit("\n"), F.array_join(ls, "\n")), "\n## ")
    docs = table(spark, d, "documents").where("text is not null and kind = 'handoff'").select("doc_id", F.posexplode(blocks).alias("k", "block"))
    cut = F.split("block", "\n")
    return docs.where("k > 0").select("doc_id", "k", F.trim(cut[0]).alias("section"), F.slice(cut, 2, F.size(cut)).alias("body"))


@R.query("q_s9_sections", f"select doc_id, section, count(*) filter (where trim(line) <> '' and not starts_with(line, '## ')) as n_lines from {_SECTIONED} where section is not null group by 1, 2")
def sections(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.filter("body", lambda x: F.trim(x) != ""))
    return sectioned(spark, d).groupBy("doc_id", "section").agg(F.sum(n).alias("n_lines"))


FIELDS = ("What", "Progress", "Next gate", "Blocker", "Skills")
_COLUMN = {f: f.lower().replace(" ", "_") for f in FIELDS}


@R.query(
    "q_s9_record",
    f"""with l as (select *, last_value(case when starts_with(line, '## ') then pos end ignore nulls) over (partition by doc_id order by pos rows unbounded preceding) as head from {_SECTIONED}),
      f as (select doc_id, section, head, arg_min(trim(line), pos) as first_line from l where section is not null and trim(line) <> '' and not starts_with(line, '## ') group by all),
      v as (select doc_id, {', '.join(f"arg_max(first_line, head) filter (where section = '{f}') as {c}" for f, c in _COLUMN.items())} from f group by 1),
      t as (select doc_id, nullif(regexp_extract(arg_min(line, pos), '({_PATH})', 1), '') as path from {_LINES} where kind = 'handoff' and starts_with(line, '# /') group by 1),
      m as (select doc_id, count(*) as n_dependencies from {{MENTIONS_PATH}} m left join t using (doc_id) where name is distinct from path group by 1), a as (select doc_id, count(*) as n_assets from {{MENTIONS_ASSET}} group by 1)
    select d.doc_id, t.path, {', '.join(_COLUMN.values())}, coalesce(n_dependencies, 0) as n_dependencies, coalesce(n_assets, 0) as n_assets
    from (select doc_id from documents where kind = 'handoff' and text is not null) d left join t using (doc_id) left join v using (doc_id) left join m using (doc_id) left join a using (doc_id)""".replace("{MENTIONS_PATH}", f"(select distinct doc_id, unnest(regexp_extract_all(text, '{_PATH}')) as name from documents where text is not null)").replace("{MENTIONS_ASSET}", f"(select distinct doc_id, unnest(regexp_extract_all(text, '{_ASSET}')) as name from documents where text is not null)"),
)
def record(spark: SparkSession, d: str) -> DataFrame:
    """Hand-offs as records: the path of the title, the first line of each field (the last section of a name that has one), and what they name; within a text, so only the fields are shuffled."""
    first = F.element_at(F.filter("body", lambda x: F.trim(x) != ""), 1)
    s = sectioned(spark, d).select("doc_id", "k", "section", F.trim(F.when(F.exists("body", lambda x: F.trim(x) != ""), first)).alias("first_line")).where("first_line is not null")
    fields = s.where(F.col("section").isin(*FIELDS)).groupBy("doc_id").agg(*(F.max_by(F.when(F.col("section") == f, F.col("first_line")), F.when(F.col("section") == f, F.col("k"))).alias(c) for f, c in _COLUMN.items()))
    ls = F.split(F.regexp_replace("text", "\r", ""), "\n")
    heads = F.filter(ls, lambda x: x.startswith("# /"))
    title = F.when(F.size(heads) > 0, F.nullif(F.regexp_extract(heads[0], f"({_PATH})", 1), F.lit("")))
    paths = TX.mentions(F.col("text"), _PATH)
    docs = table(spark, d, "documents").where("text is not null and kind = 'handoff'").select("doc_id", title.alias("path"), paths.alias("paths"), F.size(TX.mentions(F.col("text"), _ASSET)).cast("long").alias("n_assets"))
    others = F.size("paths") - F.coalesce(F.array_contains("paths", F.col("path")).cast("int"), F.lit(0))
    return docs.join(fields, "doc_id", "left").select("doc_id", "path", *_COLUMN.values(), others.cast("long").alias("n_dependencies"), "n_assets")


@R.query("q_w7_last_field", f"select doc_id, max_by(line, pos) as last_line, count(distinct section) as n_sections from {_SECTIONED} where section is not null and trim(line) <> '' group by 1")
def last_field(spark: SparkSession, d: str) -> DataFrame:
    """The last occurrence wins: the last line that is not blank, headings included."""
    s = table(spark, d, "documents").where("text is not null and kind = 'handoff'").select("doc_id", F.split(F.regexp_replace("text", "\r", ""), "\n").alias("ls"))
    at = F.filter("ls", lambda x: F.trim(x) != "")
    last = s.where(F.exists("ls", lambda x: x.startswith("## "))).select("doc_id", F.element_at(at, -1).alias("last_line"))
    return last.join(sectioned(spark, d).groupBy("doc_id").agg(F.count_distinct("section").alias("n_sections")), "doc_id")


@R.query("q_s10_frames", f"select doc_id, regexp_extract(line, '({_PATH})', 1) as path, pos from {_LINES} where starts_with(line, '# /')")
def frames(spark: SparkSession, d: str) -> DataFrame:
    heads = doc_lines(spark, d).where(F.col("line").startswith("# /"))
    return heads.select("doc_id", F.regexp_extract("line", f"({_PATH})", 1).alias("path"), F.col("pos").cast("long").alias("pos"))


_MENTIONS = "(select distinct doc_id, unnest(regexp_extract_all(text, '{0}')) as name from documents where text is not null)"


def mentions(spark: SparkSession, d: str, pattern: str, *keep: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", *keep, F.explode(TX.mentions(F.col("text"), pattern)).alias("name"))


@R.query("q_s12_references", f"select name, count(*) as n_docs, array_to_string(list_sort(list(distinct kind)), '|') as labels from (select doc_id, name, kind from {_MENTIONS.format(_PATH)} m join (select doc_id, kind from documents) using (doc_id)) group by 1")
def references(spark: SparkSession, d: str) -> DataFrame:
    """Named paths with the number of texts and the kinds of these as labels."""
    return mentions(spark, d, _PATH, "kind").groupBy("name").agg(F.count(F.lit(1)).alias("n_docs"), F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("labels"))


@R.query("q_j16_mentioned_assets", f"select m.doc_id, a.asset_id from {_MENTIONS.format(_ASSET)} m join (select distinct asset_id from assets) a on m.name = a.asset_id")
def mentioned_assets(spark: SparkSession, d: str) -> DataFrame:
    """Assets named in texts: names are taken out and joined by equality, not searched one by one."""
    return mentions(spark, d, _ASSET).join(once(spark, d, "assets", "asset_id"), F.col("name") == F.col("asset_id")).select("doc_id", "asset_id")


@R.query(
    "q_l1_defects",
    f"""with s as (select doc_id, max(case when starts_with(line, '# ') then 1 else 0 end) as titled, count(*) filter (where starts_with(line, '## ')) as n_heads, max(case when regexp_matches(line, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then 1 else 0 end) as dated from {_LINES} where kind = 'handoff' group by 1)
    select doc_id, concat_ws(',', case when titled = 0 then 'title' end, case when n_heads < 2 then 'sections' end, case when dated = 0 then 'date' end) as defects from s where titled = 0 or n_heads < 2 or dated = 0""",
)
def defects(spark: SparkSession, d: str) -> DataFrame:
    ls = F.split(F.regexp_replace("text", "\r", ""), "\n")
    heads = F.size(F.filter(ls, lambda x: x.startswith("## ")))
    found = F.concat_ws(",", F.when(~F.exists(ls, lambda x: x.startswith("# ")), "title"), F.when(heads < 2, "sections"), F.when(~F.exists(ls, lambda x: x.rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}")), "date"))
    return table(spark, d, "documents").where("text is not null and kind = 'handoff'").select("doc_id", found.alias("defects")).where("defects <> ''")


#: Seconds after writing in which an empty section is excused.
GRACE = 1800


@R.query("q_l2_empty_sections", f"select doc_id, section from {_SECTIONED} join (select doc_id from documents where written_at is null or epoch(written_at) <= {NOW} - {GRACE}) using (doc_id) where section is not null group by 1, 2 having count(*) filter (where trim(line) <> '' and not starts_with(line, '## ')) = 0")
def empty_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections without a line, but for texts written within the grace time before the clock."""
    settled = table(spark, d, "documents").where(F.col("written_at").isNull() | (F.unix_seconds(F.col("written_at").cast("timestamp")) <= NOW - GRACE)).select("doc_id")
    return sections(spark, d).where("n_lines = 0").join(settled, "doc_id", "left_semi").select("doc_id", "section")


@R.query(
    "q_l5_drift",
    r"""select doc_id, cast(date_diff('day', cast(written_at as date), max(day)) as bigint) as days from (select doc_id, written_at, try_cast(unnest(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) as date) as day from documents where text is not null and written_at is not null) where day is not null group by doc_id, written_at having date_diff('day', cast(written_at as date), max(day)) > 21""",
)
def drift(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose newest date is more than 21 days after they were written."""
    dates = F.transform(F.regexp_extract_all("text", F.lit("([0-9]{4}-[0-9]{2}-[0-9]{2})"), F.lit(1)), lambda x: x.try_cast("date"))
    days = F.datediff(F.array_max(dates), F.col("written_at").cast("date")).cast("long")
    return table(spark, d, "documents").where("text is not null and written_at is not null").select("doc_id", days.alias("days")).where("days > 21")


@R.query("q_l6_both_sides", "select path, count(distinct host) as n_hosts from pages where semantic_summary is null or semantic_summary = '' group by 1 having count(distinct host) > 1")
def both_sides(spark: SparkSession, d: str) -> DataFrame:
    blank = F.col("semantic_summary").isNull() | (F.col("semantic_summary") == "")
    return table(spark, d, "pages").where(blank).groupBy("path").agg(F.count_distinct("host").alias("n_hosts")).where("n_hosts > 1")


@R.query("q_l9_markers", r"select asset_id, bool_or(regexp_matches(relative_path, '\.(db|sqlite3?)$')) as db, bool_or(regexp_matches(relative_path, '-(wal|journal)$')) as sidecar, bool_or(regexp_matches(relative_path, '(^|/)ledger_[0-9]+')) as has_ledger from (select nullif(trim(asset_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '') as asset_id, relative_path from asset_files) group by 1")
def markers(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("relative_path")
    return table(spark, d, "asset_files").groupBy(stripped(F.col("asset_id")).alias("asset_id")).agg(F.bool_or(p.rlike(r"\.(db|sqlite3?)$")).alias("db"), F.bool_or(p.rlike("-(wal|journal)$")).alias("sidecar"), F.bool_or(p.rlike("(^|/)ledger_[0-9]+")).alias("has_ledger"))


# --- search --------------------------------------------------------------------------------------------------------------


def weighted(columns: dict[str, int], keywords: tuple[str, ...]) -> Column:
    """Sum of the weights of the fields that hold each keyword, and 20 if every keyword is found."""
    zero = F.lit(0)
    per = [sum((F.when(F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(k)), w).otherwise(0) for c, w in columns.items()), zero) for k in keywords]
    return sum(per, zero) + F.when(F.least(*per, *per[:1]) > 0, 20).otherwise(0)


def _weighted_sql(columns: dict[str, int], keywords: tuple[str, ...]) -> str:
    per = ["(" + " + ".join(f"case when contains(lower(coalesce({c}, '')), '{k}') then {w} else 0 end" for c, w in columns.items()) + ")" for k in keywords]
    return " + ".join(per) + f" + case when least({', '.join([*per, per[0]])}) > 0 then 20 else 0 end"


@R.query("q_r1_weighted_search", f"select row_number() over (order by score desc, workspace_key) as rank, workspace_key, score from (select workspace_key, {_weighted_sql(WEIGHTS, KEYWORDS)} as score from (select distinct workspace_key, {', '.join(WEIGHTS)} from pages)) where score > 0 order by rank limit 50")
def weighted_search(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "pages", "workspace_key", *WEIGHTS).select("workspace_key", weighted(WEIGHTS, KEYWORDS).alias("score")).where("score > 0")
    return top_k(p, 50, F.desc("score"), F.asc("workspace_key")).select("rank", "workspace_key", "score")


@R.query(
    "q_r2_route_score",
    f"""with s as (select workspace_key, {_weighted_sql({'path': 12, 'semantic_summary': 9}, KEYWORDS)} as base, {_weighted_sql({'reason': 1}, ('plan',))} as extra from (select distinct workspace_key, path, semantic_summary, reason from pages))
    select row_number() over (order by score desc, workspace_key) as rank, workspace_key, score from (select workspace_key, case when base > 0 then base else extra end as score from s) where score > 0 order by rank limit 50""",
)
def route_score(spark: SparkSession, d: str) -> DataFrame:
    """The last field counts only where nothing else does."""
    base, extra = weighted({"path": 12, "semantic_summary": 9}, KEYWORDS), weighted({"reason": 1}, ("plan",))
    p = once(spark, d, "pages", "workspace_key", "path", "semantic_summary", "reason").select("workspace_key", F.when(base > 0, base).otherwise(extra).alias("score")).where("score > 0")
    return top_k(p, 50, F.desc("score"), F.asc("workspace_key")).select("rank", "workspace_key", "score")


def bm25(docs: DataFrame, ident: str, text: str, words: tuple[str, ...], every: bool) -> DataFrame:
    """(ident, score): BM25 over substring matches; ``every`` wants all words, else any. One pass for the statistics, one for the scores."""
    k1, b = 1.2, 0.75
    tf = docs.select(ident, F.length(text).alias("_len"), *(TX.occurrences(F.col(text), w).alias(f"_t{i}") for i, w in enumerate(words)))
    stats = tf.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *(F.count_if(F.col(f"_t{i}") > 0).alias(f"_df{i}") for i in range(len(words))))
    both = tf.join(F.broadcast(stats))  # one row
    norm = k1 * (1 - b + b * F.col("_len") / F.col("_avg"))
    score = sum((F.log(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)) * F.col(f"_t{i}") * (k1 + 1) / (F.col(f"_t{i}") + norm) for i in range(len(words))), F.lit(0.0))
    hit = [F.col(f"_t{i}") > 0 for i in range(len(words))]
    wanted = hit[0]
    for h in hit[1:]:
        wanted = wanted & h if every else wanted | h
    return both.where(wanted).select(ident, F.round(score, 6).alias("score"))


def _bm25_sql(words: tuple[str, ...], every: bool, limit: int) -> str:
    tf = ", ".join(f"(length(low) - length(replace(low, '{w}', ''))) // {len(w)} as t{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) filter (where t{i} > 0) as df{i}" for i in range(len(words)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * len / av))" for i in range(len(words)))
    wanted = (" and " if every else " or ").join(f"t{i} > 0" for i in range(len(words)))
    return f"""with d as (select doc_id, lower(text) as low, length(text)::double as len from documents where text is not null), t as (select doc_id, len, {tf} from d), s as (select count(*)::double as n, avg(len) as av, {df} from t),
      r as (select doc_id, round({score}, 6) as score from t, s where {wanted})
    select row_number() over (order by score desc, doc_id) as rank, doc_id, score from r order by rank limit {limit}"""


@R.query("q_r3_bm25_all", _bm25_sql(TERMS, True, 50))
def bm25_all(spark: SparkSession, d: str) -> DataFrame:
    scored = bm25(table(spark, d, "documents").where("text is not null"), "doc_id", "text", TERMS, True)
    return top_k(scored, 50, F.desc("score"), F.asc("doc_id")).select("rank", "doc_id", "score")


@R.query("q_r4_bm25_any", _bm25_sql(("quota", "kiln", "lease"), False, 50))
def bm25_any(spark: SparkSession, d: str) -> DataFrame:
    scored = bm25(table(spark, d, "documents").where("text is not null"), "doc_id", "text", ("quota", "kiln", "lease"), False)
    return top_k(scored, 50, F.desc("score"), F.asc("doc_id")).select("rank", "doc_id", "score")


@R.query("q_r5_find_all", "select distinct asset_id from assets where contains(lower(concat_ws('|', asset_id, host, original_path, local_state, redundancy_class, classification_reason)), 'kiln') and contains(lower(concat_ws('|', asset_id, host, original_path, local_state, redundancy_class, classification_reason)), 'orchard')")
def find_all(spark: SparkSession, d: str) -> DataFrame:
    row = F.lower(F.concat_ws("|", "asset_id", "host", "original_path", "local_state", "redundancy_class", "classification_reason"))
    return table(spark, d, "assets").where(F.forall(F.array(F.lit("kiln"), F.lit("orchard")), lambda t: F.contains(row, t))).select("asset_id").distinct()


@R.query(
    "q_r8_vector_route",
    """with q as (select embedding as e from embeddings where vec_id = (select min(vec_id) from embeddings)),
      s as (select label, round(max(list_cosine_similarity(v.embedding, q.e))::double, 4) as best from embeddings v, q group by 1)
    select label, best, best >= 0.55 as taken from s""",
)
def vector_route(spark: SparkSession, d: str) -> DataFrame:
    """The best cosine similarity of a query vector to the vectors of each route, and whether the route is taken."""
    v = table(spark, d, "embeddings")
    q = v.agg(F.min_by("embedding", "vec_id").alias("e"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("embedding", "e") / F.sqrt(dot("embedding", "embedding") * dot("e", "e"))
    best = v.join(F.broadcast(q)).groupBy("label").agg(F.round(F.max(cosine), 4).alias("best"))  # one row
    return best.select("label", "best", (F.col("best") >= 0.55).alias("taken"))


# --- graph ---------------------------------------------------------------------------------------------------------------


def _domain() -> Column:
    pick: Column | None = None
    for name, pattern in DOMAINS:
        pick = F.when(F.col("p").rlike(pattern), name) if pick is None else pick.when(F.col("p").rlike(pattern), name)
    return pick.otherwise("unclassified")


_DOMAIN_SQL = "case " + " ".join(f"when regexp_matches(p, '{pattern}') then '{name}'" for name, pattern in DOMAINS) + " else 'unclassified' end"


@R.query("q_g1_domains", f"select {_DOMAIN_SQL} as domain, count(*) as n from (select distinct source_path, lower(relative_path) as p from asset_files) group by 1")
def domains(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that occurs wins."""
    return table(spark, d, "asset_files").select("source_path", F.lower("relative_path").alias("p")).distinct().groupBy(_domain().alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@R.query(
    "q_g2_edges",
    f"""with h as (select distinct doc_id, regexp_extract(line, '({_PATH})', 1) as owner from {_LINES} where starts_with(line, '# /pool/ws/')),
      e as (select distinct 'depends_on' as kind, owner as a, m.name as b from h join {_MENTIONS.format(_PATH)} m using (doc_id) where owner <> '' and m.name <> owner union select distinct 'contains_asset', owner, m.name from h join {_MENTIONS.format(_ASSET)} m using (doc_id) where owner <> '')
    select kind, a as node, count(*) as degree from e group by 1, 2""",
)
def edges(spark: SparkSession, d: str) -> DataFrame:
    """Out-degrees of the graph that hand-offs draw between workspaces and assets."""
    head = frames(spark, d).where("path <> ''").select("doc_id", F.col("path").alias("node")).distinct()
    to = lambda kind, pattern: mentions(spark, d, pattern).join(head, "doc_id").where("name <> node").select(F.lit(kind).alias("kind"), "node", "name")
    return to("depends_on", _PATH).unionByName(to("contains_asset", _ASSET)).distinct().groupBy("kind", "node").agg(F.count(F.lit(1)).alias("degree"))


@R.query(
    "q_l3_one_sided",
    f"""with h as (select distinct doc_id, regexp_extract(line, '({_PATH})', 1) as owner from {_LINES} where starts_with(line, '# /pool/ws/')),
      e as (select distinct owner as a, m.name as b from h join {_MENTIONS.format(_PATH)} m using (doc_id) where owner <> '' and m.name <> owner)
    select a, b from e where not exists (select 1 from e x where x.a = e.b and x.b = e.a)""",
)
def one_sided(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies that the other side doesn't declare."""
    head = frames(spark, d).where("path <> ''").select("doc_id", F.col("path").alias("a")).distinct()
    e = mentions(spark, d, _PATH).join(head, "doc_id").where("name <> a").select("a", F.col("name").alias("b")).distinct()
    back = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return e.join(back, ["a", "b"], "left_anti")


@R.query("q_t4_asset_search", f"select row_number() over (order by score desc, asset_id) as rank, asset_id, score from (select asset_id, {_weighted_sql({'asset_id': 14, 'original_path': 12, 'classification_reason': 8}, ('kiln', 'review'))} as score from (select distinct asset_id, original_path, classification_reason from assets)) where score > 0 order by rank limit 20")
def asset_search(spark: SparkSession, d: str) -> DataFrame:
    score = weighted({"asset_id": 14, "original_path": 12, "classification_reason": 8}, ("kiln", "review"))
    a = once(spark, d, "assets", "asset_id", "original_path", "classification_reason").select("asset_id", score.alias("score")).where("score > 0")
    return top_k(a, 20, F.desc("score"), F.asc("asset_id")).select("rank", "asset_id", "score")


@R.query(
    "q_g3_index",
    f"""with p as (select distinct path, 1 as rank from pages), m as (select name as path, 2 as rank from {_MENTIONS.format(_PATH)} group by 1 having count(*) >= 2), e as (select distinct split_part(rtrim(workspace_key, '/'), '|', 2) as path, 3 as rank from pager_events where workspace_key is not null)
    select path, min(rank) as rank from (select * from p union all select * from m union all select * from e) group by 1""",
)
def index(spark: SparkSession, d: str) -> DataFrame:
    """Paths known, promoted by two mentions, or only seen in events, by precedence."""
    known = table(spark, d, "pages").select("path", F.lit(1).alias("rank"))
    promoted = references(spark, d).where("n_docs >= 2").select(F.col("name").alias("path"), F.lit(2).alias("rank"))
    seen = events(spark, d).select(F.split_part("workspace_key", F.lit("|"), F.lit(2)).alias("path"), F.lit(3).alias("rank"))
    return known.unionByName(promoted).unionByName(seen).groupBy("path").agg(F.min("rank").alias("rank"))


@R.query(
    "q_a10_attribution",
    f"""with r as (select distinct rtrim(original_path, '/') as root from assets), m as (select distinct doc_id, unnest(regexp_extract_all(text, '/pool/ws/[a-z0-9/._-]*[a-z0-9]')) as path from documents where text is not null),
      u as (select doc_id, path, '/' || array_to_string(list_slice(list_filter(string_split(path, '/'), lambda s: s <> ''), 1, i), '/') as root from (select doc_id, path, unnest(range(1, len(string_split(path, '/')) + 1)) as i from m)),
      b as (select doc_id, path, max_by(root, length(root)) as root from u join r using (root) group by 1, 2)
    select root, count(distinct doc_id) as n_docs from b group by 1""",
)
def attribution(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts attributed to the deepest known root of the paths they name."""
    m = mentions(spark, d, "/pool/ws/[a-z0-9/._-]*[a-z0-9]").select("doc_id", F.col("name").alias("path"))
    roots = table(spark, d, "assets").select(F.rtrim("original_path", F.lit("/")).alias("root"))
    found = relate.deepest_root(m, roots, [], "path", "root").where("root is not null")
    return found.groupBy("root").agg(F.count_distinct("doc_id").alias("n_docs"))


def queries():
    return R.queries()


def oracle_sql():
    return R.oracle_sql()
