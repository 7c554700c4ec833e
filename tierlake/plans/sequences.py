"""Window-like, ordered and top-k queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tierlake.functions.keys import digest_key, label, workspace_key
from tierlake.operators import relate
from tierlake.operators.scan import ordered_scan
from tierlake.plans.registry import Registry
from tierlake.plans.relational import DAY, NOW, WINDOW_BYTES, WINDOW_ITEMS, _dig, once
from tierlake.session import ensure_checkpoint_dir, python_partitions
from tierlake.sources.tables import table

R = Registry()
NEED_BYTES = 2_000_000_000_000
CHUNK_BYTES = 1 << 24

_EV = """(select distinct id, "at", rtrim(workspace_key, '/') as workspace_key, upper(trim(event)) as event from pager_events where workspace_key is not null)"""
_LEDGER = r"""(select distinct line[1] as day, line[2] as label, cast(line[3][6:] as int) as part, line[4] as blob, line[5] as state
  from (select string_split(unnest(string_split(replace(text, chr(13), ''), chr(10))), chr(9)) as line from documents where kind = 'receipt') where len(line) = 5 and regexp_matches(line[3], '^part-[0-9]{4}$'))"""


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pager_events").select("id", "at", workspace_key(F.col("workspace_key")).alias("workspace_key"), label(F.col("event")).alias("event")).where("workspace_key is not null").distinct()


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Positional ledger lines inside receipts; lines with another number of fields are no ledger lines."""
    lines = table(spark, d, "documents").where("kind = 'receipt'").select(F.explode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("line"))
    f = lines.select(F.split("line", "\t").alias("f")).where(F.size("f") == 5).where(F.col("f")[2].rlike("^part-[0-9]{4}$"))
    return f.select(F.col("f")[0].alias("day"), F.col("f")[1].alias("label"), F.substring(F.col("f")[2], 6, 9).cast("int").alias("part"), F.col("f")[3].alias("blob"), F.col("f")[4].alias("state")).distinct()


def day_chunk() -> Column:
    """Days keep the order of ``at`` and cut a hot key's history into pieces."""
    return F.floor(F.coalesce("at", F.lit(0.0)) / DAY)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows by ``order`` with their ``rank``; only ``k`` rows reach the ranking window."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))


# --- windows -------------------------------------------------------------------------------------------------------------


@R.query("q_w1_latest_row", f"select label, part, day, blob, state from (select *, row_number() over (partition by label, part order by day desc, blob desc, state desc) as rn from {_LEDGER}) where rn = 1")
def latest_row(spark: SparkSession, d: str) -> DataFrame:
    return relate.latest(ledger(spark, d).select("label", "part", "day", "blob", "state"), ["label", "part"], ["day", "blob", "state"])


@R.query("q_w2_contiguity", f"select label, min(part) as lo, max(part) as hi, count(distinct part) as n, min(part) = 1 and max(part) = count(distinct part) and count(distinct part) = count(*) as whole from {_LEDGER} group by 1")
def contiguity(spark: SparkSession, d: str) -> DataFrame:
    n = F.count_distinct("part")
    return ledger(spark, d).groupBy("label").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), n.alias("n"), ((F.min("part") == 1) & (F.max("part") == n) & (n == F.count(F.lit(1)))).alias("whole"))


@R.query(
    "q_w3_latch",
    f"""select workspace_key, id, coalesce(last_value(case when event in ('DIRTY', 'SEMANTIC_STALE') then 1 when event in ('SYNC', 'SEMANTIC_ANNOTATED') then 0 end ignore nulls) over (partition by workspace_key order by "at", id rows unbounded preceding), 0) as latched from {_EV}""",
)
def latch(spark: SparkSession, d: str) -> DataFrame:
    """Hysteresis: on at one kind of event, off at another, else held."""
    switch = F.when(F.col("event").isin("DIRTY", "SEMANTIC_STALE"), 1).when(F.col("event").isin("SYNC", "SEMANTIC_ANNOTATED"), 0)
    scanned = ordered_scan(events(spark, d).withColumn("switch", switch), ["workspace_key"], ["at", "id"], day_chunk(), last_known={"latched": "switch"})
    return scanned.select("workspace_key", "id", F.coalesce("latched", F.lit(0)).alias("latched"))


@R.query(
    "q_w4_rank_score",
    """select source_path, 150 - rank as score from (select source_path, row_number() over (order by n desc, source_path) as rank from (select source_path, count(*) as n from asset_files where relative_path ilike '%ledger%' group by 1)) where rank <= 50""",
)
def rank_score(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "asset_files").where(F.col("relative_path").ilike("%ledger%")).groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))
    return top_k(hits, 50, F.desc("n"), F.asc("source_path")).select("source_path", (150 - F.col("rank")).alias("score"))


@R.query("q_w5_supersession", f"""select workspace_key, id, event, previous from (select *, lag(event) over (partition by workspace_key order by "at", id) as previous from {_EV}) where previous is distinct from event""")
def supersession(spark: SparkSession, d: str) -> DataFrame:
    """Events that change what went before, with a pointer to it."""
    scanned = ordered_scan(events(spark, d), ["workspace_key"], ["at", "id"], day_chunk(), previous={"previous": "event"})
    return scanned.where(~F.col("previous").eqNullSafe(F.col("event"))).select("workspace_key", "id", "event", "previous")


@R.query("q_w6_greedy_windows")
def greedy(spark: SparkSession, d: str) -> DataFrame:
    """Upload windows of at most WINDOW_ITEMS objects and WINDOW_BYTES bytes, one sequence a state."""
    o = once(spark, d, "objects", "digest", "plain_bytes", "cloud_state")
    return relate.greedy_windows(o, ["cloud_state"], F.struct(-F.col("plain_bytes"), F.col("digest")), F.col("plain_bytes"), WINDOW_ITEMS, WINDOW_BYTES)


@R.query(
    "q_w9_chunk_ordinal",
    f"""select digest, cast(cum as bigint) as cum, cast((cum - 1) // {CHUNK_BYTES} + 1 as bigint) as ordinal from (select digest, sum(plain_bytes) over (partition by cloud_state order by digest rows unbounded preceding) as cum from (select distinct digest, cloud_state, plain_bytes from objects where plain_bytes > 0))""",
)
def chunk_ordinal(spark: SparkSession, d: str) -> DataFrame:
    o = once(spark, d, "objects", "digest", "cloud_state", "plain_bytes").where("plain_bytes > 0")
    cum = ordered_scan(o, ["cloud_state"], ["digest"], F.substring("digest", 1, 2), running_sum={"cum": "plain_bytes"})
    return cum.select("digest", "cum", (F.floor((F.col("cum") - 1) / CHUNK_BYTES) + 1).alias("ordinal"))


@R.query("q_w10_stable", f"""select workspace_key, count(*) as n_stable from (select workspace_key, event, lag(event) over w as p, lag(event, 2) over w as q from {_EV} window w as (partition by workspace_key order by "at", id)) where event = p and p = q group by 1""")
def stable(spark: SparkSession, d: str) -> DataFrame:
    """Polls that found the same twice before."""
    once_back = ordered_scan(events(spark, d), ["workspace_key"], ["at", "id"], day_chunk(), previous={"p": "event"})
    twice_back = ordered_scan(once_back, ["workspace_key"], ["at", "id"], day_chunk(), previous={"q": "p"})
    return twice_back.where("event = p and p = q").groupBy("workspace_key").agg(F.count(F.lit(1)).alias("n_stable"))


@R.query("q_w11_sequence", f"""select workspace_key, id, row_number() over w as seq, "at" - lag("at") over w as dwell from {_EV} window w as (partition by workspace_key order by "at", id)""")
def sequence(spark: SparkSession, d: str) -> DataFrame:
    scanned = ordered_scan(events(spark, d), ["workspace_key"], ["at", "id"], day_chunk(), row_number="seq", previous={"before": "at"})
    return scanned.select("workspace_key", "id", "seq", (F.col("at") - F.col("before")).alias("dwell"))


@R.query(
    "q_a16_streaks",
    f"""with d as (select distinct workspace_key, cast(floor("at" / {DAY}) as bigint) as day from {_EV} where event like '%FAILED%' or event like '%REFUSED%' or event like '%BLOCKED%'),
      i as (select *, day - row_number() over (partition by workspace_key order by day) as island from d)
    select workspace_key, min(day) as first_day, max(day) as last_day, count(*) as n_days from i group by workspace_key, island""",
)
def streaks(spark: SparkSession, d: str) -> DataFrame:
    """Unbroken series of days with an alert, a day counting once."""
    bad = events(spark, d).where(F.col("event").rlike("FAILED|REFUSED|BLOCKED"))
    days = bad.select("workspace_key", F.floor(F.col("at") / DAY).alias("day")).distinct()
    ranked = ordered_scan(days, ["workspace_key"], ["day"], F.floor(F.col("day") / 365), row_number="rn")
    return ranked.groupBy("workspace_key", (F.col("day") - F.col("rn")).alias("island")).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n_days")).drop("island")


@R.query(
    "q_q6_prefix",
    f"""with p as (select distinct workspace_key, coalesce(size_bytes, 0) as size_bytes, coalesce(last_access, 0) as last_access, access_count from pages where local_present = 1),
      c as (select *, sum(size_bytes) over (order by size_bytes desc, last_access, access_count, workspace_key rows unbounded preceding) as cum from p)
    select workspace_key, size_bytes, cast(cum as bigint) as cum from c where cum - size_bytes < {NEED_BYTES}""",
)
def prefix(spark: SparkSession, d: str) -> DataFrame:
    """The shortest prefix of the largest pages that frees what is needed: a running sum over all rows, cut into even ranges of the order."""
    p = table(spark, d, "pages").where("local_present = 1").select("workspace_key", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), F.coalesce("last_access", F.lit(0.0)).alias("last_access"), "access_count").distinct()
    order = ["minus", "last_access", "access_count", "workspace_key"]
    ensure_checkpoint_dir(spark)
    # written once, as the numbers of the ranges must not change
    p = p.withColumn("minus", -F.col("size_bytes")).repartitionByRange(python_partitions(spark), *order).withColumn("range", F.spark_partition_id()).checkpoint()
    cum = ordered_scan(p, [], order, F.col("range"), running_sum={"cum": "size_bytes"})
    return cum.where(F.col("cum") - F.col("size_bytes") < NEED_BYTES).select("workspace_key", "size_bytes", "cum")


# --- top-k ---------------------------------------------------------------------------------------------------------------

_T = "(select distinct workspace_key, coalesce(size_bytes, 0) as size_bytes, coalesce(last_access, 0) as last_access, coalesce(nullif(last_access, 0), updated_at) as seen, access_count, lease_until from pages)"


def _top_pages(spark: SparkSession, d: str) -> DataFrame:
    seen = F.coalesce(F.nullif("last_access", F.lit(0.0)), "updated_at").alias("seen")
    return table(spark, d, "pages").select("workspace_key", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), F.coalesce("last_access", F.lit(0.0)).alias("last_access"), seen, "access_count", "lease_until").distinct()


@R.query("q_t1_coldest", f"select row_number() over (order by last_access, access_count, workspace_key) as rank, workspace_key from {_T} order by rank limit 100")
def coldest(spark: SparkSession, d: str) -> DataFrame:
    return top_k(_top_pages(spark, d), 100, F.asc("last_access"), F.asc("access_count"), F.asc("workspace_key")).select("rank", "workspace_key")


@R.query("q_t2_largest", f"select row_number() over (order by size_bytes desc, last_access, access_count, workspace_key) as rank, workspace_key, size_bytes from {_T} order by rank limit 100")
def largest(spark: SparkSession, d: str) -> DataFrame:
    return top_k(_top_pages(spark, d), 100, F.desc("size_bytes"), F.asc("last_access"), F.asc("access_count"), F.asc("workspace_key")).select("rank", "workspace_key", "size_bytes")


@R.query("q_t3_oldest", f"select row_number() over (order by age desc, workspace_key) as rank, workspace_key, age from (select workspace_key, floor(({NOW} - seen) / {DAY} * 1000) / 1000 as age from {_T}) order by rank limit 100")
def oldest(spark: SparkSession, d: str) -> DataFrame:
    age = F.floor((F.lit(NOW) - F.col("seen")) / DAY * 1000) / 1000
    return top_k(_top_pages(spark, d).select("workspace_key", age.alias("age")), 100, F.desc("age"), F.asc("workspace_key")).select("rank", "workspace_key", "age")


@R.query("q_t6_most_hits", "select row_number() over (order by hits desc, workspace_key) as rank, workspace_key, hits from (select rtrim(workspace_key, '/') as workspace_key, count(distinct id) as hits from pager_events where workspace_key is not null group by 1) order by rank limit 10")
def most_hits(spark: SparkSession, d: str) -> DataFrame:
    return top_k(events(spark, d).groupBy("workspace_key").agg(F.count("id").alias("hits")), 10, F.desc("hits"), F.asc("workspace_key")).select("rank", "workspace_key", "hits")


@R.query("q_t7_file_search", "select row_number() over (order by length(relative_path), relative_path, source_path) as rank, source_path, relative_path from (select distinct source_path, relative_path from asset_files where relative_path ilike '%frame%' and relative_path ilike '%.npy%') order by rank limit 100")
def file_search(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("relative_path")
    hits = once(spark, d, "asset_files", "source_path", "relative_path").where(p.ilike("%frame%") & p.ilike("%.npy%"))
    return top_k(hits, 100, F.length("relative_path"), F.asc("relative_path"), F.asc("source_path")).select("rank", "source_path", "relative_path")


@R.query(
    "q_t8_source_rows",
    f"select row_number() over (order by plain_bytes desc, digest, host, source_path) as rank, digest, host, source_path from (select distinct {_dig('digest')} as digest, host, source_path from object_sources where source_state = 'HASH_VERIFIED') s join (select distinct digest, plain_bytes from objects where cloud_state = 'CLOUD_CONFIRMED') o using (digest) order by rank limit 500",
)
def source_rows(spark: SparkSession, d: str) -> DataFrame:
    """The limit counts source rows, so an object with several sources takes several places."""
    s = table(spark, d, "object_sources").where("source_state = 'HASH_VERIFIED'").select(digest_key(F.col("digest")).alias("digest"), "host", "source_path").distinct()
    o = table(spark, d, "objects").where("cloud_state = 'CLOUD_CONFIRMED'").select("digest", "plain_bytes").distinct()
    return top_k(s.join(o, "digest"), 500, F.desc("plain_bytes"), F.asc("digest"), F.asc("host"), F.asc("source_path")).select("rank", "digest", "host", "source_path")


@R.query("q_t9_choice", "select asset_id, size_bytes from (select distinct asset_id, size_bytes from assets where local_state = 'cloud_only') order by starts_with(asset_id, 'v2-'), size_bytes, asset_id limit 1")
def choice(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "assets").where("local_state = 'cloud_only'")
    best = a.agg(F.min(F.struct(F.col("asset_id").startswith("v2-").alias("f"), "size_bytes", "asset_id")).alias("b")).where("b is not null")
    return best.select("b.asset_id", "b.size_bytes")


@R.query("q_t10_best_source", f"select digest, host, source_path from (select *, row_number() over (partition by digest order by (source_state <> 'HASH_VERIFIED'), host, source_path) as rn from (select distinct {_dig('digest')} as digest, host, source_path, source_state from object_sources)) where rn = 1")
def best_source(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "object_sources").groupBy(digest_key(F.col("digest")).alias("digest"))
    return s.agg(F.min(F.struct((F.col("source_state") != "HASH_VERIFIED").alias("f"), "host", "source_path")).alias("b")).select("digest", "b.host", "b.source_path")


@R.query("q_t11_upload_order", "select row_number() over (order by plain_bytes desc, digest) as rank, digest, plain_bytes from (select distinct digest, plain_bytes from objects where cloud_state = 'REGISTERED') order by rank limit 200")
def upload_order(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "objects").where("cloud_state = 'REGISTERED'").select("digest", "plain_bytes").distinct()
    return top_k(o, 200, F.desc("plain_bytes"), F.asc("digest")).select("rank", "digest", "plain_bytes")


@R.query(
    "q_t12_queue",
    f"""with q as (select workspace_key, 0 as kind, 0::double as pos from (select distinct workspace_key from pages where semantic_stale_task is not null) union all select workspace_key, 1, last_access from {_T}),
      f as (select workspace_key, min(struct_pack(kind := kind, pos := pos)) as k from q group by 1)
    select row_number() over (order by k.kind, k.pos, workspace_key) as rank, workspace_key from f order by rank limit 200""",
)
def queue(spark: SparkSession, d: str) -> DataFrame:
    """Seeds first, then the usual order; a page keeps its first place."""
    seeds = table(spark, d, "pages").where("semantic_stale_task is not null").select("workspace_key", F.lit(0).alias("kind"), F.lit(0.0).alias("pos")).distinct()
    rest = _top_pages(spark, d).select("workspace_key", F.lit(1).alias("kind"), F.col("last_access").alias("pos"))
    first = seeds.unionByName(rest).groupBy("workspace_key").agg(F.min(F.struct("kind", "pos")).alias("k"))
    return top_k(first, 200, F.col("k.kind"), F.col("k.pos"), F.asc("workspace_key")).select("rank", "workspace_key")


@R.query("q_t13_waiting", f"select row_number() over (order by eligible_at, workspace_key) as rank, workspace_key, eligible_at from (select workspace_key, greatest(seen + 3 * {DAY}, coalesce(lease_until, 0)) as eligible_at from {_T}) where eligible_at > {NOW} - 60 * {DAY} order by rank limit 8")
def waiting(spark: SparkSession, d: str) -> DataFrame:
    w = _top_pages(spark, d).select("workspace_key", F.greatest(F.col("seen") + 3 * DAY, F.coalesce("lease_until", F.lit(0.0))).alias("eligible_at")).where(F.col("eligible_at") > NOW - 60 * DAY)
    return top_k(w, 8, F.asc("eligible_at"), F.asc("workspace_key")).select("rank", "workspace_key", "eligible_at")


@R.query("q_t14_violation_sample", f"select row_number() over (order by digest, source_path, host) as rank, digest, source_path, host from (select distinct {_dig('digest')} as digest, source_path, host from object_sources where source_state = 'MISSING') order by rank limit 20")
def violation_sample(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "object_sources").where("source_state = 'MISSING'").select(digest_key(F.col("digest")).alias("digest"), "source_path", "host").distinct()
    return top_k(s, 20, F.asc("digest"), F.asc("source_path"), F.asc("host")).select("rank", "digest", "source_path", "host")


def queries():
    return R.queries()


def oracle_sql():
    return R.oracle_sql()
