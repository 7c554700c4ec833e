"""Queries of the text and sequence problems (p4, p6, p7, p8) with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.llm.mojibake import garbled_documents, garbled_evidence, restored_documents
from tierlake.llm.packing import fill_report, pack_containers
from tierlake.llm.runs import collapse_runs
from tierlake.llm.tokenizer import token_count, token_ids
from tierlake.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return collapse_runs(table(spark, d, "pager_events"), min_run=2).select("workspace_key", "first_id", "last_id")


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run as one event, with the name and reason of its first event."""
    return collapse_runs(table(spark, d, "pager_events"), keep=("event", "reason"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", token_ids(spark, F.col("text")).alias("ids"))


#: Binding limits of `p7_bounded`: documents in a container, and its attention cost in squares of the capacity.
MOST_DOCUMENTS, COST_SHARE = 16, 0.4


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", token_count(spark, F.col("text")).alias("n_tokens"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    """Under the token capacities alone, as stated."""
    return pack_containers(_sized(spark, d), table(spark, d, "container_sizes"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p7_packing(spark, d), table(spark, d, "container_sizes"))


def p7_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Under capacities of tokens, documents and attention cost, all of which bind."""
    return pack_containers(_sized(spark, d), table(spark, d, "container_sizes"), max_items=MOST_DOCUMENTS, cost_factor=COST_SHARE)


def p7_bounded_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p7_bounded(spark, d), table(spark, d, "container_sizes"), max_items=MOST_DOCUMENTS, cost_factor=COST_SHARE)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled_documents(table(spark, d, "documents"))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return restored_documents(table(spark, d, "documents"))


def p8_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents by what shows them."""
    return garbled_evidence(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p4_found, p4_runs, p6_ids, p7_packing, p7_fill, p7_bounded, p7_bounded_fill, p8_found, p8_restored, p8_evidence)}


_P4 = r"""
with once as (
  select id, "at", workspace_key, event, reason from (
    select *, row_number() over (partition by id, case when id is null then concat_ws('|', workspace_key, "at", event, reason) end order by "at" nulls first, workspace_key, event, reason) as place
    from (select id, "at", rtrim(workspace_key, '/') as workspace_key, event, reason from pager_events) where workspace_key <> '')
  where place = 1),
label as (
  select *, lower(trim(coalesce(event, ''))) as e,
    lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(reason, ''), '[^\s]*[0-9][^\s]*', '0', 'g'), '\s+', ' ', 'g'), '[\s\pP]+$', ''), '^ ', '')) as r
  from once),
marked as (
  select *, case when lag(e) over w = e and lag(r) over w = r then 0 else 1 end as fresh from label window w as (partition by workspace_key order by "at", id)),
runs as (select *, sum(fresh) over (partition by workspace_key order by "at", id rows unbounded preceding) as run from marked),
folded as (
  select workspace_key, arg_min(id, ("at", id)) as first_id, arg_max(id, ("at", id)) as last_id, count(*) as n_events, min("at") as first_at, max("at") as last_at, max("at") - min("at") as duration,
    arg_min(event, ("at", id)) as event, first(reason order by "at", id) as reason
  from (select workspace_key, id, "at", event, reason, run from runs) group by workspace_key, run)
"""


def oracle_sql() -> dict[str, str]:
    p4 = _P4.replace('("at", id)', "struct_pack(a := \"at\", b := id)")
    return {
        "p4_found": p4 + "select workspace_key, first_id, last_id from folded where n_events > 1",
        "p4_runs": p4 + "select * from folded",
    }
