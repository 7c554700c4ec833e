"""Every query of the subpackage on the smallest test data: against its SQL, or against what must hold of its rows."""

import glob
import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tierlake.llm import queries as Q

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {Path(f).stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df, want = Q.queries()[name](spark, DATA), duck.sql(Q.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    tidy = lambda r: tuple(float(f"{v:.10g}") if isinstance(v, float) else v for v in r)
    assert sorted((tidy(r) for r in df.collect()), key=repr) == sorted((tidy([r[i] for i in at]) for r in want.fetchall()), key=repr)


def test_every_document_is_encoded(spark):
    import public_tokenizers
    import tiktoken

    from tierlake.llm.tokenizer import BytePairEncoder, load_vocabulary

    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=BytePairEncoder(*load_vocabulary()).ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: r["ids"] for r in Q.p6_ids(spark, DATA).collect()}
    assert got == {i: public.encode_ordinary(t or "") for i, t in texts.items()}


@pytest.mark.parametrize("name", ["p7_packing", "p7_bounded"])
def test_no_container_breaks_a_capacity(spark, name):
    packed, boxes = Q.queries()[name](spark, DATA), {r["profile"]: r["capacity_tokens"] for r in spark.read.parquet(f"{DATA}/container_sizes.parquet").collect()}
    sized = {r["doc_id"]: r["n_tokens"] for r in Q._sized(spark, DATA).collect()}
    each, whole = {}, {}
    for r in packed.collect():
        whole.setdefault((r["profile"], r["doc_id"]), []).append((r["start_token"], r["n_tokens"]))
        if r["n_tokens"]:
            each.setdefault((r["profile"], r["container_id"]), []).append(r["n_tokens"])
    assert len(whole) == len(boxes) * len(sized)
    for (_, i), parts in whole.items():  # pieces follow each other without a gap
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == sized[i]
    for (p, _), tokens in each.items():
        assert sum(tokens) <= boxes[p]
        if name == "p7_bounded":
            assert len(tokens) <= Q.MOST_DOCUMENTS and sum(n * n for n in tokens) <= Q.COST_SHARE * boxes[p] ** 2
    fill = {r["profile"]: r for r in Q.queries()[f"{name.replace('_packing', '')}_fill"](spark, DATA).collect()}
    for p in boxes:
        n = sum(k[0] == p for k in each)
        assert (fill[p]["n_containers"], fill[p]["over_full"]) == (n, 0) and fill[p]["n_least"] <= n
        if name == "p7_packing":
            assert n <= 1.01 * fill[p]["n_least"] + 1


def test_garbled_documents_have_an_original(spark):
    found = {r["doc_id"] for r in Q.p8_found(spark, DATA).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").where(F.col("text").isNotNull()).collect()}
    restored = {r["doc_id"]: r["text"] for r in Q.p8_restored(spark, DATA).collect()}
    assert set(restored) == found <= set(texts) and found
    assert all(restored[i] != texts[i] for i in found if "�" not in texts[i])
