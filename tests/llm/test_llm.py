"""Sequence and text operators on small fixtures and against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierlake.llm import mojibake
from tierlake.llm.packing import best_fit, fill_report, pack_containers
from tierlake.llm.runs import collapse_runs
from tierlake.llm.tokenizer import BytePairEncoder, load_vocabulary, token_count, token_ids

EVENTS = "id long, at double, workspace_key string, event string, reason string, n long, block int"


def events(spark, rows):
    return spark.createDataFrame([(*r, 5, 6) for r in rows], EVENTS)


def runs(df, **kw):
    return sorted((r["workspace_key"], r["first_id"], r["last_id"], r["n_events"], r["duration"]) for r in collapse_runs(df, **kw).collect())


def test_runs_of_near_identical_events(spark):
    rows = [(1, 1.0, "w", "PIN", "size 5  differs from a1."), (2, 2.0, "w/", " pin", "Size 7 differs\tfrom b22 !"), (2, 2.0, "w/", " pin", "Size 7 differs\tfrom b22 !"), (3, 3.0, "w", "PIN", "size differs 7 from a1"), (4, 4.0, "w", "PIN", None), (5, 4.0, "w", "PIN", " . "), (6, 5.0, None, "PIN", ""), (7, 5.0, "/", "PIN", ""), (9, 0.5, "v", None, None), (8, 0.5, "v", None, ""), (10, None, "v", "X", "y")]
    got = runs(events(spark, rows))
    assert got == [("v", 8, 9, 2, 0.0), ("v", 10, 10, 1, None), ("w", 1, 2, 2, 1.0), ("w", 3, 3, 1, 0.0), ("w", 4, 5, 2, 0.0)]
    assert [g for g in got if g[3] > 1] == runs(events(spark, rows), min_run=2)
    assert runs(events(spark, [])) == []
    kept = collapse_runs(events(spark, rows[:3]), keep=("event", "reason")).collect()[0]
    assert (kept["event"], kept["reason"]) == ("PIN", "size 5  differs from a1.")


def test_an_id_counts_once(spark):
    rows = [(1, 1.0, "w", "A", ""), (1, 1.5, "w", "A", ""), (2, 2.0, "w", "A", ""), (3, 3.0, "w", "B", ""), (3, 2.5, "v", "C", ""), (4, 9.0, "v", "C", "")]
    assert runs(events(spark, rows)) == [("v", 3, 4, 2, 6.5), ("w", 1, 2, 2, 1.0)]
    loose = [(None, 1.0, "w", "A", ""), (None, 2.0, "w", "A", " "), (None, 2.0, "w", "a", "."), (None, None, "w", "A", ""), (5, 2.0, "w", "A", "")]
    assert runs(events(spark, loose)) == [("w", None, 5, 4, None)]


@pytest.mark.parametrize("batch", [3, 10000])
def test_runs_over_many_blocks(spark, batch):
    """One key holds a run over several blocks; ties and repeats at random."""
    r = random.Random(batch)
    rows = []
    for i in range(2500):
        key = "hot" if r.random() < 0.7 else f"k{r.randrange(9)}"
        name = "A" if i % 1000 < 800 or r.random() < 0.5 else r.choice("ABC")
        rows += [(i, float(i // 3), key, name, "")] * (1 + (r.random() < 0.05))
    want, last = [], {}
    for i, at, key, name, _ in sorted(set(rows), key=lambda x: (x[2], x[1], x[0])):
        if last.get(key) and last[key][3] == name:
            last[key][1], last[key][2], last[key][5] = i, last[key][2] + 1, at
        else:
            last[key] = [i, i, 1, name, at, at]
            want.append((key, last[key]))
    want = sorted((k, x[0], x[1], x[2], x[5] - x[4]) for k, x in want)
    r.shuffle(rows)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        assert runs(events(spark, rows)) == want
        assert runs(events(spark, rows), min_run=2) == [w for w in want if w[3] > 1]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


TEXTS = ["", " ", "Hello, world", "größe ├── 概要 🧊", "a" * 3000, " " * 500 + "x", "don't\r\n\t42", "ﬁ‍﻿", "<|endoftext|>", "\x00\x07"]


def test_tokens_equal_the_public_tokenizer(spark):
    import public_tokenizers
    import tiktoken

    encoder = BytePairEncoder(*load_vocabulary())
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    r = random.Random(1)
    noise = ["".join(r.choice("ab é概\n'1x") for _ in range(r.randrange(60))) for _ in range(300)]
    assert [encoder.encode(t) for t in TEXTS + noise] == [want.encode_ordinary(t) for t in TEXTS + noise]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string")
    out = df.select("doc_id", token_ids(spark, F.col("text")).alias("ids"), token_count(spark, F.col("text")).alias("n")).orderBy("doc_id").collect()
    assert [x["ids"] for x in out] == [want.encode_ordinary(t) for t in TEXTS] + [[]]
    assert all(x["n"] == len(x["ids"]) for x in out)


def test_best_fit_keeps_every_constraint():
    r = np.random.default_rng(0)
    tokens = np.sort(r.integers(1, 100, 700))[::-1].astype(np.int64)
    for rule in ("norm", "dot"):
        bins = best_fit(tokens, 100, 4, 6000, rule)
        assert np.bincount(bins, weights=tokens).max() <= 100 and np.bincount(bins).max() <= 4
        cost = np.bincount(bins, weights=tokens.astype(float) ** 2)
        assert all(c <= 6000 or n == 1 for c, n in zip(cost, np.bincount(bins), strict=True))
    assert len(best_fit(np.array([], np.int64), 10, 1, 1)) == 0


def test_packing_keeps_every_item(spark):
    r = random.Random(2)
    sizes = {i: r.choice([0, 1, 5, 99, 100, 101, 250, r.randrange(1, 130)]) for i in range(900)} | {900: None}
    items = spark.createDataFrame([(i, n, "x") for i, n in sizes.items()], "doc_id long, n_tokens int, profile string")
    boxes = spark.createDataFrame([("a", 100), ("b", 37)], "profile string, capacity_tokens int")
    out = [x.asDict() for x in pack_containers(items, boxes, block_items=64).collect()]
    for name, capacity in (("a", 100), ("b", 37)):
        mine = [x for x in out if x["profile"] == name]
        total, fill = {}, {}
        for x in mine:
            assert x["start_token"] == x["piece"] * capacity
            total[x["doc_id"]] = total.get(x["doc_id"], 0) + x["n_tokens"]
            if x["container_id"]:
                fill[x["container_id"]] = fill.get(x["container_id"], 0) + x["n_tokens"]
            else:
                assert x["n_tokens"] == 0
        assert total == {i: n or 0 for i, n in sizes.items()}
        assert max(fill.values()) <= capacity
        assert all(sum(x["doc_id"] == i for x in mine) == max(1, -(-(n or 0) // capacity)) for i, n in sizes.items())
        rest = np.array(sorted((n % capacity for n in sizes.values() if n and n % capacity), reverse=True))
        at_once = len(set(best_fit(rest, capacity, capacity, capacity**2))) + sum((n or 0) // capacity for n in sizes.values())
        assert len(fill) <= 1.02 * at_once
    assert pack_containers(items.limit(0), boxes).count() == 0
    with pytest.raises(ValueError):
        pack_containers(items, spark.createDataFrame([("a", 0)], "profile string, capacity_tokens int"))


def test_packing_of_repeated_and_null_ids(spark):
    items = spark.createDataFrame([(1, 25), (1, 25), (None, 10), (None, 10), (None, 31)], "doc_id long, n_tokens int")
    boxes = spark.createDataFrame([("a", 10)], "profile string, capacity_tokens int")
    out = pack_containers(items, boxes).cache()
    fill = {r["container_id"]: r["n"] for r in out.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert max(fill.values()) <= 10 and sum(fill.values()) == 101
    report = fill_report(out, boxes).collect()[0]
    assert (report["n_containers"], report["n_tokens"], report["n_least"], report["over_full"]) == (len(fill), 101, 11, 0) and len(fill) == 11


def test_packing_under_every_capacity(spark):
    """Limits on items and cost bind, also for items that are longer than the cost of a container allows."""
    r = random.Random(7)
    sizes = [r.choice([1, 2, 3, 40, 63, 64, 99, 100, 250, r.randrange(1, 100)]) for _ in range(700)]
    items = spark.createDataFrame([(r.choice([None, 1, i]), n) for i, n in enumerate(sizes)], "doc_id long, n_tokens int")
    boxes = spark.createDataFrame([("a", 100)], "profile string, capacity_tokens int")
    for rule in ("norm", "dot"):
        out = pack_containers(items, boxes, max_items=3, cost_factor=0.4, rule=rule, block_items=64).cache()
        each = {}
        for x in out.collect():
            each.setdefault(x["container_id"], []).append(x["n_tokens"])
        assert sum(map(sum, each.values())) == sum(sizes)
        assert all(sum(c) <= 100 and len(c) <= 3 and sum(n * n for n in c) <= 4000 for c in each.values())
        report = fill_report(out, boxes, max_items=3, cost_factor=0.4).collect()[0]
        assert report["over_full"] == 0 and report["n_least"] <= report["n_containers"] == len(each)
    with pytest.raises(ValueError):
        pack_containers(items, boxes, max_items=0)
    with pytest.raises(ValueError):
        pack_containers(items, boxes, cost_factor=0.0)


CLEAN = {"de": "Die Größe der Sicherung beträgt {} GB, der Prüfwert stimmt überein.", "fr": "La vérification nocturne a duré {} minutes et a ignoré les dossiers inchangés.", "ru": "Рабочая область не менялась {} дней, снимок совпадает с деревом.", "ja": "接続が{}回切れましたが、分割データの並びは無事です。", "en": "We don’t evict it before a restore drill has passed — the last one is {} days old."}


def corpus():
    docs = {}
    for k in range(60):
        for lang, s in CLEAN.items():
            docs[len(docs)] = (f"# Note\n\n{s.format(k)} Checked on {k}.", None)
    bad = []
    for right, wrong, langs in [("utf-8", "cp1252", "de fr en"), ("utf-8", "cp437", "de fr en"), ("cp1252", "cp437", "de fr"), ("utf-8", "cp1251", "de fr ru"), ("cp1251", "koi8-r", "ru"), ("cp932", "latin-1", "ja"), ("utf-8", "gbk", "ja")]:
        for lang in langs.split():
            for k in (70, 71, 72):
                text = CLEAN[lang].format(k)
                seen = text.encode(right).decode(wrong, "replace")
                docs[len(docs)] = (f"# Note\n\n{seen} Checked on {k}.", f"# Note\n\n{text} Checked on {k}.")
                bad.append(len(docs) - 1)
    docs[len(docs)] = (CLEAN["de"].format(5).encode("cp1252").decode("utf-8", "replace"), CLEAN["de"].format("0"))
    bad.append(len(docs) - 1)
    for text in (None, "", " ", "plain ASCII", "├── a\n│   └── b", "NÃO apague", "¿642? ¡27! ±675¢", "Ðæðin", "РСУ и РАМ", "🧊 cold"):
        docs[len(docs)] = (text, None)
    return docs, set(bad)


def test_garbled_documents_are_found_and_restored(spark):
    docs, bad = corpus()
    df = spark.createDataFrame([(i, t, 1, 2) for i, (t, _) in docs.items()], "doc_id long, text string, id int, h int")
    assert {r[0] for r in mojibake.garbled_documents(df).collect()} == bad
    out = {r["doc_id"]: r for r in mojibake.restored_documents(df).collect()}
    assert set(out) == bad
    whole = [i for i in bad if "�" not in docs[i][0]]
    assert all(out[i]["text"] == docs[i][1] and out[i]["whole"] for i in whole)
    assert re.sub(r"\d", "0", out[max(bad)]["text"]) == docs[max(bad)][1]
    assert mojibake.garbled_documents(df.limit(0)).count() == 0
    assert mojibake.garbled_documents(df.where("text is null or text = 'plain ASCII'")).count() == 0


def test_misreadings_that_occur_once_are_found(spark):
    """One document a misreading: too few to learn a pair from, but a clean twin or the text itself proves it."""
    docs = {k: s.format(k) for k, s in enumerate(s for s in CLEAN.values() for _ in range(60))}
    pl = "Kopia {} wciąż wskazuje dawne położenie węzła."
    docs |= {len(docs) + k: pl.format(k) for k in range(5)}
    good = set(docs)
    once = [(pl, "utf-8", "cp1250"), (CLEAN["en"], "cp1252", "latin-1"), (CLEAN["ja"], "cp932", "cp1252"), (CLEAN["ja"], "euc_jp", "cp1252"), (CLEAN["de"], "utf-8", "iso8859-2")]
    want = {}
    for text, right, wrong in once:
        want[len(docs)] = text.format(70)
        docs[len(docs)] = text.format(70).encode(right).decode(wrong, "strict" if right == "utf-8" else "replace")
    # a letter for another is a word of its own, not a misreading that occurs once
    docs |= {len(docs) + k: f"Die Prüfung von {k} ist größer." for k in range(4)}
    docs[len(docs)] = "Die Präfung von 9 ist größer."
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert good.isdisjoint(want)
    assert {r[0] for r in mojibake.garbled_documents(df).collect()} == set(want)
    out = {r["doc_id"]: r["text"] for r in mojibake.restored_documents(df).collect()}
    assert all(out[i] == want[i] for i in want if "�" not in docs[i])


def test_two_byte_misreadings_have_twins(spark):
    """What leaves no ASCII to join on is joined on what it reads as: one document a misreading, clean twins with other numbers."""
    zh = "校验值一致之后才能驱逐{}个页面，旧位置的记录仍然保留。"
    plain = "Three rounds of probing found a write within {} days. The tree counts as live."
    docs = {k: s.format(k) for k, s in enumerate(s for s in (*CLEAN.values(), zh, plain) for _ in range(40))}
    want = {}
    for text, right, wrong in [(zh, "utf-8", "gbk"), (CLEAN["ja"], "utf-8", "cp932"), (CLEAN["ja"], "cp932", "cp1252"), (zh, "gbk", "latin-1"), (plain, "utf-8", "utf-16-le"), (CLEAN["ru"], "utf-8", "gbk")]:
        data = text.format(77).encode(right)
        want[len(docs)] = text.format(77)
        docs[len(docs)] = data[: len(data) // 2 * 2].decode(wrong, "replace") if wrong.startswith("utf-16") else data.decode(wrong, "replace")
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r[0] for r in mojibake.garbled_documents(df).collect()} == set(want)
    assert {r["evidence"]: r["n_documents"] for r in mojibake.garbled_evidence(df).collect()} == {"reread": len(want)}
    out = {r["doc_id"]: r["text"] for r in mojibake.restored_documents(df).collect()}
    assert {i: out[i] for i in want} == want
    assert mojibake.garbled_evidence(df.limit(0)).collect() == []
