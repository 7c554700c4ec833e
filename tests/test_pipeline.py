"""The general data-pipeline operators on small fixtures: nulls, blanks, ties, repeats, empty tables, clashing columns."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tierlake.operators.copy_diff import bucket_count, copy_differences
from tierlake.operators.entity_features import entity_features
from tierlake.operators.heavy_keys import hot_keys, key_totals
from tierlake.operators.orphans import existence_deltas, orphan_references, reference_deltas, removal_deltas

EVENTS = "id long, at double, workspace_key string, event string, type string, n_total long"


def events(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], EVENTS)


@pytest.fixture(scope="module")
def types(spark):
    return spark.createDataFrame([("SYNC", "page"), ("PIN", "page"), ("sync ", "page"), (None, "page")], "event string, family string")


def test_features_of_dirty_events(spark, types):
    rows = [(1, 10.0, "h|/a", "SYNC"), (1, 10.0, "h|/a", "SYNC"), (2, 30.0, "h|/a/", " sync"), (3, 20.0, "h|/a", "Pin "), (4, None, "h|/a", "PIN"), (5, float("nan"), "h|/b", "PIN")]
    rows += [(6, 1.0, "h|/a", "OTHER"), (7, 2.0, "h|/a", None), (8, 3.0, None, "SYNC"), (9, 3.0, "", "SYNC"), (10, 3.0, "//", "SYNC"), (None, 9.0, "h|/c", "SYNC"), (None, 9.0, "h|/c", "SYNC")]
    out = {r["workspace_key"]: r.asDict() for r in entity_features(events(spark, rows), types).collect()}
    assert set(out) == {"h|/a", "h|/b", "h|/c"}
    a = out["h|/a"]
    assert (a["n_total"], a["n_types"], a["n_unlisted"], a["first_at"], a["last_at"]) == (6, 2, 2, 1.0, 30.0)
    assert (a["n_sync"], a["last_sync"], a["n_pin"], a["last_pin"]) == (2, 30.0, 2, 20.0)
    assert (out["h|/b"]["n_pin"], out["h|/b"]["last_pin"], out["h|/b"]["last_at"], out["h|/b"]["n_sync"]) == (1, None, None, 0)
    assert out["h|/c"]["n_sync"] == 1


def test_features_over_many_blocks(spark, types):
    n = 3000
    df = spark.range(n).select(F.col("id"), (F.col("id") % 97).cast("double").alias("at"), F.concat(F.lit("w"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500)).alias("workspace_key"), F.when(F.col("id") % 2 == 0, "SYNC").otherwise("PIN").alias("event"))
    got = {r["workspace_key"]: (r["n_total"], r["n_sync"], r["last_pin"]) for r in entity_features(df, types, block=7).collect()}
    want = {}
    for i in range(n):
        k = f"w{0 if i % 3 == 0 else i % 500}"
        t, s, last = want.get(k, (0, 0, None))
        want[k] = (t + 1, s + (i % 2 == 0), last if i % 2 == 0 else max(last or 0.0, float(i % 97)))
    assert got == want


def test_a_task_sends_an_entity_and_type_once(monkeypatch):
    """Stretches of a task are folded with each other, whatever the number of events of a hot entity."""
    import numpy as np
    import pyarrow as pa

    from tierlake.operators import entity_features as E

    monkeypatch.setattr(E, "PARTIAL_ROWS", 50)
    monkeypatch.setattr(E, "FOLDED_ROWS", 60)
    r = np.random.default_rng(0)
    n = 4000
    entity = np.where(r.random(n) < 0.6, 0, r.integers(0, 30, n))
    kind, at = r.integers(0, 3, n), r.random(n)
    t = pa.table({"id": np.arange(n), "entity": pa.array([f"w{k}" for k in entity]), "at": pa.array(at), "type": pa.array(kind.astype(np.int32))})
    got = [x for b in E._partial(2)(iter(t.to_batches(max_chunksize=30))) for x in b.to_pylist()]
    want = {}
    for e, k, a in zip(entity, kind, at, strict=True):
        c, lo, hi = want.get((f"w{e}", k), (0, np.inf, -np.inf))
        want[f"w{e}", k] = (c + 1, min(lo, a), max(hi, a))
    assert {(x["entity"], x["type"]): (x["n"], x["first"], x["last"]) for x in got} == want and len(got) == len(want)


def test_features_of_nothing(spark, types):
    out = entity_features(events(spark, []), types)
    assert out.count() == 0 and out.columns[:3] == ["workspace_key", "n_total", "n_types"]
    assert entity_features(events(spark, [(1, 1.0, "a", "X")]), types.limit(0)).collect()[0]["n_unlisted"] == 1


def test_events_without_an_id_count_each(spark, types):
    rows = [(None, 1.0, "w", "SYNC"), (None, 2.0, "w/", "SYNC"), (None, 2.0, "w/", "SYNC"), (None, None, "w", "PIN"), (None, 5.0, "v", "SYNC"), (-(1 << 63), 3.0, "v", "SYNC"), (None, 5.0, None, "SYNC")]
    df = events(spark, rows).withColumn("more", F.create_map(F.lit("a"), F.col("at")))
    out = {r["workspace_key"]: (r["n_total"], r["n_sync"], r["first_at"], r["last_sync"], r["n_pin"], r["last_pin"]) for r in entity_features(df, types).collect()}
    assert out == {"w": (3, 2, 1.0, 2.0, 1, None), "v": (2, 2, 3.0, 5.0, 0, None)}


FILES = "source_path string, relative_path string, size_bytes long, mtime_ns long, asset_id string, side string, bucket long"


def files(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 1) for r in rows], FILES)


def differences(a, b):
    return sorted(map(tuple, copy_differences(a, b).collect()), key=repr)


def test_differences_of_two_copies(spark):
    nfd = unicodedata.normalize("NFD", "é/ü")
    a = [("m", "x//./é/ü", 1, 2), ("m", "same", 1, None), ("m", "same", 1, None), ("m", "size", 1, 5), ("m", "both", 1, 1), ("m", "only-a", 1, 1), ("m", "nulls", None, 1), ("m", None, 1, 1), (None, "p", 1, 1), ("m", "Case", 1, 1), ("m", "", 3, 3)]
    b = [("m", "./x/" + nfd, 1, 2), ("m", "same", 1, None), ("m", "size", 2, 5), ("m", "both", 2, None), ("m", "nulls", 0, 1), ("m", None, 1, 1), (None, "p", 1, 2), ("m", "case", 1, 1), ("m", "only-b", 1, 1), ("m", "only-b/", 1, 1), ("m", "./", 3, 3)]
    assert differences(files(spark, a), files(spark, b)) == sorted(
        [("m", "size", "size_bytes"), ("m", "both", "size_bytes"), ("m", "both", "mtime_ns"), ("m", "only-a", "missing_in_mirror"), ("m", "nulls", "size_bytes"), (None, "p", "mtime_ns"), ("m", "Case", "missing_in_mirror"), ("m", "case", "missing_in_primary"), ("m", "only-b", "missing_in_primary")],
        key=repr,
    )


def test_differences_of_keys_with_several_values(spark):
    a = files(spark, [("s", "p", n, 1) for n in (1, 5, 9)] + [("s", "q", n, 1) for n in (1, 5, 9)] + [("s", "r", 1, t) for t in (None, 3, 4, 8)])
    b = files(spark, [("s", "p", n, 1) for n in (1, 7, 9, 9)] + [("s", "q", n, 1) for n in (9, 9, 5, 1)] + [("s", "r", 1, t) for t in (None, 3, 8)])
    assert sorted(map(tuple, copy_differences(a, b).collect())) == [("s", "p", "size_bytes"), ("s", "r", "mtime_ns")]


def test_differences_of_empty_copies(spark):
    assert differences(files(spark, []), files(spark, [])) == []
    assert differences(files(spark, []), files(spark, [("m", "a", 1, 1), ("m", "a", 1, 1)])) == [("m", "a", "missing_in_primary")]


def test_differences_against_brute_force(spark):
    import random

    r = random.Random(3)
    a = [(f"m{r.randrange(3)}", f"d/{i}", r.randrange(5), r.randrange(3)) for i in range(4000)]
    b = [(s, p, n + (r.random() < 0.01), t) for s, p, n, t in a if r.random() > 0.01] + [("m0", f"new/{i}", 1, 1) for i in range(9)]
    r.shuffle(b)
    x, y = {k[:2]: k for k in a}, {k[:2]: k for k in b}
    want = [(*k, "missing_in_mirror") for k in x if k not in y] + [(*k, "missing_in_primary") for k in y if k not in x]
    want += [(*k, c) for k in x if k in y for i, c in ((2, "size_bytes"), (3, "mtime_ns")) if x[k][i] != y[k][i]]
    assert differences(files(spark, a), files(spark, b)) == sorted(want, key=repr)
    assert bucket_count(0) == 1 << 10 and bucket_count(10**12) == 1 << 26


def test_equal_copies_need_one_pass(spark):
    """Nothing is read again if the matrix is equal, and only columns that it found unequal otherwise."""
    rows = [(f"m{i % 7}", f"d/{i}", i % 5, i) for i in range(3000)]
    a, b = files(spark, rows), files(spark, rows[::-1])
    same = copy_differences(a, b)
    assert same.collect() == [] and "Exchange" not in same._jdf.queryExecution().optimizedPlan().toString() and "Join" not in same._jdf.queryExecution().optimizedPlan().toString()
    few = copy_differences(a, files(spark, [(s, p, n, t + (p == "d/7")) for s, p, n, t in rows] + rows[:9]))
    assert [tuple(r) for r in few.collect()] == [("m0", "d/7", "mtime_ns")]


def test_totals_of_heavy_keys(spark):
    rows = [("hot", "a", 1)] * 60 + [("hot", "b", 2), ("hot", None, None), (None, "a", 5), ("cold", None, None)]
    df = spark.createDataFrame(rows, "key string, value string, n long")
    out = {r["key"]: tuple(r)[1:] for r in key_totals(df, F.col("key"), F.col("value"), F.col("n")).collect()}
    assert out == {"hot": (62, 2, 60, 62), None: (1, 1, 1, 5), "cold": (1, 0, 0, None)}
    assert [r["key"] for r in hot_keys(key_totals(df, F.col("key"), F.col("value")), 0.5).collect()] == ["hot"]
    assert key_totals(df.limit(0), F.col("key"), F.col("value")).count() == 0


def test_orphan_references(spark):
    ts = lambda x: F.timestamp_seconds(F.col(x))
    refs = spark.createDataFrame([("k1", 10.0), ("k1", 10.0), ("k2", 10.0), ("k3", 10.0), ("k4", 10.0), ("k4", 99.0), ("k5", None), (None, 1.0), ("k6", 10.0)], "key string, t double")
    rows = spark.createDataFrame([("k2", 5.0), ("k4", 50.0), ("k4", 50.0), ("k5", 50.0), ("k6", None), ("unused", 1.0)], "key string, t double")
    gone = spark.createDataFrame([("object", "k3"), ("asset", "k1"), ("object", "k2"), (None, "k1"), ("object", None)], "kind string, key string")
    deltas = reference_deltas(refs, "r", "object", F.col("key"), ts("t"), ts("t")).unionByName(existence_deltas(rows, "object", F.col("key"), ts("t"))).unionByName(removal_deltas(gone, F.col("kind"), F.col("key")))
    assert sorted(map(tuple, orphan_references(deltas).collect())) == [("r", "k1", "missing", "1970-01", 2), ("r", "k3", "deleted", "1970-01", 1), ("r", "k4", "late", "1970-01", 2)]
    # a later change withdraws a reference and registers a row
    change = deltas.where("key in ('k1', 'k3') and refs > 0").withColumn("refs", -F.col("refs"))
    assert [r["ref_key"] for r in orphan_references(deltas.unionByName(change)).collect()] == ["k4"]
    assert orphan_references(deltas.limit(0)).count() == 0
