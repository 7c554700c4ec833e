"""Sources, sinks and streaming jobs against their batch counterparts."""

import datetime as dt
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from tierlake.operators.orphans import advance_counts, key_counts, orphan_report
from tierlake.sources import formats as S
from tierlake.streaming import jobs as J


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a":1,"b":"x"}\n\n{"a":null}\n')
    assert [tuple(r) for r in S.read_json_lines(spark, str(p), "a long, b string").collect()] == [(1, "x"), (None, None)]
    p.write_text('{"a":1}\n[1]\n{"a":\n"x"\n')
    assert [tuple(r) for r in S.read_json_lines(spark, str(p), "a long", strict=False).collect()] == [(1,)]
    with pytest.raises(Exception, match="not a JSON object"):
        S.read_json_lines(spark, str(p), "a long").collect()


def test_positional_lines(spark, tmp_path):
    p = tmp_path / "ledger.tsv"
    p.write_text("# note\ta\nA\tB\nA\tB\tC\nonly\n\t\n")
    assert sorted(map(tuple, S.read_positional(spark, str(p), ["x", "y"]).collect())) == [("", ""), ("A", "B")]


def test_incremental_manifests(spark, tmp_path):
    """Only new and changed files are opened: one that can't be read any more is left alone while its size and time stay."""
    src, root = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()

    def put(name, rows):
        with gzip.open(src / name, "wt") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)

    rows = lambda: sorted(r["p"] for r in spark.read.parquet(f"{root}/rows").collect())
    put("a.jsonl.gz", [{"p": "1"}, {"p": "2"}])
    put("b +%41 é.jsonl.gz", [{"p": "3"}])
    put("keep.jsonl.gz", [{"p": "9"}])
    assert S.ingest_manifests(spark, str(src), root, "p string") == {"new": 3}
    assert rows() == ["1", "2", "3", "9"]
    stat = (src / "keep.jsonl.gz").stat()
    (src / "keep.jsonl.gz").write_bytes(b"x" * stat.st_size)
    os.utime(src / "keep.jsonl.gz", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    put("b +%41 é.jsonl.gz", [{"p": "4"}, {"p": "5"}])
    put("c.jsonl.gz", [{"p": "6"}])
    (src / "a.jsonl.gz").unlink()
    assert S.ingest_manifests(spark, str(src), root, "p string") == {"vanished": 1, "changed": 1, "new": 1}
    assert rows() == ["4", "5", "6", "9"]
    assert S.ingest_manifests(spark, str(src), root, "p string") == {}
    put("c.jsonl.gz", [])
    assert S.ingest_manifests(spark, str(src), root, "p string") == {"changed": 1} and rows() == ["4", "5", "9"]


def test_two_writers(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    S.write_version(spark.range(1), root, "first")
    assert S.version_note(spark, root) == "first"
    real = S.current_version
    calls = []

    def late(s, r):  # another writer comes in between
        calls.append(1)
        if len(calls) == 2:
            monkeypatch.setattr(S, "current_version", real)
            S.write_version(spark.range(7), root)
        return real(s, r)

    monkeypatch.setattr(S, "current_version", late)
    with pytest.raises(S.Refused):
        S.write_version(spark.range(3), root)
    assert S.read_version(spark, root).count() == 7 and S.write_version(spark.range(4), root) == 4
    assert S.read_version(spark, root, 1).count() == 1


def test_versions_and_dumps(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(S.Refused):
        S.read_version(spark, root)
    assert S.write_version(spark.range(2), root) == 1 and S.write_version(spark.range(3), root) == 2
    assert S.read_version(spark, root).count() == 3 and S.read_version(spark, root, 1).count() == 2
    S.append_rows(spark.range(1), root + "/log", 1)
    S.append_rows(spark.range(1), root + "/log", 2)
    assert sorted(r["ingest_batch"] for r in spark.read.parquet(root + "/log").collect()) == [1, 2]
    S.dump_tables({"a": spark.range(4)}, root + "/dump")
    assert S.restore_tables(spark, root + "/dump", ["a"])["a"].count() == 4
    with pytest.raises(S.Refused):
        S.restore_tables(spark, root + "/dump", ["a", "b"])
    S.export_lines(spark.range(5).select("id", F.lit(None).cast("string").alias("a")), root + "/lines", "id")
    assert sorted(r[0] for r in spark.read.text(root + "/lines").collect())[0] == '{"a":null,"id":0}'


def test_valid_rows_and_documents(spark, tmp_path):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "n long")
    good, bad = S.split_valid(df, {"positive": F.col("n") > 0, "small": F.col("n") < 9})
    assert [r["n"] for r in good.collect()] == [1] and sorted(r["failed"] for r in bad.collect()) == [["positive"], ["positive", "small"]]
    p = tmp_path / "d.json"
    p.write_text('{"schema_version": 2}')
    assert S.load_document(str(p), 2) == {"schema_version": 2}
    with pytest.raises(S.Refused):
        S.load_document(str(p), 3)


T0 = dt.datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, name="in"):
    schema = "id long, ts timestamp, who string, value double"
    for k in range(2):
        part = rows[k::2]
        spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), w, v) for i, s, w, v in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return J.event_stream(spark, str(tmp_path / name), schema, files_per_trigger=1), spark.read.schema(schema).parquet(str(tmp_path / name))


ROWS = [(i, 7 * i, "ab"[i % 3 == 0], 0.05 + 0.1 * (i % 2)) for i in range(40)] + [(5, 35, "a", 0.15), (39, 273, "b", 0.15)]


def test_repeats_count_once(spark, tmp_path):
    s, b = stream(spark, tmp_path, ROWS)
    J.drain(J.once_each(s, "id", "ts"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted({r["id"] for r in b.collect()})


def test_windows_and_sessions_equal_the_batch(spark, tmp_path):
    rows = [*ROWS, (99, 500_000, "z", 1.0), (100, 500_001, "z", 1.0)]  # time goes on, so that all before is final
    s, b = stream(spark, tmp_path, rows)
    for n, f in enumerate((lambda x: J.tumbling_counts(x, "ts", "1 minute", "who"), lambda x: J.sessions(x, "who", "ts", "20 seconds"))):
        out = str(tmp_path / f"out{n}")
        J.drain(f(s), out, str(tmp_path / f"c{n}"))
        want = {tuple(r) for r in f(b).collect() if r["who"] != "z"}
        assert want and {tuple(r) for r in spark.read.parquet(out).collect() if r["who"] != "z"} == want


def test_latch_is_held_across_triggers(spark, tmp_path):
    s, _ = stream(spark, tmp_path, [(1, 1, "a", 0.16), (2, 2, "a", 0.0999), (3, 3, "a", 0.12), (4, 4, "b", 0.05), (5, 5, "a", 0.12), (6, 6, "b", 0.15)])
    q = J.latch(s, "who", "value", 0.10, 0.15).writeStream.format("memory").queryName("latched").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    last = {}
    for r in spark.table("latched").collect():
        if r["seen"] >= last.get(r["who"], (0, None))[0]:
            last[r["who"]] = (r["seen"], r["latched"])
    assert last["a"][0] == 4 and last["b"][0] == 2


DELTAS = "target string, key string, ref_table string, period string, refs long, rows long, removals long, at timestamp"
DAY = dt.timedelta(days=1)


def test_counts_are_maintained_from_deltas(spark, tmp_path, monkeypatch):
    put = lambda rows: spark.createDataFrame(rows, DELTAS).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    tick = lambda c="c": J.maintain_counts(spark.readStream.schema(DELTAS).parquet(str(tmp_path / "d")), str(tmp_path / "state"), str(tmp_path / c))
    report = lambda: sorted((r["ref_key"], r["kind"], r["n_refs"]) for r in orphan_report(J.kept_counts(spark, str(tmp_path / "state"))).collect())
    put([("o", "k1", "r", "2024-01", 1, 0, 0, T0), ("o", "k2", "r", "2024-01", 1, 0, 0, T0), ("o", "k3", "r", "2024-01", 1, 0, 0, T0), ("o", "k4", "r", "2024-01", 1, 0, 0, T0)])
    tick()
    put([("o", "k1", "r", "2024-01", -1, 0, 0, T0), ("o", "k2", None, None, 0, 1, 0, T0), ("o", "k3", None, None, 0, 0, 1, None), ("o", "k4", None, None, 0, 1, 0, T0 + DAY)])
    tick()
    tick()
    assert report() == [("k3", "deleted", 1), ("k4", "late", 1)]
    # a batch whose commit was lost comes again, with the same id and rows
    import shutil

    (tmp_path / "c" / "commits" / "1").unlink()
    shutil.rmtree(tmp_path / "c" / "commits" / ".1.crc", ignore_errors=True)
    (tmp_path / "c" / "commits" / ".1.crc").unlink(missing_ok=True)
    tick()
    assert report() == [("k3", "deleted", 1), ("k4", "late", 1)]
    # folded into a base, and replayed again
    monkeypatch.setattr(J, "FIRST_FOLD", 1)
    put([("o", "k4", None, None, 0, -1, 0, T0 + DAY), ("o", "k4", None, None, 0, 1, 0, T0)])
    tick()
    assert J._pending(spark, str(tmp_path / "state")) == [] and report() == [("k3", "deleted", 1)]
    for f in ("2", ".2.crc"):
        (tmp_path / "c" / "commits" / f).unlink(missing_ok=True)
    tick()
    assert report() == [("k3", "deleted", 1)]


def test_a_withdrawn_record_is_late_no_more(spark):
    d = lambda rows: spark.createDataFrame(rows, DELTAS)
    state = key_counts(d([("o", "k", "r", "2024-01", 1, 0, 0, T0 + 4 * DAY), ("o", "k", None, None, 0, 1, 0, T0), ("o", "k", None, None, 0, 1, 0, T0 + 8 * DAY)]))
    assert [r["kind"] for r in orphan_report(state).collect()] == ["late"]
    state = advance_counts(state, d([("o", "k", None, None, 0, -1, 0, T0 + 8 * DAY)]))
    assert orphan_report(state).collect() == []
    state = advance_counts(state, d([("o", "k", "r", "2024-01", 1, 0, 0, T0 - DAY), ("o", "k", None, None, 0, -1, 0, T0)]))
    assert [(r["kind"], r["n_refs"]) for r in orphan_report(state).collect()] == [("missing", 2)]
    assert advance_counts(state, state.withColumns({c: -F.col(c) for c in ("refs", "rows", "removals")})).collect() == []


def run_stream(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_entries_expire(spark, tmp_path):
    rows = [(1, 0, "a", 1.0), (2, 50, "a", 2.0), (3, 10, "b", 3.0), (4, 20_000, "z", 0.0), (5, 20_001, "z", 0.0), (6, 40_000, "z", 5.0)]
    s, _ = stream(spark, tmp_path, sorted(rows, key=lambda r: r[1]))
    got = run_stream(spark, J.fresh_values(s, "who", "value", "ts", 60, late="1 second"), tmp_path, "fresh")
    expired = {r["who"]: (r["value"], (r["ts"] - T0).total_seconds()) for r in got if r["expired"]}
    assert expired["a"] == (2.0, 50.0) and expired["b"] == (3.0, 10.0)


def test_leases_have_one_owner(spark, tmp_path):
    schema = "key string, who string, what string, ts timestamp"
    rows = [("k", "a", "take", 0), ("k", "b", "take", 5), ("k", "a", "take", 8), ("k", "b", "take", 20), ("k", "a", "release", 21), ("k", "b", "release", 22), ("k", "a", "take", 23), ("z", "x", "take", 5000), ("z", "x", "take", 9000)]
    for part in (rows[:4], rows[4:8], rows[8:]):
        spark.createDataFrame([(k, w, a, T0 + dt.timedelta(seconds=s)) for k, w, a, s in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
    s = J.event_stream(spark, str(tmp_path / "l"), schema, files_per_trigger=1)
    got = run_stream(spark, J.leases(s, "key", "who", "what", "ts", 10, late="1 second"), tmp_path, "leases")
    mine = sorted((int((r["ts"] - T0).total_seconds()), r["who"], r["outcome"]) for r in got if r["key"] == "k")
    assert mine == [(0, "a", "granted"), (5, "b", "refused"), (8, "a", "renewed"), (18, "a", "expired"), (20, "b", "granted"), (21, "a", "ignored"), (22, "b", "released"), (23, "a", "granted"), (33, "a", "expired")]


def test_one_tick_at_a_time(spark, tmp_path):
    root = str(tmp_path / "r")
    assert J.single_tick(spark, root, lambda: None) is False

    def within():
        with pytest.raises(S.Refused):
            J.single_tick(spark, root, lambda: None)

    assert J.single_tick(spark, root, within) is False
    (tmp_path / "r" / "RUNNING").touch()
    assert J.single_tick(spark, root, lambda: None, stale_seconds=0) is True
    assert not (tmp_path / "r" / "RUNNING").exists()
