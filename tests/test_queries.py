"""Every query against its SQL on the smallest test data, and what the entry module promises."""

import ast
import glob
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]
CORE = {k for m in (entry.pipeline, entry.relational, entry.sequences, entry.texts, entry.catalog) for k in m.queries()}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {Path(f).stem} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.10g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(CORE & set(entry.oracle_sql())))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    rows = sorted((plain(tuple(r)) for r in df.collect()), key=repr)
    assert rows == sorted((plain(tuple(r[i] for i in at)) for r in want.fetchall()), key=repr)


def test_entry_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert callable(entry.entry)


def test_core_does_not_need_the_subpackage():
    for f in (ROOT / "tierlake").rglob("*.py"):
        if "llm" in f.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), f


def test_entry_does_without_the_subpackage(tmp_path):
    """The other queries stay if the subpackage can't be imported, for instance for want of a library."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('p8') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(CORE)), "False"] or not (ROOT / "tierlake" / "llm").exists()
