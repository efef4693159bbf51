"""The driver's contract, and every query with SQL beside that SQL."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import queries as engine

SF = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(engine.FOUND))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    if sql := entry.oracle_sql().get(name):
        want = duck.sql(sql)
        assert cols == sorted(want.columns)
        assert rows == sorted((tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)


@pytest.mark.parametrize("mix", "abcf")
def test_mixes_never_broadcast_the_store(spark, monkeypatch, mix):
    """Packed values make a store's files look small enough for the driver; both joins are by sorting."""
    staged = []
    own = engine.stage
    monkeypatch.setattr(engine, "stage", lambda df, name: staged.append(df) or own(df, name))
    got = entry.queries()[f"ycsb_{mix}_bulk"](spark, SF)
    for df in (*staged, got):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert len(staged) == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_optional_part(tmp_path):
    """The entry module imports, and has the engine's queries, where llm and the pipeline are gone."""
    for name in ("__spark_entry__.py", "tidemark"):
        os.symlink(f"{HERE}/{name}", tmp_path / name) if name.endswith(".py") else None
    os.mkdir(tmp_path / "tidemark")
    for name in os.listdir(f"{HERE}/tidemark"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{HERE}/tidemark/{name}", tmp_path / "tidemark" / name)
    code = "import sys; sys.path.insert(0, '.'); import runpy; e = runpy.run_path('__spark_entry__.py'); q = e['queries'](); assert 'asof_head' in q and not any(k.startswith('op') and k[2:3].isdigit() for k in q), sorted(q)"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, timeout=120).returncode == 0
