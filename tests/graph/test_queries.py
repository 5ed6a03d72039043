"""The registered queries against their SQL, and against brute force where there is none."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from codeloom.plans import catalogue
from codeloom.plans.scc import components_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders", "customer", "documents", "embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([round(r[k], 8) if isinstance(r[k], float) else r[k] for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), want.columns)


def test_call_cycles(spark):
    from codeloom.plans.projection import calls

    edges = [(r["caller"], r["callee"]) for r in calls(spark, SF).collect() if int(r["caller"]) % 5 != 4]
    parts: dict = {}
    for node, name in components_of(edges).items():
        parts.setdefault(name, []).append(node)
    want = sorted(((len(p), ",".join(sorted(p))) for p in parts.values() if len(p) > 1), reverse=True)[:20]
    assert [(r["size"], r["nodes"]) for r in catalogue.QUERIES["find_cycles_call"](spark, SF).collect()] == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_corpus_subpackage(tmp_path, pipeline):
    root = Path(entry.__file__).resolve().parent
    shutil.copytree(root / "codeloom", tmp_path / "codeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (pipeline and (root / "corpus_pipeline.py").exists()):
        shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.catalogue.QUERIES), sorted(e.oracle_sql()) == sorted(e.catalogue.ORACLES))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["True", "True"], done.stderr
    (tmp_path / "codeloom" / "llm").mkdir()  # a folder that only caches are left in
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["True", "True"], done.stderr
