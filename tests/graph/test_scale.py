"""What must not grow with the input: pairs that are grouped, plans, broadcasts, shares of a task."""

from __future__ import annotations

import random
import re

import pytest

from codeloom.operators import attribution, ingest, navigation
from codeloom.plans import paths, projection, scc
from codeloom.plans.catalogue import QUERIES
from codeloom.plans.scc import components_of, strongly_connected
from codeloom.store import Graph
from tests.graph import sample
from tests.graph.test_engine import contents

SF = "/root/testdata/sf0.001"
SYMBOLS = "qualified_name string, kind string, file string, start_line int, end_line int"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def places(spark, rng, n=300):
    """Many symbols share their lines, some are long, some of another kind."""
    rows = []
    for k in range(n):
        start = rng.randrange(1, 12) * 10
        rows.append((f"s{k}", rng.choice(["function", "method", "class"]), rng.choice("ab"), start, start + rng.choice([0, 14, 14, 14, 90])))
    return rows, spark.createDataFrame(rows, SYMBOLS)


@pytest.mark.parametrize("broadcast", [attribution.BROADCAST_SPANS, 0])
def test_symbols_at_the_same_lines_are_met_once(spark, monkeypatch, broadcast):
    monkeypatch.setattr(attribution, "BROADCAST_SPANS", broadcast)
    monkeypatch.setattr(attribution, "NAMES_IN_A_LIST", 4)
    rng = random.Random(5)
    rows, symbols = places(spark, rng)
    lines = [(f"t{rng.randrange(4)}", rng.choice("ab"), rng.randrange(0, 200)) for _ in range(300)]
    hunks = [(f"c{rng.randrange(4)}", f, a, a + rng.randrange(0, 60)) for _, f, a in lines[:120]]
    want, overlap = {}, {}
    for name, kind, file, start, end in rows:
        for test, f, line in set(lines) if kind != "class" else ():
            if f == file and start <= line <= end:
                want[test, name] = want.get((test, name), 0) + 1
        for sha, f, a, b in hunks if kind != "class" else ():
            if f == file and a <= end and start <= b:
                overlap[name, sha] = overlap.get((name, sha), 0) + min(b, end) - max(a, start) + 1
    covered = attribution.map_coverage(spark.createDataFrame(lines, "test string, file string, line int"), symbols)
    touched = attribution.attribute_hunks(spark.createDataFrame(hunks, "sha string, file string, start int, end int"), symbols)
    assert sorted((r["test"], r["symbol"], r["lines_covered"]) for r in covered.collect()) == sorted((*k, n) for k, n in want.items())
    assert sorted(tuple(r) for r in touched.collect()) == sorted((*k, n) for k, n in overlap.items())
    # the names come last: nothing is grouped, sorted or moved once the pairs are there
    for df in (covered, touched):
        above = optimized(df).split("Generate explode(names")[0]
        assert "Join" not in above and "Aggregate" not in above and "Repartition" not in above and above != optimized(df)


def test_plans_do_not_multiply_from_step_to_step(spark):
    """What several steps read is stored, so no plan holds the extraction, or the symbols' plan for each end of a call."""
    project = "demo"
    graph = ingest.build(Graph.of(spark), project, contents(spark, sample.PYTHON), "/src")
    later, summary = ingest.update(graph, project, contents(spark, sample.PYTHON | {"runner.py": sample.PYTHON["runner.py"] + "\ndef more():\n    main()\n"}))
    assert (summary.changed, summary.unchanged) == (1, 2)
    assert {r["qualified_name"] for r in later["symbols"].collect()} - {r["qualified_name"] for r in graph["symbols"].collect()} == {"runner.py::more"}
    for name in ("symbols", "calls", "imports", "files"):
        plan = optimized(later[name])
        assert "MapInPandas" not in plan
        assert plan.count("\n") < 400


def test_ways_cost_what_lies_above_their_seeds(spark, monkeypatch):
    """The search for circles sees the edges that a way can take, not the whole graph."""
    edges = [("b", "a"), ("c", "b"), ("b", "c"), ("d", "c"), ("e", "d"), ("f", "e"), ("a", "z")] + [(f"x{k}", f"x{k // 2}") for k in range(1, 400)]
    seen = []
    monkeypatch.setattr(paths, "strongly_connected", lambda spark, e: seen.append({tuple(r) for r in e.collect()}) or strongly_connected(spark, e))
    calls = spark.createDataFrame([(u, v, True, False) for u, v in edges], "caller string, callee string, static boolean, runtime boolean")
    found = paths.upstream_paths(calls, spark.createDataFrame([("a",)], "via string"), 4)
    assert seen == [{("b", "a"), ("c", "b"), ("b", "c"), ("d", "c"), ("e", "d")}]
    want = [("b", 1), ("c", 2), ("b", 3), ("d", 3), ("e", 4)]
    assert sorted((r["node"], r["depth"]) for r in found.collect()) == sorted(want)


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(projection, "ROWS_IN_A_TASK", 500)
    rows = projection.read(spark, SF, "lineitem").count()
    for df in (projection.steps(spark, SF), projection.calls(spark, SF), QUERIES["runtime_merge"](spark, SF)):
        found = [int(n) for n in re.findall(r"RepartitionByExpression \[.*\], (\d+)", optimized(df))]
        assert found and set(found) == {-(-rows // 500)}
        # what is dealt by u and v is grouped where it lies
        physical = df._jdf.queryExecution().executedPlan().toString()
        assert physical.count("Exchange hashpartitioning") == len(found)


@pytest.mark.parametrize("name", ["dead_static_calls", "runtime_only_calls"])
def test_one_sided_calls_gather_no_symbols(spark, monkeypatch, name):
    monkeypatch.setattr(navigation, "SYMBOLS_IN_A_TASK", 10)
    df = QUERIES[name](spark, SF)
    symbols = projection.read(spark, SF, "part").count()
    found = re.findall(r"RepartitionByExpression \[(call\w+)#.*\], (\d+)", optimized(df))
    assert sorted(found) == [("callee", str(symbols // 10)), ("caller", str(symbols // 10))]
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_components_by_spreading_against_the_search(spark):
    rng = random.Random(8)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(75)} | {(100, 101), (101, 102), (200, 200), (201, 200), (200, 202)}
    got = {r["node"]: r["component"] for r in scc.spread(spark, spark.createDataFrame(sorted(edges), "u long, v long")).collect()}
    # 101 loses both its edges when the ends of its chain go
    assert got == components_of(sorted(edges))
