"""The sample projects through the whole engine."""

from __future__ import annotations

import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from codeloom.checks import config as cc
from codeloom.checks import run as checks
from codeloom.operators import architecture, freeform, ingest, semantic, upserts
from codeloom.operators.embed import DimensionMismatch, HashingProvider, embed_project
from codeloom.operators.resolve import TsPaths
from codeloom.plans.paths import upstream_depths, upstream_paths
from codeloom.plans.scc import components_of, spread
from codeloom.sources.files import source_files
from codeloom.sources.history import COMMITS
from codeloom.store import Graph, GraphStore, KeyViolation, duplicate_keys
from codeloom.tools import Tools
from tests.graph import sample

P = "demo"
QN = {"add": "calculator.py::Calculator.add", "mul": "calculator.py::Calculator.multiply", "calc": "calculator.py::Calculator", "run": "runner.py::run_operation", "main": "runner.py::main"}
T_ADD, T_RUN, T_MAIN = (f"test_calculator.py::{t}" for t in ("test_add", "test_run_operation_dynamic_dispatch", "test_main"))


def contents(spark, files):
    rows = [(p, "python" if p.endswith(".py") else "typescript", bytearray(t.encode())) for p, t in files.items()]
    return spark.createDataFrame(rows, "path string, language string, content binary").withColumn("content_hash", F.sha2("content", 256))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return GraphStore(spark, f"file://{tmp_path_factory.mktemp('store')}")


@pytest.fixture(scope="module")
def graph(spark, store):
    graph = store.commit(ingest.build(store.load(), P, contents(spark, sample.PYTHON), "/src"))
    calls = spark.createDataFrame(
        [(QN["run"], QN["add"], T_MAIN, 1), (QN["run"], QN["mul"], T_RUN, 1), (QN["run"], QN["mul"], T_MAIN, 1), (QN["main"], QN["run"], T_MAIN, 2), (T_ADD, QN["add"], T_ADD, 1), (T_RUN, QN["run"], T_RUN, 1), (T_MAIN, QN["main"], T_MAIN, 1), ("x::gone", QN["add"], T_ADD, 1)],
        "caller string, callee string, test string, observed_count long",
    )
    tests = spark.createDataFrame([(T_ADD, "passed", 0.1), (T_RUN, "passed", 0.2), (T_MAIN, "failed", 0.3), ("test_calculator.py::TestX::test_y", "passed", 0.1)], "qualified_name string, outcome string, duration double")
    lines = spark.createDataFrame([(T_ADD, "calculator.py", 8), (T_RUN, "runner.py", 9), (T_RUN, "calculator.py", 11), (T_MAIN, "runner.py", 13), (T_MAIN, "runner.py", 14), (T_MAIN, "runner.py", 9), (T_MAIN, "calculator.py", 8), (T_MAIN, "calculator.py", 11), (T_MAIN, "calculator.py", 2)], "test string, file string, line int")
    return store.commit(ingest.augment(graph, P, calls, tests, lines))


@pytest.fixture(scope="module")
def tools(graph):
    return Tools(graph, P, HashingProvider(64))


def names(rows):
    return [r["qualified_name"] for r in rows]


def test_status_and_keys(graph, tools):
    s = tools.graph_status()
    assert (s["files"], s["classes"], s["methods"], s["functions"], s["tests"]) == (3, 1, 2, 5, 3)
    assert (s["calls"], s["both"], s["runtime_only"], s["static_only"]) == (9, 4, 2, 3)
    assert all(not duplicate_keys(graph, t).head(1) for t in graph.tables)
    assert tools.project_exists() and not Tools(graph, "other").project_exists()
    assert set(Tools(graph, "other").graph_status().values()) == {0}


def test_wrong_keys_are_not_stored(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    good = Graph.of(spark, files=spark.createDataFrame([(P, "a.py")], "project string, path string"))
    store.commit(good)
    for rows in ([(P, "b.py"), (P, "b.py")], [(P, None)]):
        with pytest.raises(KeyViolation):
            store.commit(Graph.of(spark, files=spark.createDataFrame(rows, "project string, path string")))
        assert store.version() == 1 and [r.path for r in store.load()["files"].collect()] == ["a.py"]
    store.clean()


def test_navigation(tools):
    assert names(tools.find_symbol("ADD")) == [QN["add"], T_ADD]
    assert names(tools.find_symbol("add", exact=True)) == [QN["add"]]
    got = tools.get_source(QN["add"])
    assert got["source"].startswith("def add") and got["runtime_observed"] and got["coverage_pct"] == 50.0 and tools.get_source("none") is None
    assert names(tools.find_callees(QN["run"])) == [QN["add"], QN["mul"]] and tools.find_callees(QN["run"], "static") == []
    assert names(tools.find_callers(QN["add"], "static")) == [T_ADD] and names(tools.find_callers(QN["add"], "runtime")) == [QN["run"], T_ADD]
    only = tools.runtime_only_calls()
    assert [(r["caller"]["name"], r["callee"]["name"], r["observed_count"]) for r in only] == [("run_operation", "add", 1), ("run_operation", "multiply", 2)]
    assert tools.runtime_only_calls("calculator.py") == []
    assert {(r["caller"]["name"], r["callee"]["name"]) for r in tools.dead_static_calls()} == {("main", "Calculator"), ("test_add", "Calculator"), ("test_run_operation_dynamic_dispatch", "Calculator")}
    assert [(r["qualified_name"], r["coverage_pct"], r["test_outcome"]) for r in tools.tests_for(QN["mul"])] == [(T_MAIN, 50.0, "failed"), (T_RUN, 50.0, "passed")]
    assert tools.untested_symbols() == []
    assert [r["other"] for r in tools.imports("test_calculator.py")] == ["calculator.py", "runner.py"]
    assert [r["other"] for r in tools.imports("calculator.py", "in")] == ["runner.py", "test_calculator.py"]
    with pytest.raises(ValueError):
        tools.imports("x", "sideways")


def test_change_impact(tools):
    diff = "--- a/calculator.py\n+++ b/calculator.py\n@@ -8 +8 @@\n-        return a + b\n+        return b + a\n--- a/none.py\n+++ b/none.py\n@@ -1 +1 @@\n+x\n"
    got = tools.change_impact(diff)
    assert names(got["changed"]) == [QN["add"]] and got["unmatched_files"] == ["none.py"]
    assert {r["qualified_name"]: r["reached_via"][0]["depth"] for r in got["impacted"]} == {QN["run"]: 1, T_ADD: 1, QN["main"]: 2, T_RUN: 2, T_MAIN: 3}
    assert got["stats"] == {"changed_files": 2, "changed_symbols": 1, "impacted_symbols": 5, "tests_to_run": 3, "max_depth_reached": 3}
    assert {r["qualified_name"]: r["covers_symbols"] for r in got["tests_to_run"]}[T_ADD] == [QN["add"]]
    way = next(r for r in got["impacted"] if r["qualified_name"] == QN["main"])["reached_via"]
    assert way == [{"via": QN["add"], "depth": 2, "edges": [{"static": True, "runtime": True}, {"static": False, "runtime": True}]}]
    assert names(tools.change_impact(diff, provenance="static")["impacted"]) == [T_ADD]
    assert tools.change_impact("")["stats"]["changed_files"] == 0


def test_free_form(tools):
    out = tools.run_sql("SELECT qualified_name FROM symbols WHERE project = :project AND kind = :k ORDER BY 1;", {"k": "method"}, row_limit=1)
    assert out["rows"] == [{"qualified_name": QN["add"]}] and out["truncated"] and out["row_count"] == 1
    for query, error in (("DROP TABLE symbols", freeform.ForbiddenKeyword), ("SELECT FROM WHERE", freeform.SqlSyntax), ("SELECT nope FROM symbols", freeform.SqlSyntax), ("SHOW TABLES", freeform.WriteAttempted)):
        with pytest.raises(error):
            tools.run_sql(query)
    with pytest.raises(freeform.Timeout):
        tools.run_sql("SELECT sum(a.id * b.id % 7) FROM range(100000000) a, range(100000) b", timeout_seconds=1)
    assert {t["name"] for t in tools.describe_schema()["tables"]} == set(tools.graph.tables)
    for example in tools.describe_schema()["examples"]:
        args = {k: "x" for k in ("q", "qn", "file") if f":{k}" in example["query"]}
        tools.run_sql(example["query"], args)


def test_semantic(graph):
    provider = HashingProvider(64)
    embedded = embed_project(graph, P, provider)
    tools = Tools(embedded, P, provider)
    found = tools.semantic_search("def multiply(self, a, b): return a * b", limit=2)
    assert names(found["results"])[0] == QN["mul"] and found["embedded_count"] == 7 and found["results"][0]["score"] > 0.9
    assert {r["kind"] for r in tools.semantic_search("add", kind="method")["results"]} == {"method"}
    around = tools.semantic_neighborhood("run_operation calculator name", limit=1)["results"][0]
    assert around["qualified_name"] == QN["run"] and [c["provenance"] for c in around["callees"]] == ["runtime", "runtime"]
    assert names(around["callers"]) == [QN["main"], T_RUN] and names(around["tests"]) == [T_MAIN, T_RUN]
    assert "callers" not in tools.semantic_neighborhood("run_operation", include=["tests"])["results"][0]
    assert tools.semantic_search("x", kind="odd")["warning"] and Tools(graph, P, provider).semantic_search("x")["warning"] and Tools(embedded, P).semantic_search("x")["warning"]
    with pytest.raises(DimensionMismatch):
        embed_project(embedded, P, HashingProvider(32))
    again = embed_project(embedded, P, HashingProvider(32), rebuild=True)
    assert again.within("embeddings", P).select(F.size("embedding")).distinct().collect()[0][0] == 32
    unit = semantic.semantic_search(embedded, P, provider.encode(["add"])[0], 1, score="unit").first()["score"]
    assert 0.5 <= unit <= 1


def test_update(spark, graph):
    files = dict(sample.PYTHON)
    files["calculator.py"] = files["calculator.py"].replace("multiply", "times")
    files["extra.py"] = "from runner import main\n\n\ndef extra():\n    return main()\n"
    del files["runner.py"]
    updated, summary = ingest.update(graph, P, contents(spark, files))
    assert (summary.added, summary.changed, summary.deleted, summary.unchanged, summary.parse_errors) == (1, 1, 1, 1, 0)
    left = {r["qualified_name"]: r for r in updated.symbols(P).collect()}
    assert QN["mul"] not in left and QN["run"] not in left and "calculator.py::Calculator.times" in left and "extra.py::extra" in left
    assert left[QN["add"]]["runtime_stale"] and not left[T_ADD]["runtime_stale"]
    ends = {x for r in updated["calls"].collect() for x in (r["caller"], r["callee"])}
    assert ends <= set(left) | {"test_calculator.py::TestX::test_y"}
    assert [r["target_kind"] for r in updated["imports"].where("src = 'extra.py'").collect()] == ["thirdparty"]
    broken, summary = ingest.update(graph, P, contents(spark, sample.PYTHON | {"calculator.py": "def ("}), ["calculator.py"])
    assert summary.parse_errors == 1 and QN["add"] in names(broken.symbols(P).collect())
    assert broken["files"].where("parse_error").count() == 1
    none, summary = ingest.update(graph, P, contents(spark, sample.PYTHON))
    assert (summary.unchanged, summary.changed) == (3, 0) and none["calls"].count() == graph["calls"].count()
    assert ingest.drifted(graph.within("files", P), contents(spark, files)).first()[0] == 3


def test_rebuild_is_idempotent(spark, graph):
    again = ingest.build(graph, P, contents(spark, sample.PYTHON), "/src")
    for t in ("files", "symbols", "calls", "imports", "covers"):
        assert sorted(map(str, again[t].collect())) == sorted(map(str, graph[t].collect())), t


def test_deletes(spark, graph):
    gone = spark.createDataFrame([(P, "runner.py")], "project string, path string")
    out = upserts.delete_files(graph, gone)
    assert out["files"].count() == 2 and not [r for r in out["calls"].collect() if "runner.py" in r["caller"] + r["callee"]]
    assert not out["imports"].where("target = 'runner.py' or src = 'runner.py'").head(1) and not out["covers"].where("symbol like 'runner%'").head(1)
    stale = upserts.flag_stale(graph, gone)
    assert names(stale["symbols"].where("runtime_stale").orderBy("qualified_name").collect()) == [QN["main"], QN["run"]]
    assert not upserts.clear_stale(stale, stale["symbols"])["symbols"].where("runtime_stale").head(1)


def test_typescript(spark, store):
    graph = ingest.build(Graph.of(spark), "ts", contents(spark, sample.TYPESCRIPT), "/src", TsPaths.parse(sample.TSCONFIG))
    tools = Tools(graph, "ts")
    assert [r["other"] for r in tools.imports("src/index.ts")] == ["src/calc.ts", "src/util.ts"] and tools.imports("tests/calc.test.ts")[0]["other"] == "src/calc.ts"
    edges = {(r["caller"].split("::")[1], r["callee"].split("::")[1]) for r in graph["calls"].collect()}
    assert edges == {("default", "Calculator"), ("default", "Calculator.add"), ("default", "normalize"), ("test_add", "Calculator"), ("test_add", "Calculator.add")}
    assert {r["language"] for r in graph["files"].collect()} == {"typescript"}


def test_history(spark, graph):
    rows = [
        (0, "bbb", "b", "2024-03-02T10:00:00+02:00", "bob@x", "Bob", "edit", [("calculator.py", 1, 1, [(8, 8)]), ("gone.py", 1, 0, [(1, 1)])]),
        (1, "aaa", "a", "2024-03-02T08:00:00+00:00", "ann@x", "Ann", "start", [("calculator.py", 11, 0, [(1, 11)])]),
    ]
    with_history = ingest.add_history(graph, P, spark.createDataFrame(rows, COMMITS))
    with_history = ingest.add_history(with_history, P, spark.createDataFrame(rows, COMMITS))
    tools = Tools(with_history, P)
    got = tools.symbol_history(QN["add"])
    assert [(c["sha"], c["author_name"], c["lines_overlapped"]) for c in got["commits"]] == [("aaa", "Ann", 2), ("bbb", "Bob", 1)] and got["total_commits"] == 2
    now = datetime(2024, 3, 10, tzinfo=timezone.utc)
    assert [(r["qualified_name"], r["commit_count"], r["unique_authors"]) for r in tools.top_churn(30, now=now)["results"]] == [(QN["add"], 2, 2), (QN["mul"], 1, 1)]
    assert tools.top_churn(1, now=now)["results"] == [] and tools.top_churn(1, now=now)["warning"] is None
    assert [(r["qualified_name"], r["latest_sha"]) for r in tools.recent_changes()["results"]] == [(QN["add"], "bbb"), (QN["mul"], "aaa")]
    assert with_history["file_changes"].count() == 2 and with_history["projects"].first()["last_history_sha"] == "bbb"
    assert Tools(graph, P).symbol_history(QN["add"])["warning"] and tools.recent_changes(kind="x")["warning"]
    hot = checks.check_churn(with_history, P, cc.Churn(True, 30, 1), now)
    assert (hot.status, hot.actual) == ("failed", 1)
    assert checks.check_churn(with_history, P, cc.Churn(True, 30, 1, ("calc*",)), now).status == "passed"
    assert checks.check_churn(graph, P, cc.Churn(True)).status == "error"


def architecture_graph(spark):
    files = spark.createDataFrame([("a", p) for p in ("web/h.py", "domain/c.py", "infra/db.py", "x.py")], "project string, path string")
    imports = spark.createDataFrame([("a", "web/h.py", "domain/c.py", "file"), ("a", "domain/c.py", "web/h.py", "file"), ("a", "infra/db.py", "os", "stdlib")], "project string, src string, target string, target_kind string")
    symbols = spark.createDataFrame([("a", f"web/h.py::{n}", n, "function", "web/h.py", True) for n in ("foo", "bar", "baz")] + [("a", "infra/db.py::q", "q", "function", "infra/db.py", True)], "project string, qualified_name string, name string, kind string, file string, contained boolean")
    calls = spark.createDataFrame([("a", "web/h.py::foo", "web/h.py::bar", True), ("a", "web/h.py::bar", "web/h.py::foo", True), ("a", "web/h.py::baz", "web/h.py::baz", True), ("a", "infra/db.py::q", "web/h.py::foo", False)], "project string, caller string, callee string, static boolean")
    return Graph.of(spark, files=files, imports=imports, symbols=symbols, calls=calls)


LAYERS = [{"name": "web", "patterns": ["web/*"]}, {"name": "domain", "patterns": ["domain/*"]}, {"name": "infra", "patterns": ["infra/*"]}]


def test_architecture(spark):
    tools = Tools(architecture_graph(spark), "a")
    assert [c["nodes"] for c in tools.find_cycles()["cycles"]] == [["web/h.py::bar", "web/h.py::foo"]]
    assert [c["size"] for c in tools.find_cycles(min_size=1)["cycles"]] == [2, 1]
    assert [c["nodes"] for c in tools.find_cycles("module")["cycles"]] == [["domain/c.py", "web/h.py"]]
    assert tools.find_cycles("call", "runtime")["cycles"] == [] and tools.find_cycles("odd")["warning"]
    got = tools.layering_violations(LAYERS)
    assert [(v["from_file"], v["to_file"], v["edge_kind"]) for v in got["violations"]] == [("domain/c.py", "web/h.py", "imports"), ("infra/db.py", "web/h.py", "calls")]
    assert got["summary"] == {"violations": 2, "files_unlayered": 1, "edges_checked": 3}
    assert tools.layering_violations([])["warning"] and tools.layering_violations(LAYERS, "odd")["warning"]
    assert [(r["qualified_name"], r["in_callers"], r["out_callees"]) for r in tools.hubs(min_fanin=2)["results"]] == [("web/h.py::foo", 2, 1)]
    assert tools.hubs("odd")["warning"]


def test_checks(spark):
    graph = architecture_graph(spark)
    cfg = cc.Config("a", cc.Cycles(True), cc.Layering(True, layers=tuple(LAYERS), max_violations=2), hubs=cc.Hubs(True, min_fanin=2, max_hubs=0), warnings=("w",))
    report = checks.run_checks(graph, cfg, 1)
    assert [(r.check, r.status, r.actual) for r in report.results] == [("cycles", "failed", 1), ("layering", "passed", 2), ("churn", "skipped", 0), ("hubs", "failed", 1)]
    assert report.exit_code() == 1 and report.exit_code(strict=True) == 2
    assert len(checks.run_checks(graph, cfg, fail_fast=True).results) == 1
    assert "infra/db.py -> web/h.py (calls)" in checks.as_text(report) and json.loads(checks.as_json(report, 1))["summary"] == {"passed": 1, "failed": 2, "skipped": 1}
    assert checks.check_layering(graph, "a", cc.Layering(True)).status == "error"


def test_components_by_spreading(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "a"), ("g", "g"), ("e", "h"), ("i", "j"), ("j", "k"), ("k", "i"), ("k", "a")]
    got = {r["node"]: r["component"] for r in spread(spark, spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == components_of(edges)
    assert spread(spark, spark.createDataFrame([], "u string, v string")).count() == 0
    assert architecture.cycles(Graph.of(spark), "none").count() == 0


def test_depths(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("a", "d")], "caller string, callee string")
    got = upstream_depths(edges, spark.createDataFrame([("a",)], "via string"), 5)
    assert {r["node"]: r["depth"] for r in got.collect()} == {"b": 1, "c": 1, "d": 2}


def walked(edges, seeds, depth):
    """Distinct (via, node, depth, flags) of all paths without a repeated edge, one path at a time."""
    out = set()

    def walk(via, at, used, flags):
        for edge in edges:
            if edge[1] == at and edge[:2] not in used:
                found = (edge[2:], *flags)
                out.add((via, edge[0], len(found), found))
                if len(found) < depth:
                    walk(via, edge[0], {*used, edge[:2]}, found)

    for via in seeds:
        walk(via, via, set(), ())
    return out


def test_paths_against_walks(spark):
    pick = random.Random(3)
    pairs = {(pick.choice("abcdefgh"), pick.choice("abcdefgh")) for _ in range(16)} | {("a", "a"), ("x", "a"), ("y", "x"), ("z", "y")}
    flagged = [(u, v, pick.random() < 0.5, pick.random() < 0.5) for u, v in sorted(pairs)]
    edges = spark.createDataFrame(flagged, "caller string, callee string, static boolean, runtime boolean")
    for depth in (1, 2, 4):
        got = upstream_paths(edges, spark.createDataFrame([("a",), ("e",)], "via string"), depth).distinct().collect()
        want = walked(flagged, "ae", depth)
        assert len(got) == len(want) and {(r["via"], r["node"], r["depth"], tuple(map(tuple, r["edges"]))) for r in got} == want


def test_paths_without_circles_do_not_multiply(spark):
    # six pairs of ways one after another: 64 paths, and one row for each node and depth
    rows = [e for k in range(6) for m in "lr" for e in ((f"{m}{k}", f"n{k}", True, False), (f"n{k + 1}", f"{m}{k}", True, False))]
    edges = spark.createDataFrame(rows, "caller string, callee string, static boolean, runtime boolean")
    assert upstream_paths(edges, spark.createDataFrame([("n0",)], "via string"), 12).count() == 18


def test_store(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/s")
    assert store.version() == 0 and store.load()["files"].count() == 0
    graph = store.commit(architecture_graph(spark))
    graph = store.commit(graph.with_tables(files=graph["files"].where("path = 'x.py'")))
    assert store.version() == 2 and store.load()["files"].count() == 1 and store.load()["calls"].count() == 4
    assert store.clean() and store.version() == 0


def test_source_files(spark, tmp_path):
    root = sample.write(tmp_path, sample.PYTHON | {"node_modules/x.py": "", "deep/.git/y.py": "", "deep/z.py": "", "build": "", "t.d.ts": "", "u.tsx": "", "readme.md": ""})
    rows = source_files(spark, root).collect()
    got = {r["path"]: r["language"] for r in rows}
    assert len(rows) == len(got) and {r["path"]: bytes(r["content"]).decode() for r in rows}["runner.py"] == sample.RUNNER
    assert got == {"calculator.py": "python", "runner.py": "python", "test_calculator.py": "python", "deep/z.py": "python", "u.tsx": "typescript"}
