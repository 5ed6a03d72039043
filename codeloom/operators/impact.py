"""From a diff to the symbols it changes, the callers it may break, and the tests to run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.columns import PROVENANCE, SYMBOL_REF, clamp, provenance_is
from codeloom.plans.paths import upstream_paths
from codeloom.sources.diff import diff_lines, touched_lines
from codeloom.store import Graph

MOST_DEPTH = 20


def _with_runtime(symbols: DataFrame) -> DataFrame:
    return symbols.select(*SYMBOL_REF, F.coalesce("runtime_observed", F.lit(False)).alias("runtime_observed"), F.coalesce("coverage_pct", F.lit(0.0)).alias("coverage_pct"))


def changed_symbols(graph: Graph, project: str, lines: DataFrame) -> DataFrame:
    """Functions and methods one of whose lines (path, line) is touched."""
    symbols = graph.symbols(project).where(F.col("kind").isin("function", "method"))
    spans = lines.select(F.col("path").alias("file"), "line")
    return _with_runtime(symbols.join(spans, (symbols["file"] == spans["file"]) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left_semi"))


def impacted_symbols(graph: Graph, project: str, changed: DataFrame, max_depth: int = 5, provenance: str = "any") -> DataFrame:
    """Symbols from which calls lead to a changed one, with every distinct way (via, depth, edges)."""
    provenance = provenance if provenance in PROVENANCE else "any"
    calls = graph.within("calls", project).where(provenance_is(provenance)).select("caller", "callee", "static", "runtime")
    paths = upstream_paths(calls, changed.select(F.col("qualified_name").alias("via")), clamp(max_depth, 1, MOST_DEPTH))
    ways = paths.groupBy(F.col("node").alias("qualified_name")).agg(F.sort_array(F.collect_set(F.struct("via", "depth", "edges"))).alias("reached_via"))
    return _with_runtime(graph.symbols(project)).join(ways, "qualified_name")


def tests_to_run(graph: Graph, project: str, affected: DataFrame) -> DataFrame:
    """Tests that cover an affected symbol (qualified_name), with what they cover of them and how well."""
    own = graph.symbols(project).select("qualified_name").join(affected.select("qualified_name").distinct(), "qualified_name", "left_semi")
    covers = graph.within("covers", project).join(own.withColumnRenamed("qualified_name", "symbol"), "symbol", "left_semi")
    found = covers.groupBy(F.col("test").alias("qualified_name")).agg(F.sort_array(F.collect_set("symbol")).alias("covers_symbols"), F.avg(F.coalesce("coverage_pct", F.lit(0.0))).alias("avg_coverage_pct"))
    tests = graph.within("symbols", project).where("is_test").select(*SYMBOL_REF, F.coalesce("test_outcome", F.lit("")).alias("test_outcome"))
    return tests.join(found, "qualified_name").orderBy("qualified_name")


def change_impact(graph: Graph, project: str, diff: str, max_depth: int = 5, provenance: str = "any", limit: int = 200) -> dict:
    """The envelope: rows of the three frames, files without a changed symbol, and figures."""
    touched = touched_lines(diff)
    out = {"changed": [], "impacted": [], "tests_to_run": [], "unmatched_files": []}
    if touched:
        changed = changed_symbols(graph, project, diff_lines(graph.spark, diff))
        impacted = impacted_symbols(graph, project, changed, max_depth, provenance).orderBy("qualified_name").limit(limit)
        affected = changed.select("qualified_name").unionByName(impacted.select("qualified_name"))
        out["changed"] = [r.asDict(True) for r in changed.orderBy("qualified_name").collect()]
        out["impacted"] = [r.asDict(True) for r in impacted.collect()] if out["changed"] else []
        out["tests_to_run"] = [r.asDict(True) for r in tests_to_run(graph, project, affected).collect()] if out["changed"] else []
        out["unmatched_files"] = sorted(set(touched) - {r["file"] for r in out["changed"]})
    out["stats"] = {
        "changed_files": len(touched),
        "changed_symbols": len(out["changed"]),
        "impacted_symbols": len(out["impacted"]),
        "tests_to_run": len(out["tests_to_run"]),
        "max_depth_reached": max((w["depth"] for s in out["impacted"] for w in s["reached_via"]), default=0),
    }
    return out
