"""Symbols, callers, callees, provenance, tests and imports.

Every result is totally ordered before its limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.columns import PROVENANCE, SYMBOL_REF, callable_kind, provenance_is
from codeloom.plans.dealing import dealt
from codeloom.store import Graph

#: Symbols whose calls a task joins on average.
SYMBOLS_IN_A_TASK = 10_000


def _ref(symbols: DataFrame, prefix: str = "") -> DataFrame:
    return symbols.select(*[F.col(c).alias(f"{prefix}{c}") for c in SYMBOL_REF])


def find_symbol(graph: Graph, project: str, query: str, exact: bool = False, limit: int = 50) -> DataFrame:
    """Symbols whose name equals the query, or contains it in any case."""
    hit = F.col("name") == query if exact else F.lower("name").contains(query.lower())
    return _ref(graph.symbols(project).where(hit)).orderBy("qualified_name").limit(limit)


def get_source(graph: Graph, project: str, qualified_name: str) -> DataFrame:
    """The symbol with its source and metadata; no row if there is none."""
    found = graph.symbols(project).where(F.col("qualified_name") == qualified_name).limit(1)
    return found.select(
        *SYMBOL_REF,
        F.coalesce("decorators", F.array().cast("array<string>")).alias("decorators"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("runtime_observed", F.lit(False)).alias("runtime_observed"),
        F.coalesce("coverage_pct", F.lit(0.0)).alias("coverage_pct"),
    )


def _neighbours(graph: Graph, project: str, at: str, other: str, qualified_name: str, provenance: str, limit: int) -> DataFrame:
    provenance = provenance if provenance in PROVENANCE else "any"
    symbols = graph.symbols(project)
    calls = graph.within("calls", project).where((F.col(at) == qualified_name) & provenance_is(provenance))
    # the queried symbol has to be one of the project's own
    calls = calls.join(symbols.select(F.col("qualified_name").alias(at)), at, "left_semi")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("static", "runtime")]
    edges = calls.select(F.col(other).alias("qualified_name"), *flags, F.coalesce("observed_count", F.lit(0)).alias("observed_count"), F.coalesce("call_site_lines", F.array().cast("array<int>")).alias("call_site_lines"))
    return _ref(symbols).join(edges, "qualified_name").orderBy("qualified_name").limit(limit)


def find_callers(graph: Graph, project: str, qualified_name: str, provenance: str = "any", limit: int = 50) -> DataFrame:
    return _neighbours(graph, project, "callee", "caller", qualified_name, provenance, limit)


def find_callees(graph: Graph, project: str, qualified_name: str, provenance: str = "any", limit: int = 50) -> DataFrame:
    return _neighbours(graph, project, "caller", "callee", qualified_name, provenance, limit)


def _one_sided(graph: Graph, project: str, wanted: str, other: str, file: str | None, limit: int) -> DataFrame:
    symbols = graph.symbols(project)
    callers = symbols if file is None else symbols.where(F.col("file") == file)
    only = F.coalesce(F.col(wanted), F.lit(False)) & ~F.coalesce(F.col(other), F.lit(False))
    calls = graph.within("calls", project).where(only).select("caller", "callee", F.coalesce("observed_count", F.lit(0)).alias("observed_count"))
    # a callee may be known by a run only: any symbol of the project will do
    callees = _ref(graph.within("symbols", project), "callee_")
    # all symbols on both sides: merged, so that the driver does not gather them for a broadcast
    n = graph["symbols"].count()
    out = dealt(calls, n, SYMBOLS_IN_A_TASK, "caller").join(_ref(callers, "caller_").hint("merge"), F.col("caller") == F.col("caller_qualified_name"))
    out = dealt(out, n, SYMBOLS_IN_A_TASK, "callee").join(callees.hint("merge"), F.col("callee") == F.col("callee_qualified_name")).drop("caller", "callee")
    return out.orderBy("caller_qualified_name", "callee_qualified_name").limit(limit)


def runtime_only_calls(graph: Graph, project: str, file: str | None = None, limit: int = 100) -> DataFrame:
    """Calls that runs have shown and the source has not."""
    return _one_sided(graph, project, "runtime", "static", file, limit)


def dead_static_calls(graph: Graph, project: str, file: str | None = None, limit: int = 100) -> DataFrame:
    """Calls that the source shows and no run has."""
    return _one_sided(graph, project, "static", "runtime", file, limit).drop("observed_count")


def tests_for(graph: Graph, project: str, qualified_name: str, limit: int = 50) -> DataFrame:
    """Tests that cover the symbol."""
    own = graph.symbols(project).select(F.col("qualified_name").alias("symbol"))
    covers = graph.within("covers", project).where(F.col("symbol") == qualified_name).join(own, "symbol", "left_semi")
    tests = graph.within("symbols", project).where("is_test").select(*SYMBOL_REF, F.coalesce("test_outcome", F.lit("")).alias("test_outcome"))
    covers = covers.select(F.col("test").alias("qualified_name"), "lines_covered", "lines_total", "coverage_pct")
    return tests.join(covers, "qualified_name").orderBy("qualified_name").limit(limit)


def untested_symbols(graph: Graph, project: str, file: str | None = None, kind: str = "any", limit: int = 100) -> DataFrame:
    """Functions and methods that no run has reached, tests apart."""
    hit = callable_kind(kind, tests=False) & ~F.coalesce(F.col("runtime_observed"), F.lit(False))
    if file is not None:
        hit &= F.col("file") == file
    return _ref(graph.symbols(project).where(hit)).orderBy("qualified_name").limit(limit)


def imports(graph: Graph, project: str, file: str, direction: str = "out", limit: int = 100) -> DataFrame:
    """What the file imports (``out``), or the files that import it (``in``)."""
    if direction not in ("in", "out"):
        raise ValueError(f"direction must be 'in' or 'out', not {direction!r}")
    rows = graph.within("imports", project)
    if direction == "out":
        rows = rows.where(F.col("src") == file).select(F.col("target").alias("other"), "target_kind", "raw", "line")
    else:
        hit = (F.col("target_kind") == "file") & (F.col("target") == file)
        rows = rows.where(hit).select(F.col("src").alias("other"), F.lit("file").alias("target_kind"), "raw", "line")
    return rows.orderBy("other", "line").limit(limit)


def _total(df: DataFrame, **sums: Column) -> DataFrame:
    return df.agg(*[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(n) for n, c in sums.items()])


def graph_status(graph: Graph, project: str) -> DataFrame:
    """One row of counts; zeros for an unknown project."""
    test = F.coalesce(F.col("is_test"), F.lit(False))
    files = graph.within("files", project).agg(F.count("*").alias("files"))
    symbols = _total(graph.symbols(project), classes=F.col("kind") == "class", functions=F.col("kind") == "function", methods=F.col("kind") == "method", tests=test)
    own = graph.symbols(project).select(F.col("qualified_name").alias("caller"))
    static, runtime = F.coalesce("static", F.lit(False)), F.coalesce("runtime", F.lit(False))
    calls = graph.within("calls", project).join(own, "caller", "left_semi")
    calls = _total(calls, calls=F.lit(True), runtime_only=runtime & ~static, static_only=static & ~runtime, both=static & runtime)
    return files.crossJoin(symbols).crossJoin(calls)  # one row each


def label_histogram(graph: Graph, project: str) -> DataFrame:
    """Symbols by label; a test has two."""
    labels = F.when(F.coalesce("is_test", F.lit(False)), F.array("kind", F.lit("test"))).otherwise(F.array("kind"))
    return graph.symbols(project).select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n")).orderBy("label")
