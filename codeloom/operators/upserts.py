"""Writes as frames: full-outer upserts by key, and deletes as anti-joins.

Each returns a new graph; nothing is changed in place, and a store's ``commit`` makes it lasting.  Only the keys
that a delete takes away are written to the shared folder, as every table is joined with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.columns import coverage_pct
from codeloom.plans.scratch import keep
from codeloom.schema import KEYS, TABLES, conform
from codeloom.store import Graph


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...], keep: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both by key.  A column takes the new value where the key is new or updated; those of ``keep``
    keep the old value, and those of ``fill`` take the new one unless it is null."""
    columns = old.columns
    o = old.select(F.lit(True).alias("has_old"), *[F.col(c).alias(f"o_{c}") for c in columns])
    n = new.select(F.lit(True).alias("has_new"), *[F.col(c).alias(f"n_{c}") for c in columns])
    on = None
    for k in keys:
        same = F.col(f"o_{k}") == F.col(f"n_{k}")
        on = same if on is None else on & same
    joined = o.join(n, on, "full")

    def value(c: str):
        if c in keys:
            return F.coalesce(f"n_{c}", f"o_{c}")
        if c in keep:
            return F.when(F.col("has_old"), F.col(f"o_{c}")).otherwise(F.col(f"n_{c}"))
        if c in fill:
            return F.coalesce(f"n_{c}", f"o_{c}")
        return F.when(F.col("has_new"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))

    return joined.select(*[value(c).alias(c) for c in columns])


def _ends_exist(graph: Graph, edges: DataFrame, *ends: str) -> DataFrame:
    # all symbols: merged, so that the driver does not gather them for a broadcast
    known = graph["symbols"].select("project", "qualified_name").hint("merge")
    for end in ends:
        edges = edges.join(known.withColumnRenamed("qualified_name", end), ["project", end], "left_semi")
    return edges


def write_files(graph: Graph, files: DataFrame) -> Graph:
    return graph.with_tables(files=upsert(graph["files"], conform(files, "files"), KEYS["files"]))


def write_project(graph: Graph, project: str, root_path: str | None = None, last_history_sha: str | None = None) -> Graph:
    """The project's row; what is not given stays."""
    new = graph.spark.createDataFrame([(project, root_path, last_history_sha)], TABLES["projects"])
    return graph.with_tables(projects=upsert(graph["projects"], new, KEYS["projects"], fill=("root_path", "last_history_sha")))


RUNTIME = ("runtime_observed", "coverage_pct", "lines_covered", "lines_total", "test_outcome", "test_duration", "runtime_only", "runtime_stale")


def write_definitions(graph: Graph, symbols: DataFrame) -> Graph:
    """Definitions; what runs have shown of a symbol stays, and so does its being a test."""
    new = conform(symbols, "symbols").withColumn("contained", F.lit(True)).withColumn("is_test", F.coalesce("is_test", F.lit(False)))
    classes = new.where("kind = 'class'").select("project", F.col("qualified_name").alias("parent_class"))
    known = graph["symbols"].where("kind = 'class'").select("project", F.col("qualified_name").alias("parent_class")).unionByName(classes).distinct().hint("merge")
    methods = new.where("kind = 'method'").join(known, ["project", "parent_class"], "left_semi")
    new = new.where("kind <> 'method'").unionByName(methods)
    merged = upsert(graph["symbols"], conform(new, "symbols"), KEYS["symbols"], keep=(*RUNTIME, "is_test"))
    return graph.with_tables(symbols=merged)


def write_calls(graph: Graph, calls: DataFrame) -> Graph:
    """Static calls: their provenance is overwritten, what runs have shown stays; both ends must exist."""
    new = conform(calls, "calls").select("project", "caller", "callee", F.coalesce("static", F.lit(True)).alias("static"), F.lit(False).alias("runtime"), F.lit(0).cast("bigint").alias("observed_count"), F.coalesce("call_site_lines", F.array().cast("array<int>")).alias("call_site_lines"))
    return graph.with_tables(calls=upsert(graph["calls"], _ends_exist(graph, new, "caller", "callee"), KEYS["calls"], keep=("runtime", "observed_count")))


def write_runtime_calls(graph: Graph, calls: DataFrame) -> Graph:
    """Calls seen in runs (project, caller, callee, observed_count): count overwritten, static stays."""
    new = calls.select("project", "caller", "callee", F.lit(False).alias("static"), F.lit(True).alias("runtime"), F.col("observed_count").cast("bigint").alias("observed_count"), F.array().cast("array<int>").alias("call_site_lines"))
    return graph.with_tables(calls=upsert(graph["calls"], _ends_exist(graph, new, "caller", "callee"), KEYS["calls"], keep=("static", "call_site_lines")))


def write_tests(graph: Graph, tests: DataFrame) -> Graph:
    """Outcomes (project, qualified_name, test_outcome, test_duration); an unknown test becomes a symbol of its own."""
    old = graph["symbols"]
    new = tests.select("project", "qualified_name", F.lit("function").alias("kind"), "test_outcome", "test_duration", F.lit(True).alias("is_test"), F.lit(False).alias("contained"), F.lit(True).alias("runtime_only"))
    keep = tuple(c for c in old.columns if c not in ("is_test", "test_outcome", "test_duration"))
    return graph.with_tables(symbols=upsert(old, conform(new, "symbols"), KEYS["symbols"], keep=keep))


def write_coverage(graph: Graph, covers: DataFrame) -> Graph:
    """Coverage edges (project, test, symbol, lines_covered, lines_total, seq); a symbol takes the figures of its last one."""
    covers = _ends_exist(graph, covers, "test", "symbol")
    pct = coverage_pct(F.col("lines_covered"), F.col("lines_total"))
    edges = conform(covers.withColumn("coverage_pct", pct), "covers")
    last = covers.groupBy("project", F.col("symbol").alias("qualified_name")).agg(F.max_by(F.struct("lines_covered", "lines_total"), F.struct("seq", "test")).alias("last"))
    last = last.select("project", "qualified_name", F.col("last.lines_covered").alias("lines_covered"), F.col("last.lines_total").alias("lines_total"), F.lit(True).alias("runtime_observed"))
    new = conform(last.withColumn("coverage_pct", pct), "symbols")
    keep = tuple(c for c in graph["symbols"].columns if c not in ("runtime_observed", "coverage_pct", "lines_covered", "lines_total"))
    symbols = upsert(graph["symbols"], new, KEYS["symbols"], keep=keep)
    return graph.with_tables(covers=upsert(graph["covers"], edges, KEYS["covers"]), symbols=symbols)


def write_imports(graph: Graph, imports: DataFrame) -> Graph:
    """One edge for each pair of file and target; of several statements the first line."""
    new = conform(imports, "imports").groupBy("project", "src", "target").agg(F.min(F.struct("line", "raw", "target_kind")).alias("first"))
    new = new.select("project", "src", "target", "first.target_kind", "first.raw", "first.line")
    return graph.with_tables(imports=upsert(graph["imports"], conform(new, "imports"), KEYS["imports"]))


def write_history(graph: Graph, commits: DataFrame, authors: DataFrame, file_changes: DataFrame, symbol_changes: DataFrame) -> Graph:
    known = graph["files"].select("project", "path").hint("merge")
    file_changes = conform(file_changes, "file_changes").join(known, ["project", "path"], "left_semi")
    return graph.with_tables(
        commits=upsert(graph["commits"], conform(commits, "commits"), KEYS["commits"]),
        authors=upsert(graph["authors"], conform(authors, "authors"), KEYS["authors"], fill=("name",)),
        file_changes=upsert(graph["file_changes"], conform(file_changes, "file_changes"), KEYS["file_changes"]),
        symbol_changes=upsert(graph["symbol_changes"], conform(symbol_changes, "symbol_changes"), KEYS["symbol_changes"]),
    )


def delete_symbols(graph: Graph, gone: DataFrame) -> Graph:
    """Symbols (project, qualified_name), and every edge at either of its ends."""
    # eight joins read it
    gone = keep(graph.spark, gone.select("project", "qualified_name").distinct())

    def without(table: str, *ends: str) -> DataFrame:
        df = graph[table]
        for end in ends:
            df = df.join(gone.withColumnRenamed("qualified_name", end), ["project", end], "left_anti")
        return df

    return graph.with_tables(
        symbols=without("symbols", "qualified_name"),
        calls=without("calls", "caller", "callee"),
        covers=without("covers", "test", "symbol"),
        symbol_changes=without("symbol_changes", "qualified_name"),
        embeddings=without("embeddings", "qualified_name"),
    )


def reset_static(graph: Graph, paths: DataFrame) -> Graph:
    """Static provenance of the calls out of these files (project, path) goes; calls no run has shown go with it."""
    callers = graph["symbols"].select("project", F.col("qualified_name").alias("caller"), F.col("file").alias("path")).join(paths.select("project", "path").distinct(), ["project", "path"], "left_semi")
    marked = graph["calls"].join(callers.select("project", "caller", F.lit(True).alias("hit")), ["project", "caller"], "left")
    calls = marked.withColumn("static", F.when(F.col("hit"), F.lit(False)).otherwise(F.col("static")))
    return graph.with_tables(calls=calls.where("hit is null or coalesce(runtime, false)").drop("hit"))


def delete_imports_from(graph: Graph, paths: DataFrame) -> Graph:
    gone = paths.select("project", F.col("path").alias("src")).distinct()
    return graph.with_tables(imports=graph["imports"].join(gone, ["project", "src"], "left_anti"))


def delete_files(graph: Graph, paths: DataFrame) -> Graph:
    """Files (project, path) with their symbols, imports in and out, and changes."""
    paths = keep(graph.spark, paths.select("project", "path").distinct())
    symbols = graph["symbols"].where("contained").join(paths.withColumnRenamed("path", "file"), ["project", "file"], "left_semi")
    graph = delete_symbols(graph, symbols)
    into = paths.select("project", F.col("path").alias("target"), F.lit("file").alias("target_kind"))
    return delete_imports_from(graph, paths).with_tables(
        files=graph["files"].join(paths, ["project", "path"], "left_anti"),
        imports=delete_imports_from(graph, paths)["imports"].join(into, ["project", "target", "target_kind"], "left_anti"),
        file_changes=graph["file_changes"].join(paths, ["project", "path"], "left_anti"),
    )


def flag_stale(graph: Graph, paths: DataFrame) -> Graph:
    """What runs have shown of the symbols of these files is out of date."""
    hit = paths.select("project", F.col("path").alias("file"), F.lit(True).alias("hit")).distinct()
    symbols = graph["symbols"].join(hit, ["project", "file"], "left")
    stale = F.when(F.col("hit") & F.coalesce("runtime_observed", F.lit(False)), F.lit(True)).otherwise(F.col("runtime_stale"))
    return graph.with_tables(symbols=symbols.withColumn("runtime_stale", stale))


def clear_stale(graph: Graph, seen: DataFrame) -> Graph:
    """Symbols (project, qualified_name) that a run has shown again."""
    hit = seen.select("project", "qualified_name", F.lit(True).alias("hit")).distinct()
    symbols = graph["symbols"].join(hit, ["project", "qualified_name"], "left")
    return graph.with_tables(symbols=symbols.withColumn("runtime_stale", F.when(F.col("hit"), F.lit(False)).otherwise(F.col("runtime_stale"))))
