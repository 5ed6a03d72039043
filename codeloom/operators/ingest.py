"""Source trees into the graph: full builds, incremental updates, runs and history.

What several steps read is written and read back, so that no plan holds the plans of all steps before it: a
plan's size, and with it what its tasks report to the driver, does not multiply from step to step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import upserts
from codeloom.operators.attribution import attribute_hunks, map_coverage
from codeloom.operators.resolve import TsPaths, resolve_calls, resolve_python_imports, resolve_ts_imports
from codeloom.plans.scratch import keep
from codeloom.sources.files import extract
from codeloom.store import Graph


def _kept(graph: Graph, *tables: str) -> Graph:
    return graph.with_tables(**{t: keep(graph.spark, graph[t]) for t in tables})


def definitions(rows: DataFrame, project: str) -> DataFrame:
    found = rows.where("record = 'definition'").select(F.lit(project).alias("project"), "qualified_name", "name", "kind", F.col("path").alias("file"), "start_line", "end_line", "decorators", "source", "parent_class")
    # a name that a file defines twice counts once, as it stands last
    last = found.groupBy("project", "qualified_name").agg(F.max_by(F.struct(*[c for c in found.columns if c not in ("project", "qualified_name")]), F.struct("start_line", "end_line")).alias("d"))
    test = (F.col("d.kind") == "function") & F.col("d.name").startswith("test_")
    return last.select("project", "qualified_name", "d.*", test.alias("is_test"))


def file_records(files: DataFrame, rows: DataFrame, project: str) -> DataFrame:
    broken = rows.where("record = 'broken'").select("path", F.lit(True).alias("parse_error"))
    return files.join(broken, "path", "left").select(F.lit(project).alias("project"), "path", F.element_at(F.split("path", "/"), -1).alias("name"), "language", F.coalesce("parse_error", F.lit(False)).alias("parse_error"), "content_hash")


def edges_of(rows: DataFrame, symbols: DataFrame, files: DataFrame, project: str, ts: TsPaths) -> tuple[DataFrame, DataFrame]:
    """Static calls and imports; each language resolves among its own symbols and files."""
    calls, imports = None, None
    for language in ("python", "typescript"):
        own_files = files.where(F.col("language") == language).select("path").hint("merge")
        own = rows.join(own_files, "path", "left_semi")
        own_symbols = symbols.join(own_files.withColumnRenamed("path", "file"), "file", "left_semi")
        found = resolve_calls(own.where("record = 'call'"), own_symbols)
        raw = own.where("record = 'import'")
        other = resolve_python_imports(raw, own_files) if language == "python" else resolve_ts_imports(raw, own_files, ts)
        calls = found if calls is None else calls.unionByName(found)
        imports = other if imports is None else imports.unionByName(other)
    return calls.withColumn("project", F.lit(project)).withColumn("static", F.lit(True)), imports.withColumn("project", F.lit(project))


def build(graph: Graph, project: str, files: DataFrame, root: str | None = None, ts: TsPaths | None = None) -> Graph:
    """A full ingest of (path, language, content, content_hash): what has vanished from the sources goes."""
    spark = graph.spark
    rows = keep(spark, extract(files))
    records = keep(spark, file_records(files, rows, project))
    defined = keep(spark, definitions(rows, project))
    gone_files = graph.within("files", project).join(records, "path", "left_anti")
    graph = upserts.delete_files(graph, gone_files)
    gone = graph.symbols(project).join(defined, "qualified_name", "left_anti")
    graph = upserts.delete_symbols(graph, gone)
    every = records.select("project", "path")
    graph = upserts.delete_imports_from(upserts.reset_static(graph, every), every)
    graph = upserts.write_project(upserts.write_files(graph, records), project, root)
    graph = _kept(upserts.write_definitions(graph, defined), "symbols", "files")
    calls, imports = edges_of(rows, graph.symbols(project), graph.within("files", project), project, ts or TsPaths())
    return upserts.write_calls(upserts.write_imports(graph, imports), calls)


def detect_changes(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """``path`` and ``change`` (added, changed, deleted, unchanged) of stored and present (path, content_hash)."""
    s = stored.select("path", F.col("content_hash").alias("old"), F.lit(True).alias("was"))
    d = disk.select("path", F.col("content_hash").alias("new"), F.lit(True).alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")) & F.col("old").isNotNull(), "unchanged").otherwise("changed")
    return s.join(d, "path", "full").select("path", change.alias("change"))


def drifted(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """One row: how many files differ from the graph or stand on one side only."""
    return detect_changes(stored, disk).agg(F.count_if(F.col("change") != "unchanged").alias("drifted_files"))


@dataclass(frozen=True)
class UpdateSummary:
    added: int
    changed: int
    deleted: int
    unchanged: int
    parse_errors: int


def update(graph: Graph, project: str, files: DataFrame, paths: list[str] | None = None, ts: TsPaths | None = None) -> tuple[Graph, UpdateSummary]:
    """Brings the graph up to date with the files: first all structure, then edges against the final state.

    ``paths`` limits the update to these files.  A file that no longer parses keeps its old symbols.
    """
    stored = graph.within("files", project)
    if paths is not None:
        files, stored = files.where(F.col("path").isin(paths)), stored.where(F.col("path").isin(paths))
    spark = graph.spark
    changes = keep(spark, detect_changes(stored, files))
    counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
    fresh = files.join(changes.where("change in ('added', 'changed')"), "path", "left_semi")
    rows = keep(spark, extract(fresh))
    records = keep(spark, file_records(fresh, rows, project))
    errors = records.where("parse_error").count()
    named = lambda df: df.select(F.lit(project).alias("project"), "path")
    graph = upserts.delete_files(graph, named(changes.where("change = 'deleted'")))
    sound = named(records.where("not parse_error"))
    defined = keep(spark, definitions(rows, project))
    old = graph.symbols(project).join(sound.select(F.col("path").alias("file")), "file", "left_semi")
    graph = upserts.delete_symbols(graph, old.join(defined, "qualified_name", "left_anti"))
    graph = upserts.delete_imports_from(upserts.reset_static(upserts.flag_stale(graph, sound), sound), sound)
    graph = _kept(upserts.write_definitions(upserts.write_files(graph, records), defined), "symbols", "files")
    calls, imports = edges_of(rows, graph.symbols(project), graph.within("files", project), project, ts or TsPaths())
    graph = upserts.write_calls(upserts.write_imports(graph, imports), calls)
    counted = (counts.get(k, 0) for k in ("added", "changed", "deleted", "unchanged"))
    return graph, UpdateSummary(*counted, errors)


def merge_runs(calls: DataFrame) -> DataFrame:
    """Calls that runs have seen (caller, callee, observed_count; a row for each test) as one row for each pair."""
    return calls.groupBy("caller", "callee").agg(F.sum("observed_count").cast("bigint").alias("observed_count"))


def augment(graph: Graph, project: str, calls: DataFrame, tests: DataFrame, lines: DataFrame) -> Graph:
    """What a test run has shown: calls (caller, callee, observed_count, by test), tests (qualified_name,
    outcome, duration) and covered lines (test, file, line)."""
    named = lambda df: df.withColumn("project", F.lit(project))
    spark = graph.spark
    covers = keep(spark, map_coverage(lines, graph.symbols(project)))
    summed = keep(spark, merge_runs(calls))
    tests = keep(spark, tests.select("qualified_name", F.col("outcome").alias("test_outcome"), F.col("duration").alias("test_duration")))
    graph = _kept(upserts.write_tests(graph, named(tests)), "symbols")
    graph = upserts.write_runtime_calls(graph, named(summed))
    graph = upserts.write_coverage(graph, named(covers).withColumn("seq", F.lit(0)))
    seen = [summed.select(F.col("caller").alias("qualified_name")), summed.select(F.col("callee").alias("qualified_name")), tests.select("qualified_name"), covers.select(F.col("symbol").alias("qualified_name"))]
    every = seen[0]
    for more in seen[1:]:
        every = every.unionByName(more)
    return upserts.clear_stale(graph, named(every.distinct()))


def add_history(graph: Graph, project: str, commits: DataFrame) -> Graph:
    """Commits (sources.history): authors, commits, and what each changed of files and symbols."""
    commits = keep(graph.spark, commits)
    ts = F.to_timestamp("timestamp")
    rows = commits.select(F.lit(project).alias("project"), "sha", "short_sha", "message", F.col("timestamp").alias("ts_raw"), ts.alias("ts"), "author_email", "author_name", "files")
    files = rows.select("project", "sha", F.explode("files").alias("f")).select("project", "sha", "f.*")
    changed = files.select("project", "path", "sha", "additions", "deletions")
    hunks = files.select("sha", F.col("path").alias("file"), F.explode("hunks").alias("h")).select("sha", "file", "h.start", "h.end")
    touched = attribute_hunks(hunks, graph.symbols(project)).withColumn("project", F.lit(project))
    authors = rows.groupBy(F.col("author_email").alias("email")).agg(F.max_by("author_name", "ts").alias("name"))
    graph = upserts.write_history(graph, rows, authors, changed, touched)
    newest = commits.orderBy("place").limit(1).collect()
    return upserts.write_project(graph, project, None, newest[0]["sha"]) if newest else graph
