"""Tables of the code graph, their keys, and empty frames of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, str] = {
    "projects": "project string, root_path string, last_history_sha string",
    "files": "project string, path string, name string, language string, parse_error boolean, content_hash string",
    "symbols": (
        "project string, qualified_name string, name string, kind string, file string, start_line int, end_line int, "
        "decorators array<string>, source string, parent_class string, is_test boolean, contained boolean, "
        "runtime_observed boolean, coverage_pct double, lines_covered int, lines_total int, "
        "test_outcome string, test_duration double, runtime_only boolean, runtime_stale boolean"
    ),
    "imports": "project string, src string, target string, target_kind string, raw string, line int",
    "calls": "project string, caller string, callee string, static boolean, runtime boolean, observed_count bigint, call_site_lines array<int>",
    "covers": "project string, test string, symbol string, lines_covered int, lines_total int, coverage_pct double",
    "commits": "project string, sha string, short_sha string, message string, ts_raw string, ts timestamp, author_email string",
    "authors": "email string, name string",
    "file_changes": "project string, path string, sha string, additions int, deletions int",
    "symbol_changes": "project string, qualified_name string, sha string, lines_overlapped int",
    "embeddings": "project string, qualified_name string, embedding array<float>, source_hash string, model string",
}

KEYS: dict[str, tuple[str, ...]] = {
    "projects": ("project",),
    "files": ("project", "path"),
    "symbols": ("project", "qualified_name"),
    "imports": ("project", "src", "target"),
    "calls": ("project", "caller", "callee"),
    "covers": ("project", "test", "symbol"),
    "commits": ("project", "sha"),
    "authors": ("email",),
    "file_changes": ("project", "path", "sha"),
    "symbol_changes": ("project", "qualified_name", "sha"),
    "embeddings": ("project", "qualified_name"),
}

DESCRIPTIONS: dict[str, str] = {
    "symbols": "classes, functions and methods; is_test marks tests, contained those that a source file defines",
    "files": "source files with their content hash",
    "imports": "file to file or module",
    "calls": "caller to callee with provenance: static (seen in source), runtime (seen in a run)",
    "covers": "test to symbol with line coverage",
    "commits": "first-parent commits",
    "authors": "commit authors by e-mail address",
    "file_changes": "files that a commit changed",
    "symbol_changes": "functions and methods whose lines a commit changed",
    "embeddings": "vectors of symbol sources",
    "projects": "ingested projects and how far their history has been read",
}

EXAMPLES: tuple[tuple[str, str], ...] = (
    ("find a symbol", "SELECT qualified_name, kind, file FROM symbols WHERE contains(lower(name), lower(:q)) LIMIT 20"),
    ("who calls a symbol", "SELECT caller, static, runtime, observed_count FROM calls WHERE callee = :qn"),
    ("calls that only a run has shown", "SELECT caller, callee, observed_count FROM calls WHERE runtime AND NOT coalesce(static, false) LIMIT 50"),
    ("tests that cover a symbol", "SELECT test, coverage_pct FROM covers WHERE symbol = :qn ORDER BY coverage_pct DESC"),
    ("what no test has run", "SELECT qualified_name, file FROM symbols WHERE kind IN ('function', 'method') AND NOT is_test AND NOT coalesce(runtime_observed, false) LIMIT 100"),
    ("importers of a file", "SELECT src, raw, line FROM imports WHERE target_kind = 'file' AND target = :file ORDER BY src"),
)


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type; those the frame lacks are null."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(TABLES[table])])


def describe() -> dict:
    """The static self-description: tables, columns, keys and example queries."""
    return {
        "tables": [{"name": t, "columns": ddl, "key": list(KEYS[t]), "about": DESCRIPTIONS[t]} for t, ddl in TABLES.items()],
        "examples": [{"intent": i, "query": q} for i, q in EXAMPLES],
    }
