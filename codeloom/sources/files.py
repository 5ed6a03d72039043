"""Source files as a DataFrame: discovery, hashes, and extraction on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.columns import matches_glob
from codeloom.sources import python_source, ts_source
from codeloom.sources.records import COLUMNS, EXTRACTED

# Folders that are never searched, and the endings of source files.
SKIPPED = (".git", "__pycache__", ".venv", "venv", "env", ".tox", "build", "dist", ".mypy_cache", ".pytest_cache", ".ruff_cache", "node_modules")
UNWATCHED = (".git", "__pycache__", ".venv", "venv", "node_modules", ".mypy_cache", ".pytest_cache", ".ruff_cache")
TS_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def in_folder(path: Column, folders: tuple[str, ...]) -> Column:
    """Whether a segment before the file's name is one of the folders."""
    return F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*[F.lit(x) for x in folders]))


def language_of(path: Column) -> Column:
    ts = F.lit(False)
    for ending in TS_ENDINGS:
        ts = ts | path.endswith(ending)
    return F.when(path.endswith(".py"), "python").when(ts & ~path.endswith(".d.ts"), "typescript")


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """``path`` (below the root), ``language``, ``content`` and ``content_hash`` of each source file."""
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{py,ts,tsx,js,jsx,mjs,cjs}").load(base)
    # listings and scans write local paths with one slash or three
    path = F.regexp_replace("path", "^file:/+", "/").alias("path")
    every = spark.createDataFrame([(p,) for p in found.inputFiles()], "path string").select(path)
    rows = found.select(path, "content")
    # scans skip files without content, the listing has them
    nothing = every.join(rows.select("path"), "path", "left_anti").select("path", F.lit(b"").alias("content"))
    start = base.removeprefix("file://") + "/"
    rows = rows.unionByName(nothing).where(F.locate(start, F.col("path")) > 0)
    rows = rows.select(F.expr(f"substring(path, locate('{start}', path) + {len(start)})").alias("path"), "content")
    rows = rows.where(~in_folder(F.col("path"), SKIPPED)).withColumn("language", language_of(F.col("path"))).where("language is not null")
    return rows.select("path", "language", "content", F.sha2("content", 256).alias("content_hash"))


def extract(files: DataFrame) -> DataFrame:
    """The rows of ``records.EXTRACTED`` of all files (path, language, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, language, content in zip(part["path"], part["language"], part["content"]):
                rows += (python_source if language == "python" else ts_source).extract(path, bytes(content))
            yield pd.DataFrame(rows, columns=list(COLUMNS)).astype({c: "Int32" for c in ("start_line", "end_line", "line")})

    return files.select("path", "language", "content").mapInPandas(run, EXTRACTED)


def gitignore_lines(text: str) -> list[str]:
    return [x for line in text.splitlines() if (x := line.strip()) and not x.startswith("#")]


def _in_any_segment(parts: Column, pattern: str) -> Column:
    return F.exists(parts, lambda segment: matches_glob(segment, pattern))


def accepted(path: Column, ignores: tuple[str, ...] = (), gitignore: tuple[str, ...] = ()) -> Column:
    """Whether a path (below the root) is to be watched."""
    parts = F.split(path, "/")
    hit = language_of(path).isNotNull() | path.endswith(".d.ts")
    hit &= ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in UNWATCHED]))
    for pattern in ignores:
        hit &= ~matches_glob(path, pattern) & ~_in_any_segment(parts, pattern.rstrip("/"))
    for pattern in gitignore:
        if pattern.endswith("/"):
            hit &= ~F.array_contains(parts, pattern.rstrip("/"))
        else:
            hit &= ~matches_glob(path, pattern) & ~_in_any_segment(parts, pattern)
    return hit
