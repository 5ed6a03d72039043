"""Columns that several operators share."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

PROVENANCE = ("any", "static", "runtime")
KINDS = ("any", "function", "method")

#: The columns by which results name a symbol.
SYMBOL_REF = ("qualified_name", "name", "kind", "file", "start_line", "end_line")


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(int(value), high))


def provenance_is(wanted: str) -> Column:
    """Calls of this provenance; ``any`` passes everything."""
    return F.lit(True) if wanted == "any" else F.coalesce(F.col(wanted), F.lit(False))


def provenance_label(static: Column, runtime: Column) -> Column:
    return F.when(static & runtime, "both").when(static, "static").when(runtime, "runtime").otherwise("unknown")


def callable_kind(kind: str, tests: bool) -> Column:
    """Functions and methods of a kind; ``tests``: whether ``any`` takes in tests (``function`` never does)."""
    function = (F.col("kind") == "function") & ~F.coalesce(F.col("is_test"), F.lit(False))
    method = F.col("kind") == "method"
    if kind == "function":
        return function
    if kind == "method":
        return method
    return F.col("kind").isin("function", "method") if tests else function | method


def matches_glob(path: Column, pattern: str) -> Column:
    """``fnmatch`` semantics: ``*`` crosses slashes."""
    regex = fnmatch.translate(pattern).replace("\\Z", "\\z")
    return path.rlike(f"^{regex}")


def coverage_pct(covered: Column, total: Column) -> Column:
    """Percentage rounded half-even to two places; 0 where there is nothing to cover."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.bround(F.lit(100.0) * covered / total, 2))


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine with a literal query in double precision; null for vectors without length."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = vector.cast("array<double>")

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    norm = F.sqrt(dot(v, v)) * F.lit(sum(float(x) ** 2 for x in query) ** 0.5)
    return F.when(norm > 0, dot(v, q) / norm)


def snippet(source: Column, lines: int = 3) -> Column:
    """The first lines that are not blank."""
    kept = F.filter(F.split(source, "\r?\n"), lambda x: F.length(F.trim(x)) > 0)
    return F.array_join(F.slice(kept, 1, lines), "\n")
