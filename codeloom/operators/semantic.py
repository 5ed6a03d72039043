"""Nearest symbols by cosine, and their neighbourhood in the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.columns import KINDS, callable_kind, clamp, cosine, provenance_label
from codeloom.store import Graph

MOST_SEEDS = 50
INCLUDES = ("callers", "callees", "tests")


def semantic_search(graph: Graph, project: str, query: list[float], limit: int = 10, kind: str = "any", min_score: float | None = None, score: str = "cosine") -> DataFrame:
    """The symbols nearest to the query vector, by exact scan; ``score``: ``cosine``, or ``unit`` for (1 + cosine) / 2."""
    if kind not in KINDS:
        raise ValueError(f"invalid kind {kind!r}; must be one of {', '.join(KINDS)}")
    symbols = graph.symbols(project).where(callable_kind(kind, tests=True)).select("qualified_name", "name", "kind", "file", "start_line", "end_line", "source")
    value = cosine(F.col("embedding"), query)
    value = (F.lit(1.0) + value) / 2 if score == "unit" else value
    scored = graph.within("embeddings", project).where(F.size("embedding") == len(query)).select("qualified_name", value.alias("score"))
    out = symbols.join(scored, "qualified_name").where("score is not null")
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    return out.orderBy(F.desc("score"), "qualified_name").limit(max(1, int(limit)))


def _first_neighbours(graph: Graph, project: str, seeds: DataFrame, at: str, other: str, most: int) -> DataFrame:
    """The first neighbours of each seed by name, with their provenance."""
    calls = graph.within("calls", project).select(F.col(at).alias("seed"), F.col(other).alias("neighbour"), F.coalesce("static", F.lit(False)).alias("static"), F.coalesce("runtime", F.lit(False)).alias("runtime"))
    calls = calls.join(seeds.select(F.col("qualified_name").alias("seed")), "seed", "left_semi")
    edges = calls.groupBy("seed", "neighbour").agg(F.bool_or("static").alias("static"), F.bool_or("runtime").alias("runtime"))
    first = edges.withColumn("k", F.row_number().over(Window.partitionBy("seed").orderBy("neighbour"))).where(F.col("k") <= most)
    return first.select("seed", "neighbour", provenance_label(F.col("static"), F.col("runtime")).alias("provenance"))


def neighbourhood(graph: Graph, project: str, seeds: DataFrame, per_seed: int = 10, include: tuple[str, ...] = INCLUDES) -> DataFrame:
    """Rows (seed, relation, neighbour, provenance) of all seeds in one plan for each relation."""
    per_seed = clamp(per_seed, 1, MOST_SEEDS)
    parts = []
    if "callers" in include:
        parts.append(_first_neighbours(graph, project, seeds, "callee", "caller", per_seed).withColumn("relation", F.lit("callers")))
    if "callees" in include:
        parts.append(_first_neighbours(graph, project, seeds, "caller", "callee", per_seed).withColumn("relation", F.lit("callees")))
    if "tests" in include:
        tests = graph.within("symbols", project).where("is_test").select(F.col("qualified_name").alias("test"))
        covers = graph.within("covers", project).join(tests, "test", "left_semi").select(F.col("symbol").alias("seed"), F.col("test").alias("neighbour")).distinct()
        covers = covers.join(seeds.select(F.col("qualified_name").alias("seed")), "seed", "left_semi")
        first = covers.withColumn("k", F.row_number().over(Window.partitionBy("seed").orderBy("neighbour"))).where(F.col("k") <= per_seed)
        parts.append(first.select("seed", "neighbour", F.lit(None).cast("string").alias("provenance"), F.lit("tests").alias("relation")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select("seed", "relation", "neighbour", "provenance")


def semantic_neighborhood(graph: Graph, project: str, query: list[float], limit: int = 10, per_seed_limit: int = 10, kind: str = "any", include: list[str] | None = None, min_score: float = 0.0) -> list[dict]:
    """The seeds, best first, each with its callers, callees and tests."""
    wanted = tuple(x for x in include or INCLUDES if x in INCLUDES) or INCLUDES
    seeds = semantic_search(graph, project, query, clamp(limit, 1, MOST_SEEDS), kind, min_score)
    rows = [r.asDict() for r in seeds.collect()]  # at most MOST_SEEDS
    if not rows:
        return []
    fixed = graph.spark.createDataFrame([(r["qualified_name"],) for r in rows], "qualified_name string")
    around: dict[tuple[str, str], list[dict]] = {}
    for r in neighbourhood(graph, project, fixed, per_seed_limit, wanted).orderBy("neighbour").collect():
        item = {"qualified_name": r["neighbour"]} | ({} if r["relation"] == "tests" else {"provenance": r["provenance"]})
        around.setdefault((r["seed"], r["relation"]), []).append(item)
    return [{"qualified_name": r["qualified_name"], "kind": r["kind"], "score": r["score"], "file": r["file"], "line": r["start_line"]} | {w: around.get((r["qualified_name"], w), []) for w in wanted} for r in rows]
