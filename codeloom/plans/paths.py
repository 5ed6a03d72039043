"""Bounded path expansion as unrolled joins.

The depth is known when the plan is built, so the paths of each length are one more join of the edges;
no edge occurs twice in a path.  The edge filter goes before the expansion, which is the same as
asking it of every edge of the path, and keeps the joins small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.plans.scc import strongly_connected
from codeloom.plans.scratch import keep


def _within(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """The edges that ways of at most ``depth`` calls to a seed (via) can take, so the cost follows what lies above the seeds.

    A way that comes to an edge again has gone around a circle of such edges, so they also tell which edges those are.
    """
    spark = edges.sparkSession
    # read by every level
    edges = keep(spark, edges)
    front = seen = keep(spark, seeds.select(F.col("via").alias("callee")).distinct())
    for _ in range(depth - 1):
        found = edges.join(front, "callee", "left_semi").select(F.col("caller").alias("callee")).distinct()
        front = keep(spark, found.join(seen, "callee", "left_anti"))
        if not front.head(1):
            break
        seen = seen.unionByName(front)
    return keep(spark, edges.join(seen, "callee", "left_semi"))


def _steps(edges: DataFrame, depth: int) -> DataFrame:
    """caller, at (callee), flags, and ``edge``: the name of an edge that a path can take twice, else null.

    Only an edge within a strongly connected component can be taken twice, and by two steps only a loop at a node.
    """
    flags = F.struct(F.coalesce("static", F.lit(False)).alias("static"), F.coalesce("runtime", F.lit(False)).alias("runtime"))
    steps = edges.select("caller", F.col("callee").alias("at"), flags.alias("flags"))
    name = F.concat_ws("\x00", "caller", "at")
    if depth <= 2:
        return steps.withColumn("edge", F.when(F.col("caller") == F.col("at"), name))
    of = strongly_connected(edges.sparkSession, edges.select(F.col("caller").alias("u"), F.col("callee").alias("v")))
    # read by every level, so made once
    of = keep(edges.sparkSession, of)
    ends = steps.join(of.select(F.col("node").alias("caller"), F.col("component").alias("one")), "caller")
    ends = ends.join(of.select(F.col("node").alias("at"), F.col("component").alias("two")), "at")
    return keep(edges.sparkSession, ends.select("caller", "at", "flags", F.when(F.col("one") == F.col("two"), name).alias("edge")))


def upstream_paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """The distinct ways of at most ``depth`` calls that end in a seed.

    edges: caller, callee, static, runtime (unique caller and callee); seeds: via.  Returns ``via``,
    ``node`` (where the path starts), ``depth`` and ``edges`` (array of the flags, from the node on).

    Paths of a length that have the same end, flags and edges that could come again are one from there on, so
    where calls make no circles, the rows of a level are at most nodes times seeds times kinds of flags.
    """
    steps = _steps(_within(edges, seeds, depth) if depth > 2 else edges, depth)
    front = seeds.select("via", F.col("via").alias("at"), F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<static:boolean,runtime:boolean>>").alias("edges"))
    levels = []
    for k in range(1, depth + 1):
        step = front.join(steps, "at").where(F.col("edge").isNull() | ~F.array_contains("used", F.col("edge")))
        used = F.when(F.col("edge").isNull(), F.col("used")).otherwise(F.array_sort(F.array_append("used", F.col("edge"))))
        front = step.select("via", F.col("caller").alias("at"), used.alias("used"), F.concat(F.array("flags"), F.col("edges")).alias("edges")).distinct()
        levels.append(front.select("via", F.col("at").alias("node"), F.lit(k).alias("depth"), "edges"))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def upstream_depths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``node`` and its least ``depth`` above any seed: breadth first, each node once."""
    steps = edges.select(F.col("caller").alias("next"), F.col("callee").alias("node")).distinct()
    seen = seeds.select(F.col("via").alias("node"), F.lit(0).alias("depth")).distinct()
    front = seen
    for k in range(1, depth + 1):
        found = front.select("node").join(steps, "node").select(F.col("next").alias("node")).distinct()
        front = found.join(seen.select("node"), "node", "left_anti").select("node", F.lit(k).alias("depth"))
        seen = seen.unionByName(front)
    return seen.where("depth > 0")
