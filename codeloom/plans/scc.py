"""Strongly connected components of an edge table.

Nodes without an edge in or out are trimmed first: they stand alone.  What is left is solved in one
task while it is small (``EDGES_IN_A_TASK``), since a round trip of the cluster costs more than the
whole search; beyond that, colours (the least node that reaches a node) spread by joins, and the nodes
that reach their colour's root backwards make a component, until no node is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.scratch import keep

#: Edges that one task may hold; about 200 bytes each.
EDGES_IN_A_TASK = 1_000_000


def components_of(edges: list[tuple]) -> dict:
    """Least node of each node's component, by two depth-first passes (forward finishing order, then backward)."""
    out: dict = {}
    back: dict = {}
    for u, v in edges:
        out.setdefault(u, []).append(v)
        out.setdefault(v, [])
        back.setdefault(v, []).append(u)
    seen, finished = set(), []
    for start in sorted(out):
        if start in seen:
            continue
        seen.add(start)
        path = [(start, iter(out[start]))]
        while path:
            node, rest = path[-1]
            for other in rest:
                if other not in seen:
                    seen.add(other)
                    path.append((other, iter(out[other])))
                    break
            else:
                finished.append(node)
                path.pop()
    name: dict = {}
    for start in reversed(finished):
        if start in name:
            continue
        part, todo = [start], [start]
        name[start] = start
        while todo:
            for other in back.get(todo.pop(), ()):
                if other not in name:
                    name[other] = start
                    part.append(other)
                    todo.append(other)
        least = min(part)
        for node in part:
            name[node] = least
    return name


def _in_one_task(edges: DataFrame) -> DataFrame:
    kind = dict(edges.dtypes)["u"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        name = components_of(pairs)
        cells = pa.string() if kind == "string" else pa.int64()
        yield pa.RecordBatch.from_pydict({"node": pa.array(list(name), cells), "component": pa.array(list(name.values()), cells)})

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def _reached(spark: SparkSession, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``node``: the seeds and what is reached from them along edges (u, v); each node's edges are read once."""
    front = reached = keep(spark, seeds)
    while front.head(1):
        step = front.join(edges, F.col("node") == F.col("u")).select(F.col("v").alias("node")).distinct()
        front = keep(spark, step.join(reached, "node", "left_anti"))
        reached = reached.unionByName(front)
    return reached


def _ends(edges: DataFrame) -> DataFrame:
    """``node`` and whether edges other than a loop lead ``out`` of it and ``in``; one pass over the edges."""
    other = F.col("u") != F.col("v")
    ends = F.array(F.struct(F.col("u").alias("node"), other.alias("out"), F.lit(False).alias("in")), F.struct(F.col("v").alias("node"), F.lit(False).alias("out"), other.alias("in")))
    return edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.bool_or("e.out").alias("out"), F.bool_or("e.in").alias("in"))


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges neither of whose ends is one of the nodes."""
    return edges.join(nodes.select(F.col("node").alias("u")), "u", "left_anti").join(nodes.select(F.col("node").alias("v")), "v", "left_anti").select("u", "v")


def spread(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Components by colours; for edge sets of any size."""
    edges = keep(spark, edges.select("u", "v"))
    done: list[DataFrame] = []
    while True:
        # nodes that lack an edge in or out are components of their own
        while True:
            nodes = keep(spark, _ends(edges))
            alone = nodes.where("not (out and in)").select("node")
            if not alone.head(1):
                break
            done.append(alone.select("node", F.col("node").alias("component")))
            # a node that loses its last edge is left out of the edges, so it ends here
            left = keep(spark, _without(edges, alone))
            inner = nodes.where("out and in").select("node")
            lost = keep(spark, inner.join(_ends(left).select("node"), "node", "left_anti"))
            done.append(lost.select("node", F.col("node").alias("component")))
            edges = left
        if not nodes.head(1):
            break
        # as many rows as nodes: merged, so that the driver does not gather them in each round for a broadcast
        color = nodes.select("node", F.col("node").alias("color"))
        fell = color
        while True:
            # only a color that fell in the last round has something new to offer
            offered = edges.join(fell.select(F.col("node").alias("u"), "color").hint("merge"), "u").groupBy(F.col("v").alias("node")).agg(F.min("color").alias("offer"))
            new = keep(spark, color.join(offered, "node", "left").select("node", F.least("color", F.coalesce("offer", "color")).alias("color"), F.coalesce(F.col("offer") < F.col("color"), F.lit(False)).alias("fell")))
            color, fell = new.select("node", "color"), new.where("fell").select("node", "color")
            if not fell.head(1):
                break
        named = edges.join(color.select(F.col("node").alias("u"), F.col("color").alias("cu")).hint("merge"), "u").join(color.select(F.col("node").alias("v"), F.col("color").alias("cv")).hint("merge"), "v")
        # a node has one color, so within these edges a root reaches nodes of its own color only
        backward = keep(spark, named.where("cu = cv and u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        part = _reached(spark, color.where("node = color").select("node"), backward)
        part = keep(spark, color.join(part, "node", "left_semi").select("node", F.col("color").alias("component")))
        done.append(part)
        left = keep(spark, color.select("node").join(part.select("node"), "node", "left_anti"))
        if not left.head(1):
            break
        edges = keep(spark, _without(edges, part))
        # nodes that have lost all their edges
        done.append(keep(spark, left.join(_ends(edges).select("node"), "node", "left_anti")).select("node", F.col("node").alias("component")))
    out = done[0] if done else edges.select(F.col("u").alias("node"), F.col("u").alias("component")).limit(0)
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def strongly_connected(spark: SparkSession, edges: DataFrame, in_a_task: int = EDGES_IN_A_TASK) -> DataFrame:
    """``node`` and ``component`` (its least node) for every node of the edges (u, v)."""
    edges = edges.where("u is not null and v is not null").distinct()
    return _in_one_task(edges) if edges.limit(in_a_task + 1).count() <= in_a_task else spread(spark, edges)
