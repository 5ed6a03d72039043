"""Connected components of an edge table, by rounds of local union-find and contraction.

A round deals the edges out to tasks of bounded size, each of which joins what it has and names the
smallest node of each part.  Nodes that got several names tie those names together; these ties are
the next round's edges.  Names only fall, and each round leaves names alone, so the table shrinks.
No task holds more than its share of edges, and nothing but counts reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch

#: Edges that one task joins.
EDGES_A_TASK = 400_000


def smallest_names(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes of the edges, and the smallest node that each can reach.

    Names fall to the least one over each edge, and then to their own names' names, until all edges agree.
    """
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    name = np.arange(len(nodes))
    while True:
        least = np.minimum(name[a], name[b])
        apart = np.flatnonzero(name[a] != name[b])
        if not len(apart):
            return nodes, nodes[name]
        # the names themselves fall too, so that whole parts move at once
        np.minimum.at(name, name[a[apart]], least[apart])
        np.minimum.at(name, name[b[apart]], least[apart])
        while True:
            up = name[name]
            if (up == name).all():
                break
            name = up
        a, b = a[apart], b[apart]


def _join_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
    if got:
        nodes, names = smallest_names(np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got]))
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes), "name": pa.array(names)})


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for each node of ``edges`` (u, v: long, not null)."""
    edges = scratch.keep(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v"))
    rounds: list[DataFrame] = []
    while True:
        tasks = max(1, math.ceil(edges.count() / edges_a_task))
        names = edges.repartition(tasks).mapInArrow(_join_locally, "node long, name long")
        if tasks == 1:
            rounds.append(scratch.keep(names))
            break
        # a node has at most one name from each task
        grouped = scratch.keep(names.groupBy("node").agg(F.min("name").alias("name"), F.collect_set("name").alias("names")))
        rounds.append(grouped.select("node", "name"))
        edges = scratch.keep(grouped.where(F.size("names") > 1).select(F.explode("names").alias("u"), F.col("name").alias("v")).where("u <> v").distinct())
    out = rounds.pop().select("node", F.col("name").alias("component"))
    while rounds:
        below = rounds.pop()
        out = below.join(out.withColumnRenamed("node", "name"), "name", "left").select("node", F.coalesce("component", "name").alias("component"))
        out = scratch.keep(out)
    return out
