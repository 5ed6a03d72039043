"""Cycles, layering and hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.columns import KINDS, PROVENANCE, callable_kind, clamp, matches_glob, provenance_is
from codeloom.plans.scc import strongly_connected
from codeloom.plans.scratch import keep
from codeloom.store import Graph

MOST_ROWS = 100
MOST_VIOLATIONS = 200
SCOPES = ("call", "module")
EDGE_KINDS = ("any", "imports", "calls")


def cycle_edges(graph: Graph, project: str, scope: str, provenance: str) -> DataFrame:
    """The edges ``u`` to ``v`` of the call graph or of the imports between files."""
    if scope == "module":
        files = graph.within("files", project).select(F.col("path").alias("src"))
        edges = graph.within("imports", project).where("target_kind = 'file'").join(files, "src", "left_semi")
        return edges.select(F.col("src").alias("u"), F.col("target").alias("v")).distinct()
    own = graph.symbols(project).where(callable_kind("any", tests=True)).select(F.col("qualified_name").alias("caller"))
    calls = graph.within("calls", project).where(provenance_is(provenance)).join(own, "caller", "left_semi")
    return calls.select(F.col("caller").alias("u"), F.col("callee").alias("v")).distinct()


def cycles(graph: Graph, project: str, scope: str = "call", provenance: str = "any", min_size: int = 2) -> DataFrame:
    """Strongly connected components: ``size`` and sorted ``nodes``; a single node needs a loop."""
    # read for their number, the components and the loops
    edges = keep(graph.spark, cycle_edges(graph, project, scope, provenance))
    members = strongly_connected(graph.spark, edges)
    loops = edges.where("u = v").select(F.col("u").alias("node"), F.lit(True).alias("loop"))
    parts = members.join(loops, "node", "left").groupBy("component").agg(F.count("*").cast("int").alias("size"), F.sort_array(F.collect_list("node")).alias("nodes"), F.bool_or(F.coalesce("loop", F.lit(False))).alias("loop"))
    return parts.where((F.col("size") >= clamp(min_size, 1, MOST_ROWS)) & ((F.col("size") > 1) | F.col("loop"))).select("size", "nodes")


def find_cycles(graph: Graph, project: str, scope: str = "call", provenance: str = "any", min_size: int = 2, limit: int = 20) -> DataFrame:
    """The largest components first."""
    if scope not in SCOPES or provenance not in PROVENANCE:
        raise ValueError(f"invalid scope {scope!r} or provenance {provenance!r}")
    return cycles(graph, project, scope, provenance, min_size).orderBy(F.desc("size"), F.col("nodes")[0]).limit(clamp(limit, 1, MOST_ROWS))


def layer_of(path, layers: list[dict]) -> tuple:
    """The first layer one of whose patterns matches: its name and its rank (from the top)."""
    name, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
    ranks = {layer["name"]: k for k, layer in enumerate(layers)}
    for layer in reversed(layers):
        for pattern in reversed(layer.get("patterns") or []):
            hit = matches_glob(path, pattern)
            name, rank = F.when(hit, F.lit(layer["name"])).otherwise(name), F.when(hit, F.lit(ranks[layer["name"]])).otherwise(rank)
    return name, rank


def file_edges(graph: Graph, project: str, edge_kind: str = "any") -> DataFrame:
    """Distinct edges between different files: imports and calls across files."""
    files = graph.within("files", project).select(F.col("path").alias("src"))
    kinds = []
    if edge_kind in ("any", "imports"):
        rows = graph.within("imports", project).where("target_kind = 'file'").join(files, "src", "left_semi")
        kinds.append(rows.select(F.col("src").alias("from_file"), F.col("target").alias("to_file"), F.lit("imports").alias("edge_kind")).distinct())
    if edge_kind in ("any", "calls"):
        symbols = graph.symbols(project).select("qualified_name", "file")
        caller = symbols.select(F.col("qualified_name").alias("caller"), F.col("file").alias("from_file"))
        callee = symbols.select(F.col("qualified_name").alias("callee"), F.col("file").alias("to_file"))
        rows = graph.within("calls", project).select("caller", "callee").join(caller, "caller").join(callee, "callee").where("from_file <> to_file")
        kinds.append(rows.select("from_file", "to_file", F.lit("calls").alias("edge_kind")).distinct())
    out = kinds[0]
    for more in kinds[1:]:
        out = out.unionByName(more)
    return out


def layered_edges(graph: Graph, project: str, layers: list[dict], edge_kind: str = "any") -> DataFrame:
    """Edges both of whose files have a layer, with the layers and their ranks."""
    if edge_kind not in EDGE_KINDS:
        raise ValueError(f"invalid edge_kind {edge_kind!r}; must be one of {', '.join(EDGE_KINDS)}")
    name, rank = layer_of(F.col("path"), layers)
    known = graph.within("files", project).select("path", name.alias("layer"), rank.alias("rank")).where("layer is not null")
    source = known.select(F.col("path").alias("from_file"), F.col("layer").alias("from_layer"), F.col("rank").alias("from_rank"))
    target = known.select(F.col("path").alias("to_file"), F.col("layer").alias("to_layer"), F.col("rank").alias("to_rank"))
    return file_edges(graph, project, edge_kind).join(source, "from_file").join(target, "to_file")


def violations(graph: Graph, project: str, layers: list[dict], edge_kind: str = "any") -> DataFrame:
    """Edges that go up."""
    found = layered_edges(graph, project, layers, edge_kind).where("from_rank > to_rank")
    return found.select("from_file", "to_file", "from_layer", "to_layer", "edge_kind")


def layering_violations(graph: Graph, project: str, layers: list[dict], edge_kind: str = "any", limit: int = 50) -> DataFrame:
    order = ("from_layer", "from_file", "to_file", "edge_kind")
    return violations(graph, project, layers, edge_kind).orderBy(*order).limit(clamp(limit, 1, MOST_VIOLATIONS))


def layering_summary(graph: Graph, project: str, layers: list[dict], edge_kind: str = "any") -> DataFrame:
    """One row: edges that go up, files without a layer, edges with two layers."""
    edges = layered_edges(graph, project, layers, edge_kind)
    counts = edges.agg(F.count_if(F.col("from_rank") > F.col("to_rank")).alias("violations"), F.count("*").alias("edges_checked"))
    name, _ = layer_of(F.col("path"), layers)
    files = graph.within("files", project).agg(F.count_if(name.isNull()).alias("files_unlayered"))
    return counts.crossJoin(files)  # one row each


def fan(graph: Graph, project: str, kind: str = "any") -> DataFrame:
    """Distinct callers and callees of each function and method; each side is summed before the join."""
    if kind not in KINDS:
        raise ValueError(f"invalid kind {kind!r}; must be one of {', '.join(KINDS)}")
    calls = graph.within("calls", project)
    callers = calls.groupBy(F.col("callee").alias("qualified_name")).agg(F.countDistinct("caller").alias("in_callers"))
    callees = calls.groupBy(F.col("caller").alias("qualified_name")).agg(F.countDistinct("callee").alias("out_callees"))
    symbols = graph.symbols(project).where(callable_kind(kind, tests=False)).select("qualified_name", "kind", "file")
    out = symbols.join(callers, "qualified_name", "left").join(callees, "qualified_name", "left")
    return out.na.fill(0, ["in_callers", "out_callees"])


def hubs(graph: Graph, project: str, kind: str = "any", min_fanin: int = 10, limit: int = 20) -> DataFrame:
    """The most called functions and methods."""
    found = fan(graph, project, kind).where(F.col("in_callers") >= clamp(min_fanin, 1, 1000))
    return found.orderBy(F.desc("in_callers"), "qualified_name").limit(clamp(limit, 1, MOST_ROWS))
