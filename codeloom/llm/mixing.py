"""Operator 5: mixing sources to target weights by temperature.

Token shares p of the sources are raised to an exponent a in [0, 1] and normalised.  The exponent is
bisected (many cuts at once, as one aggregate) against what it is to meet: the largest one whose weights
have at least the target entropy, and the least one with which no source is repeated more than
``most_repeats`` times as often as the one repeated least; the larger of the two holds, as the limit on
repeats must.  The target is given in nats (``entropy``) or as the part of the way from the entropy of the
shares to the largest possible (``evenness``: 0 leaves the shares, 1 makes all weights equal).  The budget
is such that the least repeated source is used ``passes`` times, so with ``passes`` = 1 no document is lost.

The weights are realised as block permutations: documents of a source fall into 4096 blocks by hash.
Each whole pass uses all of them.  The last, partial pass takes whole blocks in the order of a seeded
hash while the source's budget lasts, of the block at the edge whole sub-blocks, and of the sub-block
at the edge whole documents.  ``position`` (0 to 1) spreads every source evenly over the mixture, block
by block in each pass's own order; sorting by it gives the training order.

Per-source numbers stay in a small table; running sums go over at most 4096 rows a source, and hot
sources are summed before any shuffle.

Tokens are white-space words here unless the caller gives another measure as a column (``tokens``).

Edge cases: a null source is a source of its own; null texts count as one token, as empty ones do;
repeated rows are documents of their own, equal ones are taken together; without rows there are none;
all columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import SPACE_CLASS, SPACES, Scratch, fits_broadcast

BLOCKS = 4096
MOST_REPEATS = 2.0
#: Half the way from the corpus's own entropy to equal weights.
EVENNESS = 0.5
SEED = 17
#: Cuts of the bracket in one round of bisection.
CUTS = 32
#: Sources whose weights are broadcast.
MOST_SOURCES = 100_000


def word_tokens(text: Column) -> Column:
    """Words of a text, and at least one token."""
    trimmed = F.btrim(text.cast("string"), F.lit(SPACES))
    return F.greatest(F.coalesce(F.size(F.split(trimmed, f"{SPACE_CLASS}+")), F.lit(1)), F.lit(1)).cast("long")


def measures(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent the entropy (nats) of the normalised p ** a, and how often the most repeated source goes
    for once of the least repeated one; in one aggregate."""
    aggs = []
    for k, a in enumerate(exponents):
        w, repeats = F.pow("p", F.lit(a)), F.pow("p", F.lit(a - 1))
        aggs += [F.sum(w).alias(f"z{k}"), F.sum(w * F.lit(a) * F.log("p")).alias(f"t{k}"), (F.max(repeats) / F.min(repeats)).alias(f"r{k}")]
    r = sources.agg(*aggs).first()
    return [(math.log(r[f"z{k}"]) - r[f"t{k}"] / r[f"z{k}"], r[f"r{k}"]) for k in range(len(exponents))]


def bisect(sources: DataFrame, holds: Callable[[tuple[float, float]], bool], upper: bool, rounds: int = 6) -> float:
    """The exponent in [0, 1] at which ``holds`` changes: the least that holds if it holds above (``upper``), else the largest."""
    low, high = 0.0, 1.0
    for _ in range(rounds):
        grid = [low + (high - low) * k / CUTS for k in range(CUTS + 1)]
        found = [holds(x) for x in measures(sources, grid)]
        if upper:
            k = found.index(True) if True in found else CUTS
            if k == 0:
                return grid[0]
            low, high = grid[k - 1], grid[k]
        else:
            k = max((i for i, x in enumerate(found) if x), default=0)
            if k == CUTS:
                return grid[CUTS]
            low, high = grid[k], grid[k + 1]
    return high if upper else low


def exponent_for(sources: DataFrame, entropy: float | None, evenness: float | None, most_repeats: float) -> float:
    """The temperature exponent; ``sources`` has the shares ``p``."""
    r = sources.agg(F.min("p").alias("low"), F.max("p").alias("high"), F.count("*").alias("n")).first()
    if r["low"] is None or r["low"] == r["high"]:
        return 1.0
    if entropy is None and evenness is not None:
        own = measures(sources, [1.0])[0][0]
        entropy = own + evenness * (math.log(r["n"]) - own)
    # repeats go as p ** (a - 1), so the limit holds from some exponent on; the entropy falls as the exponent rises
    least = bisect(sources, lambda x: x[1] <= most_repeats * (1 + 1e-9), True)
    return least if entropy is None else max(least, bisect(sources, lambda x: x[0] >= entropy, False))


def _hash_bits(pass_no: Column, key: Column, seed: int, bits: int, shift: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), pass_no, key), shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def mix(spark: SparkSession, docs: DataFrame, scratch: Scratch, tokens: Column | None = None, entropy: float | None = None, evenness: float | None = EVENNESS, most_repeats: float = MOST_REPEATS, passes: float = 1.0, seed: int = SEED) -> DataFrame:
    """The mixture: struct ``row`` (the columns of ``docs``), ``pass``, ``position``, ``n_tokens``, ``weight``."""
    tokens = word_tokens(F.col("text")) if tokens is None else tokens.cast("long")
    light = docs.select(F.col("source").cast("string").alias("source"), tokens.alias("n_tokens"), F.xxhash64(F.col("doc_id"), F.col("text")).alias("key"))
    light = scratch.keep(light)
    totals = light.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    totals = scratch.keep(totals.where("tokens > 0"))
    every = totals.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    sources = totals.select("*", (F.col("tokens") / F.lit(float(max(every, 1)))).alias("p"))
    a = exponent_for(sources, entropy, evenness, most_repeats)
    r = sources.agg(F.sum(F.pow("p", F.lit(a))).alias("z"), F.min(F.pow("p", F.lit(a - 1))).alias("rate")).first()
    z, rate = r["z"] or 1.0, r["rate"] or 1.0
    repeats = F.lit(passes) * F.pow("p", F.lit(a - 1)) / F.lit(rate)
    plan = sources.select("source", "tokens", (F.pow("p", F.lit(a)) / F.lit(z)).alias("weight"), F.round(repeats, 9).alias("repeats"))
    plan = plan.select("*", F.floor("repeats").cast("int").alias("whole"))
    plan = scratch.keep(plan.select("*", F.floor((F.col("repeats") - F.col("whole")) * F.col("tokens")).alias("budget")))
    small = F.broadcast(plan) if fits_broadcast(plan, MOST_SOURCES) else plan

    rows = light.groupBy("source", "key").agg(F.sum("n_tokens").alias("n")).alias("l").join(small.alias("s"), F.col("l.source").eqNullSafe(F.col("s.source")))
    level = rows.where("budget > 0").select("l.source", "key", "n", "budget", _hash_bits(F.col("whole"), F.col("key"), seed, 12, 52).alias("b1"), _hash_bits(F.col("whole"), F.col("key"), seed, 12, 40).alias("b2"))
    level = scratch.keep(level)

    def edge(sums: DataFrame, order: str) -> DataFrame:
        """For each source, the first row (in the permutation's order) that its budget does not hold whole, and what is left for it."""
        before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        over = sums.select("*", before.alias("before")).where("before + n > budget")
        return scratch.keep(over.groupBy("source").agg(F.min(F.struct(F.col(order).alias("at"), (F.col("budget") - F.col("before")).alias("rest"))).alias("edge")))

    def at_edge(rows: DataFrame, edges: DataFrame, order: str) -> DataFrame:
        edges = F.broadcast(edges) if fits_broadcast(edges, MOST_SOURCES) else edges
        found = rows.alias("l").join(edges.alias("c"), F.col("l.source").eqNullSafe(F.col("c.source")) & (F.col(f"l.{order}") == F.col("c.edge.at")))
        return found.select("l.source", "l.key", "l.n", F.col("c.edge.rest").alias("budget"), "l.b2")

    edge1 = edge(level.groupBy("source", "b1").agg(F.sum("n").alias("n"), F.first("budget").alias("budget")), "b1")
    level = scratch.keep(at_edge(level, edge1, "b1"))
    edge2 = edge(level.groupBy("source", "b2").agg(F.sum("n").alias("n"), F.first("budget").alias("budget")), "b2")
    edge3 = edge(at_edge(level, edge2, "b2"), "key")
    plan = plan.alias("s")
    for k, found in enumerate((edge1, edge2, edge3), 1):
        found = found.select(F.col("source").alias(f"from{k}"), F.col("edge.at").alias(f"e{k}"))
        plan = plan.join(found, F.col("s.source").eqNullSafe(F.col(f"from{k}")), "left")
    plan = scratch.keep(plan.select("s.*", "e1", "e2", "e3"))

    # what each source takes in its partial pass is now a comparison of hashes
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    every_row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), tokens.alias("n_tokens"), key.alias("key"))
    small = (F.broadcast(plan) if fits_broadcast(plan, MOST_SOURCES) else plan).alias("s")
    used = every_row.join(small, F.col("row.source").cast("string").eqNullSafe(F.col("s.source")))
    h1, h2 = _hash_bits(F.col("whole"), F.col("key"), seed, 12, 52), _hash_bits(F.col("whole"), F.col("key"), seed, 12, 40)
    inside = (h1 < F.col("e1")) | (h1 == F.col("e1")) & ((h2 < F.col("e2")) | (h2 == F.col("e2")) & (F.col("key") < F.col("e3")))
    copies = F.col("whole") + F.when((F.col("budget") > 0) & inside, 1).otherwise(0)
    used = used.withColumn("copies", copies).where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    # a partial pass takes the first blocks of its permutation, so it ends where its share of the pass ends
    place = _hash_bits(F.col("pass"), F.col("key"), seed, 30, 34) / F.lit(float(1 << 30))
    position = F.least(F.lit(1.0), (F.col("pass") + place) / F.col("repeats"))
    return used.select("row", "pass", position.alias("position"), "n_tokens", "weight")
