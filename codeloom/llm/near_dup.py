"""Operator 9: n-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of shingles of five words (white space parts words, A-Z count as a-z; a text of one to
four words is one shingle).  Equal word sequences make a class, of which one text goes on.  112 MinHash
values a text are cut into 28 bands of four; texts with an equal band are candidates (a pair of
similarity 0.8 shares none with probability 4e-7).  Candidates' MinHash values are compared 16 at a
time, and a pair is dropped as soon as the posterior probability (uniform prior) of a similarity of at
least the threshold falls below the tolerance.  What is left is verified on the exact shingle sets.

Hot bands are cut into blocks, and pairs of blocks are tasks of bounded size, so a group of any size is
compared whole.  A pair is compared only in the first band that it shares.  Tasks return link counts
and a spanning forest of their links, never the pairs, so what is shuffled stays in proportion to the
texts (times the blocks of hot bands).

Nodes are distinct word sequences, numbered once they are written, so texts that share a doc_id are kept
apart: each row is a document of its own.  A class is named by its least doc_id, and the row kept is the one
with that id (of several, that with the least text hash).

Edge cases: null and wordless texts link with nothing; texts of any length are hashed whole; equal rows
link with each other and are all marked as kept if one is; rows with a null doc_id link with nothing, are
kept and have a null class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import PASS_BYTES, Scratch, flat_bytes, frugal, join_keys, mix64, text_chunks
from codeloom.llm.components import components, smallest_names

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
#: Texts of one block of a hot band.
BLOCK = 512
#: Pairs compared at once.
PAIRS = 1 << 16

_draw = np.random.Generator(np.random.PCG64(20240229))
BYTE_HASH = _draw.integers(0, 1 << 64, 256, np.uint64)
XOR = _draw.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)
ODD = _draw.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32) | np.uint32(1)
STEPS = (np.uint64(0x9E3779B97F4A7C15) ** np.arange(SHINGLE, dtype=np.uint64)).astype(np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), 0x100000001B3, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a string column, and the rows' first words (one more at the end)."""
    raw, starts = flat_bytes(text)
    raw = FOLD[raw]
    inside = ~SPACE[raw]
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    bounds = np.searchsorted(begins, starts)
    if not len(begins):
        return np.zeros(0, np.uint64), bounds
    at = np.flatnonzero(inside)
    of = np.searchsorted(at, begins)
    sizes = np.diff(np.append(of, len(at)))
    place = np.arange(len(at)) - np.repeat(of, sizes)
    value = BYTE_HASH[raw[at]] * powers(int(sizes.max()))[place]
    return mix64(np.add.reduceat(value, of) + sizes.astype(np.uint64)), bounds


def shingles(text: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles (repeats too), the rows' first shingles, and hashes of the whole word sequences."""
    words, bounds = word_hashes(text)
    sizes = np.diff(bounds)
    end = np.repeat(bounds[1:], sizes)
    start = np.repeat(bounds[:-1], sizes)
    place = np.arange(len(words))
    total = np.zeros(len(words), np.uint64)
    for j in range(size):
        here = np.zeros(len(words), np.uint64)
        here[: len(words) - j] = words[j:] if j else words
        total += np.where(place + j < end, here, np.uint64(0)) * (STEPS[j] if size == SHINGLE else np.uint64(0x9E3779B97F4A7C15) ** np.uint64(j))
    good = (place + size <= end) | (place == start) & (end - start < size)
    sequence = np.zeros((len(sizes), 2), np.uint64)
    if len(words):
        rank = powers(int(sizes.max()))[place - start]
        full = np.flatnonzero(sizes)
        sequence[full, 0] = mix64(np.add.reduceat(words * rank, bounds[:-1][full]))
        sequence[full, 1] = mix64(np.add.reduceat(mix64(words ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * rank, bounds[:-1][full]))
    counts = np.where(sizes >= size, sizes - size + 1, np.minimum(sizes, 1))
    return mix64(total[good]), np.concatenate([[0], np.cumsum(counts)]), sequence


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values of rows that have a shingle, as 16-bit numbers; other rows are zero."""
    out = np.zeros((len(bounds) - 1, HASHES), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        at = bounds[:-1][full]
        for k in range(HASHES):
            least = np.minimum.reduceat((low ^ XOR[k]) * ODD[k], at)
            out[full, k] = mix64(least.astype(np.uint64) + np.uint64(k)) >> np.uint64(48)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP) -> list[tuple[int, int]]:
    """(values compared, least matches with which a pair goes on): P(similarity >= threshold | matches) >= tolerance."""
    out = []
    for n in range(step, HASHES + 1, step):
        # under a uniform prior the posterior is Beta(m + 1, n - m + 1); its upper tail is P(Binomial(n + 1, t) <= m)
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row and band: the band's four values, mixed with its number."""
    four = np.ascontiguousarray(sig).view("<u8").reshape(len(sig), BANDS)
    return mix64(four + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def runs(key: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys, and the end."""
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)


def candidate_pairs(sig: np.ndarray, group: np.ndarray, band: np.ndarray, node: np.ndarray, side: np.ndarray, limits: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of the same group (rows come sorted by it) that pass the pruning.

    ``side``: -1 where a group is compared within itself, else the block; such rows meet the other block only.
    """
    cuts = runs(group)
    columns = np.ascontiguousarray(np.ascontiguousarray(sig).view("<u8").reshape(len(sig), BANDS).T)
    most = int(np.diff(cuts).max()) if len(group) else 0
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for d in range(1, most + 1):
        i = np.flatnonzero(group[d:] == group[:-d]) if d < most else np.zeros(0, np.int64)
        if len(i):
            i = i[(node[i] != node[i + d]) & ((side[i] < 0) | (side[i] != side[i + d]))]
            waiting.append((i, i + d))
            held += len(i)
        if held >= PAIRS or d == most:
            if held:
                a, b = np.concatenate([x for x, _ in waiting]), np.concatenate([x for _, x in waiting])
                for k in range(0, len(a), PAIRS):
                    got = prune(sig, columns, band, a[k : k + PAIRS], b[k : k + PAIRS], limits)
                    if len(got[0]):
                        yield got
            waiting, held = [], 0


def prune(sig: np.ndarray, columns: np.ndarray, band: np.ndarray, a: np.ndarray, b: np.ndarray, limits: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose first shared band is this one and that stay likely enough after each step; ``columns``: the values of each band."""
    # near copies share most bands, so nearly all of their pairs go with the first earlier band
    for k in range(int(band[a].max()) if len(a) else 0):
        new = (columns[k][a] != columns[k][b]) | (band[a] <= k)
        a, b = a[new], b[new]
        if not len(a):
            break
    own = columns[band[a], a] == columns[band[a], b]
    a, b = a[own], b[own]
    matches, done = np.zeros(len(a), np.int64), 0
    for n, least in limits:
        if not len(a):
            break
        matches += (sig[a, done:n] == sig[b, done:n]).sum(1)
        good = matches >= least
        a, b, matches, done = a[good], b[good], matches[good], n
    return a, b


def shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted sets; by matrix products of 0/1 columns where pairs are many."""
    used = np.unique(np.concatenate([a, b]))
    if len(a) < 4 * len(used):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist())], np.int64)
    sizes = np.array([len(sets[x]) for x in used])
    every, column, times = np.unique(np.concatenate([sets[x] for x in used]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), sizes)
    keep = times[column] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(used), len(used)))
    width = max(256, (4 << 20) // max(1, len(used)))
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        lo, hi = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(used), width), np.float32)
        part[row[lo:hi], column[lo:hi] - start] = 1
        total += part @ part.T
    return total[np.searchsorted(used, a), np.searchsorted(used, b)].astype(np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys; rows come sorted by the key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.asarray(batch.column(key))
        last = int(np.flatnonzero(k[1:] != k[:-1])[-1]) + 1 if (k[1:] != k[:-1]).any() else 0
        same = bool(held) and held[-1].column(key)[-1].as_py() == k[0]
        if held and not same:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def fixed(column: pa.ChunkedArray, width: int, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def links_of(node: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict[str, pa.Array]:
    """Link counts of the rows and a spanning forest of their links, as rows (u, v, links)."""
    count = np.zeros(len(node), np.int64)
    np.add.at(count, a, copies[b])
    np.add.at(count, b, copies[a])
    at = np.flatnonzero(count)
    nodes, names = smallest_names(node[a], node[b])
    u = np.concatenate([node[at], nodes])
    v = np.concatenate([np.full(len(at), -1), names])
    own = np.arange(len(u)) < len(at)
    links = np.concatenate([count[at], np.zeros(len(nodes), np.int64)])
    return {"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64(), mask=own), "links": pa.array(links, pa.int64(), mask=~own)}


PAIR_ROWS = "u long, v long, links long"


def numbered(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """The classes with a ``node`` number each, which is part of what is written and so never changes."""
    return scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()))


def finish(spark: SparkSession, members: DataFrame, classes: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """The members with the ``n_links`` and ``class_id`` of each, its class's columns, and whether that is the ``head`` of its component.

    members: doc_id, h, g (null h: links with nothing) and others; classes: h, g, node, rep (least doc_id), copies and others; found: PAIR_ROWS between nodes.
    """
    names = components(spark, found.where("v is not null").select("u", "v"), scratch)
    links = found.where("links is not null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    table = scratch.keep(classes.join(names, "node", "left").join(links, "node", "left"))
    own = F.struct("rep", "h", "g")
    tops = scratch.keep(table.where("component is not null").groupBy("component").agg(F.min(own).alias("top")))
    table = join_keys(table, tops, ["component"], "left")
    n_links, head = F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.col("top").isNull() | (own == F.col("top"))
    table = table.withColumns({"n_links": n_links, "class_id": F.coalesce("top.rep", "rep"), "head": head})
    out = members.join(scratch.keep(table.drop("top", "links", "copies", "node", "component")), ["h", "g"], "left")
    return out.withColumns({"n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "class_id": F.coalesce("class_id", "doc_id")})


def similarity_join(spark: SparkSession, docs: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """A row for each document: ``doc_id``, ``n_links`` (other documents linked directly), ``class_id``, ``kept``, and ``text_key``.

    ``text_key`` is ``xxhash64(text)``: with doc_id, it names the row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select(F.xxhash64("text").alias("text_key"), "text", "doc_id")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text", PASS_BYTES):
            hashes, bounds, sequence = shingles(part.column(1))
            sig = signatures(hashes, bounds)
            empty = (np.diff(bounds) == 0) | np.asarray(part.column(2).is_null())
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column(2),
                "text_key": part.column(0),
                "h": pa.array(sequence[:, 0].view(np.int64), mask=empty),
                "g": pa.array(sequence[:, 1].view(np.int64), mask=empty),
                "sig": pa.array([x.tobytes() for x in sig], pa.binary()),
            })

    signed = scratch.keep(docs.mapInArrow(frugal(sign), "doc_id long, text_key long, h long, g long, sig binary"))
    members = signed.select("doc_id", "text_key", "h", "g")
    classes = members.where("h is not null").groupBy("h", "g").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("copies"))
    classes = numbered(classes.select("h", "g", "copies", F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("rep_key")), scratch)
    # one text of each class goes on; the key holds doc_id, so that copies do not meet in one task
    first = classes.select("h", "g", "copies", "node", F.col("rep").alias("doc_id"), F.col("rep_key").alias("text_key"))
    heads = signed.join(first, ["doc_id", "text_key", "h", "g"]).dropDuplicates(["node"])
    heads = scratch.keep(heads.select("node", "copies", "doc_id", "text_key", "sig"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(fixed(batch.column(1), HASHES, "<u2"))
            yield pa.RecordBatch.from_pydict({
                "node": pa.array(np.repeat(np.asarray(batch.column(0)), BANDS)),
                "band": pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys))),
                "key": pa.array(keys.reshape(-1).view(np.int64)),
            })

    bands = heads.select("node", "sig").mapInArrow(frugal(cut), "node long, band int, key long")
    shared = scratch.keep(bands.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = join_keys(bands, shared, ["key"], "inner").select("*", blocks.alias("blocks"))
    rows = rows.select("*", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int").alias("own"))
    rows = rows.select("node", "band", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.select("node", "band", F.xxhash64("key", low, high).alias("task"), F.when(low == high, -1).otherwise(F.col("own")).alias("side"))
    rows = rows.join(heads.select("node", "copies", "sig"), "node")
    limits = least_matches(threshold, tolerance)

    def survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 2):
            sig = fixed(t.column("sig"), HASHES, "<u2")
            group, band, node, side = (np.asarray(t.column(c)) for c in ("task", "band", "node", "side"))
            alive = np.zeros(len(sig), bool)
            for a, b in candidate_pairs(sig, group, band, node, side, limits):
                alive[a] = True
                alive[b] = True
            yield from t.filter(pa.array(alive)).combine_chunks().to_batches()

    schema = "node long, band int, task long, side int, copies long, sig binary"
    rows = rows.select("node", "band", "task", "side", "copies", "sig")
    alive = scratch.keep(rows.repartition("task").sortWithinPartitions("task", "node").mapInArrow(frugal(survive), schema))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 2):
            cuts = runs(np.asarray(t.column("task")))
            start = 0
            while start < len(cuts) - 1:  # whole groups of a few megabytes
                end = start + 1
                while end < len(cuts) - 1 and cuts[end + 1] - cuts[start] <= 2 * BLOCK:
                    end += 1
                yield from exact(t.slice(cuts[start], cuts[end] - cuts[start]).combine_chunks())
                start = end

    def exact(t: pa.Table) -> Iterator[pa.RecordBatch]:
        sig = fixed(t.column("sig"), HASHES, "<u2")
        group, band, node, side, copies = (np.asarray(t.column(c)) for c in ("task", "band", "node", "side", "copies"))
        pairs = list(candidate_pairs(sig, group, band, node, side, limits))
        if not pairs:
            return
        a, b = np.concatenate([x for x, _ in pairs]), np.concatenate([x for _, x in pairs])
        sets: list[np.ndarray] = []
        text = t.column("text").combine_chunks()
        for part in text_chunks(iter([pa.RecordBatch.from_arrays([text], ["text"])]), "text", PASS_BYTES):
            hashes, bounds, _ = shingles(part.column(0))
            sets += [np.unique(hashes[x:y]) for x, y in zip(bounds, bounds[1:])]
        sizes = np.array([len(x) for x in sets])
        both = np.zeros(len(a), np.int64)
        order = np.argsort(group[a], kind="stable")
        a, b = a[order], b[order]
        cuts = runs(group[a])
        for x, y in zip(cuts, cuts[1:]):
            both[x:y] = shared_counts(sets, a[x:y], b[x:y])
        good = both / (sizes[a] + sizes[b] - both) >= threshold
        if good.any():
            yield pa.RecordBatch.from_pydict(links_of(node, copies, a[good], b[good]))

    wanted = scratch.keep(join_keys(heads.select("node", "doc_id", "text_key"), alive.select("node").distinct(), ["node"], "left_semi"))
    texts = join_keys(docs, wanted, ["doc_id", "text_key"], "inner").dropDuplicates(["node"]).select("node", "text")
    with_text = alive.join(texts, "node").select("node", "band", "task", "side", "copies", "sig", "text")
    found = scratch.keep(with_text.repartition("task").sortWithinPartitions("task", "node").mapInArrow(frugal(verify), PAIR_ROWS))
    out = finish(spark, members, classes, found, scratch)
    kept = F.col("head") & (F.col("doc_id") == F.col("rep")) & (F.col("text_key") == F.col("rep_key"))
    return out.select("doc_id", "n_links", "class_id", F.coalesce(kept, F.lit(True)).alias("kept"), "text_key")
