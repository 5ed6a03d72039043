"""Operator 3: quality classifier by co-training of two views.

The text view sees hashed byte trigrams of the whole text (square roots of their shares); the metadata
view sees language, source, length and layout (lines, capitals, symbols, repeated words).  Each is a
logistic regression.  In every round each view names the unlabelled documents that it is surest of,
in the classes' proportion, and the other view learns from them as well.  Both are then calibrated on
labelled documents that were held out, and a document's score joins the calibrated log odds.
The driver holds the sample's features once, as half floats, and one matrix of the rows that a view learns from.

The fit uses a bounded sample, drawn by hash of the id over the whole table: ``LABELLED`` labelled documents
and a pool of ``POOL`` documents without a label, both parameters.  Every document is scored, on its whole
text, in one pass without a shuffle.

Edge cases: null text is empty; null language, source and n_chars are values of their own; documents
with contradictory labels, and labels other than 0 and 1, are not learnt from; of rows that share a doc_id
the one with the least text hash is; where either class has fewer than two labelled documents every
document scores 1 and stays; repeated rows score alike; an empty table gives no rows; other columns pass
through ``keep`` and are ignored by ``score``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import PASS_BYTES, flat_bytes, frugal, give_back, join_keys, text_chunks
from codeloom.llm.near_dup import word_hashes

#: Bounds of the sample that the classifiers are fitted on.
LABELLED, POOL = 4000, 4000
ROUNDS = 4
#: Share of the pool that a view names in a round, and how sure it must be.
SHARE, SURE = 0.08, 0.9
#: Only documents that are all but surely bad are rejected: those below this probability of good quality.
THRESHOLD = 0.02

GRAMS = 2048
LANGS, SOURCES = 16, 32
#: Rows whose counts are held at once.
ROWS = 256
LETTERS = np.zeros(256, np.uint8)
LETTERS[65:91] = 1
LETTERS[97:123] = 2
MARKS = np.zeros(256, bool)
MARKS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()"]] = True


def _slot(value: str | None, size: int) -> int:
    return 0 if value is None else 1 + zlib.crc32(value.encode()) % (size - 1)


def views(text: pa.Array, lang: list, source: list, n_chars: list) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the two views, for some hundreds of documents."""
    raw, starts = flat_bytes(text)
    n, sizes = len(lang), np.diff(starts)
    row = np.repeat(np.arange(n), sizes)
    b = raw.astype(np.uint32)
    code = np.zeros(len(raw), np.uint32)
    code[:-2] = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    slot = ((code * np.uint32(2654435761)) >> np.uint32(32 - GRAMS.bit_length() + 1)).astype(np.int64)
    inside = np.arange(len(raw)) < np.repeat(starts[1:], sizes) - 3  # a trigram ends within its text
    grams = np.bincount(row[inside] * GRAMS + slot[inside], minlength=n * GRAMS).reshape(n, GRAMS)
    grams = np.sqrt(grams / np.maximum(grams.sum(1, keepdims=True), 1)).astype(np.float32)

    words, bounds = word_hashes(text)
    count = np.diff(bounds)
    again = np.zeros(len(words))
    if len(words):
        again[1:] = words[1:] == words[:-1]
        again[bounds[:-1][count > 0]] = 0

    def total(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0.0], np.cumsum(flags)])[at])

    length = np.maximum(sizes - 1, 1)
    lines = total(raw == 10, starts)
    upper, lower = total(LETTERS[raw] == 1, starts), total(LETTERS[raw] == 2, starts)
    plain = [
        np.log1p(np.array([len_ if c is None else max(c, 0) for c, len_ in zip(n_chars, (sizes - 1).tolist())], float)) / 10,
        np.log1p(lines) / 5,
        np.log1p(count / lines) / 5,
        upper / np.maximum(upper + lower, 1),
        np.sqrt(total(MARKS[raw], starts) / length),
        np.sqrt(total((raw >= 48) & (raw < 58), starts) / length),
        length / np.maximum(count, 1) / 20,
        np.sqrt(total(again, bounds) / np.maximum(count, 1)),
        np.log1p(count) / 10,
        (count < 50).astype(float),
    ]
    meta = np.zeros((n, LANGS + SOURCES + len(plain)), np.float32)
    meta[np.arange(n), [_slot(x, LANGS) for x in lang]] = 0.3
    meta[np.arange(n), [LANGS + _slot(x, SOURCES) for x in source]] = 0.3
    meta[:, LANGS + SOURCES :] = np.minimum(np.stack(plain, 1), 4)
    return grams, meta


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150, rate: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression (last weight: bias) by Adam over all rows; classes weigh alike."""
    w = np.zeros(x.shape[1] + 1, np.float32)
    balance = weight * np.where(y > 0, 0.5 / max((weight * (y > 0)).sum(), 1e-9), 0.5 / max((weight * (y == 0)).sum(), 1e-9))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        error = ((_sigmoid(x @ w[:-1] + w[-1]) - y) * balance).astype(np.float32)
        g = np.append(error @ x, error.sum()) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w.astype(np.float32)


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (x.astype(np.float32, copy=False) @ w[:-1] + w[-1]).astype(np.float64)


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and offset of the log odds given the logit, by Newton's method with smoothed targets."""
    good, bad = float((y > 0).sum()), float((y == 0).sum())
    scale = float(np.std(z)) or 1.0
    z = z / scale
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, float(np.log((good + 1) / (bad + 1)))
    for _ in range(50):
        p = _sigmoid(a * z + b)
        g = np.array([((p - target) * z).sum() + 0.01 * a, (p - target).sum()])
        h = p * (1 - p) + 1e-9
        hess = np.array([[(h * z * z).sum() + 0.01, (h * z).sum()], [(h * z).sum(), h.sum()]])
        step = np.linalg.solve(hess + 1e-9 * np.eye(2), g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.0) / scale, b


class Model:
    """Two views' weights, their calibration and the prior log odds; ``None`` weights: everything passes."""

    def __init__(self, text: np.ndarray | None = None, meta: np.ndarray | None = None, cal: tuple = ((1.0, 0.0), (1.0, 0.0)), prior: float = 0.0) -> None:
        self.text, self.meta, self.cal, self.prior = text, meta, cal, prior

    def score(self, grams: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            one = np.ones(len(grams))
            return one, one, one
        a, b = (c[0] * logits(x, w) + c[1] for x, w, c in ((grams, self.text, self.cal[0]), (meta, self.meta, self.cal[1])))
        return _sigmoid(a), _sigmoid(b), _sigmoid(a + b - self.prior)


def co_train(grams: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_grams: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS) -> Model:
    """y: 0 or 1 for each labelled row.  Every fourth labelled row is held out for calibration.

    Features may be half floats: they become floats as they are learnt from, a view at a time.
    """
    if (y > 0).sum() < 2 or (y == 0).sum() < 2:
        return Model()
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[1::4]] = True
    learnt = np.flatnonzero(~held)
    own, pools = (grams, meta), (pool_grams, pool_meta)
    labels = y[~held].astype(float)
    free = np.ones(len(pool_grams), bool)
    given: list[dict[int, float]] = [{}, {}]  # pseudo-labels that each view has been given by the other
    weights: list[np.ndarray] = []
    for r in range(rounds + 1):
        weights = []
        for view in (0, 1):
            extra = np.array(list(given[view]), np.int64)
            x = np.empty((len(learnt) + len(extra), own[view].shape[1]), np.float32)
            x[: len(learnt)] = own[view][learnt]
            x[len(learnt) :] = pools[view][extra]
            t = np.concatenate([labels, np.array(list(given[view].values()))]) if len(extra) else labels
            w = np.concatenate([np.ones(len(labels)), np.full(len(extra), 0.5)])
            weights.append(fit(x, t, w))
            del x  # before the next one is made
        if r == rounds or not free.any():
            break
        share = labels.mean()
        named = []
        for view in (0, 1):
            p = _sigmoid(logits(pools[view], weights[view]))
            order = np.argsort(p, kind="stable")
            order = order[free[order]]
            n = max(2, int(SHARE * len(p)))
            low = [k for k in order[: max(1, round(n * (1 - share)))] if p[k] < 1 - SURE]
            high = [k for k in order[::-1][: max(1, round(n * share))] if p[k] > SURE]
            named.append([(int(k), 0.0) for k in low] + [(int(k), 1.0) for k in high])
        for view in (0, 1):
            given[1 - view].update(named[view])
            free[[k for k, _ in named[view]]] = False
    cal = tuple(calibrate(logits(x[held], w), y[held]) for x, w in zip((grams, meta), weights))
    prior = float(np.log(((y > 0).sum() + 1) / ((y == 0).sum() + 1)))
    return Model(weights[0], weights[1], cal, prior)


def _matrix(column: pa.ChunkedArray, dtype: type, place: np.ndarray) -> np.ndarray:
    """Byte strings of one length as rows, the i-th at ``place[i]``; copied once, straight from Arrow's memory."""
    out, at = np.empty((0, 0), dtype), 0
    for chunk in column.cast(pa.large_binary()).chunks:
        if len(chunk):
            ends = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
            rows = np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(dtype).reshape(len(chunk), -1)
            if not at:
                out = np.empty((len(column), rows.shape[1]), dtype)
            out[place[at : at + len(chunk)]] = rows
            at += len(chunk)
    return out


def _column(batch: pa.RecordBatch, name: str) -> list:
    at = batch.schema.get_field_index(name)
    return batch.column(at).to_pylist() if at >= 0 else [None] * batch.num_rows


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part in text_chunks(batches, "text", PASS_BYTES):
        for at in range(0, part.num_rows, ROWS):
            some = part.slice(at, ROWS)
            text = some.column(some.schema.get_field_index("text"))
            chars = [None if x is None else float(x) for x in _column(some, "n_chars")]
            yield some, *views(text, _column(some, "lang"), _column(some, "source"), chars)


def _inputs(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "double"}
    return docs.select(*[(F.col(c).cast(k) if c in have else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Model:
    """Fits both views on the bounded sample; features are made on executors."""
    rows = _inputs(docs)
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    drawn = known.where("low = high").select("doc_id", F.col("low").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).collect()
    y_of = {r["doc_id"]: r["y"] for r in drawn}
    if len(set(y_of.values())) < 2:
        return Model()
    free = join_keys(rows.select("doc_id").where("doc_id is not null"), known.select("doc_id"), ["doc_id"], "left_anti").distinct()
    others = free.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(pool).collect()
    ids = sorted({*y_of, *(r["doc_id"] for r in others)})
    # at most ``labelled`` + ``pool`` ids, a bound that doesn't grow with the data, and one row for each
    sample = F.broadcast(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    names = [c for c in rows.columns if c != "doc_id"]
    one = rows.join(sample, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("at"), *names)).alias("r"))
    one = one.select("doc_id", *[F.col(f"r.{c}").alias(c) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, grams, meta in _parts(batches):
            yield pa.RecordBatch.from_pydict({
                "doc_id": some.column(0),
                "grams": pa.array([x.tobytes() for x in grams.astype(np.float16)], pa.binary()),
                "meta": pa.array([x.tobytes() for x in meta.astype(np.float32)], pa.binary()),
            })

    got = one.mapInArrow(frugal(run), "doc_id long, grams binary, meta binary").toArrow()
    if not got.num_rows:
        return Model()
    at = np.array(got.column("doc_id").to_pylist(), np.int64)
    y = np.array([y_of.get(i, -1) for i in at.tolist()])
    order = np.lexsort((at, y < 0))  # labelled rows, then the pool, each by doc_id
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    grams, meta = _matrix(got.column("grams"), np.float16, place), _matrix(got.column("meta"), np.float32, place)
    del got
    give_back()
    n = int((y >= 0).sum())
    model = co_train(grams[:n], meta[:n], y[order[:n]], grams[n:], meta[n:])
    del grams, meta
    give_back()
    return model


def score(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, each view's calibrated probability, the joint ``score`` and ``kept``, for every document."""
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, grams, meta in _parts(batches):
            a, b, both = sent.value.score(grams, meta)
            yield pa.RecordBatch.from_pydict({"doc_id": some.column(0), "text_score": pa.array(a), "meta_score": pa.array(b), "score": pa.array(both), "kept": pa.array(both >= threshold)})

    return _inputs(docs).mapInArrow(frugal(run), "doc_id long, text_score double, meta_score double, score double, kept boolean")


def keep(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that reach the threshold, with all their columns."""
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, grams, meta in _parts(batches):
            yield some.filter(pa.array(sent.value.score(grams, meta)[2] >= threshold))

    return docs.mapInArrow(frugal(run), docs.schema)
