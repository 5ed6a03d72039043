"""Operator 6: quality rules by a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words are runs of anything but white space.  Word unigrams and bigrams are hashed into a fixed number
of buckets.  The raw multinomial comes from all documents, the trusted one from the documents whose
ids are given, drawn towards the raw one by pseudo-counts in proportion (``prior``) to the trusted n-grams.
Documents fall into ``folds`` by a hash of their id, and a document is scored by trusted counts without
those of its own fold: so a trusted document is judged as any other, by n-grams that it has not brought in.

A document's score is the mean of log(trusted / raw) over its n-grams.  The threshold is the score that all
but a share ``reject`` of the trusted documents that hold the base rules reach (to a thousandth, from a
count of all of them).  A document passes where its score reaches the threshold and the base rules hold.

Base counts: characters in words, characters of ``#*$%&|<>``, lines with a word that equal an earlier
line, and words that lie in a three-word window found at least twice in the text.

Edge cases: null text has no words and fails; a document whose n-grams cannot be scored has score 0;
repeated rows are judged one by one (and all count as corpus); a null doc_id is trusted by nobody; an empty
table gives no rows; without trusted documents all scores are 0 and the base rules decide alone; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import SPACE_CLASS, SPACES, Scratch, join_keys

BUCKETS = 1 << 16
FOLDS = 2
#: Pseudo-counts that draw the trusted multinomial towards the raw one, for each trusted n-gram.
PRIOR = 0.5
#: Share of the trusted documents (held out, base rules held) that may fall below the threshold.
REJECT = 0.01
#: Steps of the score in which the threshold is set.
STEP = 0.001

# Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # in a hundred words


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, f"{SPACE_CLASS}+")).otherwise(F.array().cast("array<string>"))


def _pairs(hashes: Column) -> Column:
    """Hashes of neighbouring elements."""
    n = F.greatest(F.size(hashes) - 1, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def _in_order(windows: Column) -> Column:
    """Hashes and places of the windows, sorted, so that equal windows are neighbours."""
    return F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _covered(order: Column) -> Column:
    """Words in windows of three that occur at least twice."""
    n = F.size(order) - 1
    twins = F.zip_with(F.slice(order, F.lit(1), n), F.slice(order, F.lit(2), n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    at = F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull())))
    return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))


def _occurrences(text: Column, characters: str) -> Column:
    """How often characters of one byte occur: by bytes that replacing takes away, which is a plain scan."""
    out = F.lit(0)
    for c in characters:
        out = out + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return out


def base_counts(docs: DataFrame) -> DataFrame:
    """The base counts, with hashes of the words (``h1``) and of their pairs (``h2``) for the ratio."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    out = out.select("doc_id", "text", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h1"))
    # each of these columns is used at least twice, so that none is computed again inside another
    out = out.select("*", _pairs(F.col("h1")).alias("h2"))
    out = out.select("*", _pairs(F.col("h2")).alias("h3"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    order = F.when(F.size(F.array_distinct("h3")) < F.size("h3"), _in_order(F.col("h3")))
    out = out.select("doc_id", "text", "h1", "h2", lines.alias("lines"), order.alias("order"))
    return out.select(
        "doc_id",
        F.size("h1").cast("long").alias("n_words"),
        (F.length("text") - _occurrences(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        _occurrences(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("order").isNotNull(), _covered(F.col("order"))).otherwise(0).cast("long").alias("n_repeat_words"),
        "h1",
        "h2",
    )


def _grams(buckets: int) -> Column:
    return F.transform(F.concat("h1", "h2"), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def _fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("fold")), F.lit(folds)).cast("int")


def _looked_up(table: Column) -> Column:
    return F.aggregate("grams", F.lit(0.0), lambda acc, b: acc + F.get(table, b))


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int, folds: int, prior: float) -> list[float]:
    """log(trusted / raw) of each bucket, for one fold after the other, from one pass over all documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    flagged = trusted.withColumn("good", F.lit(True))
    rows = join_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")), flagged, ["doc_id"], "left")
    rows = rows.select(F.when(F.col("good"), _fold(F.col("doc_id"), folds)).alias("fold"), F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h1"))
    rows = rows.select("fold", "h1", _pairs(F.col("h1")).alias("h2")).select("fold", F.explode(_grams(buckets)).alias("b"))
    own = [F.count(F.when(F.col("fold") == f, 1)).alias(f"g{f}") for f in range(folds)]
    raw, good = [0] * buckets, [[0] * buckets for _ in range(folds)]
    for r in rows.groupBy("b").agg(F.count("*").alias("raw"), *own).collect():  # no more rows than buckets
        raw[r["b"]] = r["raw"]
        for f in range(folds):
            good[f][r["b"]] = r[f"g{f}"]
    n_raw, out = sum(raw), []
    for f in range(folds):
        kept = [sum(good[k][b] for k in range(folds) if k != f or folds == 1) for b in range(buckets)]
        n_kept = sum(kept)
        if not n_kept:
            out += [0.0] * buckets
            continue
        extra = prior * n_kept
        for a, b in zip(raw, kept):
            p = (a + 1) / (n_raw + buckets)
            out.append(math.log((b + extra * p) / (n_kept + extra) / p))
    return out


def threshold_of(scored: DataFrame, trusted: DataFrame, reject: float) -> float | None:
    """The score that all but a share of the trusted documents reach; counted in steps, so a bounded table is collected."""
    own = join_keys(scored.where("not base_failed").select("doc_id", "score"), trusted, ["doc_id"], "left_semi")
    steps = own.groupBy(F.floor(F.col("score") / STEP).cast("long").alias("s")).agg(F.count("*").alias("n")).collect()
    below, every = 0, sum(r["n"] for r in steps)
    for r in sorted(steps):
        below += r["n"]
        if below > reject * every:
            return r["s"] * STEP
    return None


def judge(spark: SparkSession, docs: DataFrame, trusted: DataFrame, scratch: Scratch, buckets: int = BUCKETS, folds: int = FOLDS, prior: float = PRIOR, reject: float = REJECT) -> DataFrame:
    """A row for each document: base counts, base verdict, score, verdict and the threshold that it was judged by."""
    trusted = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    ratios = log_ratios(docs, trusted, buckets, folds, prior)
    rows = base_counts(docs).withColumn("grams", _grams(buckets))
    total = F.lit(0.0)
    for f in range(folds):
        # a constant array: the optimiser folds it, and rows do not carry it; the fold is not asked for each n-gram
        table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios[f * buckets : (f + 1) * buckets])), ",").cast("array<double>")
        total = F.when(_fold(F.col("doc_id"), folds) == f, _looked_up(table)).otherwise(total)
    failed = (F.col("n_words") < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED) * F.col("n_words"))
    rows = rows.select("*", failed.alias("base_failed"), F.when(F.size("grams") > 0, F.round(total / F.size("grams"), 9)).otherwise(F.lit(0.0)).alias("score"))
    rows = scratch.keep(rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score"))
    threshold = F.lit(threshold_of(rows, trusted, reject)).cast("double")
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(True))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score", threshold.alias("threshold"))
