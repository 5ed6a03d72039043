"""Operator 7: substring dedup by sliding sentence spans.

A text is cut into sentences after each word that ends in ``.``, ``!`` or ``?``.  Longer ones are cut
again: of every ``LONG`` words in a row, the last of those with the least hash ends a piece (a word that
ends a sentence counts as least), so no piece has more than ``LONG`` words.  From every sentence on, the
shortest run of at least ``SENTENCES`` sentences and ``WORDS`` words is hashed to 96 bits.  The hashes
are joined over the corpus; of equal runs the first, by doc_id and then by place, stays, and sentences
that lie in any other one are removed.

Words alone decide where cuts are, not what surrounds a passage, nor its line breaks: the first ``LONG``
words of a passage hold a cut, the next ones up to the end of the run are the same in every copy, and
the run is at most ``WORDS`` + ``LONG`` - 1 words long.  So each 2 ``LONG`` + ``WORDS`` - 1 = 48 words
that two texts share hold a whole run, whatever they are.  Two pieces are fewer than ``WORDS`` words.

The counts of a hash are summed before the shuffle, and hot hashes meet their documents in a join whose
hot partitions AQE splits; no group is gathered in one task.  A document's runs are gathered as a set, so
rows with the same id and text, however many, gather what one of them has.

Documents are ordered by doc_id (null first), those that share one by a hash of id and text.  Of rows that
are equal in both, one stands first; all runs of the others are repeats.

Edge cases: null text stays null (no sentences); a text without a word is one sentence, an empty one none;
runs shorter than the least never count, so short texts stay; an empty table gives no rows; other columns
pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, frugal, join_keys, text_chunks

SENTENCES = 3
WORDS = 25
LONG = 12

WORD_ENDS = re.compile(r"\S+\s*")


def last_words(words: list[str]) -> np.ndarray:
    """Places of the words that end a sentence or a piece of one."""
    n = len(words)
    rank = np.fromiter((0 if w[-1] in ".!?" else zlib.crc32(w.encode()) + 1 for w in words), np.uint64, n)
    ends = rank == 0
    if n >= LONG:
        low = np.uint64((1 << 31) - 1)
        least = rank << np.uint64(31) | low - np.arange(n, dtype=np.uint64)  # of equal ranks the last is least
        width = 1
        while width < LONG:
            step = min(width, LONG - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        ends[(low - (least & low)).astype(np.int64)] = True
    ends[-1:] = True
    return np.flatnonzero(ends)


def sentences_of(text: str) -> list[str]:
    """Pieces that make up the text; each has a word, unless the whole text has none."""
    words = text.split()
    if not words:
        return [text] if text else []
    ends = [m.end() for m in WORD_ENDS.finditer(text)]
    at = [0, *(ends[k] for k in last_words(words).tolist())]
    return [text[x:y] for x, y in zip(at, at[1:])]


def spans_of(text: str, sentences: int = SENTENCES, words: int = WORDS) -> tuple[list[tuple[bytes, int, int]], int]:
    """(digest, first sentence, sentences) of the shortest sufficient run from each sentence on, and the text's sentences."""
    every = text.split()
    if not every:
        return [], int(bool(text))
    at = [0, *(last_words(every) + 1).tolist()]
    norm = [" ".join(every[x:y]) for x, y in zip(at, at[1:])]
    sizes = [y - x for x, y in zip(at, at[1:])]
    out, end, total = [], 0, 0
    for i in range(len(norm)):
        while end < len(norm) and (end - i < sentences or total < words):
            total += sizes[end]
            end += 1
        if end - i < sentences or total < words:
            break
        out.append((xxhash.xxh3_128_digest("\n".join(norm[i:end]).encode()), i, end - i))
        total -= sizes[i]
    return out, len(norm)


def without(text: str, first: np.ndarray, count: np.ndarray) -> tuple[str, int]:
    """The text without these runs, and how many sentences went."""
    pieces = sentences_of(text)
    gone = np.zeros(len(pieces) + 1, np.int64)
    np.add.at(gone, first, 1)
    np.add.at(gone, first + count, -1)
    gone = np.cumsum(gone)[:-1] > 0
    return "".join(p for p, g in zip(pieces, gone) if not g), int(gone.sum())


#: Stands for a null doc_id, before all others; the hash tells it from the number itself.
NO_ID = -(1 << 63)


def dedup(spark: SparkSession, docs: DataFrame, scratch: Scratch, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` with a struct ``dedup`` (text, n_sentences, n_removed) beside them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text"):
            digests, first, count, rows, again = [], [], [], [], []
            totals = []
            for row, text in enumerate(part.column(2).to_pylist()):
                seen: set[bytes] = set()
                spans, total = spans_of(text, sentences, words) if text else ((), 0)
                totals.append(total)
                for digest, i, n in spans:
                    again.append(digest in seen)
                    seen.add(digest)
                    digests.append(digest)
                    first.append(i)
                    count.append(n)
                    rows.append(row)
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            # the runs, and then a row without a hash for each text: its number of sentences
            n, none = len(rows), len(totals)
            take = pa.array([*rows, *range(none)], pa.int64())
            own = np.arange(n + none) >= n
            yield pa.RecordBatch.from_pydict({
                "h": pa.array(np.append(both[:, 0], np.zeros(none, np.int64)), mask=own),
                "g": pa.array(np.append(both[:, 1] & 0x7FFFFFFF, np.zeros(none, np.int64)).astype(np.int32), mask=own),
                "name": part.column(0).take(take),
                "key": part.column(1).take(take),
                "first": pa.array([*first, *[-1] * none], pa.int32()),
                "count": pa.array([*count, *totals], pa.int32()),
                "again": pa.array([*again, *[False] * none], pa.bool_()),
            })

    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    name, key = F.coalesce(doc_id, F.lit(NO_ID)).alias("name"), F.xxhash64(doc_id, text).alias("key")
    row = ["name", "key"]
    spans = scratch.keep(docs.select(name, key, text.alias("text")).mapInArrow(frugal(find), "h long, g int, name long, key long, first int, count int, again boolean"))

    # the least doc_id keeps its first occurrence
    repeated = spans.where("h is not null").groupBy("h", "g").agg(F.count("*").alias("n"), F.min("name").alias("lead"))
    repeated = scratch.keep(repeated.where("n > 1").select("h", "g", "lead"))
    hits = spans.join(repeated, ["h", "g"])
    totals = spans.where("first < 0").select("name", "key", "first", "count")
    texts = scratch.keep(totals.groupBy(*row).agg(F.count("*").alias("n")).where("n > 1").select(*row))
    shared = scratch.keep(totals.groupBy("name").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("name"))
    later = F.col("again") | (F.col("name") != F.col("lead"))
    if shared.head(1):  # several texts have one id: of those, the least hash leads
        firsts = join_keys(hits.where("name = lead"), shared, ["name"], "left_semi").groupBy("h", "g").agg(F.min("key").alias("lead_key"))
        hits = hits.join(firsts, ["h", "g"], "left")
        later = later | F.coalesce(F.col("key") != F.col("lead_key"), F.lit(False))
    marks = hits.where(later).select("name", "key", "first", "count").unionByName(totals).groupBy(*row)
    run = F.when(F.col("first") >= 0, F.struct("first", "count"))
    marks = marks.agg(F.max(F.when(F.col("first") < 0, F.col("count"))).alias("n_sentences"), F.collect_set(run).alias("m"))
    marks = marks.select(*row, "n_sentences", F.col("m.first").alias("first"), F.col("m.count").alias("count"))

    @F.pandas_udf("text string, n_removed long")
    def cut(text: pd.Series, first: pd.Series, count: pd.Series, twin: pd.Series) -> pd.DataFrame:
        got = []
        for t, f, c, again in zip(text, first, count, twin):
            if again and t:
                runs = spans_of(t, sentences, words)[0]
                f, c = [i for _, i, _ in runs], [n for _, _, n in runs]
            hit = t is not None and f is not None and len(f)
            got.append(without(t, np.asarray(f, np.int64), np.asarray(c, np.int64)) if hit else (t, 0))
        return pd.DataFrame(got, columns=["text", "n_removed"])

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name, key)
    if texts.head(1):  # of rows equal in id and text, all but one are repeats as a whole
        equal = scratch.keep(join_keys(whole, texts, row, "left_semi").withColumn("place", F.monotonically_increasing_id()))
        firsts = scratch.keep(equal.groupBy(*row).agg(F.min("place").alias("lead")))
        equal = join_keys(equal, firsts, row, "inner").select("row", "name", "key", (F.col("place") != F.col("lead")).alias("twin"))
        whole = join_keys(whole, texts, row, "left_anti").withColumn("twin", F.lit(False)).unionByName(equal)
    else:
        whole = whole.withColumn("twin", F.lit(False))
    joined = whole.join(marks, row, "left").withColumn("hit", F.col("twin") | (F.size("first") > 0))
    text = F.when(F.col("hit"), F.col("row.text").cast("string"))
    done = joined.select("row", "hit", "n_sentences", cut(text, "first", "count", "twin").alias("cut"))
    new = F.when(F.col("hit"), F.col("cut.text")).otherwise(F.col("row.text").cast("string"))
    return done.select("row", F.struct(new.alias("text"), F.col("n_sentences").cast("long").alias("n_sentences"), F.col("cut.n_removed").alias("n_removed")).alias("dedup"))
