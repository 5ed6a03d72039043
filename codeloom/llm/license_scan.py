"""Operator 8: licence scan by a positional index of rare licence words.

One pass over the whole texts finds the places of all words that occur in a licence template, and the
base phrases.  Document frequencies of those words over the corpus give their IDF.  The index holds, for
each template, postings (word to template and position) of its ``RARE`` mandatory words of highest IDF.
Every place of an indexed word in a file gives a relative position (place in the file less position in the
template); the postings are intersected by it, so a candidate is a template and a relative position on
which all its indexed words agree.  A candidate's mandatory phrases are then verified word by word at
their places, and its aligned words counted by IDF.  A licence that stands in the file has all its
mandatory words there, so no candidate is missed, however many licences or licence words a file has.

Edge cases: null text is empty (no words, no labels, score 0, null places); texts of any length are
scanned whole; repeated rows and doc_ids are scanned one by one; of ties in IDF the earlier word of a
template is indexed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, own_batches, small_batches, text_chunks

# Fixed values of the contract: phrases and labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Templates: label, words of a notice, and phrases (one at least) that must stand at their places.  A label may have several.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", ("apache license version 2 0 january 2004",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license as published by the free software foundation", "version 2 of the license")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license as published by the free software foundation", "version 3 of the license")),
    ("lgpl-2.1", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ("gnu lesser general public license as published by the free software foundation", "version 2 1 of the license")),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license version 3",)),
    ("lgpl-3.0", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu lesser general public license as published by the free software foundation", "version 3 of the license")),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("gnu affero general public license version 3",)),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu affero general public license as published by the free software foundation", "version 3 of the license")),
    ("mit-notice", "released under the mit license", ("mit license",)),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software for any purpose with or without fee",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", ("mozilla public license version 2 0",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    ("epl-2.0", "made available under the terms of the eclipse public license v 2 0", ("eclipse public license v 2 0",)),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ("without any express or implied warranty in no event will the authors be held liable",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license version 1 0",)),
    ("wtfpl", "do what the fuck you want to public license", ("do what the fuck you want to public license",)),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ("waived all copyright and related or neighboring rights",)),
    ("artistic-2.0", "under the terms of the artistic license 2 0", ("artistic license 2 0",)),
)
#: Identifiers whose own lines (``SPDX-License-Identifier: ...``) and short names make templates by rule.
IDENTIFIERS = ("apache-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "mit", "isc", "mpl-2.0", "epl-2.0", "bsd-2-clause", "bsd-3-clause", "zlib", "unlicense", "bsl-1.0", "wtfpl", "cc0-1.0", "artistic-2.0")
CREATIVE_COMMONS = tuple(f"cc-by{kind}-{version}" for version in ("4.0", "3.0") for kind in ("", "-sa", "-nc", "-nd", "-nc-sa", "-nc-nd"))


def _words(identifier: str) -> str:
    return identifier.replace("-", " ").replace(".", " ")


TEMPLATES = (
    *NOTICES,
    *((name, f"spdx license identifier {_words(name)}", (f"spdx license identifier {_words(name)}",)) for name in (*IDENTIFIERS, *CREATIVE_COMMONS)),
    *((name, f"licensed under {_words(name)}", (_words(name),)) for name in CREATIVE_COMMONS),
)
#: Mandatory words of a template that are indexed.
RARE = 3
#: Share of a template's IDF that its aligned words must have.
LEAST_COVERAGE = 0.6
#: Digits of a score: sums of IDF in another order differ beyond them.
SCORE_DIGITS = 9

#: Rows of a task of the second pass, and tasks at most.
ROWS_A_TASK, MOST_TASKS = 10_000, 20_000

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


class Templates:
    """Words, indexed postings and mandatory places of the templates."""

    def __init__(self, templates=TEMPLATES) -> None:
        self.labels = [t[0] for t in templates]
        self.words = [t[1].split() for t in templates]
        self.vocabulary = sorted({w for words in self.words for w in words} | {w for p in BASE for w in p.split()})
        self.number = {w.encode(): k for k, w in enumerate(self.vocabulary)}
        self.lines = [[self.number[w.encode()] for w in words] for words in self.words]
        self.mandatory: list[list[int]] = []
        for words, (_, _, phrases) in zip(self.words, templates):
            places = []
            for phrase in (p.split() for p in phrases):
                at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
                places += range(at, at + len(phrase))
            self.mandatory.append(places)


class Postings:
    """Each template's rarest mandatory words: word to (template, position), and how many must agree."""

    def __init__(self, templates: Templates, idf: np.ndarray, rare: int = RARE) -> None:
        self.templates, self.idf = templates, idf
        self.of: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.needed: list[int] = []
        for t, line in enumerate(templates.lines):
            chosen = sorted(templates.mandatory[t], key=lambda q: (-idf[line[q]], q))[:rare]
            self.needed.append(len(chosen))
            for q in chosen:
                self.of[line[q]].append((t, q))
        self.indexed = np.zeros(len(templates.vocabulary), bool)
        self.indexed[list(self.of)] = True

    def candidates(self, places: list[int], words: list[int]) -> list[tuple[int, int]]:
        """(template, relative position) on which all indexed words of the template agree."""
        votes: Counter[tuple[int, int]] = Counter()
        for p, w in zip(places, words):
            for t, q in self.of.get(w, ()):
                votes[t, p - q] += 1
        return [at for at, n in votes.items() if n == self.needed[at[0]]]

    def match(self, places: list[int], words: list[int], least: float) -> tuple[set[str], float]:
        """Labels of the templates that the licence words at these places make, and the best coverage."""
        found, best, idf = set(), 0.0, self.idf
        at = dict(zip(places, words))
        for t, shift in self.candidates(places, words):
            line = self.templates.lines[t]
            hit = [at.get(shift + q) == w for q, w in enumerate(line)]
            if not all(hit[q] for q in self.templates.mandatory[t]):
                continue
            total = sum(idf[w] for w in line)
            share = sum(idf[w] for w, h in zip(line, hit) if h) / total if total > 0 else sum(hit) / len(hit)
            if share >= least:
                found.add(self.templates.labels[t])
                best = max(best, float(min(1.0, share)))
        return found, best


def scan(spark: SparkSession, docs: DataFrame, scratch: Scratch, templates=TEMPLATES, least: float = LEAST_COVERAGE) -> DataFrame:
    index = Templates(templates)
    base = [([w.encode() for w in p.split()], label) for p, label in BASE.items()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = index.number
        for part in text_chunks(batches, "text"):
            n_words, places, words, starts, labels = [], [], [], [], []
            for text in part.column(1).to_pylist():
                every = WORD.findall(text.encode().lower()) if text else []
                at = [i for i, w in enumerate(every) if w in number]
                n_words.append(len(every))
                places.append(at)
                words.append([number[every[i]] for i in at])
                hits = [(i, label) for i in at for phrase, label in base if every[i] == phrase[0] and every[i : i + len(phrase)] == phrase]
                starts.append([i for i, _ in hits])
                labels.append(sorted({x for _, x in hits}))
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column(0),
                "n_words": pa.array(n_words, pa.int64()),
                "places": pa.array(places, pa.list_(pa.int32())),
                "words": pa.array(words, pa.list_(pa.int32())),
                "starts": pa.array(starts, pa.list_(pa.int64())),
                "base_labels": pa.array(labels, pa.list_(pa.string())),
            })

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with own_batches(spark):
        small_batches(spark)  # whole texts; the second pass has few bytes a row
        hits = scratch.keep(docs.mapInArrow(find, "doc_id long, n_words long, places array<int>, words array<int>, starts array<long>, base_labels array<string>"))

    counted = hits.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    n_docs = hits.count()
    idf = np.full(len(index.vocabulary), np.log1p(n_docs))
    for r in counted:
        idf[r["w"]] = np.log((n_docs + 1) / (r["n"] + 0.5))
    idf = np.maximum(idf, 0.0)
    postings = Postings(index, idf)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = [",".join(x) for x in batch.column(5).to_pylist()], np.zeros(batch.num_rows)
            sizes = np.asarray(pc.list_value_length(batch.column(3))).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            # only files that have an indexed word are looked at one by one
            for k in np.unique(row[postings.indexed[np.asarray(batch.column(3).flatten())]]).tolist():
                found, scores[k] = postings.match(batch.column(2)[k].as_py(), batch.column(3)[k].as_py(), least)
                if found:
                    labels[k] = ",".join(sorted(found.union(batch.column(5)[k].as_py())))
            starts = batch.column(4)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "n_words": batch.column(1),
                "n_base": pc.list_value_length(starts).cast(pa.int64()),
                "first_word": pa.array([min(x, default=None) for x in starts.to_pylist()], pa.int64()),
                "last_word": pa.array([max(x, default=None) for x in starts.to_pylist()], pa.int64()),
                "base_labels": pa.array([",".join(x) for x in batch.column(5).to_pylist()], pa.string()),
                "labels": pa.array(labels, pa.string()),
                "score": pa.array(scores),
            })

    # few bytes a row, but work for each: dealt by rows
    hits = hits.repartition(max(1, min(MOST_TASKS, n_docs // ROWS_A_TASK)))
    return hits.mapInArrow(match, SCHEMA).withColumn("score", F.round("score", SCORE_DIGITS))
