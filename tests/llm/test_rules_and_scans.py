from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import license_scan, ngram_rules, oracles, url_filter
from codeloom.llm.common import BATCH_ROWS, TEXT_ROWS, Scratch

SPACE = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_of(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def texts(seed=4):
    rng = random.Random(seed)
    good = [f"g{i}" for i in range(50)]
    bad = [f"b{i}" for i in range(50)]
    out = []
    for k in range(60):
        some = good if k % 3 else bad
        out.append(" ".join(rng.choice(some) for _ in range(rng.choice([3, 49, 50, 51, 120]))) + ("\nx\n y\nx\n\n \nx" if k % 5 == 0 else ""))
    return [*out, None, "", " \n\t ", "a b", "a b c a b c a b c", "é\x0bñ | 日本 #<>", "rep rep " * 20000, "\x1f x \xa0y"]


def grams_of(text):
    words = WORD.findall(text or "")
    return words + list(zip(words, words[1:]))


def test_ngram_rules(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(3, texts()[3], "x"), (None, "null id " * 60, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string").repartition(3)
    ids = {i for i in range(60) if i % 3}
    trusted = spark.createDataFrame([(i,) for i in ids] + [(None,), (1,)], "doc_id long")
    scratch = Scratch(spark, "test")
    got = ngram_rules.judge(spark, docs, trusted, scratch, reject=0.1).collect()
    assert len(got) == len(rows)
    want = Counter((i, *base_of(t)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    # the score, exactly, from the buckets of the words and pairs
    grams = {g for _, t, _ in rows for g in grams_of(t)}
    pairs = [(g, g) if isinstance(g, str) else g for g in grams]
    hashed = spark.createDataFrame(pairs, "a string, b string").selectExpr("a", "b", f"pmod(xxhash64(a), {ngram_rules.BUCKETS}) one", f"pmod(xxhash64(xxhash64(a), xxhash64(b)), {ngram_rules.BUCKETS}) two").collect()
    bucket = {r.a: r.one for r in hashed} | {(r.a, r.b): r.two for r in hashed}
    fold = {r.doc_id: r.f for r in docs.selectExpr("doc_id", f"pmod(xxhash64(doc_id, 'fold'), {ngram_rules.FOLDS}) f").collect()}
    assert set(fold.values()) == set(range(ngram_rules.FOLDS))
    every = [bucket[g] for _, t, _ in rows for g in grams_of(t)]
    raw, size, by = Counter(every), ngram_rules.BUCKETS, {r.doc_id: r.score for r in got}
    for f in range(ngram_rules.FOLDS):
        good = Counter(bucket[g] for i, t, _ in rows if i in ids and fold[i] != f for g in grams_of(t))
        n_good, extra = sum(good.values()), ngram_rules.PRIOR * sum(good.values())
        ratio = {g: math.log((good[g] + extra * (p := (c + 1) / (len(every) + size))) / (n_good + extra) / p) for g, c in raw.items()}
        for i, t, _ in rows:
            if fold[i] == f and grams_of(t):
                assert abs(by[i] - sum(ratio[bucket[g]] for g in grams_of(t)) / len(grams_of(t))) < 1e-6
    # the threshold: the trusted rows below it are within the share, and one step more would be too many
    own = sorted(r.score for r in got if r.doc_id in ids and not r.base_failed)
    threshold = got[0].threshold
    assert sum(x < threshold for x in own) <= 0.1 * len(own) < sum(x < threshold + ngram_rules.STEP for x in own)
    assert all(r.threshold == threshold and r.kept == (not r.base_failed and r.score >= threshold) for r in got)
    assert by[1] > by[0]
    scratch.drop()


def test_held_out_documents_are_judged_like_trusted_ones(spark):
    rng = random.Random(7)
    good = [f"g{i}" for i in range(400)]
    bad = [f"b{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(bad if i % 5 == 0 else good) for _ in range(80))) for i in range(600)]
    trusted = spark.createDataFrame([(i,) for i in range(0, 600, 3) if i % 5], "doc_id long")
    scratch = Scratch(spark, "test")
    kept = {r.doc_id: r.kept for r in ngram_rules.judge(spark, spark.createDataFrame(rows, "doc_id long, text string"), trusted, scratch).collect()}
    share = lambda ids: sum(kept[i] for i in ids) / len(ids)
    inside = [i for i in range(600) if i % 5 and i % 3 == 0]
    outside = [i for i in range(600) if i % 5 and i % 3]
    assert share(inside) > 0.95 and share(outside) > 0.95 and share(range(0, 600, 5)) == 0
    scratch.drop()


def test_ngram_rules_without_trusted_or_rows(spark):
    scratch = Scratch(spark, "test")
    docs = spark.createDataFrame([(1, "w " * 20 + " ".join(f"x{i}" for i in range(40)))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert [(r.score, r.kept, r.threshold) for r in ngram_rules.judge(spark, docs, none, scratch).collect()] == [(0.0, True, None)]
    assert ngram_rules.judge(spark, docs.limit(0), none, scratch).count() == 0
    assert ngram_rules.judge(spark, docs.limit(0), spark.createDataFrame([(1,)], "doc_id long"), scratch).count() == 0
    scratch.drop()


def by_sql(docs):
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([r.asDict() for r in docs.select("doc_id", "text").collect()], pa.schema([("doc_id", pa.int64()), ("text", pa.string())])))
    return con.sql(oracles.OP8)


def same_as_sql(got, docs):
    """The operator's rows are those of the SQL, which has no index and tries every template at every place."""
    want = by_sql(docs)
    assert Counter(tuple(r[c] for c in want.columns) for r in got) == Counter(want.fetchall())


def test_license_scan(spark):
    rows = [
        (1, "Some text.\nLicensed under the Apache License, Version 2.0. More"),
        (2, "is licensed under the GNU General Public License, version 3."),
        (3, "Licensed under CC BY-NC 4.0."),
        (4, "the MIT License; the mit-license; submit license"),
        (5, "gnu general public gnu general public license"),
        (6, None),
        (7, ""),
        (8, "cc by cc by 4.0 Éa"),
        (9, "word " * 20000 + "GNU General Public License version 2"),
        (1, "repeated row"),
        (10, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
        (11, "apache xlicense apache licensé"),
    ]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, labels string").repartition(3)
    scratch = Scratch(spark, "test")
    got = license_scan.scan(spark, docs, scratch).collect()
    assert len(got) == len(rows)
    same_as_sql(got, docs)

    def base(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        hits = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in hits]
        return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))

    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((i, *base(t)) for i, t in rows)
    by = {r.doc_id: r for r in got if r.n_words != 2}
    assert by[1].labels == "apache,apache-2.0" and by[2].labels == "gpl,gpl-3.0" and by[3].labels == "cc-by,cc-by-nc-4.0"
    assert by[1].score > 0 and by[5].score == 0
    assert by[10].labels == "mit-grant" and by[4].labels.startswith("mit") and by[9].labels == "gpl,gpl-2.0"
    assert by[6].labels == "" and by[6].score == 0 and all(0 <= r.score <= 1 for r in got)
    assert license_scan.scan(spark, docs.limit(0), scratch).count() == 0
    scratch.drop()


def test_license_scan_takes_few_texts_at_once(spark, monkeypatch):
    def chunks(batches, text):
        for batch in batches:
            assert batch.num_rows <= TEXT_ROWS
            yield batch

    monkeypatch.setattr(license_scan, "text_chunks", chunks)
    before = spark.conf.get(BATCH_ROWS)
    scratch = Scratch(spark, "test")
    docs = spark.range(0, 3 * TEXT_ROWS + 1, 1, 1).selectExpr("id AS doc_id", "'the mit license' AS text")
    assert license_scan.scan(spark, docs, scratch).where("labels = 'mit'").count() == 3 * TEXT_ROWS + 1
    assert spark.conf.get(BATCH_ROWS) == before
    scratch.drop()


def test_license_scan_of_several_notices(spark):
    line = {label: words for label, words, _ in license_scan.TEMPLATES}
    mixes = [("mit-notice", "mit-grant"), ("mit-grant", "mit-notice"), ("mit-grant", "mpl-2.0"), ("mpl-2.0", "mit-grant"), ("apache-2.0", "bsd-3-clause"), ("bsd-3-clause", "apache-2.0"), tuple(line)]
    vocabulary = " ".join(license_scan.Templates().vocabulary)
    rows = [(i, " . xx ".join(line[label] for label in mix)) for i, mix in enumerate(mixes)]
    rows += [(100 + i, f"{vocabulary} xx {words} xx") for i, (_, words, _) in enumerate(license_scan.TEMPLATES)]
    rows += [(1000 + i, "the use of any software is free and in the public version 2 3 4 0") for i in range(40)]
    scratch = Scratch(spark, "test")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scanned = license_scan.scan(spark, docs, scratch).collect()
    same_as_sql(scanned, docs)
    got = {r.doc_id: set(r.labels.split(",")) for r in scanned}
    base = set(license_scan.BASE.values()) - set(line)
    assert all(set(mix) <= got[i] and (got[i] - base - {"mit"}) <= set(mix) for i, mix in enumerate(mixes))
    assert all(label in got[100 + i] for i, (label, _, _) in enumerate(license_scan.TEMPLATES))
    assert all(got[1000 + i] == {""} for i in range(40))
    scratch.drop()


def plain_labels(text, idf):
    """Every template tried at every place."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    found = set()
    for label, line, phrases in license_scan.TEMPLATES:
        line = line.split()
        must = set()
        for p in (x.split() for x in phrases):
            at = next(i for i in range(len(line)) if line[i : i + len(p)] == p)
            must |= set(range(at, at + len(p)))
        for shift in range(-len(line), len(words)):
            hit = [0 <= shift + q < len(words) and words[shift + q] == w for q, w in enumerate(line)]
            if all(hit[q] for q in must) and sum(idf[w] for w, h in zip(line, hit) if h) >= license_scan.LEAST_COVERAGE * sum(idf[w] for w in line):
                found.add(label)
    return found


@pytest.mark.parametrize("rare", [1, 3, 50])
def test_license_candidates_against_every_place(rare):
    rng = random.Random(5)
    index = license_scan.Templates()
    lines = [t[1].split() for t in license_scan.TEMPLATES]
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 5)):
            part = list(rng.choice(lines))
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = "xx"
            words += part + ["yy"] * rng.randint(0, 2)
        idf = np.array([rng.choice([0.1, 1.0, 5.0]) for _ in index.vocabulary])
        at = [i for i, w in enumerate(words) if w.encode() in index.number]
        found, _ = license_scan.Postings(index, idf, rare).match(at, [index.number[words[i].encode()] for i in at], license_scan.LEAST_COVERAGE)
        assert found == plain_labels(" ".join(words), dict(zip(index.vocabulary, idf)))


def test_standard_headers():
    index = license_scan.Templates()
    postings = license_scan.Postings(index, np.ones(len(index.vocabulary)))
    headers = {
        "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "gpl-3.0": "# under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "bsd-2-clause": "// SPDX-License-Identifier: BSD-2-Clause",
        "cc-by-nc-sa-3.0": "Licensed under CC BY-NC-SA 3.0",
    }
    for label, text in headers.items():
        words = license_scan.WORD.findall(text.lower().encode())
        at = [i for i, w in enumerate(words) if w in index.number]
        assert postings.match(at, [index.number[words[i]] for i in at], 0.6)[0] == {label}


URLS = [
    None, "", "no scheme.com/en/", "http://a.com/x", "https://Example.COM/en/1?q=/en/", "http://www.example.com/en/2", "http://m.www.example.com/en/", "http://notexample.com/en/",
    "http://x.net/es/1", "http://x.net/fr", "http://x.net/fr/#a", "http://net/es/", "http://a.com", "http://a.com?x/", "ftp://u@b.org:80/p", "http://casino.example.org/a", "http://b.casino.example.org", "x://y://z.com/",
    "http://login.example.org/account/1", "http://login.example.org/other", "http://.com/", "http://a..com/é",
]


LISTED = ("casino.example.org", "login.example.org/account/")


def judged(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]

    def fits(text):
        h, p = text[: text.index("/")], text[text.index("/") :]
        return (host == h or host.endswith("." + h)) and path.startswith(p)

    best = max(((len(t), t, v) for t, v in url_filter.RULES if fits(t)), default=None)
    verdict = best[2] if best else "block" if any(fits(t if "/" in t else t + "/") for t in LISTED) else "allow"
    return host, path, best[1] if best else None, verdict


@pytest.mark.parametrize("shard", [1, 3, 500_000])
def test_url_filter(spark, shard):
    rows = [(i, u, "v") for i, u in enumerate(URLS)] + [(3, URLS[3], "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = url_filter.judge(spark, pages, blocked=LISTED, shard=shard).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter((i, *judged(u)) for i, u, _ in rows)
    assert url_filter.judge(spark, pages.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [1, 100])
def test_equal_digests_do_no_harm(tmp_path, shard):
    entries = url_filter.entries_of([("a.com/", "block"), ("b.com/", "allow"), ("c.com/x", "block")], ["d.org"])
    digest = lambda b: len(b)
    paths = []
    for k, raw in enumerate(url_filter.pack_index(entries, digest, shard)):
        paths.append(str(tmp_path / str(k)))
        (tmp_path / str(k)).write_bytes(raw)
    assert len(paths) == (2 if shard == 1 else 1)  # equal keys stay together
    index = url_filter.Shards(paths, digest)
    assert sorted(index.find([b"a.com/", b"q.com/", b"c.com/x", b"d.org/"])) == [(0, 1), (2, 1), (3, 2)]
    assert index.find([]) == []


def test_no_entries_and_lists_from_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(spark, pages, rules=(), blocked=()).collect()] == ["allow"]
    (tmp_path / "list.txt").write_text("# sites\n\na.com\n b.org/x \na.com\n")
    assert sorted(url_filter.read_list(spark, str(tmp_path / "list.txt"))) == ["a.com", "b.org/x"]
    assert [r.verdict for r in url_filter.judge(spark, pages, rules=(), blocked=["a.com"]).collect()] == ["block"]
