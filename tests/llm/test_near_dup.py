from __future__ import annotations

import random
from math import comb

import numpy as np
import pytest

from codeloom.llm import components as cc
from codeloom.llm import near_dup as nd
from codeloom.llm.common import Scratch


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, threshold=0.8):
    sets = [shingle_set(t) for _, t in rows]
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        out[rows[i][0]] = (len(links[i]), min(rows[k][0] for k in seen))
    return out


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Éa", "ñu", "x,"]
    rows, doc = [], 0
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 20, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((doc := doc + rng.randint(1, 3), " ".join(words)))
    group = [rng.choice(vocabulary) for _ in range(300)]
    for _ in range(60):
        words = list(group)
        for _ in range(3):
            words[rng.randrange(300)] = rng.choice(vocabulary)
        rows.append((doc := doc + 1, "\n".join(words)))
    rows += [(doc + k, rows[0][1].upper()) for k in range(1, 20)]
    return [*rows, (90000, None), (90001, ""), (90002, " \n"), (90003, "one"), (90004, "One "), (90005, "y " * 30000)]


@pytest.mark.parametrize("block", [512, 8])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, band int").repartition(4)
    scratch = Scratch(spark, "test")
    got = nd.similarity_join(spark, docs, scratch).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_links, r.class_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    scratch.drop()


def test_null_ids_and_empty_table(spark):
    scratch = Scratch(spark, "test")
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.class_id, r.n_links, r.kept) for r in nd.similarity_join(spark, docs, scratch).collect())
    assert got == [(-1, None, 0, True), (1, 1, 2, True), (2, 1, 2, False), (2, 1, 2, False)]
    assert nd.similarity_join(spark, docs.limit(0), scratch).count() == 0


def test_texts_that_share_an_id(spark):
    rng = random.Random(8)
    base = [[f"t{k}w{i}" for i in range(60)] for k in range(4)]

    def text(k, changed=None):
        words = list(base[k])
        if changed is not None:
            words[changed] = "x"
        return " ".join(words)

    # ids 1 and 5 have two texts each; 7 has one text twice, and again in other letters
    rows = [(1, text(0)), (1, text(1)), (2, text(0, 0)), (3, text(1, 59)), (5, text(2)), (5, text(1)), (6, text(2, 59)), (7, text(3)), (7, text(3)), (7, text(3).upper()), (8, text(3, 0))]
    rng.shuffle(rows)
    scratch = Scratch(spark, "test")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = nd.similarity_join(spark, docs, scratch).collect()
    key = {t: k for t, k in docs.selectExpr("text", "xxhash64(text)").collect()}
    mine = sorted((r.doc_id, r.text_key, r.n_links, r.class_id) for r in got)
    sets = [shingle_set(t) for _, t in rows]
    link = [[i != j and len(x & y) / len(x | y) >= 0.8 for j, y in enumerate(sets)] for i, x in enumerate(sets)]
    want = []
    for i, (doc, t) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = {j for j in range(len(rows)) if link[k][j]} - seen
            seen |= new
            todo += new
        want.append((doc, key[t], sum(link[i]), min(rows[j][0] for j in seen)))
    assert mine == sorted(want)
    kept = sorted((r.doc_id, r.text_key) for r in got if r.kept)
    sevens = min(key[text(3)], key[text(3).upper()])
    assert kept == sorted([(1, key[text(0)]), (1, key[text(1)]), (5, key[text(2)])] + [(7, sevens)] * (2 if sevens == key[text(3)] else 1))
    scratch.drop()


def test_shared_counts_agree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(40)]
    a, b = np.triu_indices(40, 1)
    want = [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(a, b)]
    assert nd.shared_counts(sets, a, b).tolist() == want
    assert nd.shared_counts(sets, a[:9], b[:9]).tolist() == want[:9]


def test_limits_are_posterior_bounds():
    for n, least in nd.least_matches(0.8, 1e-3):
        grid = (np.arange(20000) + 0.5) / 20000

        def posterior(m):
            like = comb(n, m) * grid**m * (1 - grid) ** (n - m)
            return like[grid >= 0.8].sum() / like.sum()

        assert posterior(least) >= 1e-3 * 0.98
        assert least == 0 or posterior(least - 1) < 1e-3 * 1.02


def test_components_in_rounds(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(120)] + [(2000, 2001 + i) for i in range(100)]
    scratch = Scratch(spark, "test")
    got = {r.node: r.component for r in cc.components(spark, spark.createDataFrame(edges, "u long, v long"), scratch, edges_a_task=60).collect()}
    nodes, names = cc.smallest_names(np.array([u for u, v in edges if u != v]), np.array([v for u, v in edges if u != v]))
    assert got == dict(zip(nodes.tolist(), names.tolist()))
