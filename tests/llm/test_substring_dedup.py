from __future__ import annotations

import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import substring_dedup as sd
from codeloom.llm.common import Scratch


@given(st.text(alphabet="ab. !?\n\té", max_size=200))
@settings(deadline=None)
def test_sentences_make_up_the_text(text):
    pieces = sd.sentences_of(text)
    assert "".join(pieces) == text
    assert len(pieces) <= 1 or all(p.split() for p in pieces)


def sentence(rng, n=None):
    return " ".join(f"v{rng.randrange(5000)}" for _ in range(n or rng.randint(3, 14))) + "."


def brute(rows):
    """Which sentences stay, by comparing all runs as tuples of words."""
    runs = {}
    for doc_id, text in sorted(rows):
        split = [tuple(x.split()) for x in sd.sentences_of(text or "")]
        for i in range(len(split)):
            end = i
            while end < len(split) and (end - i < sd.SENTENCES or sum(map(len, split[i:end])) < sd.WORDS):
                end += 1
            if end - i >= sd.SENTENCES and sum(map(len, split[i:end])) >= sd.WORDS:
                runs.setdefault(tuple(split[i:end]), []).append((doc_id, i, end))
    gone = {}
    for places in runs.values():
        for doc_id, i, end in places[1:]:
            gone.setdefault(doc_id, set()).update(range(i, end))
    return {d: None if t is None else "".join(p for k, p in enumerate(sd.sentences_of(t)) if k not in gone.get(d, ())) for d, t in rows}


def corpus(seed=1):
    rng = random.Random(seed)
    passages = [" ".join(sentence(rng) for _ in range(8)) for _ in range(5)] + [" ".join(f"u{rng.randrange(900)}" for _ in range(90))]
    rows = []
    for d in range(60):
        parts = [" ".join(sentence(rng) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        rows.append((d * 2, rng.choice(["\n", " "]).join(parts)))
    rows += [(500, rows[4][1]), (501, rows[4][1]), (502, None), (503, ""), (504, "\n \n"), (505, sentence(rng, 40000)), (506, "short one. twice.")]
    return [*rows, (507, "short one. twice."), (508, passages[0] + "\n" + passages[0])]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, key string, n int").repartition(5)
    scratch = Scratch(spark, "test")
    got = {r.row.doc_id: r for r in sd.dedup(spark, docs, scratch).collect()}
    assert {d: r.dedup.text for d, r in got.items()} == brute(rows)
    assert {d: r.dedup.n_sentences for d, r in got.items()} == {d: len(sd.sentences_of(t or "")) for d, t in rows}
    assert got[501].dedup.n_removed > 0 and got[8].row.key == "s"
    assert got[506].dedup.n_removed == got[507].dedup.n_removed == 0
    scratch.drop()


def test_long_passages_go_wherever_they_stand(spark):
    rng = random.Random(9)
    rows = []
    for k in range(30):
        n = rng.choice([1, 2, 3, 6])
        words = [f"p{rng.randrange(10**6)}" for _ in range(rng.randint(51, 80))]
        cut = sorted(rng.sample(range(5, len(words) - 5), n - 1))
        passage = " ".join(w + ("." if i + 1 in cut or i == len(words) - 1 else "") for i, w in enumerate(words))
        for j in range(2):
            rows.append((k * 2 + j, f"{sentence(rng)} {sentence(rng)}\n{passage}\n{sentence(rng)}"))
    scratch = Scratch(spark, "test")
    got = {r.row.doc_id: r.dedup for r in sd.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    caught = sum(got[2 * k + 1].n_removed > 0 for k in range(30))
    assert caught == 30
    assert all(got[2 * k].n_removed == 0 for k in range(30))
    scratch.drop()


def test_repeated_rows_and_empty_table(spark):
    rng = random.Random(3)
    text = " ".join(sentence(rng) for _ in range(10))
    scratch = Scratch(spark, "test")
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    got = sorted((r.row.doc_id or 0, r.dedup.text) for r in sd.dedup(spark, docs, scratch).collect())
    assert got == [(0, text), (1, ""), (1, "")]
    docs = spark.createDataFrame([(None, text), (None, text), (None, None), (None, None), (None, ""), (None, "")], "doc_id long, text string")
    got = sorted((r.dedup for r in sd.dedup(spark, docs, scratch).collect()), key=str)
    n = len(sd.sentences_of(text))
    assert Counter((r.text, r.n_sentences, r.n_removed) for r in got) == Counter({(text, n, 0): 1, ("", n, n): 1, (None, 0, 0): 2, ("", 0, 0): 2})
    assert sd.dedup(spark, docs.limit(0), scratch).count() == 0


def test_texts_that_share_an_id(spark):
    rng = random.Random(21)
    passage = " ".join(sentence(rng) for _ in range(8))
    texts = [f"{sentence(rng, 9)} {passage} {sentence(rng, 9)}" for _ in range(6)]
    rows = [(4, texts[0]), (4, texts[1]), (4, texts[1]), (None, texts[2]), (None, texts[3]), (9, texts[4]), (9, texts[5])]
    scratch = Scratch(spark, "test")
    for some in (rows, rows[:3] + rows[5:]):
        docs = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
        keys = {(r.doc_id, r.text): r.k for r in docs.selectExpr("doc_id", "text", "xxhash64(doc_id, text) k").collect()}
        order = sorted(range(len(some)), key=lambda i: (some[i][0] is not None, some[i][0] or 0, keys[some[i]], i))
        want = brute([(place, some[i][1]) for place, i in enumerate(order)])
        got = Counter((r.row.doc_id, r.row.text, r.dedup.text) for r in sd.dedup(spark, docs, scratch).collect())
        assert got == Counter((*some[i], want[place]) for place, i in enumerate(order))
    scratch.drop()


def test_every_stretch_of_51_words_holds_a_run():
    rng = random.Random(11)
    kinds = [lambda: f"m{rng.randrange(10**6)}", lambda: rng.choice(["m", "n."]), lambda: "same", lambda: f"m{rng.randrange(9)}" + rng.choice([""] * 40 + ["."])]
    for k in range(400):
        word = kinds[k % len(kinds)]
        passage = [word() for _ in range(51)]
        texts = []
        for space in (" ", "\n"):
            before, after = ([word() for _ in range(rng.randrange(60))] for _ in range(2))
            texts.append(" ".join(before) + " " + space.join(passage) + " " + " ".join(after))
        a, b = ({d for d, _, _ in sd.spans_of(t)[0]} for t in texts)
        assert a & b
        assert all(len(p.split()) <= sd.LONG for t in texts for p in sd.sentences_of(t))


def test_passages_in_mid_sentence_and_of_repeated_words(spark):
    rng = random.Random(12)
    words = lambda n: " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for k in range(60):
        passage = words(51) if k < 30 else " ".join([f"w{k}", f"x{k}"][: 1 + k % 2] * 60)
        for j in range(2):
            rows.append((k * 2 + j, f"{words(3 + k % 9)} {passage} {words(4 + k % 7)}."))
    scratch = Scratch(spark, "test")
    got = {r.row.doc_id: r.dedup for r in sd.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    assert all(got[2 * k + 1].n_removed > 0 for k in range(60))
    assert all(got[2 * k].n_removed == 0 for k in range(30))
    scratch.drop()
