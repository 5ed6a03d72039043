from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import mixing, near_dup, quality_classifier, substring_dedup
from codeloom.llm.common import Scratch, table
from tests.llm.test_near_dup import shingle_set

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, written and reread as the contract says."""
    where = tmp_path_factory.mktemp("stages")
    docs, out = table(spark, SF, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{where}/{k}")
        after = spark.read.parquet(f"{where}/{k}")
        out.append((docs, after))
        docs = after
    return out


def test_columns_of_documents(stages):
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes
        assert 0 < after.count()


def test_classifier_keeps_clean_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in stages[0][1].collect()}
    assert all(i in kept for i, q in labels.items() if q == 1)


def test_one_of_each_group_stays(stages):
    before, after = ({r.doc_id: shingle_set(r.text) for r in x.select("doc_id", "text").collect()} for x in stages[1])
    near = lambda a, b: len(a & b) / len(a | b) >= 0.8 if a and b else False
    left = list(after.values())
    assert not any(near(a, b) for k, a in enumerate(left) for b in left[:k])
    assert all(any(near(s, a) for i, a in before.items() if i < d) for d, s in before.items() if d not in after)


def test_substrings_as_brute_force(stages):
    from tests.llm.test_substring_dedup import brute

    before, after = ({r.doc_id: r.text for r in x.select("doc_id", "text").collect()} for x in stages[2])
    want = {d: t for d, t in brute(list(before.items())).items() if t == before[d] or t.split()}
    assert after == want


def test_mixing_loses_nothing(stages):
    before, after = (Counter(r.doc_id for r in x.select("doc_id").collect()) for x in stages[3])
    assert set(before) == set(after) and max(after.values()) <= mixing.MOST_REPEATS


def test_packing_holds_every_token(spark, stages):
    from codeloom.llm import token_files

    before, after = stages[4]
    sizes = Counter()
    for r in token_files.tokenize(before, token_files.default_tokenizer(), keep_ids=False).collect():
        sizes[r.doc_id] += r.n_tokens
    packed = Counter()
    for r in after.collect():
        packed[r.doc_id] += r.n_tokens
    assert sizes == packed


def test_run_equals_the_stages_and_results_live_side_by_side(spark, stages):
    from codeloom.llm.common import BATCH_ROWS

    before = spark.conf.get(BATCH_ROWS)
    first = corpus_pipeline.run(spark, SF)
    second = corpus_pipeline.run(spark, SF)
    want = Counter((r.doc_id, r.piece, r.n_tokens) for r in stages[-1][1].collect())
    assert Counter((r.doc_id, r.piece, r.n_tokens) for r in second.collect()) == want
    assert Counter((r.doc_id, r.piece, r.n_tokens) for r in first.collect()) == want
    assert spark.conf.get(BATCH_ROWS) == before


def edge_cases(spark):
    words = [f"w{k}" for k in range(400)]
    text = " ".join(words[:300])
    rows = [
        (1, text, "en", "a", 5, "x"),
        (1, text, "en", "a", 5, "x"),  # an equal row
        (1, " ".join(words[100:]) + ".", "en", "a", 5, "x"),  # another text of the same id
        (2, text.upper(), "en", "a", 5, "x"),  # a copy
        (3, None, None, None, None, None),
        (4, "", "", "", 0, ""),
        (None, text, "en", None, 5, "x"),
        (None, text, "en", None, 5, "x"),
        (6, " ".join(f"long{k}" for k in range(60000)), "en", "b", 9, "x"),
    ]
    # columns whose names the stages use themselves
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `row` string").withColumn("kept", F.lit(1)).withColumn("position", F.lit(2)).withColumn("__text", F.lit("t"))


def test_stages_on_edge_cases(spark, tmp_path):
    docs = edge_cases(spark)
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            where = f"{tmp_path}/{empty}{k}"
            stage(spark, now, SF).write.parquet(where)
            after = spark.read.parquet(where)
            if k < 4:
                assert after.dtypes == now.dtypes, name
            assert (after.count() == 0) == empty, name
            if name == "jaccard_join" and not empty:
                want = [(r.doc_id, r.text) for r in now.collect()]
                got = sorted(((r.doc_id, r.text) for r in after.collect()), key=str)
                # the equal row and the copy go; null ids, null and empty texts and the other text of id 1 stay
                left = {x for x in want if x[0] != 2}
                assert got == sorted([*left, *[x for x in left if x[0] is None]], key=str)
            now = after


def test_operators_named(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "jaccard_join", "substring_dedup", "mixing", "packing"]
    assert all((near_dup, quality_classifier, substring_dedup, Scratch))
