from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codeloom.llm import quality_classifier as qc


def corpus(seed=0, n=600):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        bad = k % 6 == 0
        words = ["".join(rng.choice(["the", "er", "on", "in", "st"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(30, 300))]
        if bad:
            kind = k // 6 % 3
            words = [w + rng.choice(["***", "$$$", "###"]) for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [w for w in words[:20] for _ in range(15)]
        docs.append((k, " ".join(words) + ".", rng.choice(["en", "de", None]), f"s{k % 7}", 1, "extra"))
        if k % 2 == 0:
            labels.append((k, 0 if bad else 1, 0))
    return docs, labels


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    docs += [(5000, None, None, None, None, "e"), (5001, "", "en", "s1", 0, "e"), (5002, "the on " * 30000, "en", "s1", None, "e"), (3, docs[3][1], *docs[3][2:])]
    labels += [(4, 0, 0), (4, 1, 0), (None, 1, 0), (8, None, 1), (10, 7, 0)]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(4)
    model = qc.train(spark, frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labelled=250, pool=250)
    got = qc.score(spark, frame, model).collect()
    assert len(got) == len(docs)
    odd = [r for r in got if r.doc_id < 600 and r.doc_id % 2]
    assert np.mean([r.kept == (r.doc_id % 6 != 0) for r in odd]) > 0.97
    assert all(r.kept for r in odd)
    even = [r for r in got if r.doc_id < 600 and r.doc_id % 2 == 0]
    assert np.mean([r.kept == (r.doc_id % 6 != 0) for r in even]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    kept = qc.keep(spark, frame, model)
    assert kept.schema == frame.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_no_labels_keep_everything(spark):
    docs, _ = corpus(n=20)
    frame = spark.createDataFrame(docs, SCHEMA)
    model = qc.train(spark, frame, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert all(r.kept and r.score == 1 for r in qc.score(spark, frame, model).collect())
    assert qc.score(spark, frame.limit(0), model).count() == 0


def test_missing_columns(spark):
    frame = spark.createDataFrame([(1, "only text")], "doc_id long, text string")
    assert qc.score(spark, frame, qc.Model()).count() == 1


def test_calibration_is_monotone_and_near_the_shares():
    rng = np.random.default_rng(0)
    z = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * z + 1)))).astype(int)
    a, b = qc.calibrate(z * 5, y)
    assert abs(a * 5 - 2) < 0.3 and abs(b - 1) < 0.3


def test_driver_holds_a_full_sample_once(spark):
    # as many documents as the sample may hold; the driver held seven times their half floats at once
    text = F.when(F.col("id") % 6 == 0, F.lit("*** AB# ")).otherwise(F.lit("the on er "))
    docs = spark.range(qc.LABELLED + qc.POOL).select(F.col("id").alias("doc_id"), F.concat(F.repeat(text, 9), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    labels = docs.where("doc_id % 2 = 0").selectExpr("doc_id", "if(doc_id % 6 = 0, 0, 1) as quality")
    tracemalloc.start()
    try:
        model = qc.train(spark, docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.text is not None
    half = (qc.LABELLED + qc.POOL) * qc.GRAMS * 2
    assert peak < 3 * half


def test_half_floats_learn_the_same():
    rng = np.random.default_rng(1)
    y = (np.arange(200) % 5 > 0).astype(int)
    grams, meta = ((rng.random((500, n)) + 0.2 * np.resize(y, 500)[:, None]).astype(np.float16) for n in (64, 20))
    a, b = (qc.co_train(*(x.astype(kind) for x in (grams[:200], meta[:200])), y, *(x.astype(kind) for x in (grams[200:], meta[200:]))) for kind in (np.float16, np.float32))
    assert (a.text == b.text).all() and (a.meta == b.meta).all() and a.cal == b.cal


def test_rows_of_byte_strings_in_their_places():
    rows = np.arange(24, dtype=np.float32).reshape(6, 4)
    whole = pa.array([x.tobytes() for x in rows], pa.binary())
    column = pa.chunked_array([whole.slice(1, 2), whole.slice(0, 0), whole.slice(3)])
    assert (qc._matrix(column, np.float32, np.array([4, 0, 3, 1, 2])) == rows[[2, 4, 5, 3, 1]]).all()
