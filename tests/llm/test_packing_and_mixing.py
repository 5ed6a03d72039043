from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import mixing, packing, queries, token_files
from codeloom.llm.common import BATCH_ROWS, Scratch


def check_bins(rows, lengths=packing.LENGTHS):
    """rows: (bin, length, offset, size); bins overlap nowhere and no smaller length would do."""
    bins = defaultdict(list)
    for b, length, offset, size in rows:
        bins[b].append((offset, size, length))
    for inside in bins.values():
        at = 0
        for offset, size, length in sorted(inside):
            assert offset == at and length == inside[0][2]
            at += size
        assert inside[0][2] == min(x for x in lengths if x >= at)
    return bins


@given(st.lists(st.integers(1, 8192), min_size=1, max_size=120))
@settings(deadline=None, max_examples=60)
def test_pack_is_sound_and_not_costlier_than_the_plain_ways(sizes):
    bins, offsets, final = packing.pack(np.array(sizes))
    found = check_bins(zip(bins.tolist(), final.tolist(), offsets.tolist(), sizes))
    cost = sum(packing.cost_of(x[0][2], 8192) for x in found.values())
    alone = sum(packing.cost_of(min(c for c in packing.LENGTHS if c >= s), 8192) for s in sizes)
    assert cost <= alone + 1e-6


def cost_of_bins(bins, final):
    return sum(packing.cost_of(c, 8192) for c in dict(zip(bins.tolist(), final.tolist())).values())


def least_sufficient(sizes):
    """Best fit, falling, with the least length that holds the piece opened each time."""
    rooms, used = {}, []
    for s in sorted(sizes, reverse=True):
        b = min((b for b, r in rooms.items() if r >= s), key=lambda b: (rooms[b], b), default=None)
        if b is None:
            b = len(used)
            used.append(0)
            rooms[b] = min(c for c in packing.LENGTHS if c >= s)
        used[b] += s
        rooms[b] -= s
    return sum(packing.cost_of(min(c for c in packing.LENGTHS if c >= u), 8192) for u in used)


def test_lengths_above_the_least_sufficient_are_opened_and_pay():
    rng = random.Random(1)
    lengths, costs = packing.LENGTHS, {c: packing.cost_of(c, 8192) for c in packing.LENGTHS}
    for low, high, gain in ((500, 700, 0.75), (1100, 1500, 0.75), (300, 3000, 1.0)):
        sizes = [rng.randint(low, high) for _ in range(1500)]
        bins, offsets, final = packing.pack(np.array(sizes))
        check_bins(zip(bins.tolist(), final.tolist(), offsets.tolist(), sizes))
        assert cost_of_bins(bins, final) < gain * least_sufficient(sizes)
        of, _, _, opened = packing._fill(sorted(sizes, reverse=True), lengths, costs, True)
        first = {}
        for b, s in zip(of, sorted(sizes, reverse=True)):
            first.setdefault(b, s)
        by_class = defaultdict(set)
        for b, s in first.items():
            by_class[min(c for c in lengths if c >= s)].add(opened[b])
        assert max(len(x) for x in by_class.values()) > 1  # several lengths for one class of sizes


def test_downsizing_changes_bins():
    rng = random.Random(1)
    lengths, costs = packing.LENGTHS, {c: packing.cost_of(c, 8192) for c in packing.LENGTHS}
    changed = 0
    for _ in range(20):
        sizes = sorted((min(8192, int(rng.lognormvariate(6.5, 1.2)) + 1) for _ in range(400)), reverse=True)
        _, _, used, opened = packing._fill(sizes, lengths, costs, True)
        changed += sum(o > min(c for c in lengths if c >= u) for u, o in zip(used, opened))
    assert changed > 0


def test_against_the_best_of_all_packings():
    """Small cases against every partition into bins."""

    def best(sizes):
        if not sizes:
            return 0.0
        least = math.inf
        rest = sizes[1:]
        for mask in range(1 << len(rest)):
            own = sizes[0] + sum(s for k, s in enumerate(rest) if mask >> k & 1)
            if own <= 8192:
                length = min(c for c in packing.LENGTHS if c >= own)
                least = min(least, packing.cost_of(length, 8192) + best([s for k, s in enumerate(rest) if not mask >> k & 1]))
        return least

    rng = random.Random(3)
    ratio = []
    for _ in range(40):
        sizes = [rng.choice([rng.randint(1, 512), rng.randint(400, 1500), rng.randint(1, 8192)]) for _ in range(rng.randint(1, 6))]
        bins, _, final = packing.pack(np.array(sizes))
        ratio.append(cost_of_bins(bins, final) / best(sizes))
    assert min(ratio) >= 1 - 1e-9 and sum(ratio) / len(ratio) < 1.03


def first_fit_cost(sizes):
    rooms = []
    for s in sorted(sizes, reverse=True):
        for k, r in enumerate(rooms):
            if r >= s:
                rooms[k] -= s
                break
        else:
            rooms.append(8192 - s)
    return len(rooms) * packing.cost_of(8192, 8192)


def test_pack_beats_one_length():
    rng = random.Random(1)
    sizes = [min(8192, int(rng.lognormvariate(6.5, 1.2)) + 1) for _ in range(3000)]
    bins, _, final = packing.pack(np.array(sizes))
    cost = sum(packing.cost_of(c, 8192) for c in dict(zip(bins.tolist(), final.tolist())).values())
    assert cost < first_fit_cost(sizes)
    assert sum(sizes) / sum(dict(zip(bins.tolist(), final.tolist())).values()) > 0.97


def test_query_reads_texts_in_small_batches(spark, tmp_path, monkeypatch):
    reader = "spark.sql.parquet.columnarReaderBatchSize"
    before = [spark.conf.get(k) for k in (BATCH_ROWS, reader)]
    spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []

    def rows_of_batches(docs, *args, **kwargs):
        seen.append(int(spark.conf.get(reader)))

        def run(batches):
            for batch in batches:
                yield batch.set_column(1, "n_tokens", pa.array([batch.num_rows] * batch.num_rows, pa.int64()))

        return docs.select("doc_id", F.lit(0).cast("long").alias("n_tokens")).mapInArrow(run, "doc_id long, n_tokens long")

    monkeypatch.setattr(token_files, "tokenize", rows_of_batches)
    got = queries.op2_packing(spark, str(tmp_path)).collect()
    assert len(got) == 3000 and max(r.n_tokens for r in got) <= 1000
    assert seen[0] <= 500
    assert [spark.conf.get(k) for k in (BATCH_ROWS, reader)] == before


def test_pack_documents(spark):
    rows = [(i, (i * 37) % 900 + 1, "x") for i in range(500)] + [(700, 30_000, "x"), (701, 8192, "x"), (702, 8193, "x"), (703, 0, "x"), (704, None, "x"), (None, 5, "x"), (1, 38, "x"), (1, 38, "x")]
    sizes = spark.createDataFrame(rows, "doc_id long, n_tokens long, bin_id string")
    got = packing.pack_documents(sizes, chunk=100, most_tasks=3).collect()
    check_bins([(r.bin_id, r.bin_length, r.bin_offset, r.n_tokens) for r in got])
    total = Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
    assert total == Counter({1: 38 * 3}) + Counter({i: n for i, n, _ in rows if n and i != 1})
    assert sorted((r.piece, r.first_token, r.n_tokens) for r in got if r.doc_id == 700) == [(0, 0, 8192), (1, 8192, 8192), (2, 16384, 8192), (3, 24576, 5424)]
    assert packing.pack_documents(sizes.limit(0)).count() == 0


def mixture(spark, docs, **how):
    scratch = Scratch(spark, "test")
    rows = mixing.mix(spark, docs, scratch, **how).select("row.*", "pass", "position", "n_tokens", "weight").collect()
    scratch.drop()
    return rows


def corpus(spark):
    rng = random.Random(2)
    sizes = {"hot": 3000, "b": 300, "c": 300, "d": 40, None: 200}
    rows = [(k, " ".join(["w"] * rng.randint(1, 60)), s, k) for k, s in enumerate(x for s, n in sizes.items() for x in [s] * n)]
    rows += [(90000, None, "c", 1), (90001, "", "c", 1), (90002, "  ", "hot", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, weight long").repartition(3)


def test_mix_to_a_repetition_limit(spark):
    rows, docs = corpus(spark)
    got = mixture(spark, docs.drop("weight"), most_repeats=4.0, evenness=None)
    tokens, used, passes = Counter(), Counter(), defaultdict(Counter)
    for i, t, s, _ in rows:
        tokens[s] += max(1, len((t or "").split()))
    for r in got:
        used[r.source] += r.n_tokens
        passes[r.source][r.doc_id] += 1
        assert 0 <= r.position <= 1
    shares = {s: n / sum(tokens.values()) for s, n in tokens.items()}
    a = 1 - math.log(4) / math.log(max(shares.values()) / min(shares.values()))
    for s in tokens:
        repeats = (shares[s] / max(shares.values())) ** (a - 1)
        assert {i for i, _, x, _ in rows if x == s} == set(passes[s])  # nothing is lost
        assert max(passes[s].values()) - min(passes[s].values()) <= 1
        # the greedy prefix of the permutation falls short of the budget by less than its next document
        assert -1e-6 <= repeats * tokens[s] - used[s] < 61
    z = sum(p**a for p in shares.values())
    assert all(abs(r.weight - shares[r.source] ** a / z) < 1e-6 for r in got)


def test_mix_to_an_entropy(spark):
    _, docs = corpus(spark)
    docs = docs.where("source is not null").drop("weight")
    got = mixture(spark, docs, entropy=1.2, most_repeats=1e9)
    weights = {r.source: r.weight for r in got}
    assert abs(-sum(w * math.log(w) for w in weights.values()) - 1.2) < 1e-6
    assert abs(sum(weights.values()) - 1) < 1e-9


def test_query_bisects_to_unequal_weights(spark, monkeypatch):
    from codeloom.llm import queries

    called = []
    plain = mixing.bisect
    monkeypatch.setattr(mixing, "bisect", lambda *a, **k: called.append(plain(*a, **k)) or called[-1])
    rows = queries.op5_mixing(spark, "/root/testdata/sf0.01").select("source", "weight").distinct().collect()
    assert len(called) == 2 and 0 < called[1] < 1
    weights = sorted(r.weight for r in rows)
    assert len(weights) == 20 and weights[-1] > 1.1 * weights[0]
    tokens = Counter()
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("source", "text").collect():
        tokens[r.source] += max(1, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
    shares = [n / sum(tokens.values()) for n in tokens.values()]
    entropy = lambda x: -sum(p * math.log(p) for p in x)
    assert abs(entropy(weights) - (entropy(shares) + math.log(20)) / 2) < 1e-6


def test_permutation_against_brute_force(spark):
    """Each source's copies, taken in order from its hashed blocks while the budget lasts."""
    rows, docs = corpus(spark)
    docs = docs.drop("weight")
    got = Counter((r.source, r.doc_id) for r in mixture(spark, docs, most_repeats=3.0, evenness=0.7))
    first = mixture(spark, docs, most_repeats=3.0, evenness=0.7)
    weight = {r.source: r.weight for r in first}
    tokens = Counter()
    for _, t, s, _ in rows:
        tokens[s] += max(1, len((t or "").split()))
    total = sum(tokens.values())
    rate = min(weight[s] / tokens[s] for s in tokens) * total  # the source repeated least goes once
    want: Counter = Counter()
    for s in tokens:
        repeats = round(weight[s] * total / tokens[s] / rate, 9)
        whole = math.floor(repeats)
        budget = math.floor((repeats - whole) * tokens[s])
        mine = docs.where(F.col("source").eqNullSafe(F.lit(s))).select("doc_id", mixing.word_tokens(F.col("text")).alias("n"), F.xxhash64("doc_id", "text").alias("key"))
        mine = mine.select("*", F.expr(f"shiftrightunsigned(xxhash64({mixing.SEED}, {whole}, key), 52) & 4095").alias("b1"), F.expr(f"shiftrightunsigned(xxhash64({mixing.SEED}, {whole}, key), 40) & 4095").alias("b2")).collect()
        for r in mine:
            want[s, r.doc_id] += whole
        # whole blocks, then sub-blocks of the next block, then documents of the next sub-block
        for level in ("b1", "b2", "key"):
            sizes: Counter = Counter()
            for r in mine:
                sizes[r[level]] += r.n
            edge = None
            for k in sorted(sizes):
                if sizes[k] > budget:
                    edge = k
                    break
                budget -= sizes[k]
                for r in mine:
                    if r[level] == k:
                        want[s, r.doc_id] += 1
            mine = [r for r in mine if edge is not None and r[level] == edge]
    assert got == +want


def test_partial_passes_drop_only_the_end_of_a_permutation(spark):
    _, docs = corpus(spark)
    got = mixture(spark, docs.drop("weight"), most_repeats=1.0, passes=0.5)
    n = sum(r.n_tokens for r in got)
    every = docs.agg(F.sum(mixing.word_tokens(F.col("text")))).first()[0]
    assert abs(n - every / 2) < 5 * 61


def test_mix_one_source_and_none(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, None, "s")], "doc_id long, text string, source string")
    got = mixture(spark, docs)
    assert sorted((r.doc_id or 0, r["pass"]) for r in got) == [(0, 0), (1, 0), (1, 0)]
    assert mixture(spark, docs.limit(0)) == []
