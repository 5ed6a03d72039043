from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import token_files as tf
from codeloom.llm.common import Scratch


@given(st.lists(st.integers(0, 2**32 - 1), max_size=200))
@settings(deadline=None)
def test_values_round_trip(values):
    v = np.array(values, "<u4")
    control, data = tf.pack_values(v)
    assert len(control) == -(-len(v) // 4)
    got = tf.unpack_values(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(v))
    assert got.tolist() == values


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tf.default_tokenizer())  # as it is


TEXTS = ["", " ", "a", "one two\nthree", "  lead", "trail \n", "a\t b", "don't stop... now!!\nIt's 12,5%", "é ü\nñandú ß", "x\n\ny", " nb sp", "junk### on*** a%%%", "<|endoftext|> here", "hello <|endoftext|> world", "a<|endoftext|>b <|endoftext|>\n<|endoftext|>", "no <|endoftext | >", "word " * 5000 + "end"]


@given(st.lists(st.text(alphabet="ab é.,'!\n\t1 ", max_size=30), max_size=8))
@settings(deadline=None, max_examples=60)
def test_encoder_equals_library(texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tf.default_tokenizer())
    own = tf.encoder(tf.default_tokenizer(), 2)
    for text, got in zip(texts, own.encode(texts)):
        assert np.frombuffer(got, own.dtype).tolist() == [*lib.encode(text, add_special_tokens=False).ids, 2]


def test_small_memory_gives_the_same(library):
    own = tf.Encoder(tf.default_tokenizer(), 2, words_kept=3)
    for text, got in zip(TEXTS, own.encode(TEXTS)):
        assert np.frombuffer(got, own.dtype).tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_frequent_words_stay_when_the_memory_is_full(library):
    own = tf.Encoder(tf.default_tokenizer(), 2, words_kept=40)
    often = [f"often{i}" for i in range(20)]
    asked = []
    learn = own._learn
    own._learn = lambda words: (asked.append(set(words)), learn(words))
    for k in range(8):
        text = " ".join([*often, *(f"rare{k}x{i}" for i in range(15 if k else 0))])
        assert np.frombuffer(own.encode([text])[0], own.dtype).tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]
    assert len(asked) == 8 and not any(set(often) & words for words in asked[1:])
    assert len(own.memory) <= 40


class Counted(dict):
    asked = 0

    def get(self, word):
        self.asked += 1
        return super().get(word)


def test_a_repeated_word_is_looked_up_once(library):
    own = tf.Encoder(tf.default_tokenizer(), 2)
    texts = ["one two, three. two,\n" * 300 + f"end{k}" for k in range(20)]
    own.encode(texts)
    own.memory = Counted(own.memory)
    for text, got in zip(texts, own.encode(texts)):
        assert np.frombuffer(got, own.dtype).tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]
    assert 0 < own.memory.asked < 50  # 24,000 words


@given(st.lists(st.text(alphabet="ab1 é×ß٣.,*%|&'!-…«\n\t\x85\u2028\u00a0 ", max_size=30), max_size=8))
@settings(deadline=None, max_examples=500)
def test_punctuation_within_words(library, texts):
    own = tf.encoder(tf.default_tokenizer(), 2)
    texts = [*texts, " ".join(texts)]
    for _ in range(2):  # new words and remembered ones
        for text, got in zip(texts, own.encode(texts)):
            assert np.frombuffer(got, own.dtype).tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_the_library_is_asked_for_few_words_at_a_time():
    own = tf.Encoder(tf.default_tokenizer(), 2)
    asked = []

    class Library:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **kwargs):
            asked.append(max(len(x.split()) for x in texts))
            return self.library.encode_batch_fast(texts, **kwargs)

    own.lib, own.parted = Library(own.lib), Library(own.parted)
    own.encode([" ".join(f"{'abc'[i % 3] * (i % 7)}x{i:x}" for i in range(45_000))])
    assert sum(asked) >= 45_000 and max(asked) <= tf.ASKED


def test_other_white_space_at_a_words_edge(library):
    for text in ("\xa0\x851", "a \u2028b", "a\t b", "a,\x85 b", "x\n\xa0y"):
        own = tf.Encoder(tf.default_tokenizer(), 2)
        assert np.frombuffer(own.encode([text])[0], own.dtype).tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_long_passes_are_parted(library, monkeypatch):
    monkeypatch.setattr(tf, "MOST_BYTES", 64)
    own = tf.Encoder(tf.default_tokenizer(), 2)
    for text, got in zip(TEXTS * 2, own.encode(TEXTS * 2)):
        assert np.frombuffer(got, own.dtype).tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_words_of_all_letters(library):
    own = tf.Encoder(tf.default_tokenizer(), 2)
    texts = [" ".join(f"x ab{chr(c)}d {chr(c)} {chr(c)}e, \n{chr(c)}Z{chr(c)}" for c in range(at, at + 16)) for at in range(0x20, 0x3400, 16)]
    texts += [" ".join(chr(c) * 3 + "q" for c in range(at, at + 16)) for at in range(0x1D400, 0x1D800, 16)]
    for text, got in zip(texts, own.encode(texts)):
        assert np.frombuffer(got, own.dtype).tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_files_against_brute_force(spark, library):
    rows = [(i * 3, t, "extra") for i, t in enumerate(TEXTS)] + [(7, None, "x"), (7, None, "x"), (None, "null id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(5)
    scratch = Scratch(spark, "test")
    tf.write_token_files(spark, docs, path := scratch.place(), scratch)
    got = [tuple(r)[:4] for r in tf.read_token_files(spark, path).collect()]
    coded = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, _ in rows]
    at, want = 0, []
    for i, ids in sorted(coded, key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]))):
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    back = {(r.start): list(r.ids) for r in tf.read_token_ids(spark, path).collect()}
    assert sorted(map(tuple, back.values())) == sorted(tuple(x[1]) for x in coded)
    scratch.drop()


def test_special_strings_as_text():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tf.default_tokenizer())
    lib.encode_special_tokens = True
    own = tf.Encoder(tf.default_tokenizer(), 2, special_as_text=True)
    for text, got in zip(TEXTS, own.encode(TEXTS)):
        assert np.frombuffer(got, own.dtype).tolist() == [*lib.encode(text, add_special_tokens=False).ids, 2]


def test_one_id_in_several_shards(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        shards(spark)
    finally:
        spark.conf.set(name, before)


def shards(spark):
    rows = [(5 if i % 3 else None, f"w{i % 7} " * (i % 11 + 1)) for i in range(3000)]
    scratch = Scratch(spark, "test")
    tf.write_token_files(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path := scratch.place(), scratch)
    got = sorted((tuple(r) for r in tf.read_token_files(spark, path).collect()), key=lambda r: r[1])
    assert len(got) == 3000 and [r[0] for r in got] == [None] * 1000 + [5] * 2000
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    assert spark.read.parquet(f"{path}/blocks").select("shard").distinct().count() > 2
    scratch.drop()


def test_empty_table(spark):
    scratch = Scratch(spark, "test")
    tf.write_token_files(spark, spark.createDataFrame([], "doc_id long, text string"), path := scratch.place(), scratch)
    assert tf.read_token_files(spark, path).count() == 0
