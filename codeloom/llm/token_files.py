"""Operator 1: token-ID files.

Documents are encoded by a public tokenizer, ids are ranked by corpus frequency, and the ranks are
written in a byte-aligned variable-length code whose control bytes (two bits a value: bytes less one)
stand apart from the data bytes.  Frequent ids take one byte.  Reading looks control bytes up in
256-row numpy tables, so no value is decoded on its own.

Layout: a folder of Parquet shards (Spark's committer survives lost executors and works on every
store).  A row is one block: ``shard``, ``block``, ``first`` (tokens of the shard before the block),
``n_docs``, ``n_tokens`` and ``payload``::

    b"RVB1" | u32 n_docs | u64 n_tokens | i64 doc_id[n_docs] | u8 is_null[n_docs] | u32 n_tokens[n_docs]
    | control bytes, four values each | data bytes, little-endian

Shards and blocks ascend by doc_id.  The rank table is saved beside the shards.

A tokenizer's special strings in a text become its special ids, as the library has it; ``special_as_text``
takes them for ordinary text instead.

Edge cases: null text is the empty text (only the end id); a null doc_id sorts first and comes back
null; rows that share a doc_id are all kept, shorter ones first, and may lie in several shards; an empty
table gives no rows; other columns are ignored.  Blocks hold whole documents, so a very long one makes a
large block.
"""

from __future__ import annotations

import functools
import gc
import itertools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, frugal, text_chunks

#: Values of one block at most, unless one document has more.
BLOCK_TOKENS = 1 << 20
#: Distinct words whose ids a worker remembers; when the memory is full, the half that was met first stays.
#: Beyond 699,050 words Python doubles the dictionary's table.
WORDS_KEPT = 690_000
WORDS_A_TASK = 150_000
#: Words that the library is asked for at a time, as it holds far more for each than its ids.
ASKED = 10_000
#: Bytes of the ids of one pass of the encoder at most.
MOST_BYTES = 1 << 30
#: Punctuation that the pre-tokenizer parts from a letter or digit before it.
PUNCTUATION = ".,;:!?|*%$#&"
#: Kinds of bytes; punctuation is cut off after ASCII letters and digits.
SPACE, LETTER, POINT = 1, 2, 3
KINDS = bytes(SPACE if c == " " else POINT if c in PUNCTUATION else LETTER if c.isascii() and c.isalnum() else 0 for c in map(chr, range(256)))
#: Letters beyond ASCII that every version of Unicode takes for letters.
LATIN = [c for c in map(chr, range(0xC0, 0x100)) if c.isalpha()]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Byte-level BPE through the tokenizers library, each distinct word once for a worker.

    The pre-tokenizer never joins characters across a single space or newline that stands between
    two other characters, nor a letter or digit with the punctuation after it, so such a text is the
    concatenation of its words' ids.  Any other text (runs of spaces, tabs, edges, special strings) goes
    to the library as a whole.  In the memory a word keeps the newline that precedes it, and else stands for
    itself after a space; what punctuation begins within a word has a space before it.

    Of words of letters, that pre-tokenizer makes one token each: a space and the word, its bytes as the model's
    characters.  The library gets them so, and is spared its search for tokens, which takes longer than the ids.
    """

    def __init__(self, path: str, end_id: int, words_kept: int = WORDS_KEPT, special_as_text: bool = False) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content for t in self.lib.get_added_tokens_decoder().values()]
        size = self.lib.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.newline = self._whole("\n")
        self.words_kept = words_kept
        self.memory: dict[str, bytes] = {}
        # ids whose first byte is a space or a newline: in joined words they begin a word
        self.begins = np.array([(self.lib.id_to_token(i) or "x")[0] in "ĠĊ" for i in range(size)])
        self.parted = None
        rules = json.loads(self.lib.to_str())
        first = rules["pre_tokenizer"] or {}
        if rules["normalizer"] is None and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space"):
            self.latin = str.maketrans({c: self.lib.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in LATIN})
            self.parted = Tokenizer(self.lib.model)
            self.parted.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")

    def _whole(self, text: str) -> bytes:
        return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def _learn(self, words: set[str]) -> None:
        if len(self.memory) + len(words) > self.words_kept:
            # words that were met first are the frequent ones
            self.memory = dict(itertools.islice(self.memory.items(), self.words_kept // 2))
        memory = self.memory
        bare = [w[1:] if w[0] in " \n" else w for w in words]
        if " ".join(bare).split() != bare:
            # a word that other white space begins or ends depends on its neighbours, and stays unknown
            words = {w for w in words if not w[-1].isspace() and not w[1:2].isspace() and (w[0] in " \n" or not w[0].isspace())}
        memory.update((w, self._whole(w[1:])) for w in words if w[0] == " ")
        rest = [w for w in words if w[0] != " "]
        for at in range(0, len(rest), ASKED):
            self._ask(rest[at : at + ASKED])

    def _ask(self, words: list[str]) -> None:
        memory = self.memory
        begun = [s for s in words if s[0] == "\n"]
        rest = set(words).difference(begun)
        ask = [(self.lib, "\n", begun, "".join(begun))]
        if self.parted:
            letters = [s for s in rest if s.isalpha()]
            english = [s for s in letters if s.isascii()]
            latin = [s for s in letters if not s.isascii() and known_letters(s)]
            ask.append((self.parted, " ", english, "Ġ" + " Ġ".join(english)))
            ask.append((self.parted, " ", latin, "Ġ" + " Ġ".join(latin).translate(self.latin)))
            rest.difference_update(english, latin)
        some = list(rest)
        ask.append((self.lib, " ", some, " " + " ".join(some)))
        for lib, head, some, text in ask:
            if not some:
                continue
            ids = np.array(lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            cuts = (np.append(np.flatnonzero(self.begins[ids]), len(ids)) * self.dtype.itemsize).tolist()
            if len(cuts) != len(some) + 1:  # a tokenizer with other rules
                memory.update((s, self._whole(s if head == "\n" else " " + s)) for s in some)
                continue
            raw = ids.tobytes()
            memory.update(zip(some, (raw[a:b] for a, b in zip(cuts, cuts[1:]))))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        collecting = gc.isenabled()
        gc.disable()  # long lists of words are no garbage, but each is searched for it
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        """Each distinct word of the texts is looked up once; Arrow finds them and puts their ids in the words' places."""
        out: list[bytes] = [b""] * len(texts)
        pieces, places = [], []
        for k, text in enumerate(texts):
            if text and not any(x in text for x in self.special):
                piece = f"\n{text}".replace("\n", " \n")
                # neighbouring, leading or trailing spaces and newlines: such words are never known
                if "  " not in piece and " \n " not in piece and not piece.endswith((" ", " \n")):
                    pieces.append(piece.encode())
                    places.append(k)
                    continue
            out[k] = self._alone(text)
        # Arrow's places are of 32 bits: a pass has no more bytes of ids than MOST_BYTES, as an id stands for a byte or more
        at, most = 0, MOST_BYTES // max(2, self.dtype.itemsize)
        while at < len(pieces):
            end, size = at + 1, len(pieces[at])
            while end < len(pieces) and size + len(pieces[end]) <= most:
                size += len(pieces[end])
                end += 1
            if size > most:
                out[places[at]] = self._alone(texts[places[at]])
            else:
                self._look_up(texts, pieces[at:end], places[at:end], out)
            at = end
        return out

    def _alone(self, text: str | None) -> bytes:
        return (self._whole(text) if text else b"") + self.end

    def _look_up(self, texts: list[str | None], pieces: list[bytes], places: list[int], out: list[bytes]) -> None:
        raw = b"".join(pieces)
        kinds = np.frombuffer(raw.translate(KINDS), np.uint8)
        # a word reaches from its space, or its punctuation after a letter or digit, to the next one
        begin = kinds == SPACE
        begin[1:] |= (kinds[1:] == POINT) & (kinds[:-1] == LETTER)
        starts = np.flatnonzero(begin)
        cuts = np.append(starts, len(raw)).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(raw)]).dictionary_encode()
        bounds, joined = (np.frombuffer(x, kind) for x, kind in zip(words.dictionary.buffers()[1:], (np.int32, np.uint8)))
        spaced = joined[bounds[: len(words.dictionary)]] == 0x20
        distinct, order = [], np.empty(len(spaced), np.int32)
        for own, head in ((spaced, ""), (~spaced, " ")):
            some = words.dictionary.filter(pa.array(own))
            order[own] = np.arange(len(distinct), len(distinct) + len(some))
            if head:
                distinct += [head + x.decode() for x in some.to_pylist()]
            elif len(some):
                ends, joined = some.buffers()[1:]
                distinct = joined[: np.frombuffer(ends, np.int32)[len(some)]].to_pybytes().decode().split(" ")
                del distinct[0]
        parts = list(map(self.memory.get, distinct))
        gaps = places_of_none(parts)
        if gaps:
            self._learn({distinct[i] for i in gaps})
            for i in gaps:
                parts[i] = self.memory.get(distinct[i])
        indices = order[words.indices.to_numpy()]
        first = np.searchsorted(starts, np.cumsum([0, *map(len, pieces)])).tolist()
        unknown = np.array([x is None for x in parts])[indices] if gaps and None in parts else None
        coded = pa.array(parts, pa.binary()).take(pa.array(indices))
        ends = np.frombuffer(coded.buffers()[1], np.int32, len(coded) + 1)[first].tolist()
        ids, skip = memoryview(coded.buffers()[2] or b""), len(self.newline)
        for k, a, b, i, j in zip(places, ends, ends[1:], first, first[1:]):
            if unknown is not None and unknown[i:j].any():
                out[k] = self._alone(texts[k])
            else:
                out[k] = b"".join((ids[a + skip : b], self.end))


known_letters = re.compile(f"[A-Za-z{''.join(LATIN)}]+").fullmatch


def places_of_none(parts: list) -> list[int]:
    out, i = [], -1
    try:
        while True:
            out.append(i := parts.index(None, i + 1))
    except ValueError:
        return out


@functools.cache
def encoder(path: str, end_id: int, words_kept: int = WORDS_KEPT, special_as_text: bool = False) -> Encoder:
    """One for a Python worker, over all its tasks."""
    return Encoder(path, end_id, words_kept, special_as_text)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 2, keep_ids: bool = True, words_kept: int = WORDS_KEPT, special_as_text: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens`` (with the end id) and, if asked for, ``ids`` as little-endian numbers.

    A worker holds about 150 bytes for each of ``words_kept`` words from then on; with 0 a task keeps
    ``WORDS_A_TASK`` words and nothing stays.
    """
    schema = "doc_id long, n_tokens long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, end_id, words_kept, special_as_text) if words_kept else Encoder(tokenizer, end_id, WORDS_A_TASK, special_as_text)
        for part in text_chunks(batches, "text", 1 << (21 if words_kept else 18)):
            coded = own.encode(part.column(1).to_pylist())
            n = pa.array([len(x) // own.dtype.itemsize for x in coded], pa.int64())
            cols = {"doc_id": part.column(0), "n_tokens": n} | ({"ids": pa.array(coded, pa.binary())} if keep_ids else {})
            yield pa.RecordBatch.from_pydict(cols)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(frugal(run), schema)


def vocab_size(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def id_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs, over all documents; a task sends one row for each id it has."""
    width = "<u2" if size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), width), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int32()), "n": pa.array(total[at])})

    out = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4", copy=False)
    most = 2 if not len(v) or v.max() <= 0xFFFF else 4
    length = 1 + (v > 0xFF).astype(np.uint8)
    if most == 4:
        length += (v > 0xFFFF).astype(np.uint8) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = length - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    keep = np.arange(most, dtype=np.uint8)[None, :] < length[:, None]
    return control.tobytes(), v.astype(f"<u{most}").view(np.uint8).reshape(-1, most)[keep].tobytes()


#: Bytes of each of the four values of a control byte.
LENGTHS = np.array([[1 + (c >> s & 3) for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)
#: What is kept of four bytes read at a value's start.
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], "<u4")
SHORT_MASKS = MASKS[:3].astype("<u2")


def unpack_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The values again (as 16 bits if all fit): lengths by table lookup, starts by a running sum, bytes by one gather."""
    length = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(length, dtype=np.int64)
    at -= length
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    if len(length) and length.max() <= 2:
        pairs = np.ndarray((len(padded) - 1,), "<u2", padded, strides=(1,))  # two bytes from each place on
        return pairs[at] & SHORT_MASKS[length]
    words = np.lib.stride_tricks.as_strided(padded, (max(len(padded) - 3, 0), 4), (1, 1))
    return words[at].view("<u4").reshape(-1) & MASKS[length]


def pack_block(doc_ids: list[int | None], lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack_values(ranks)
    null = np.array([x is None for x in doc_ids], np.uint8)
    ids = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join([b"RVB1", struct.pack("<IQ", len(ids), len(ranks)), ids.tobytes(), null.tobytes(), lengths.astype("<u4").tobytes(), control, data])


def unpack_block(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    if bytes(raw[:4]) != b"RVB1":
        raise ValueError("not a token block")
    n_docs, n = struct.unpack_from("<IQ", raw, 4)
    at = 16
    ids = np.frombuffer(raw, "<i8", n_docs, at)
    null = np.frombuffer(raw, np.uint8, n_docs, at + 8 * n_docs)
    lengths = np.frombuffer(raw, "<u4", n_docs, at + 9 * n_docs)
    at += 13 * n_docs
    control = np.frombuffer(raw, np.uint8, -(-n // 4), at)
    data = np.frombuffer(raw, np.uint8, offset=at + len(control))
    doc_ids = [None if z else x for x, z in zip(ids.tolist(), null.tolist())]
    return doc_ids, lengths.astype(np.int64), unpack_values(control, data, n)


def write_token_files(spark: SparkSession, docs: DataFrame, path: str, scratch: Scratch, tokenizer: str | None = None, end_id: int = 2, special_as_text: bool = False) -> None:
    """Writes the shards of ``docs`` (doc_id, text) below ``path``, with the rank table in ``path``/ranks."""
    tokenizer = tokenizer or default_tokenizer()
    tokens = scratch.keep(tokenize(docs, tokenizer, end_id, special_as_text=special_as_text))
    size = vocab_size(tokenizer)
    width = "<u2" if size <= 1 << 16 else "<u4"
    counts = id_counts(tokens, size)
    by_rank = np.lexsort((np.arange(size), -counts)).astype(np.int64)
    spark.createDataFrame([(by_rank.astype("<u4").tobytes(),)], "id_of_rank binary").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.empty(size, "<u4")
    rank_of[by_rank] = np.arange(size, dtype="<u4")
    ranks = spark.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        coded: list[bytes] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, first, ids, coded, waiting
            lengths = np.array([len(x) for x in coded], np.int64) // np.dtype(width).itemsize
            payload = pack_block(ids, lengths, ranks.value[np.frombuffer(b"".join(coded), width)])
            row = {"shard": [shard], "block": [block], "first": [first], "n_docs": [len(ids)], "n_tokens": [waiting], "payload": [payload]}
            block, first, ids, coded, waiting = block + 1, first + waiting, [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())]))

        for batch in batches:
            for doc_id, n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if waiting and waiting + n > BLOCK_TOKENS:
                    yield flush()
                ids.append(doc_id)
                coded.append(x.as_py())
                waiting += n
        if ids:
            yield flush()

    # rows that share a doc_id, or have none, are dealt to several shards by their places in the scratch table
    order = ["doc_id", "n_tokens", "place"]
    ordered = tokens.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = ordered.select("doc_id", "n_tokens", "ids").mapInArrow(run, "shard int, block int, first long, n_docs long, n_tokens long, payload binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document in the files."""
    return _read(spark, path, ids=False)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_token_files``, with ``ids`` as an array."""
    return _read(spark, path, ids=True)


def _read(spark: SparkSession, path: str, ids: bool) -> DataFrame:
    by_rank = spark.sparkContext.broadcast(np.frombuffer(spark.read.parquet(f"{path}/ranks").first()["id_of_rank"], "<u4"))
    blocks = spark.read.schema("shard int, block int, first long, n_docs long, n_tokens long, payload binary").parquet(f"{path}/blocks")
    # one row for each shard, not for each document
    totals = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    before, at = {}, 0
    for shard, n in totals:
        before[shard], at = at, at + n
    starts = spark.sparkContext.broadcast(before)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                doc_ids, lengths, ranks = unpack_block(payload.as_buffer().to_pybytes())
                values = by_rank.value[ranks].tobytes()
                ends = np.cumsum(lengths)
                cuts = [0, *(4 * ends).tolist()]
                crc = [zlib.crc32(values[a:b]) for a, b in zip(cuts, cuts[1:])]
                cols = {"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(starts.value[shard] + first + ends - lengths), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64())}
                if ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(values, "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_pydict(cols)

    return blocks.select("shard", "first", "payload").mapInArrow(run, schema)
