"""Operator 10: URL filter over a sorted digest array.

Rules and blocked prefixes (``host/path``) become index files, each for a range of 64-bit xxhash keys
(``SHARD`` entries, so a list of any length takes the same way): the sorted keys, then the full strings and
their verdicts in the same order.  Executors fetch the files once and memory-map them, so pages are read
as they are probed.  A task hashes every candidate of its urls (each parent domain with each path length
that the index has), finds them by one vectorised binary search for each file, and compares the stored
strings, so that equal digests of different strings do no harm.

The rules are the contract's.  The blocked prefixes are the caller's: ``BLOCKED`` is a short stand-in, as no
real list comes with the library, and ``read_list`` reads one from text files.

A rule fits its host and all subdomains if the url's path starts with the rule's path; the longest
fitting rule wins, of equally long ones that with the longer host.  Where no rule fits, a fitting
blocked prefix means ``block``, else ``allow``.

Edge cases: a null url, or one without ``://``, has an empty host and path, no rule, and the verdict
``allow``; repeated rows and repeated page_ids are judged one by one; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import shared_dir

# Fixed values of the contract.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: The method's own list: prefixes that are blocked where no rule fits.
BLOCKED_SITES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED = tuple(f"{site}.example.{top}/" for site in BLOCKED_SITES for top in ("com", "net", "org"))
#: Entries of one index file, about 60 bytes each; entries with the same key stay together.
SHARD = 500_000

#: How an entry is stored.
ALLOW_RULE, BLOCK_RULE, BLOCKED_PREFIX = 0, 1, 2

PATTERN = re.compile(r"(?s).*?://([^/?#]*)([^?#]*)")
LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    found = PATTERN.match(url) if url else None
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def entries_of(rules: Iterable[tuple[str, str]], blocked: Iterable[str]) -> list[tuple[str, int]]:
    """Distinct entries; of contradictory rules ``block`` holds.  A prefix without a path gets ``/``."""
    out: dict[tuple[str, bool], int] = {}
    for text, verdict in rules:
        kind = BLOCK_RULE if verdict == "block" else ALLOW_RULE
        out[text, True] = max(kind, out.get((text, True), kind))
    for text in blocked:
        out[text if "/" in text else f"{text}/", False] = BLOCKED_PREFIX
    return [(text, kind) for (text, _), kind in out.items()]


def read_list(spark: SparkSession, path: str) -> list[str]:
    """Prefixes from text files: one a line; empty lines and those that begin with ``#`` don't count."""
    lines = spark.read.text(path).select(F.trim("value").alias("x")).where("x <> '' and not startswith(x, '#')").distinct()
    return [r["x"] for r in lines.toLocalIterator()]


def pack_index(entries: list[tuple[str, int]], digest=xxhash.xxh64_intdigest, shard: int = SHARD) -> list[bytes]:
    """Files ``b"UDX1" | u64 n | u32 n_lengths | u32 lengths | u64 key[n] | u64 offset[n+1] | u8 kind[n] | strings``, by ranges of keys."""
    rows = sorted((digest(text.encode()), text.encode(), kind) for text, kind in entries)
    lengths = np.array(sorted({len(text) - text.index("/") for text, _ in entries}), "<u4")
    out, at = [], 0
    while at < len(rows) or not out:
        end = min(at + shard, len(rows))
        while end < len(rows) and rows[end][0] == rows[end - 1][0]:
            end += 1
        some = rows[at:end]
        keys = np.array([r[0] for r in some], "<u8")
        offsets = np.cumsum([0, *(len(r[1]) for r in some)]).astype("<u8")
        kinds = np.array([r[2] for r in some], np.uint8)
        head = b"UDX1" + struct.pack("<QI", len(some), len(lengths)) + lengths.tobytes()
        out.append(b"".join([head, keys.tobytes(), offsets.tobytes(), kinds.tobytes(), *(r[1] for r in some)]))
        at = end
    return out


class Index:
    """A packed index, memory-mapped."""

    def __init__(self, path: str, digest=xxhash.xxh64_intdigest) -> None:
        self.raw = np.memmap(path, np.uint8, "r")
        if self.raw[:4].tobytes() != b"UDX1":
            raise ValueError("not a digest index")
        n, m = struct.unpack("<QI", self.raw[4:16].tobytes())
        self.lengths = self.raw[16 : (at := 16 + 4 * m)].view("<u4").tolist()
        self.keys = np.frombuffer(self.raw, "<u8", n, at)
        self.offsets = np.frombuffer(self.raw, "<u8", n + 1, at + 8 * n)
        self.kinds = np.frombuffer(self.raw, np.uint8, n, at + 16 * n + 8)
        self.strings = at + 17 * n + 8
        self.digest = digest

    def find(self, candidates: list[bytes], keys: np.ndarray, some: np.ndarray) -> list[tuple[int, int]]:
        """(candidate, kind) for each entry whose string is the candidate's, of ``some`` candidates."""
        low = np.searchsorted(self.keys, keys[some], "left")
        high = np.searchsorted(self.keys, keys[some], "right")
        out = []
        for j in np.flatnonzero(high > low).tolist():
            c = int(some[j])
            for k in range(int(low[j]), int(high[j])):
                a, b = int(self.offsets[k]), int(self.offsets[k + 1])
                if self.raw[self.strings + a : self.strings + b].tobytes() == candidates[c]:
                    out.append((c, int(self.kinds[k])))
        return out


class Shards:
    """Several indexes, by ranges of keys."""

    def __init__(self, paths: Iterable[str], digest=xxhash.xxh64_intdigest) -> None:
        self.parts = [Index(p, digest) for p in paths]
        self.lengths = self.parts[0].lengths
        self.lows = np.array([p.keys[0] if len(p.keys) else 0 for p in self.parts], "<u8")
        self.digest = digest

    def find(self, candidates: list[bytes]) -> list[tuple[int, int]]:
        keys = np.fromiter(map(self.digest, candidates), "<u8", len(candidates))
        of = np.maximum(np.searchsorted(self.lows, keys, "right") - 1, 0)
        return [x for k in np.unique(of).tolist() for x in self.parts[k].find(candidates, keys, np.flatnonzero(of == k))]


@functools.cache
def _shards(names: tuple[str, ...]) -> Shards:
    return Shards([SparkFiles.get(name) for name in names])


def candidates_of(host: str, path: str, lengths: list[int]) -> Iterator[str]:
    """The host and each parent domain with each prefix of the path that has an indexed length."""
    ends = [n for n in lengths if n <= len(path)]
    at = 0
    while True:
        for n in ends:
            yield host[at:] + path[:n]
        if (at := host.find(".", at) + 1) == 0:
            return


#: Bytes handed to the JVM at once.
WRITTEN = 1 << 22


def publish(spark: SparkSession, packed: list[bytes]) -> tuple[str, ...]:
    """Puts the index files in the shared folder, from where executors fetch them; returns their names."""
    names = []
    for raw in packed:
        names.append(f"url-index-{uuid.uuid4().hex}.bin")
        where = f"{shared_dir(spark).rstrip('/')}/codeloom/{names[-1]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        for at in range(0, len(raw), WRITTEN):
            out.write(bytearray(raw[at : at + WRITTEN]))
        out.close()
        spark.sparkContext.addFile(where)
    return tuple(names)


SCHEMA = "page_id long, host string, path string, rule string, verdict string, listed string"


def judge(spark: SparkSession, pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, blocked: Iterable[str] = BLOCKED, shard: int = SHARD) -> DataFrame:
    """A row for each page: host, path, the rule that wins, the verdict, and the blocked prefix that fits."""
    names = publish(spark, pack_index(entries_of(rules, blocked), shard=shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _shards(names)
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            probes: list[bytes] = []
            hosts: list[int] = []
            of: list[int] = []
            for k, (host, path) in enumerate(parts):
                for x in candidates_of(host, path, index.lengths) if path else ():
                    probes.append(x.encode())
                    hosts.append(x.index("/"))
                    of.append(k)
            best: list[tuple[int, int, str, int]] = [(-1, -1, "", -1)] * len(parts)
            listed: list[str | None] = [None] * len(parts)
            for c, kind in index.find(probes):
                text, k = probes[c].decode(), of[c]
                if kind != BLOCKED_PREFIX:
                    best[k] = max(best[k], (len(text), hosts[c], text, kind))
                elif listed[k] is None or (len(listed[k]), listed[k]) < (len(text), text):
                    listed[k] = text
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column(0),
                "host": pa.array([h for h, _ in parts], pa.string()),
                "path": pa.array([p for _, p in parts], pa.string()),
                "rule": pa.array([b[2] if b[3] >= 0 else None for b in best], pa.string()),
                "verdict": pa.array(["block" if b[3] == BLOCK_RULE or b[3] < 0 and x is not None else "allow" for b, x in zip(best, listed)], pa.string()),
                "listed": pa.array(listed, pa.string()),
            })

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(run, SCHEMA)
