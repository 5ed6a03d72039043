"""Helpers shared by the corpus operators: reading, shared scratch tables, Arrow chunks.

Scratch tables are Parquet folders below ``spark.checkpoint.dir`` (the folder that every
executor shares).  They survive lost executors, cut lineage and are columnar, so they take
less disk than ``checkpoint()``.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the corpus contracts: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"

#: A side with at most so many 8-byte keys (about 64 MB as a hash table) may be broadcast.
BROADCAST_KEYS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder of our own, but on a local master only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='codeloom-')}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


class Scratch:
    """A folder of temporary tables of one operator call.

    Results are lazy and read it, so who takes the result drops it; what is left goes when the process ends.
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/codeloom/{name}-{uuid.uuid4().hex}"
        self.count = 0
        Scratch.made.append(self)
        if (block := _block.get()) is not None:
            block.append(self)

    def place(self) -> str:
        self.count += 1
        return f"{self.path}/{self.count}"

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes the frame once and reads it back."""
        where = self.place()
        df.write.option("compression", "zstd").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        if self in Scratch.made:
            Scratch.made.remove(self)


#: Where a block collects the scratch that it makes; of its own thread only.
_block: contextvars.ContextVar[list[Scratch] | None] = contextvars.ContextVar("block", default=None)


@contextlib.contextmanager
def scratch_of_block() -> Iterator[None]:
    """Drops what scratch is made inside at the end: for blocks that write their result elsewhere."""
    made: list[Scratch] = []
    token = _block.set(made)
    try:
        yield
    finally:
        _block.reset(token)
        for scratch in made:
            scratch.drop()


@atexit.register
def _drop_all() -> None:
    for scratch in list(Scratch.made):
        with contextlib.suppress(Exception):  # the JVM may have gone
            scratch.drop()


def fits_broadcast(keys: DataFrame, most: int = BROADCAST_KEYS) -> bool:
    """Whether a frame of fixed-width rows is small enough to be broadcast (counts ``most`` + 1 at most)."""
    return keys.limit(most + 1).count() <= most


def join_keys(df: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join with a table of keys: broadcast behind a check of its size, else shuffled (AQE splits hot keys)."""
    return df.join(F.broadcast(keys) if fits_broadcast(keys) else keys, on, how)


def give_back() -> None:
    """Gives this process's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition function after which the worker gives its free memory back.

    Workers serve many tasks, and beside them the executor's heap needs the room.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


#: Rows of one Arrow batch where rows carry whole texts.
TEXT_ROWS = 1000


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """For a session whose rows carry whole texts: batches of ``TEXT_ROWS`` rows, unless smaller ones are set.

    Spark's 10,000 rows of text are held several times over, in the executor and in each of its workers.
    """
    now = int(spark.conf.get(BATCH_ROWS))
    if not 0 < now <= TEXT_ROWS:
        spark.conf.set(BATCH_ROWS, str(TEXT_ROWS))


@contextlib.contextmanager
def own_batches(spark: SparkSession) -> Iterator[None]:
    """Puts the session's batch size back at the end."""
    now = spark.conf.get(BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, now)


#: Rows that Spark's Parquet reader decodes at once where rows carry whole texts.
READ_ROWS = 500


@contextlib.contextmanager
def small_reads(spark: SparkSession) -> Iterator[None]:
    """For queries that run inside: ``READ_ROWS`` rows at once, unless fewer are set; Spark's 4,096 make large arrays in the executor's heap."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    now = spark.conf.get(name)
    spark.conf.set(name, str(min(int(now), READ_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(name, now)


#: Bytes of text of which a vectorised pass makes arrays at once (some eighty bytes for each).
PASS_BYTES = 1 << 18


def text_chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices record batches so that one holds about ``most`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).cumsum()
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def flat_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column with a newline after each row, and the rows' starts (one more at the end).

    Nulls count as empty.
    """
    col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    lens = np.diff(offsets)
    starts = np.concatenate([[0], np.cumsum(lens + 1)])
    out = np.full(starts[-1], 10, np.uint8)
    mask = np.ones(starts[-1], bool)
    mask[starts[1:] - 1] = False
    out[mask] = raw
    return out, starts


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3, over unsigned 64-bit numbers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
