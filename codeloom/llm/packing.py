"""Operator 2: variable-capacity best-fit packing into several permitted sequence lengths.

A document of more tokens than the largest length is cut into pieces of that length and a rest, so
nothing is dropped.  Pieces are dealt evenly to tasks, and each task packs them chunk by chunk (``CHUNK``
pieces, longest first), so memory is bounded whatever the table's size or its largest document, and the
number of tasks is, too (``MOST_TASKS``).

A piece goes into the open bin with the least sufficient room.  If there is none, a bin is opened for it:
for each permitted length that holds the piece it is looked ahead how the pieces still to be packed would
fill the rest of it (the largest that fits, again and again), and the length with the least cost per token
of those contents is opened.  So a length above the least sufficient one is opened where the pieces at
hand fill it better.  At the end every bin is downsized to the least permitted length that holds its
contents.  A chunk's packing is never dearer than with the least sufficient length opened each time:
that is done as well, and the cheaper of the two stays.

A bin of c tokens costs ``c * (1 + attention * c / longest) + overhead``.

Edge cases: lengths that are null or below 1 make no piece; repeated rows are pieces of their own;
equal lengths are ordered by doc_id and piece; an empty table gives no rows; a null doc_id is packed
like any other.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTHS = (512, 1024, 2048, 4096, 8192)
ATTENTION = 0.25
OVERHEAD = 16.0
#: Pieces packed together, and what a task is given, unless there would be too many tasks.
CHUNK = 10_000
MOST_TASKS = 20_000
#: Different sizes that looking ahead puts into a bin at most.
LOOK = 12

SCHEMA = "doc_id long, piece int, first_token long, n_tokens long, bin_id long, bin_length int, bin_offset int"


def cost_of(length: int, longest: int, attention: float = ATTENTION, overhead: float = OVERHEAD) -> float:
    return length * (1 + attention * length / longest) + overhead


def _planned(size: int, length: int, sizes: list[int], left: dict[int, int]) -> int:
    """Contents of a new bin of this length, begun with the piece, if the largest pieces that fit follow.

    ``sizes``: the distinct sizes still to be packed, rising; ``left``: how many there are of each.
    """
    room, below = length - size, len(sizes)
    for _ in range(LOOK):
        below = bisect.bisect_right(sizes, room, 0, below)
        if not below:
            break
        other = sizes[below - 1]
        room -= other * min(room // other, left[other] - (other == size))
        below -= 1  # smaller ones next
    return length - room


def _fill(falling: list[int], lengths: tuple[int, ...], costs: dict[int, float], ahead: bool) -> tuple[list[int], list[int], list[int], list[int]]:
    """Best fit of sizes that fall: each piece's bin and offset, the bins' contents and the lengths they were opened with."""
    rooms: list[tuple[int, int]] = []  # (room, bin) of open bins
    left = dict(Counter(falling))
    sizes = sorted(left)
    used: list[int] = []
    opened: list[int] = []
    bins, offsets = [], []
    for size in falling:
        at = bisect.bisect_left(rooms, (size, -1))
        if at < len(rooms):
            b = rooms.pop(at)[1]
        else:
            length = lengths[bisect.bisect_left(lengths, size)]
            if ahead:
                plans = [(c, _planned(size, c, sizes, left)) for c in lengths if c >= size]
                length = min(plans, key=lambda p: (costs[lengths[bisect.bisect_left(lengths, p[1])]] / p[1], p[0]))[0]
            b = len(used)
            used.append(0)
            opened.append(length)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        left[size] -= 1
        if not left[size]:
            sizes.pop()  # the largest
        if opened[b] > used[b]:
            bisect.insort(rooms, (opened[b] - used[b], b))
    return bins, offsets, used, opened


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, attention: float = ATTENTION, overhead: float = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in it and the downsized length of it for each piece (1 <= size <= longest)."""
    if not len(sizes):
        return (np.zeros(0, np.int64),) * 3
    lengths = tuple(sorted(set(lengths)))
    costs = {c: cost_of(c, lengths[-1], attention, overhead) for c in lengths}
    order = np.argsort(-sizes, kind="stable")
    best = None
    for ahead in (True, False):
        bins, offsets, used, _ = _fill(sizes[order].tolist(), lengths, costs, ahead)
        final = [lengths[bisect.bisect_left(lengths, u)] for u in used]
        total = sum(costs[c] for c in final)
        if best is None or total < best[0]:
            best = (total, bins, offsets, final)
    _, bins, offsets, final = best
    out = np.empty((3, len(sizes)), np.int64)
    out[0, order], out[1, order] = bins, offsets
    out[2, order] = np.array(final)[bins]
    return out[0], out[1], out[2]


def pack_documents(sizes: DataFrame, lengths: tuple[int, ...] = LENGTHS, attention: float = ATTENTION, overhead: float = OVERHEAD, chunk: int = CHUNK, most_tasks: int = MOST_TASKS) -> DataFrame:
    """A row for each piece of each document of ``sizes`` (doc_id, n_tokens): its bin, the bin's length and the offset."""
    longest = max(lengths)
    sizes = sizes.select(F.col("doc_id").cast("long"), F.col("n_tokens").cast("long")).where("n_tokens > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(longest).cast("long")))
    pieces = sizes.select("doc_id", "n_tokens", starts.alias("first_token"))
    pieces = pieces.select("doc_id", (F.col("first_token") / longest).cast("int").alias("piece"), "first_token", F.least(F.lit(longest), F.col("n_tokens") - F.col("first_token")).alias("n_tokens"))
    tasks = max(1, min(most_tasks, -(-pieces.count() // chunk)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # bins of one task never meet those of another: task, chunk and bin make the id
        base, held, rows = TaskContext.get().partitionId() << 40, [], 0
        used = 0

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal used
            table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
            bins, offsets, final = pack(np.asarray(table.column("n_tokens")), lengths, attention, overhead)
            table = table.append_column("bin_id", pa.array(base + used + bins)).append_column("bin_length", pa.array(final.astype(np.int32))).append_column("bin_offset", pa.array(offsets.astype(np.int32)))
            used += int(bins.max()) + 1
            yield from table.combine_chunks().to_batches()

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, chunk - rows)
                held.append(part)
                rows += part.num_rows
                at += part.num_rows
                if rows == chunk:
                    yield from flush(pa.Table.from_batches(held))
                    held, rows = [], 0
        if rows:
            yield from flush(pa.Table.from_batches(held))

    return pieces.repartition(tasks).mapInArrow(run, SCHEMA)
