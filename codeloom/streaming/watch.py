"""The change feed: session windows that debounce, coalescing, and a sink with retries.

A batch of changes closes when nothing has happened for the window's length after its last event.
Within a batch only what the events of a path amount to counts: created then deleted cancels; after
that, the last event says whether the path is to be read again or to go.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

EVENTS = "path string, kind string, ts timestamp"
#: Kind of events that only move the watermark, so that the last batch closes though nothing follows it.
TICK = "tick"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events (JSON lines) that a watcher drops into a folder."""
    return spark.readStream.schema(EVENTS).json(folder)


def debounced(events: DataFrame, window: str = "300 milliseconds", by: tuple[str, ...] = ()) -> DataFrame:
    """Batches: session windows over the events (of each ``by``, or of all), with their events in order."""
    # ticks have sessions of their own, so they prolong no batch
    feed = F.when(F.col("kind") == TICK, TICK).otherwise("").alias("feed")
    keys = [F.session_window("ts", window).alias("session"), *([F.col(c) for c in by] or [feed])]
    return events.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ts", "path", "kind"))).alias("events"))


def coalesced(batches: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each path of each batch whose events leave something: path and outcome.

    Needs no state of its own: a batch carries all its events.  They are sorted by path once, and each is
    compared with its neighbours only, so the work is linear in them.  The last event of a path says what
    becomes of it; a deletion cancels where the path's last event before it, changes aside, made the file.
    """
    known = F.filter("events", lambda e: e["kind"].isin("created", "modified", "deleted"))
    by_path = F.sort_array(F.transform(known, lambda e: F.struct(e["path"].alias("path"), e["ts"].alias("ts"), e["kind"].alias("kind"))))

    def marked(e: Column, i: Column) -> Column:
        after = F.get("sorted", i + 1)
        return F.struct(e["path"].alias("path"), e["kind"].alias("kind"), (after.isNull() | ~after["path"].eqNullSafe(e["path"])).alias("last"))

    def stays(e: Column, i: Column) -> Column:
        before = F.get("marked", i - 1)
        cancels = (e["kind"] == "deleted") & before.isNotNull() & before["path"].eqNullSafe(e["path"]) & (before["kind"] == "created")
        return e["last"] & ~F.coalesce(cancels, F.lit(False))

    ordered = batches.select("session", *keys, by_path.alias("sorted"))
    ends = ordered.select("session", *keys, F.filter(F.transform("sorted", marked), lambda e: (e["kind"] != "modified") | e["last"]).alias("marked"))
    each = ends.select("session", *keys, F.filter("marked", stays).alias("left")).select("session", *keys, F.explode("left").alias("of"))
    return each.select("session", *keys, "of.path", F.when(F.col("of.kind") == "deleted", "deleted").otherwise("modified").alias("outcome"))


def changes(events: DataFrame, window: str = "300 milliseconds", late: str = "1 second") -> DataFrame:
    """The streaming form: watermark, sessions, outcomes (append mode)."""
    return coalesced(debounced(events.withWatermark("ts", late), window))


@dataclass
class Backoff:
    """Waits 1, 2, 4 ... at most ``cap`` seconds between attempts."""

    first: float = 1.0
    cap: float = 30.0
    attempts: int = 8
    sleep: Callable[[float], None] = field(default=time.sleep)

    def run(self, work: Callable[[], None], retry_on: tuple[type[BaseException], ...]) -> bool:
        """Whether the work succeeded; other errors than ``retry_on`` are logged and the batch skipped."""
        wait = self.first
        for k in range(self.attempts):
            try:
                work()
                return True
            except retry_on as error:
                if k + 1 == self.attempts:
                    raise
                log.error("%s; next attempt in %.1fs", error, wait)
                self.sleep(wait)
                wait = min(wait * 2, self.cap)
            except Exception:
                log.exception("batch skipped")
                return False
        return False


def sink(update: Callable[[list[str]], int], embed: Callable[[], None] | None = None, backoff: Backoff | None = None, retry_on: tuple[type[BaseException], ...] = (ConnectionError,)) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: updates the batch's paths, then embeds unless a file did not parse.

    ``update`` takes the paths and returns how many files did not parse.
    """
    backoff = backoff or Backoff()

    def handle(batch: DataFrame, _epoch: int) -> None:
        paths = sorted({r["path"] for r in batch.select("path").distinct().collect()})
        if not paths:
            return
        broken: list[int] = []
        if backoff.run(lambda: broken.append(update(paths)), retry_on) and embed is not None and not broken[-1]:
            try:
                embed()
            except Exception as error:
                log.warning("embedding failed: %s", error)

    return handle


def start(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, window: str = "300 milliseconds", late: str = "1 second", **trigger):
    """Starts the feed; ``trigger`` as for ``DataStreamWriter.trigger`` (``availableNow=True``, ``processingTime=...``)."""
    writer = changes(events, window, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(**trigger) if trigger else writer).start()
