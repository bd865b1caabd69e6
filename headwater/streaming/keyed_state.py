"""News as arbitrary keyed state: each micro-batch touches the keys that it holds, and each key expires by its own timer.

The state of a key lives in the RocksDB store of its partition and is merged row by row; nothing else is read or written.
A key leaves ``ttl`` after it was first seen, by the clock or, for replays, by event time. What leaves the operator are
changed keys only: an upsert with the key's whole row, or that it expired. ``expiring_news`` applies the changes of each
micro-batch to a versioned table, which rewrites the touched buckets alone, and restarts from its checkpoint.

Merge rules are those of ``state.upsert_news``: they keep the sequence number of each value, so the order in which rows of a
batch arrive never shows. A row for a key that has expired starts the key anew. Defined cases: a null id is dropped, as no
state can be kept for it; null titles, images and heats never replace a value, except that a later null title does; rows later
than the watermark are dropped (event time only); an empty source leaves the table as it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from headwater.sources.tables import work_dir
from headwater.sources.versioned import BucketTable
from headwater.streaming.micro_batches import NEWS

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "title string, title_seq long, image string, image_seq long, url string, url_seq long, first_ms long, heat double"
CHANGES = "id long, op string, title string, image string, url string, first_ms long, heat double"


class NewsProcessor(StatefulProcessor):
    """One value and one timer a key."""

    def __init__(self, ttl_ms: int, by_clock: bool):
        self.ttl_ms, self.by_clock = ttl_ms, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.news = handle.getValueState("news", _STATE)

    def _schedule(self, before: int | None, first: int, now: int) -> None:
        """By the clock the timer runs from the batch that brought the key; by event time from its earliest row."""
        if self.by_clock:
            if before is None:
                self.handle.registerTimer(now + self.ttl_ms)
        elif before is None or first < before:
            if before is not None:
                self.handle.deleteTimer(before + self.ttl_ms)
            self.handle.registerTimer(first + self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.news.get() if self.news.exists() else None
        title, title_seq, image, image_seq, url, url_seq, first, heat = kept or (None, None, None, None, None, None, None, None)
        for r in rows:
            if title_seq is None or r.seq > title_seq:
                title, title_seq = r.title, r.seq
            if r.image and (image_seq is None or r.seq > image_seq):
                image, image_seq = r.image, r.seq
            if url_seq is None or r.seq < url_seq:
                url, url_seq = r.url, r.seq
            first = r.ts_ms if first is None else min(first, r.ts_ms)
            heat = r.heat if heat is None else heat if r.heat is None else max(heat, r.heat)
        self._schedule(kept[6] if kept else None, first, timerValues.getCurrentProcessingTimeInMs())
        self.news.update((title, title_seq, image, image_seq, url, url_seq, first, heat))
        yield Row(id=key[0], op="upsert", title=title, image=image, url=url, first_ms=first, heat=heat)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.news.exists():
            self.news.clear()
            yield Row(id=key[0], op="expired", title=None, image=None, url=None, first_ms=None, heat=None)

    def close(self) -> None:
        pass


@contextmanager
def _rocksdb(spark: SparkSession):
    """Queries that start within keep their state in RocksDB; the session's setting comes back."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def changed_news(source: DataFrame, ttl_ms: int, by_clock: bool = True, delay: str = "1 day") -> DataFrame:
    """The stream of changed keys (``CHANGES``) of a stream (id, seq, ts, title, image, url, heat)."""
    rows = source.where("id is not null and seq is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    if not by_clock:
        rows = rows.withWatermark("ts", delay)
    told = rows.withColumn("ts_ms", F.unix_millis("ts"))
    return told.groupBy("id").transformWithState(NewsProcessor(ttl_ms, by_clock), CHANGES, "Update", "ProcessingTime" if by_clock else "EventTime")


def once(by_clock: bool) -> dict[str, bool]:
    """The trigger of a start that ends."""
    return {"once": True} if by_clock else {"availableNow": True}


def apply_changes(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Old rows without the changed keys, and the new rows of those that did not expire. Within a batch timers come last."""
    last = changes.groupBy("id").agg(F.max_by(F.struct(*[c for c in changes.columns if c != "id"]), F.when(F.col("op") == "expired", 1).otherwise(0)).alias("c"))
    new = last.where("c.op = 'upsert'").select("id", "c.title", "c.image", "c.url", F.timestamp_millis("c.first_ms").alias("first_seen"), "c.heat")
    return old.join(last.select("id"), "id", "left_anti").select(*new.columns).unionByName(new)


def expiring_news(spark: SparkSession, source: DataFrame, path: str | None = None, days: float = 30, by_clock: bool = True, delay: str = "1 day", buckets: int = 64, keep: int = 3) -> BucketTable:
    """Runs what is available and returns the table of keys that have not expired.

    A key whose timer has run leaves with the first micro-batch after that. By the clock a start is one micro-batch: a
    query with timers by the clock always wants another batch, so it would never be through with what is available.
    """
    path = path or f"{work_dir(spark)}/expiring-{uuid.uuid4().hex}"
    news = BucketTable(spark, f"{path}/news", "id", NEWS, buckets, "first_seen")

    def write(batch: DataFrame, number: int) -> None:
        if news.merge(batch, apply_changes, "stream", number)["changed"]:
            news.collect(keep)

    changes = changed_news(source, round(days * 86_400_000), by_clock, delay)
    with _rocksdb(spark):
        query = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(**once(by_clock)).start()
        query.awaitTermination()
    return news
