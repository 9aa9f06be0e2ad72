"""Streams: stopping after refusals in order of arrival or of time, run changes, and link frontiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import Row

from ..operators.storage import fresh_path, remove

STOP_AFTER = 3
#: Statuses that end a run.
TERMINAL = ("completed", "failed", "cancelled", "interrupted", "blocked")


def refusal_stops(events: DataFrame, key: str, order: str, refused: str, stop_after: int = STOP_AFTER) -> DataFrame:
    """(key, stopped_at) once per key, when its refusals in a row reach `stop_after`.

    State per key is the streak and whether it has stopped. Within a micro-batch events are put in
    order; order between micro-batches is that of arrival.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, stopped = state.get if state.exists else (0, False)
        at = None
        for row in pd.concat(list(frames)).sort_values(order).itertuples():
            streak = streak + 1 if getattr(row, refused) else 0
            if streak >= stop_after and not stopped:
                stopped, at = True, getattr(row, order)
        state.update((streak, stopped))
        if at is not None:
            yield pd.DataFrame({key: [k[0]], "stopped_at": [at]})

    kinds = dict(events.dtypes)
    return (
        events.select(key, order, refused)
        .groupBy(key)
        .applyInPandasWithState(run, f"{key} {kinds[key]}, stopped_at {kinds[order]}", "streak int, stopped boolean", "append", GroupStateTimeout.NoTimeout)
    )


class StopInTime(StatefulProcessor):
    """A key's events wait until the watermark has passed them, then count in the order of their time (ties by `tie`).

    State: the events that wait, the streak so far and whether the key has stopped. A timer stands at the earliest event
    that waits; after the stop nothing is kept. What comes after the watermark has passed it is late, and dropped.
    """

    def __init__(self, stop_after: int):
        self.stop_after = stop_after

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, tie long, refused boolean")
        self.so_far = handle.getValueState("so_far", "streak int, stopped boolean")

    def _wake(self, events: list) -> None:
        """At the millisecond that the first of the events is in."""
        self.handle.registerTimer(-(-min(e[0] for e in events) // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000  # 0: none yet
        fresh = [(r["__at"], r["__tie"], bool(r["__refused"])) for r in rows if r["__at"] is not None and (mark <= 0 or r["__at"] > mark)]
        if fresh and not (self.so_far.exists() and self.so_far.get()[1]):
            self.waiting.appendList(fresh)
            self._wake(fresh)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        events = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        streak, stopped = self.so_far.get() if self.so_far.exists() else (0, False)
        due, rest = sorted(e for e in events if e[0] <= until), [e for e in events if e[0] > until]
        for at, _, refused in () if stopped else due:
            streak = streak + 1 if refused else 0
            if streak == self.stop_after:
                stopped, rest = True, []
                yield Row(key=key[0], at=at)
                break
        self.so_far.update((streak, stopped))
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self._wake(rest)


def refusal_stops_in_time(events: DataFrame, key: str, time: str, refused: str, tie: str, late: str = "10 minutes", stop_after: int = STOP_AFTER) -> DataFrame:
    """(key, stopped_at) once per key: the time of the event by which its refusals in a row reach `stop_after`.

    However the events arrive, the result is that of their order in time, as long as none is later than `late`; those that
    are do not count. A stop is said once the watermark has passed it. Events without a time do not count.
    """
    kind = dict(events.dtypes)[key]
    marked = events.select(F.col(key).alias("key"), F.col(time).alias("__time"), F.unix_micros(time).alias("__at"), F.col(tie).cast("long").alias("__tie"), F.coalesce(F.col(refused), F.lit(False)).alias("__refused"))
    found = marked.withWatermark("__time", late).groupBy("key").transformWithState(StopInTime(stop_after), f"key {kind}, at long", "Append", "EventTime")
    return found.select(F.col("key").alias(key), F.timestamp_micros("at").alias("stopped_at"))


def run_changes(updates: DataFrame, push: Callable[[DataFrame], None], checkpoint: str):
    """Pushes each run's newest state of a micro-batch, where it says something new.

    updates: run_id, status, payload, seq (a stream). The query's checkpoint is the memory across
    restarts; a payload pushed twice after a restart is the same payload.
    """

    def batch(df: DataFrame, _: int) -> None:
        newest = df.groupBy("run_id").agg(F.max_by(F.struct("status", "payload", "seq"), "seq").alias("r")).select("run_id", "r.*")
        push(newest.withColumn("terminal", F.col("status").isin(*TERMINAL)))

    return updates.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def crawl_order(links: DataFrame, seeds: DataFrame, path: str | None = None, buckets: int = 256) -> DataFrame:
    """(url, depth) of what can be reached over links (source, target) from the seeds, breadth first.

    What is known lies in hash buckets of the urls, to which each level is appended; nothing is rewritten. A level joins the
    newest pages with the links and drops what is known, reading only the buckets that its findings are in, until it
    finds nothing new. To the driver come the numbers of buckets and whether a level is empty.
    """
    spark = links.sparkSession
    path = path or fresh_path(spark, "reached")
    bucket = F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")
    schema = "url string, depth int, bucket int"
    known = lambda: spark.read.schema(schema).parquet(path)
    add = lambda df, depth: df.select("url", F.lit(depth).alias("depth"), bucket.alias("bucket")).write.mode("append").partitionBy("bucket", "depth").parquet(path)
    add(seeds.select("url").where("url IS NOT NULL").distinct(), 0)
    for depth in count(1):
        frontier = known().where(F.col("depth") == depth - 1)
        found = links.join(frontier.select(F.col("url").alias("source")), "source").select(F.col("target").alias("url")).where("url IS NOT NULL").distinct()
        at = fresh_path(spark, "found")
        found.withColumn("bucket", bucket).write.parquet(at)
        found = spark.read.schema("url string, bucket int").parquet(at)
        touched = [r[0] for r in found.select("bucket").distinct().collect()]
        if touched:
            add(found.join(known().where(F.col("bucket").isin(touched)).select("url", "bucket"), ["bucket", "url"], "left_anti"), depth)
        remove(spark, at)
        if known().where(F.col("depth") == depth).isEmpty():
            return known().select("url", "depth")
