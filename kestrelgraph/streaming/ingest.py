"""Streams: deduplicated turns, windowed counts that allow for late events, and fact batches run through a cycle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kestrelgraph.runtime import remove


def once_within(turns: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """A stream with each identified row once, for copies that arrive within the delay; others pass.

    Rows without an identifier are given one of their own, so that all stay.
    """
    own = F.when(F.col(key).isNotNull() & (F.col(key) != ""), F.concat(F.lit("k"), F.col(key))).otherwise(F.concat(F.lit("r"), F.expr("uuid()")))
    return turns.withColumn("__key", own).withWatermark(at, delay).dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def windowed(events: DataFrame, at: str, kind: str, value: str, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """(start, kind, n, total): counts and sums by event-time window; windows close once the watermark has passed."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    agg = events.withWatermark(at, delay).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return agg.select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, at: str, entity: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """(entity, start, end, n): runs of an entity's events that are no further apart than the gap."""
    agg = events.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), entity).agg(F.count("*").alias("n"))
    return agg.select(entity, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def cycle(stream: DataFrame, jobs: dict[int, Callable[[DataFrame, int], None]], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run jobs on micro-batches: the job of period k at every k-th batch, on the rows of all batches since its last run.

    A job gets the rows and the batch's number. What a longer period still has to see is kept as files beside the
    checkpoint, by batch, until its job has run; a batch that is repeated after a failure writes the same files.
    """
    held = f"{checkpoint}/held"
    seen_by_all = lambda n: min(n - n % k for k in jobs) if n >= 0 else -1

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = lambda n: f"{held}/batch={n}"
        batch.write.mode("overwrite").parquet(place(number))
        for period in sorted(jobs):
            if number % period == 0:
                seen = [place(n) for n in range(max(0, number - period + 1), number + 1)]
                jobs[period](spark.read.schema(batch.schema).parquet(*seen), number)
        for n in range(seen_by_all(number - 1) + 1, seen_by_all(number) + 1):
            remove(spark, place(n))

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="3 seconds")).start()
