"""Structured Streaming forms of the claim flows: sources, counters and idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from adjudica.functions.scalar import remedy
from adjudica.sources.keyed_table import KeyedTable, largest


def cdc_source(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """New files of a table as a stream; the query's checkpoint remembers what was read. `path` may be a pattern."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


@contextmanager
def set_for(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold for a while."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, settings: dict[str, str] | None = None) -> StreamingQuery:
    """All that is there now, in micro-batches; a batch that is run again has the number it had before. A query takes the
    session's settings when it starts: `settings` hold for this one alone."""
    with set_for(stream.sparkSession, settings or {}):
        query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def batch_sink(path: str, transform: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Writes transform(batch) to a folder of its own for every batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def hourly_counters(events: DataFrame, watermark: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Processed and value sum per hour of event time and name. Later rows than the watermark are dropped."""
    hour = F.window("at", "1 hour", slide) if slide else F.window("at", "1 hour")
    sums = events.withWatermark("at", watermark).groupBy(hour.alias("hour"), "name").agg(F.count(F.lit(1)).alias("processed"), F.sum(F.col("value").cast("decimal(20,6)")).alias("total"))
    return sums.select(F.col("hour.start").alias("hour"), "name", "processed", F.col("total").cast("double").alias("total"))


def checkpoints(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """(claim_id, stage) with the latest time of both."""
    return existing.unionByName(batch).groupBy("claim_id", "stage").agg(F.max("checkpoint_at").alias("checkpoint_at"))


class CheckpointSink:
    """Merges micro-batches of (claim_id, stage, checkpoint_at) into a keyed table, of which each batch writes its own rows
    and now and then a bucket. A batch that is run again changes nothing."""

    def __init__(self, path: str, schema: str = "claim_id long, stage string, checkpoint_at timestamp_ntz", buckets: int = 16) -> None:
        self.path, self.schema, self.buckets = path, schema, buckets

    def keyed(self, spark: SparkSession) -> KeyedTable:
        return KeyedTable(spark, self.path, self.schema, ("claim_id", "stage"), self.buckets, {"checkpoint_at": largest})

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.keyed(batch.sparkSession).merge(batch, "checkpoints", number)

    def table(self, spark: SparkSession) -> DataFrame:
        return self.keyed(spark).read()


def counted_hours(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Processed and value sum per hour and name, each hour once, when the watermark has passed it. events: event_id, name,
    at, value. Events that are delivered again within the watermark count once; later ones than the watermark are dropped
    row by row before anything is summed, so that the stream's progress tells their number (see late_rows). The engine holds
    a micro-batch's rows against the watermark that the batch before it started with."""
    once = events.withWatermark("at", watermark).dropDuplicates(["event_id", "at"])
    sums = once.groupBy(F.window("at", "1 hour").alias("hour"), "name").agg(F.count(F.lit(1)).alias("processed"), F.sum(F.col("value").cast("decimal(20,6)")).alias("total"))
    return sums.select(F.col("hour.start").alias("hour"), "name", "processed", F.col("total").cast("double").alias("total"))


def late_rows(query: StreamingQuery) -> dict[int, int]:
    """Rows that each micro-batch dropped as late, where some were. The query remembers the last hundred batches
    (spark.sql.streaming.numRecentProgressUpdates)."""
    late = {p["batchId"]: sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"]) for p in query.recentProgress}
    return {batch: n for batch, n in late.items() if n}


def run_counted_hours(events: DataFrame, hours: KeyedTable, late: KeyedTable, checkpoint: str, watermark: str = "1 hour") -> StreamingQuery:
    """All that is there now: closed hours into `hours` (hour, name, processed, total), numbers of late rows into `late`
    (batch, late_rows). What is in both, and what is still open, are all events."""
    query = drain(counted_hours(events, watermark), lambda batch, number: hours.merge(batch, "hours", number), checkpoint)
    found = late_rows(query)
    if found:
        late.merge(events.sparkSession.createDataFrame(list(found.items()), "batch long, late_rows long"))
    return query


def error_windows(validated: DataFrame, length: str, at: str = "created_at", watermark: str = "1 day") -> DataFrame:
    """Errors per stretch of event time: start, error, n. As a stream, a stretch is forgotten once the watermark passed it."""
    own = validated.withWatermark(at, watermark).withColumn("error", F.explode("errors"))
    counts = own.groupBy(F.window(at, length).alias("stretch"), "error").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("stretch.start").alias("start"), "error", "n")


def pattern_watch(counts: DataFrame, threshold: int, alert: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = "300 seconds", mode: str = "update") -> StreamingQuery:
    """Hands the errors at or above the threshold to `alert`, with a remedy, at most once an interval; without an interval
    all that is there now. counts: error_windows of a stream (update: the stretches that changed; complete: all)."""
    watch = lambda batch, number: alert(batch.where(F.col("n") >= threshold).withColumn("remedy", remedy(F.col("error"))), number)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return counts.writeStream.outputMode(mode).foreachBatch(watch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
