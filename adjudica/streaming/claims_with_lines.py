"""Claims and their lines as two feeds that are joined as they move.

Both sides carry `arrived_at`. A claim waits in state for the lines that arrive up to `within` after it; when the watermark
has passed that, it goes on with the summary of its lines (or none, if none came) and leaves the state. Each line is kept
only as long as a claim could ask for it: no micro-batch looks at the tables behind the feeds.

`process` keeps what waits in the engine's state, a lookup a row: for many small micro-batches. `process_backlog` keeps it in
files that are joined as wholes: for feeds that bring much at once, where a lookup a row costs many times the join.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from adjudica.operators import enrichment
from adjudica.sources.files import dealt, remove, tasks_for

from .claims_stream import drain, set_for

#: State lies in RocksDB, not on the heap, where every micro-batch copies the maps of all that waits; what changed is logged,
#: and the databases of an executor share one bounded memory.
_ROCKS = "spark.sql.streaming.stateStore"
STATE = {
    f"{_ROCKS}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_ROCKS}.rocksdb.changelogCheckpointing.enabled": "true", f"{_ROCKS}.rocksdb.boundedMemoryUsage": "true",
}


def claims_with_lines(claims: DataFrame, lines: DataFrame, rvu: DataFrame, within: str = "93 days", delay: str = "1 day", nested: bool = False) -> DataFrame:
    """Each claim once, with what enrichment.summarise says of its lines. claims and lines are streams with claim_id and
    arrived_at, at most `delay` out of order; ids are those of one claim each."""
    own = claims.withWatermark("arrived_at", delay)
    priced = enrichment.enrich(lines, rvu)
    sent = priced.select(*[F.col(c).alias(f"line_{c}") for c in priced.columns]).withWatermark("line_arrived_at", delay)
    soon = (F.col("line_arrived_at") >= F.col("arrived_at")) & (F.col("line_arrived_at") <= F.col("arrived_at") + F.expr(f"interval {within}"))
    joined = own.join(sent, (F.col("claim_id") == F.col("line_claim_id")) & soon, "left_outer")
    some = lambda c: F.when(F.count("line_claim_id") > 0, c)
    item = F.when(F.col("line_claim_id").isNotNull(), F.struct(*[F.col(f"line_{c}").alias(c) for c in enrichment.LINE]))
    more = [some(F.sort_array(F.collect_list(item))).alias("line_items")] if nested else []
    return joined.groupBy(*claims.columns).agg(
        F.min("line_service_from_date").alias("first_from"), F.max("line_service_to_date").alias("last_to"),
        some(F.count("line_claim_id")).alias("n_lines"), F.sum("line_reimbursement").alias("revenue"), *more,
    )


def process(claims: DataFrame, lines: DataFrame, rvu: DataFrame, each: Callable[[DataFrame, int], object], checkpoint: str, **how) -> StreamingQuery:
    """Hands the claims that are complete to `each`, micro-batch by micro-batch; heartbeats, which have no id, stay out."""
    whole = claims_with_lines(claims, lines, rvu, **how)
    return drain(whole, lambda batch, number: each(batch.where("claim_id is not null"), number), checkpoint, STATE)


#: What a micro-batch leaves to the next: the files that still matter (with their batch, the watermark that they met and their
#: last arrival), the last arrivals of both sides and the watermark; times in microseconds.
MARK = "file string, side string, batch long, past long, last long, claims_at long, lines_at long, watermark long"


def micros(value: int | None) -> Column:
    return F.timestamp_micros(F.lit(value).cast("long"))


class Backlog:
    """A foreachBatch sink over the files that arrive (see `arrivals`). Claims that the watermark has passed are joined with the
    lines of their time and handed to `each`. Rows wait in the files of the feeds, of which a file is read again only while it
    reaches into the time that is settled. A batch that is run again starts from the marks of the one before."""

    def __init__(self, claims: StructType, lines: StructType, rvu: DataFrame, each: Callable[[DataFrame, int], object], path: str, within: str = "93 days", delay: str = "1 day", nested: bool = False) -> None:
        self.kinds, self.rvu, self.each, self.path, self.nested = {"claims": claims, "lines": lines}, rvu, each, path, nested
        self.within, self.delay = F.expr(f"interval {within}"), F.expr(f"interval {delay}")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(MARK).parquet(f"{self.path}/batch={number - 1}").collect() if number else []
        past = before[0]["watermark"] if before else None
        new = [(unquote(r["file"]), r["side"], number, past, r["last"]) for r in batch.groupBy("file", "side").agg(F.max(F.unix_micros("arrived_at")).alias("last")).collect()]  # a row a file
        held = [tuple(r[:5]) for r in before if r["file"] is not None] + new
        seen = [max([at for _, s, _, _, at in new if s == side and at is not None] + [r[f"{side}_at"] for r in before[:1] if r[f"{side}_at"] is not None], default=None) for side in self.kinds]
        at = F.col("arrived_at")
        edge = lambda value: F.unix_micros(value).alias("t")
        mark = None if None in seen else spark.range(1).select(edge(micros(min(seen)) - self.delay)).first()["t"]
        if mark is not None:
            self.settle(self.rows(spark, "claims", held), self.rows(spark, "lines", held), micros(past), micros(mark), number)
            # a claim that waits or is still to come, and a line that one of these could ask for, are younger than this
            young = spark.range(1).select(edge(micros(mark) - self.within)).first()["t"]
            held = [f for f in held if f[4] is not None and f[4] > young]
        rows = [(*f, *seen, mark) for f in held] or [(None, None, None, None, None, *seen, mark)]
        spark.createDataFrame(rows, MARK).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def rows(self, spark: SparkSession, side: str, held: list[tuple]) -> DataFrame:
        """The rows of one side's files, without those that were late when they came: at or before the watermark then."""
        came: dict[tuple, list[str]] = {}
        for file, of, number, past, _ in held:
            if of == side:
                came.setdefault((number, past), []).append(file)
        parts = [spark.read.schema(self.kinds[side]).parquet(*files).where(F.coalesce(F.col("arrived_at") > micros(past), F.lit(True))) for (_, past), files in came.items()]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], self.kinds[side])

    def settle(self, claims: DataFrame, lines: DataFrame, past: Column, mark: Column, number: int) -> None:
        """Hands on the claims whose time for lines ended between two watermarks."""
        at = F.col("arrived_at")
        end = at + self.within
        due = claims.where(F.col("claim_id").isNotNull() & (end <= mark) & F.coalesce(end > past, F.lit(True)))
        sent = lines.where(F.col("claim_id").isNotNull() & (at <= mark) & F.coalesce(at > past - self.within, F.lit(True)))
        n = tasks_for(sent)
        priced = enrichment.enrich(sent, self.rvu).withColumnsRenamed({"claim_id": "_id", "arrived_at": "_at"})
        spans = dealt(due.select("claim_id", "arrived_at"), "claim_id", n).distinct()
        found = spans.join(dealt(priced, "_id", n), (F.col("claim_id") == F.col("_id")) & (F.col("_at") >= at) & (F.col("_at") <= end))
        due = due.repartition(n, "claim_id", "arrived_at") if n else due
        self.each(due.join(enrichment.summary(found.groupBy("claim_id", "arrived_at"), self.nested), ["claim_id", "arrived_at"], "left"), number)


def arrivals(claims: DataFrame, lines: DataFrame) -> DataFrame:
    """What arrives in both feeds: side, file (as a URL) and arrived_at of each row. Nothing else of the rows is read."""
    one = lambda rows, side: rows.select(F.lit(side).alias("side"), F.col("_metadata.file_path").alias("file"), "arrived_at")
    return one(claims, "claims").unionByName(one(lines, "lines"))


def process_backlog(claims: DataFrame, lines: DataFrame, rvu: DataFrame, each: Callable[[DataFrame, int], object], path: str, checkpoint: str, **how) -> StreamingQuery:
    """As `process`, for feeds in Parquet files that stay for the time of `delay` and `within`; marks lie under `path`. The
    watermark counts from the micro-batch that brings it, so claims leave one micro-batch sooner; rows at or before the
    watermark that the last one left are late and dropped."""
    return drain(arrivals(claims, lines), Backlog(claims.schema, lines.schema, rvu, each, path, **how), checkpoint)


def write_feed(rows: DataFrame, path: str, edges: list[datetime], files: int) -> None:
    """Rows as they would arrive: one period of arrived_at after the other, `files` files each. The first and the last
    period are open. The rows are computed once and laid out by period beside the feed, whose files are then written in turn."""
    at: Column = F.col("arrived_at")
    period = sum((F.when(at >= F.lit(edge), 1).otherwise(0) for edge in edges), F.lit(0))
    spark, laid = rows.sparkSession, f"{path}-by-period"
    own = (rows.where(at.isNotNull()) if edges else rows).withColumn("_period", period)
    with set_for(spark, {"spark.sql.maxConcurrentOutputFileWriters": str(len(edges) + 1)}):  # a task needn't sort its rows by period
        own.write.mode("overwrite").partitionBy("_period").parquet(laid)
    for k in range(len(edges) + 1):
        spark.read.schema(rows.schema).parquet(laid).where(F.col("_period") == k).drop("_period").repartition(files).write.mode("append").parquet(path)
    remove(spark, [laid])


def heartbeat(spark: SparkSession, path: str, like: DataFrame, time: str, at: datetime, **values) -> None:
    """A row that says only that all before `at` has arrived. Among claims its id stays null; among lines it is given any
    number, as lines without an id are left out before their time is looked at."""
    own = {time: F.lit(at)} | {c: F.lit(v) for c, v in values.items()}
    spark.range(1).select(*[own.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in like.dtypes]).write.mode("append").parquet(path)
