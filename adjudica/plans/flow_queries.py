"""Queries that write files or run streams over the tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.catalog import CLAIMS
from adjudica.model import adapter as m
from adjudica.model.adapter import CTE
from adjudica.operators import analytics, flow, outcomes, validation
from adjudica.sources import files, id_feed
from adjudica.sources.keyed_table import KeyedTable
from adjudica.streaming import claims_stream as cs
from adjudica.streaming import claims_with_lines as cl
from adjudica.streaming import dead_letters

from .claims_queries import _BATCH, RULES, SINKS, batch, code_filter, sinks
from .claims_queries import KEY as CLAIMS_KEY
from .report_queries import letters

CUTOFF = "1996-01-01"
KEY = "key of the archive"


def aged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    own = m.claims(spark, sf).select("claim_id", "patient_account_number", "service_to_date", "total_charge_amount")
    return files.split_by_age(own, F.to_date(F.lit(CUTOFF)))


@CLAIMS.add("archive_split", CTE + f"SELECT CASE WHEN service_to_date < DATE '{CUTOFF}' THEN 'archived' ELSE 'live' END AS place, count(*) AS n FROM claims GROUP BY 1")
def archive_split(spark, sf):
    old, live = aged(spark, sf)
    return old.select(F.lit("archived").alias("place")).unionByName(live.select(F.lit("live").alias("place"))).groupBy("place").agg(F.count(F.lit(1)).alias("n"))


@CLAIMS.add("archive_restore", CTE + f"SELECT claim_id, patient_account_number, service_to_date FROM claims WHERE service_to_date < DATE '{CUTOFF}'")
def archive_restore(spark, sf):
    old, path = aged(spark, sf)[0], files.shared_folder(spark)
    files.archive(old, path, KEY)
    return files.restore(spark, path, KEY, old.schema).select("claim_id", "patient_account_number", "service_to_date")


@CLAIMS.add("partition_retention", CTE + "SELECT claim_id, year(service_to_date)::INT AS service_year FROM claims WHERE year(service_to_date) >= 1998 - 3")
def partition_retention(spark, sf):
    """Older years are removed from the table, not only left out."""
    path = files.shared_folder(spark)
    files.write_by_year(m.claims(spark, sf).select("claim_id", "service_to_date"), path)
    files.drop_old_years(spark, path, m.NOW, 3)
    return spark.read.parquet(path).select("claim_id", "service_year")


@CLAIMS.add("retention_job", CTE + f"SELECT claim_id, CASE WHEN service_to_date < DATE '{CUTOFF}' THEN 'archived' ELSE 'live' END AS place FROM claims WHERE service_to_date >= DATE '1994-12-01'")
def retention_job(spark, sf):
    """What is live and what the archive still holds after the job."""
    own, path = m.claims(spark, sf).select("claim_id", "patient_account_number", "service_to_date"), files.shared_folder(spark)
    live = files.retention_job(own, path, KEY, CUTOFF, m.NOW, 4)
    kept = files.restore(spark, path, KEY, own.schema)
    return live.select("claim_id", F.lit("live").alias("place")).unionByName(kept.select("claim_id", F.lit("archived").alias("place")))


@CLAIMS.add("purge_archives", CTE + "SELECT 'claims_' || strftime(day, '%Y_%m_%d') || '.jsonl' AS name FROM (SELECT DISTINCT service_to_date AS day FROM claims) WHERE day < DATE '1998-12-01' - INTERVAL 4 YEAR")
def purge_archives(spark, sf):
    listing = m.claims(spark, sf).select(F.concat(F.lit("claims_"), F.date_format("service_to_date", "yyyy_MM_dd"), F.lit(".jsonl")).alias("name")).distinct()
    return files.purgeable(listing, F.to_date(F.lit(m.NOW)), 4)


@CLAIMS.add("queue_replay", CTE + "SELECT claim_id, priority, total_charge_amount::DOUBLE AS charge, primary_diagnosis FROM claims WHERE processing_status = 'pending'")
def queue_replay(spark, sf):
    own, path = m.claims(spark, sf).where("processing_status = 'pending'").select("claim_id", "priority", F.col("total_charge_amount").cast("double").alias("charge"), "primary_diagnosis"), files.shared_folder(spark)
    files.queue_claims(own, path)
    files.drain_queue(spark, path, own.schema, lambda queued: queued.write.parquet(f"{path}-committed"))
    left = files.replay_claims(spark, path, own.schema)  # nothing
    return spark.read.parquet(f"{path}-committed").unionByName(left)


@CLAIMS.add("bulk_load", CTE + "SELECT claim_id, procedure_code, units FROM lines")
def bulk_load(spark, sf):
    own, path = m.lines(spark, sf).select("claim_id", "procedure_code", "units"), files.shared_folder(spark)
    files.bulk_load(own, path)
    return files.read_table(spark, path, own.schema)


def stream_of(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A table as a stream; the pattern lets one file be read like a folder of files."""
    return cs.cdc_source(spark, f"{sf}/{table}.parque[t]", spark.read.parquet(f"{sf}/{table}.parquet").schema)


@CLAIMS.add("cdc_replay", "SELECT event_id, user_id FROM events")
def cdc_replay(spark, sf):
    path = files.shared_folder(spark)
    cs.drain(stream_of(spark, sf, "events"), cs.batch_sink(path, lambda b: b.select("event_id", "user_id")), f"{path}-offsets")
    return spark.read.parquet(path).select("event_id", "user_id")


@CLAIMS.add("stream_hourly", "SELECT date_trunc('hour', ts) AS hour, event_type AS name, count(*) AS processed, sum(value::DECIMAL(20,6))::DOUBLE AS total FROM events GROUP BY 1, 2")
def stream_hourly(spark, sf):
    """In complete mode, where every hour is emitted; each trigger replaces the last result."""
    path = files.shared_folder(spark)
    events = stream_of(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("name"), "value")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(path)
    cs.hourly_counters(events).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}-offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "name", "processed", "total")


#: Periods in which the feeds of the sample arrive.
PERIODS = 3


def feeds(spark: SparkSession, sf: str, path: str) -> tuple[DataFrame, DataFrame, str]:
    """Waiting claims and all lines, written as they would arrive; both as streams that read a period a micro-batch, and how
    far the rows of a period may be out of order."""
    claims = flow.pending(m.claims(spark, sf)).withColumn("arrived_at", F.col("created_at"))
    lines = m.lines(spark, sf).withColumn("arrived_at", F.col("service_from_date").cast("timestamp"))
    first, last = claims.agg(F.min("arrived_at"), F.max("arrived_at")).first()
    period = (last - first) / PERIODS
    files_each = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, rows, mark in (("claims", claims, None), ("lines", lines, 0)):
        cl.write_feed(rows, f"{path}/{name}", [first + period * k for k in range(1, PERIODS)], files_each)
        cl.heartbeat(spark, f"{path}/{name}", rows, "arrived_at", last + period + timedelta(days=3650), claim_id=mark)
    stream = lambda name, rows: cs.cdc_source(spark, f"{path}/{name}", rows.schema, files_each)
    return stream("claims", claims), stream("lines", lines), f"{period.days + 1} days"


@CLAIMS.add("stream_process", _BATCH + SINKS)
def stream_process(spark, sf):
    """Claims and lines arrive as two feeds; complete claims go through the whole flow into the sinks."""
    path = files.shared_folder(spark)
    claims, lines, delay = feeds(spark, sf, f"{path}/feeds")
    kept = tuple(c for c in claims.columns if c != "arrived_at")

    def each(batch: DataFrame, number: int) -> None:
        judged = flow.judge_summarised(batch.drop("arrived_at"), m.facilities(spark, sf), m.financial_classes(spark, sf), tuple(RULES), code_filter)
        flow.write(judged, path, number, CLAIMS_KEY, kept)

    cl.process_backlog(claims, lines, m.rvu(spark, sf), each, f"{path}/backlog", f"{path}/offsets", delay=delay, nested=flow.needs_lines(tuple(RULES)))
    return sinks(spark, path, flow.pending(m.claims(spark, sf)))


@CLAIMS.add("checkpoint_upsert", "SELECT user_id AS claim_id, event_type AS stage, max(ts) AS checkpoint_at FROM events GROUP BY 1, 2")
def checkpoint_upsert(spark, sf):
    """Events in three files, each a micro-batch that is merged into the table of checkpoints."""
    path = files.shared_folder(spark)
    own = m.events(spark, sf).select(F.col("user_id").alias("claim_id"), F.col("name").alias("stage"), F.col("at").cast("timestamp_ntz").alias("checkpoint_at"))
    own.repartition(3).write.parquet(f"{path}/in")
    sink = cs.CheckpointSink(f"{path}/out", ", ".join(f"{c} {kind}" for c, kind in own.dtypes))
    cs.drain(cs.cdc_source(spark, f"{path}/in", own.schema, 1), sink, f"{path}/offsets")
    return sink.table(spark)


@CLAIMS.add("cdc_feed", "SELECT o_orderkey AS claim_id, ((o_orderkey - least(0, (SELECT min(o_orderkey) FROM orders))) // (((SELECT max(o_orderkey) - least(0, min(o_orderkey)) FROM orders) // 4 + 1)))::BIGINT AS batch FROM orders")
def cdc_feed(spark, sf):
    """Orders in id order, a quarter of the ids a micro-batch, each written with its batch's number."""
    path = files.shared_folder(spark)
    low, high = m.table(spark, sf, "orders").agg(F.least(F.lit(0), F.min("o_orderkey")), F.max("o_orderkey")).first()
    feed = id_feed.id_feed(spark, sf, "orders", "o_orderkey", "o_orderkey long", f"{path}/offsets", ids_per_batch=(high - low) // 4 + 1, starting_id=low - 1)
    id_feed.follow(feed, lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}"), f"{path}/offsets")
    return spark.read.schema("o_orderkey long, batch long").parquet(f"{path}/out").select(F.col("o_orderkey").alias("claim_id"), "batch")


_LATE = "(event_id % 50 = 0 AND ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events))"


@CLAIMS.add("stream_hourly_late", f"SELECT date_trunc('hour', ts) AS hour, event_type AS name, count(*) AS processed, sum(value::DECIMAL(20,6))::DOUBLE AS total FROM events WHERE NOT {_LATE} GROUP BY 1, 2 UNION ALL SELECT NULL, 'late', count(*), NULL FROM events WHERE {_LATE} HAVING count(*) > 0")
def stream_hourly_late(spark, sf):
    """Events of the first half that arrive after all others are late: they are in no hour, but counted."""
    path = files.shared_folder(spark)
    events = m.events(spark, sf).select("event_id", "name", "at", "value").withColumn("arrived_at", F.col("at"))
    first, last = events.agg(F.min("at"), F.max("at")).first()
    period, files_each = (last - first) / 3, int(spark.conf.get("spark.sql.shuffle.partitions"))
    late = (F.col("event_id") % 50 == 0) & (F.col("at") < F.lit(first + (last - first) / 2))
    cl.write_feed(events.where(~late), f"{path}/in", [first + period, first + 2 * period], files_each)
    events.where(late).repartition(files_each).write.mode("append").parquet(f"{path}/in")
    cl.heartbeat(spark, f"{path}/in", events, "at", last + timedelta(days=3650))
    hours = KeyedTable(spark, f"{path}/hours", "hour timestamp, name string, processed long, total double", ("hour", "name"), 4)
    lost = KeyedTable(spark, f"{path}/late", "batch long, late_rows long", ("batch",), 1)
    cs.run_counted_hours(cs.cdc_source(spark, f"{path}/in", events.schema, files_each).drop("arrived_at"), hours, lost, f"{path}/offsets")
    counted = lost.read().agg(F.sum("late_rows").alias("processed")).where("processed > 0").select(F.lit(None).cast("timestamp_ntz").alias("hour"), F.lit("late").alias("name"), "processed", F.lit(None).cast("double").alias("total"))
    return hours.read().select(F.col("hour").cast("timestamp_ntz").alias("hour"), "name", "processed", "total").unionByName(counted)


_PATTERNS = "SELECT unnest(list_filter([CASE WHEN e1 THEN 'invalid_facility' END, CASE WHEN e2 THEN 'invalid_financial_class' END, CASE WHEN e3 THEN 'invalid_dob' END, CASE WHEN e4 THEN 'invalid_service_dates' END], lambda x: x IS NOT NULL)) AS error, epoch(created_at)::BIGINT // 2592000 AS stretch FROM checked"


@CLAIMS.add("pattern_watch", CTE + f"SELECT make_timestamp(stretch * 2592000000000) AS start, error, count(*) AS n, CASE error WHEN 'invalid_facility' THEN 'Verify facility_id mappings in source data' WHEN 'invalid_financial_class' THEN 'Check financial_class values' WHEN 'invalid_dob' THEN 'Ensure patient date_of_birth is valid' ELSE 'Investigate data quality issues' END AS remedy FROM ({_PATTERNS}) GROUP BY stretch, error HAVING count(*) >= 5")
def pattern_watch(spark, sf):
    """Errors of claims as they arrive, by stretches of 30 days, with at least five of a kind; in complete mode, where each
    alert holds all stretches and replaces the one before."""
    path = files.shared_folder(spark)
    validated = validation.validate(m.claims(spark, sf, stream_of(spark, sf, "orders")), m.facilities(spark, sf), m.financial_classes(spark, sf))
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/alerts")
    cs.pattern_watch(cs.error_windows(validated, "30 days"), 5, write, f"{path}/offsets", None, "complete").awaitTermination()
    return spark.read.parquet(f"{path}/alerts").select(F.col("start").cast("timestamp_ntz").alias("start"), "error", "n", "remedy")


_OLDEST = "(SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 800)"


@CLAIMS.add("dlq_stream", f"SELECT 'inserted' AS place, user_id AS id, max(event_id) AS letter FROM {_OLDEST} WHERE user_id % 3 <> 0 GROUP BY user_id UNION ALL SELECT 'failed', event_id, event_id FROM {_OLDEST} WHERE user_id % 3 = 0 UNION ALL SELECT 'waiting', event_id, event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM {_OLDEST})")
def dlq_stream(spark, sf):
    """Letters arrive in four periods; each micro-batch settles the 200 oldest that wait."""
    path = files.shared_folder(spark)
    own = letters(spark, sf).withColumn("arrived_at", F.col("inserted_at"))
    first, last = own.agg(F.min("arrived_at"), F.max("arrived_at")).first()
    files_each = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cl.write_feed(own, f"{path}/in", [first + (last - first) / 4 * k for k in (1, 2, 3)], files_each)
    sink = dead_letters.DeadLetters(spark, f"{path}/tables", 200, files_each)
    dead_letters.run(cs.cdc_source(spark, f"{path}/in", own.schema, files_each).drop("arrived_at"), sink, f"{path}/offsets")
    one = lambda rows, place, key: rows.select(F.lit(place).alias("place"), F.col(key).alias("id"), F.col("dlq_id").alias("letter"))
    return one(sink.inserted.read(), "inserted", "claim_id").unionByName(one(sink.failed(), "failed", "dlq_id")).unionByName(one(sink.waiting(), "waiting", "dlq_id"))


@CLAIMS.add("batch_runs", _BATCH + """SELECT (claim_id % 3)::BIGINT AS batch_id, count(*) AS processed, count(*) FILTER (errors <> '' OR rule_errors <> '') AS failed, coalesce(sum(CASE WHEN errors = '' AND rule_errors = '' THEN revenue END), 0)::DECIMAL(28,4)::DOUBLE AS revenue, true AS timed, 0 AS violations
FROM judged WHERE processing_status IN ('pending', 'received', 'processing') GROUP BY 1""")
def batch_runs(spark, sf):
    """Three batches written by the whole flow, and what each tells of itself; no claim took an hour."""
    path, claims = files.shared_folder(spark), flow.pending(m.claims(spark, sf))
    for number in range(3):
        own = claims.where(F.col("claim_id") % 3 == number)
        flow.write(batch(spark, sf, claims=own, model=code_filter), path, number, CLAIMS_KEY, tuple(claims.columns))
    runs = flow.summaries(spark, path)
    late = analytics.sla_violations(runs.withColumnRenamed("processed", "claims"), 3600.0).select(F.col("violations").cast("int").alias("violations"))
    timed = (F.col("seconds") > 0) & (analytics.share(F.col("processed"), F.col("seconds")) > 0)
    return runs.join(late, F.lit(True)).select("batch_id", "processed", "failed", analytics.as_double(F.col("revenue")).alias("revenue"), timed.alias("timed"), "violations")


@CLAIMS.add("shards_bucketed", CTE + "SELECT (('0x' || substr(md5(facility_id::VARCHAR), 1, 8))::BIGINT % 4)::INT AS shard, count(*) AS accepted, coalesce(sum(n), 0)::BIGINT AS lines, sum(charges)::DOUBLE AS charges FROM claims LEFT JOIN (SELECT claim_id, count(*) AS n, sum(charge_amount) AS charges FROM lines GROUP BY claim_id) USING (claim_id) WHERE patient_account_number <> '' AND facility_id IS NOT NULL GROUP BY 1")
def shards_bucketed(spark, sf):
    return outcomes.process_shards(*bucketed(spark, sf), 4)


def bucketed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Claims and lines as bucketed tables with names of their own."""
    path, n = files.shared_folder(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"b_{path.rsplit('/', 1)[1]}"
    return outcomes.save_bucketed(m.claims(spark, sf), f"claims_{name}", f"{path}/claims", n), outcomes.save_bucketed(m.lines(spark, sf), f"lines_{name}", f"{path}/lines", n)


@CLAIMS.add("archives_purged", CTE + ", archives AS (SELECT DISTINCT 'claims_' || strftime(date_trunc('month', service_to_date), '%Y_%m_%d') || '.jsonl' AS name, date_trunc('month', service_to_date) AS month FROM claims) SELECT name, CASE WHEN month < DATE '1998-12-01' - INTERVAL 2 YEAR THEN 'purged' ELSE 'kept' END AS place FROM archives")
def archives_purged(spark, sf):
    """Archives written as files, listed, purged, and listed again."""
    path = files.shared_folder(spark)
    files.write_archives(m.claims(spark, sf).select("claim_id", "service_to_date"), path, KEY)
    gone = files.purge_archives(spark, path, m.NOW, 2)
    return gone.select("name", F.lit("purged").alias("place")).unionByName(files.list_archives(spark, path).select("name", F.lit("kept").alias("place")))
