"""Reference-data synchronisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.sources.keyed_table import KeyedTable

from .outcomes import amend, reconcile, upsert


def changed_since(source: DataFrame, log: DataFrame) -> DataFrame:
    """Rows that changed since the latest completed sync, all if there was none. The mark is one row, joined, not collected."""
    mark = log.where("sync_status = 'completed'").agg(F.max("completed_on").alias("_mark"))
    return source.join(mark, F.lit(True)).where(F.col("_mark").isNull() | (F.col("updated_on") > F.col("_mark"))).drop("_mark")


def incremental(source: DataFrame, cache: DataFrame, log: DataFrame) -> DataFrame:
    """The cache with the changed rows."""
    return upsert(cache, changed_since(source, log), "procedure_code")


def incremental_into(table: KeyedTable, source: DataFrame, log: DataFrame, writer: str | None = None, batch: int | None = None) -> int | None:
    """The same into a standing table (keyed by procedure_code), at the cost of the changed rows."""
    return table.merge(changed_since(source, log), writer, batch)


def full_into(table: KeyedTable, source: DataFrame) -> int:
    """All active rows as the table's next version; readers see all of them or the version before."""
    return table.replace(full(source))


def log_row(source: DataFrame, log: DataFrame, today: Column) -> DataFrame:
    """What such a sync adds to the log."""
    return changed_since(source, log).agg(F.count(F.lit(1)).alias("records_processed")).select(F.lit("incremental").alias("sync_type"), "records_processed", F.lit("completed").alias("sync_status"), today.alias("completed_on"))


def force_if_needed(source: DataFrame, cache: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cache, synchronised only if both sides differ, and the states before and after. One flag is looked at."""
    before = status(source, cache)
    after = incremental(source, cache, log) if before.select("sync_required").first()[0] else cache
    return after, before.withColumn("phase", F.lit("before")).unionByName(status(source, after).withColumn("phase", F.lit("after")))


def full(source: DataFrame) -> DataFrame:
    """All active rows, in place of the cache."""
    return source.where(F.lower("status") == "active")


def bulk_update(rvu: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with the changes, and (updated, failed): changes whose code is missing fail."""
    hits = changes.join(rvu.select("procedure_code").withColumn("_hit", F.lit(1)), "procedure_code", "left")
    return amend(rvu, changes, "procedure_code"), hits.agg(F.count("_hit").alias("updated"), F.sum(F.col("_hit").isNull().cast("long")).alias("failed"))


def status(source: DataFrame, cache: DataFrame) -> DataFrame:
    """Counts of both sides and of each state, and whether a sync is required."""
    r = reconcile(full(source), full(cache))
    n = lambda c: F.sum(c.cast("long"))
    return r.agg(n(F.col("source_rvu").isNotNull()).alias("source_rows"), n(F.col("cache_rvu").isNotNull()).alias("cache_rows"), n(F.col("state") == "differs").alias("differing"), n(F.col("state") != "same").alias("unequal")).withColumn("sync_required", F.col("unequal") > 0)


def recent(rvu: DataFrame, since: Column) -> DataFrame:
    return rvu.where(F.col("updated_on") >= since)
