"""The whole way of a batch of claims: judged in one plan, kept once, written to both sides with its statuses."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import enrichment, models, outcomes, rules, validation


def pending(claims: DataFrame, above: int | None = None) -> DataFrame:
    """Claims that wait, and if asked for only those above a priority."""
    waits = F.col("processing_status").isin("pending", "received", "processing")
    return claims.where(waits if above is None else waits & (outcomes.priority_rank(F.col("priority")) > above))


def needs_lines(ruleset: tuple[rules.Rule, ...]) -> bool:
    """Whether a rule looks at the lines themselves."""
    return any("condition" in json.loads(r.logic) for r in ruleset if r.active)


def judge(claims: DataFrame, lines: DataFrame, facilities: DataFrame, classes: DataFrame, rvu: DataFrame, ruleset: tuple[rules.Rule, ...] = (), model=None, short_circuit: bool = False) -> DataFrame:
    """Claims with validation_errors, rule_errors, both as errors, revenue and n_lines (null without lines), filter_number.
    The lines are read once; they are nested only for rules that look at them."""
    per_claim = enrichment.summarise(enrichment.enrich(lines, rvu), needs_lines(ruleset))
    return decide(validation.validate(claims, facilities, classes, per_claim), ruleset, model, short_circuit)


def judge_summarised(claims: DataFrame, facilities: DataFrame, classes: DataFrame, ruleset: tuple[rules.Rule, ...] = (), model=None, short_circuit: bool = False) -> DataFrame:
    """The same for claims that come with the summary of their lines (see enrichment.summarise)."""
    return decide(validation.validate(claims, facilities, classes), ruleset, model, short_circuit)


def decide(validated: DataFrame, ruleset: tuple[rules.Rule, ...], model, short_circuit: bool) -> DataFrame:
    out = rules.evaluate(validated, list(ruleset), short_circuit)
    out = models.predict_filter(out, model)
    return out.withColumn("validation_errors", F.col("errors")).withColumn("errors", F.concat("errors", "rule_errors"))


def statuses(judged: DataFrame) -> DataFrame:
    """claim_id, status and the stage where the claim ended."""
    stage = F.when(F.size("validation_errors") > 0, "validation").when(F.size("rule_errors") > 0, "rules").otherwise("completed")
    return judged.select("claim_id", F.when(F.size("errors") == 0, "completed").otherwise("failed").alias("status"), stage.alias("stage"))


#: What a run tells of itself.
SUMMARY = "batch_id long, processed long, failed long, revenue decimal(38,4), seconds double"


def write(judged: DataFrame, path: str, number: int, key: str, original: tuple[str, ...]) -> dict:
    """Valid claims, failed ones (cut to the table's widths, with the encrypted original), statuses, and one row about the
    run, each in a folder of the batch's own, so that a batch that is run again replaces itself. The frame is kept for the
    three writes, and counts and revenue come from what was kept; the seconds are those of the writes. (An Observation would
    count in passing, but a session that has made one can't run Spark ML models any more: its manager isn't serializable.)"""
    began = time.perf_counter()
    kept = judged.persist()
    try:
        good, bad = outcomes.split(kept)
        failed = outcomes.truncated(outcomes.failed_records(bad, F.coalesce("revenue", "total_charge_amount"), key, original))
        valid = good.select(*original, "filter_number", F.coalesce("revenue", F.lit(0)).alias("revenue"))
        for name, rows in (("valid", valid), ("failed", failed), ("status", statuses(kept))):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        seconds, wrong = time.perf_counter() - began, F.size("errors") > 0
        counted = kept.agg(
            F.count(F.lit(1)).alias("processed"), F.coalesce(F.sum(wrong.cast("long")), F.lit(0)).alias("failed"),
            F.coalesce(F.sum(F.when(~wrong, F.col("revenue"))), F.lit(0)).cast("decimal(38,4)").alias("revenue"),
        ).first()
    finally:
        kept.unpersist()
    summary = {"batch_id": number, **counted.asDict(), "seconds": seconds}
    judged.sparkSession.createDataFrame([summary], SUMMARY).coalesce(1).write.mode("overwrite").parquet(f"{path}/summary/batch={number}")
    return summary


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """The rows that `write` left about its runs."""
    return spark.read.schema(SUMMARY).parquet(f"{path}/summary")
