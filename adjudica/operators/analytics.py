"""Failure, revenue, throughput and model reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjudica.functions.scalar import remedy


#: Metric, comparison, threshold, message.
ALERTS = (
    ("cpu_usage_percent", ">", 85.0, "CPU usage high"),
    ("memory_usage_percent", ">", 85.0, "Memory usage high"),
    ("batch_processing_rate_per_sec", "<", 1000.0, "Throughput below threshold"),
    ("error_rate", ">", 0.05, "High error rate"),
)


def counts(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def error_counts(validated: DataFrame) -> DataFrame:
    return counts(validated.select(F.explode("errors").alias("error")), "error")


def share(a: Column, b: Column) -> Column:
    """a / b to six places, 0 for nothing."""
    return F.round(F.when(b != 0, a.cast("double") / b).otherwise(0.0), 6)


def as_double(c: Column, scale: int = 4) -> Column:
    return c.cast(f"decimal(28,{scale})").cast("double")


def revenue_loss(failed: DataFrame) -> DataFrame:
    return failed.agg(as_double(F.coalesce(F.sum("potential_revenue_loss"), F.lit(0))).alias("loss"))


def revenue_loss_by(failed: DataFrame, key: Column, name: str) -> DataFrame:
    return failed.groupBy(F.coalesce(key, F.lit("unknown")).alias(name)).agg(as_double(F.coalesce(F.sum("potential_revenue_loss"), F.lit(0))).alias("loss"))


def totals(claims: DataFrame, *keys: str) -> DataFrame:
    return claims.groupBy(*keys).agg(F.count(F.lit(1)).alias("claims"), as_double(F.sum(F.coalesce("total_charge_amount", F.lit(0)))).alias("charges"))


def daily_summary(judged: DataFrame) -> DataFrame:
    """Per day and facility: claims, failed, lines, charges, reimbursement and the rates, from validated claims with n_lines
    and revenue."""
    bad = (F.size("errors") > 0).cast("long")
    out = judged.groupBy(F.col("service_from_date").alias("day"), "facility_id").agg(
        F.count(F.lit(1)).alias("claims"), F.sum(bad).alias("failed"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("lines"),
        as_double(F.sum("total_charge_amount")).alias("charges"), as_double(F.coalesce(F.sum("revenue"), F.lit(0))).alias("reimbursement"))
    return out.withColumn("reimbursement_rate", share(F.col("reimbursement"), F.col("charges"))).withColumn("error_rate", share(F.col("failed"), F.col("claims"))).withColumn("pass_rate", share(F.col("claims") - F.col("failed"), F.col("claims")))


def batch_summary(outcomes: DataFrame, seconds: DataFrame) -> DataFrame:
    """Per batch: processed, failed, revenue of the valid ones, claims a second. seconds: batch_id, seconds."""
    bad = F.size("errors") > 0
    done = outcomes.groupBy("batch_id").agg(F.count(F.lit(1)).alias("processed"), F.sum(bad.cast("long")).alias("failed"), as_double(F.sum(F.when(~bad, F.col("revenue")).otherwise(0))).alias("revenue"))
    return done.join(seconds, "batch_id", "left").withColumn("throughput", share(F.col("processed"), F.col("seconds")))


def sla_violations(batches: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Claims in batches whose seconds a claim are above the threshold; batches without claims don't count."""
    late = (F.col("claims") > 0) & (F.col("seconds") / F.col("claims") > threshold)
    return batches.agg(F.coalesce(F.sum(F.when(late, F.col("claims"))), F.lit(0)).cast("long").alias("violations"))


def error_patterns(validated: DataFrame, threshold: int = 20) -> DataFrame:
    return error_counts(validated).where(F.col("n") >= threshold).withColumn("remedy", remedy(F.col("error")))


def alerts(metrics: DataFrame, rules: tuple[tuple[str, str, float, str], ...] = ALERTS) -> DataFrame:
    """metrics: metric, value. A value of zero never fires. Messages hold the value, the error rate in percent."""
    fired = []
    for metric, operator, threshold, text in rules:
        hit = (F.col("metric") == metric) & (F.col("value") != 0) & (F.col("value") > threshold if operator == ">" else F.col("value") < threshold)
        message = F.format_string(f"{text}: %.2f%%", F.col("value") * 100) if metric == "error_rate" else F.format_string(f"{text}: %.2f", "value")
        fired.append(F.when(hit, F.struct(F.lit(metric).alias("metric"), message.alias("message"))))
    return metrics.select(F.explode(F.array_compact(F.array(*fired))).alias("a")).select("a.*")


def prediction_counts(df: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("version"))
    return counts(df, "version", "predicted").withColumn("total", total)


def accuracy(df: DataFrame) -> DataFrame:
    right = F.coalesce(F.col("predicted") == F.col("actual"), F.lit(False)).cast("long")
    return df.groupBy("version").agg(F.count(F.lit(1)).alias("total"), F.sum(right).alias("correct")).withColumn("accuracy", share(F.col("correct"), F.col("total")))


def exposure(df: DataFrame, variants: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """Rows and share of each variant, zeros included."""
    sums = df.agg(F.count(F.lit(1)).alias("total"), *[F.coalesce(F.sum((F.col("variant") == v).cast("long")), F.lit(0)).alias(v) for v in variants])
    return sums.select("total", F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("n")) for v in variants])).alias("x")).select("x.*", "total").withColumn("share", share(F.col("n"), F.col("total")))


def failure_frequency(df: DataFrame, key: str, failed: Column) -> DataFrame:
    """Total, positives and their ratio per key; null is "unknown"."""
    out = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("code")).agg(F.count(F.lit(1)).alias("total"), F.sum(failed.cast("long")).alias("positives"))
    return out.withColumn("p", share(F.col("positives"), F.col("total")))


def log_summary(log: DataFrame) -> DataFrame:
    """Mean duration per first word of the statement and database. Durations are added up as decimals."""
    return log.groupBy(F.lower(F.split("statement", " ")[0]).alias("verb"), "database").agg(F.count(F.lit(1)).alias("n"), F.round(as_double(F.sum(F.col("duration").cast("decimal(20,4)"))) / F.count(F.lit(1)), 4).alias("mean_duration"))


def rvu_stats(rvu: DataFrame) -> DataFrame:
    value = F.col("total_rvu")
    return rvu.agg(F.count(F.lit(1)).alias("codes"), F.sum((F.lower("status") == "active").cast("long")).alias("active"), F.round(as_double(F.sum(value), 5) / F.count(value), 6).alias("mean_rvu"), as_double(F.min(value), 5).alias("least_rvu"), as_double(F.max(value), 5).alias("most_rvu"), F.countDistinct("category").alias("categories"))


def dashboard(failed: DataFrame, audit_events: DataFrame, archived: DataFrame, since: Column, top: int = 5) -> DataFrame:
    """One row: audit events, archives and the latest, the most frequent error lists, the failures of each day since, the
    loss, and the loss by category. The failures are added up once; all lists come from that small frame."""
    money = F.sum("potential_revenue_loss").cast("decimal(28,4)")
    errors, category = F.coalesce("errors", F.lit("unknown")).alias("errors"), F.coalesce("failure_category", F.lit("unknown")).alias("category")
    small = failed.groupBy(errors, category, "failed_on").agg(F.count(F.lit(1)).alias("n"), money.alias("loss"))
    # one row for each key of each list
    keys = F.array(
        F.struct(F.lit("errors").alias("kind"), F.col("errors").alias("key")), F.struct(F.lit("category").alias("kind"), F.col("category").alias("key")),
        F.struct(F.when(F.col("failed_on") >= since, "day").alias("kind"), F.col("failed_on").cast("string").alias("key")),
    )
    rows = small.select("n", "loss", F.explode(keys).alias("k")).where("k.kind is not null").groupBy("k.kind", "k.key").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))
    # of the many error lists only those are gathered that lead one of 64 groups, and the first ones of all are among them
    leading = F.row_number().over(Window.partitionBy("kind", F.pmod(F.xxhash64("key"), F.lit(64))).orderBy(F.desc("n"), "key"))
    rows = rows.withColumn("place", leading).where((F.col("kind") != "errors") | (F.col("place") <= top)).drop("place")
    listed = lambda kind, *order: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], "key", "n", F.coalesce("loss", F.lit(0)).cast("double").alias("loss")))))
    text = lambda items, value: F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["key"], value(x))), ";")
    lists = rows.agg(listed("errors", -F.col("n"), F.col("key")).alias("e"), listed("day", F.col("key")).alias("d"), listed("category", F.col("key")).alias("c"), F.sum(F.when(F.col("kind") == "category", F.col("loss"))).alias("total"))
    cents = lambda x: F.format_string("%.2f", x["loss"])
    done = lists.select(
        text(F.slice("e", 1, top), lambda x: x["n"]).alias("top_errors"), text(F.col("d"), lambda x: x["n"]).alias("trend"), text(F.col("c"), cents).alias("loss_by_category"),
        as_double(F.coalesce("total", F.lit(0))).alias("loss"),
    )
    out = audit_events.agg(F.count(F.lit(1)).alias("audit_events"))
    for one in (archived.agg(F.count(F.lit(1)).alias("archives"), F.max("day").alias("latest_archive")), done):  # single rows
        out = out.join(one, F.lit(True))
    return out
