"""Valid and failed claims, repairs, routing, and the changes that follow."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjudica.functions.scalar import encrypted, priority_rank
from adjudica.sources.files import queue_claims

#: Repair text for each error, in the order in which they are joined.
REPAIRS = {
    "invalid_facility": "Verify facility_id",
    "invalid_financial_class": "Check financial_class",
    "invalid_dob": "Check date_of_birth",
    "invalid_service_dates": "Correct service dates",
}
#: Characters that the failed-claims table holds.
WIDTHS = {"claim_id": 50, "facility_id": 20, "patient_account_number": 50, "failure_reason": 1000, "failure_category": 50, "processing_stage": 50}


def suggest_repairs(errors: Column) -> Column:
    return F.concat_ws("; ", *[F.when(F.array_contains(errors, e), F.lit(text)) for e, text in REPAIRS.items()])


def auto_repair(df: DataFrame) -> DataFrame:
    """Missing classes and facilities are marked, a birth date after the service takes the service's date, reversed
    service dates collapse to the first. Facility ids are compared as text."""
    has = lambda e: F.array_contains("errors", e)
    known = lambda c: F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")), F.lit("UNKNOWN"))
    return df.withColumns({
        "facility_id": F.when(has("invalid_facility"), known("facility_id")).otherwise(F.col("facility_id").cast("string")),
        "financial_class": F.when(has("invalid_financial_class"), known("financial_class")).otherwise(F.col("financial_class")),
        "date_of_birth": F.when(has("invalid_dob"), F.coalesce("service_from_date", "service_to_date", "date_of_birth")).otherwise(F.col("date_of_birth")),
        "service_to_date": F.when(has("invalid_service_dates"), F.col("service_from_date")).otherwise(F.col("service_to_date")),
    })


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims without errors, and the others; one predicate, so none is lost."""
    good = F.size("errors") == 0
    return df.where(good), df.where(~good)


def failed_records(failed: DataFrame, loss: Column, key: str | None = None, original: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the failed-claims table. A claim with validation errors failed there, any other in the rules. With a key,
    original_data holds the claim's `original` columns as encrypted JSON."""
    stage = F.when(F.size("validation_errors") > 0, "validation").otherwise("rules") if "validation_errors" in failed.columns else F.lit("validation")
    whole = [encrypted(F.to_json(F.struct(*original), {"ignoreNullFields": "false"}), key).alias("original_data")] if key else []
    return failed.select(
        "claim_id", "patient_account_number", "facility_id", stage.alias("failure_reason"), stage.alias("failure_category"),
        stage.alias("processing_stage"), F.concat_ws(",", "errors").alias("errors"), suggest_repairs(F.col("errors")).alias("repair_suggestions"),
        loss.cast("decimal(12,2)").alias("potential_revenue_loss"), F.col("service_from_date").alias("failed_on"), *whole,
    )


def advise(failed: DataFrame, advisor: Callable[[pd.DataFrame], pd.Series] | None, *inputs: str) -> DataFrame:
    """advice: further suggestions (an array of text) of an outside model on a pandas frame of the inputs. Without one, and
    where it fails, there are none."""
    kind = "array<string>"
    if advisor is None:
        return failed.withColumn("advice", F.array().cast(kind))

    def run(frame: pd.DataFrame) -> pd.Series:
        try:
            return advisor(frame)
        except Exception:  # an adviser must never stop a batch
            return pd.Series([[]] * len(frame))

    return failed.withColumn("advice", F.pandas_udf(run, kind)(F.struct(*inputs)))


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows with the text in any column, in any case."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])), F.lit(text.lower())))


def truncated(df: DataFrame) -> DataFrame:
    """Text columns cut to the widths of the table."""
    return df.withColumns({c: F.substring(F.col(c).cast("string"), 1, n) for c, n in WIDTHS.items() if c in df.columns})


def missing(fetched: DataFrame, handled: DataFrame) -> DataFrame:
    """Fetched ids in no outcome, to be marked failed."""
    return fetched.select("claim_id").distinct().join(handled.select("claim_id"), "claim_id", "left_anti").withColumn("processing_status", F.lit("failed")).withColumn("processing_stage", F.lit("processing_error"))


def update_status(claims: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: claim_id, status, stage; one row an id. Other claims stay as they are."""
    new = changes.select(F.col("claim_id").alias("_id"), F.col("status").alias("_status"), F.col("stage").alias("_stage"))
    joined = claims.join(new, F.col("claim_id") == F.col("_id"), "left")
    return joined.withColumn("processing_status", F.coalesce("_status", "processing_status")).withColumn("processing_stage", F.col("_stage")).drop("_id", "_status", "_stage")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of every key; `order` must tell rows apart."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def amend(claims: DataFrame, changes: DataFrame, key: str = "claim_id") -> DataFrame:
    """The columns of `changes` where they are not null."""
    columns = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = claims.join(new, F.col(key) == F.col("_key"), "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop("_key", *[f"_new_{c}" for c in columns])


def upsert(target: DataFrame, changes: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of `changes` over those of `target`, new ones added; columns of `keep` stay as first written."""
    t, c = target.alias("t"), changes.alias("c")
    joined = t.join(c, F.col(f"t.{key}") == F.col(f"c.{key}"), "full")
    pick = lambda n: F.coalesce(f"t.{n}", f"c.{n}") if n == key or n in keep else F.when(F.col(f"c.{key}").isNotNull(), F.col(f"c.{n}")).otherwise(F.col(f"t.{n}"))
    return joined.select(*[pick(n).alias(n) for n in target.columns])


def resolve(failed: DataFrame, actions: DataFrame) -> DataFrame:
    """The latest action on each failed claim: assign sets a person, resolve closes it."""
    last = latest(actions, ["claim_id"], F.col("at").desc(), F.col("action_id").desc()).select("claim_id", "kind", "person", "notes", "at")
    joined = failed.join(last, "claim_id", "left")
    return joined.select(
        *failed.columns, F.when(F.col("kind") == "assign", F.col("person")).alias("assigned_to"),
        F.when(F.col("kind") == "assign", "assigned").when(F.col("kind") == "resolve", "resolved").otherwise("open").alias("resolution_status"),
        F.when(F.col("kind") == "resolve", F.col("notes")).alias("resolution_notes"), F.when(F.col("kind") == "resolve", F.col("at")).alias("resolved_at"),
    )


def reconcile(source: DataFrame, cache: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Every code of either side with its state: same, differs, only_source, only_cache."""
    s = source.select("procedure_code", F.col("total_rvu").alias("source_rvu"))
    c = cache.select("procedure_code", F.col("total_rvu").alias("cache_rvu"))
    state = F.when(F.col("cache_rvu").isNull(), "only_source").when(F.col("source_rvu").isNull(), "only_cache").when(F.abs(F.col("source_rvu") - F.col("cache_rvu")) > F.lit(tolerance).cast("decimal(4,2)"), "differs").otherwise("same")
    return s.join(c, "procedure_code", "full").withColumn("state", state)


def seed_classes(facilities: DataFrame, classes: DataFrame, present: DataFrame) -> DataFrame:
    """Present pairs, and every active facility with every class that is not there yet. `classes` is a short list."""
    listed = F.array_sort(F.collect_set("financial_class"))
    pairs = facilities.where("active").select("facility_id").join(F.broadcast(classes.agg(listed.alias("all"))), F.lit(True)).select("facility_id", F.explode("all").alias("financial_class"))
    new = pairs.join(present, ["facility_id", "financial_class"], "left_anti").withColumn("seeded", F.lit(True))
    return present.withColumn("seeded", F.lit(False)).unionByName(new)


def audit_diff(old: DataFrame, new: DataFrame, key: str, table: str, user: str, reason: str) -> DataFrame:
    """A row for every record that was inserted, deleted or changed, with both states and the changed columns."""
    columns = [c for c in old.columns if c != key]
    o, n = old.select(key, F.struct(*columns).alias("old")), new.select(key, F.struct(*columns).alias("new"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), c) for c in columns]))
    joined = o.join(n, key, "full").withColumn("changed", changed)
    operation = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
    return joined.where("old is null or new is null or size(changed) > 0").select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("record_id"), operation.alias("operation"), F.lit(user).alias("user_id"), F.to_json("old").alias("old_values"), F.to_json("new").alias("new_values"), F.concat_ws(",", "changed").alias("changed"), F.lit(reason).alias("reason"))


def route_shard(key: Column, n: int) -> Column:
    """Shard 0 for null, else a hash of the key."""
    return F.when(key.isNull(), F.lit(0)).otherwise(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % n).cast("int")


def save_bucketed(df: DataFrame, name: str, path: str, n: int, key: str = "claim_id") -> DataFrame:
    """df as the table `name` with its files under path, in n buckets by the key, sorted in each. Tables with as many
    buckets are joined and grouped by the key where they lie, without an exchange."""
    spark = df.sparkSession
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def process_shards(claims: DataFrame, lines: DataFrame, n: int) -> DataFrame:
    """What every shard accepts, of bucketed claims and lines: shard, claims, lines, charges. The lines are summed and joined
    within their buckets; only the sums of n shards are exchanged. Hot facilities fill a shard, but no task: buckets are
    by claim."""
    own = lines.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("charge_amount").alias("line_charges"))
    joined = claims.join(own, "claim_id", "left").withColumn("shard", route_shard(F.col("facility_id"), n))
    return accepted(joined).groupBy("shard").agg(F.count(F.lit(1)).alias("accepted"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("lines"), F.sum("line_charges").cast("double").alias("charges"))


def accepted(claims: DataFrame) -> DataFrame:
    """Claims with account and facility."""
    return claims.where(F.col("patient_account_number").isNotNull() & (F.col("patient_account_number") != "") & F.col("facility_id").isNotNull())


def identified(claims: DataFrame, run: int = 10_000) -> DataFrame:
    """Claims without an id get one made from the row and from its number among equal rows, so that it is the same when a task
    runs again. Equal rows are counted before they are exchanged, and leave in runs of bounded length that many tasks share."""
    cols = claims.columns
    digest = F.md5(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))
    claims = claims.withColumn("claim_id", F.col("claim_id").cast("string"))
    own = [c for c in cols if c != "claim_id"]
    equal = claims.where("claim_id IS NULL").groupBy(digest.alias("_row")).agg(*[F.first(c).alias(c) for c in own], F.count(F.lit(1)).alias("_n"))
    runs = equal.withColumn("_run", F.explode(F.expr(f"sequence(0L, (_n - 1) div {run})"))).repartition("_row", "_run")
    each = runs.withColumn("_place", F.explode(F.expr(f"sequence(_run * {run} + 1, least(_n, (_run + 1) * {run}))")))
    name = F.when(F.col("_place") == 1, F.col("_row")).otherwise(F.md5(F.concat_ws("-", "_row", "_place")))
    made = F.concat_ws("-", *[F.substring(name, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return claims.where("claim_id IS NOT NULL").unionByName(each.select(made.alias("claim_id"), *own))


def insertable(claims: DataFrame, key: str) -> DataFrame:
    """Claims with account and facility, the account encrypted; every claim has an id of its own (see `identified`); missing
    status, stage and date get their defaults."""
    ok = identified(accepted(claims))
    stage = F.coalesce(F.col("processing_stage") if "processing_stage" in claims.columns else F.lit(None), F.lit("completed"))
    return ok.withColumns({
        "processing_status": F.coalesce("processing_status", F.lit("completed")), "processing_stage": stage,
        "service_to_date": F.coalesce("service_to_date", "service_from_date"), "patient_account_number": encrypted(F.col("patient_account_number"), key),
    })


def transitions(judged: DataFrame, *keys: str) -> DataFrame:
    """A row for every stage that a claim reaches: validation, then rules and the model if nothing was found before, and
    the outcome."""
    good, ruled = F.size("validation_errors") == 0, F.size("rule_errors") == 0
    stages = F.array_compact(F.array(F.lit("validation"), F.when(good, "rules"), F.when(good & ruled, "ml"), F.when(good & ruled, "completed").otherwise("failed")))
    return judged.select(*keys, "claim_id", F.posexplode(stages).alias("step", "stage"))


def reprocess(letters: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Of the n oldest dead letters, those with a claim's id, to be inserted, and the others, which have failed."""
    oldest = letters.orderBy("inserted_at", "dlq_id").limit(n)
    known = F.col("claim_id").isNotNull()
    return oldest.where(known).withColumn("resolution", F.lit("inserted")), oldest.where(~known).withColumn("resolution", F.lit("failed"))


def queue_order(df: DataFrame, *partition: str) -> DataFrame:
    """queue_place within each partition: higher priority first, then arrival, then id."""
    order = Window.partitionBy(*partition).orderBy(priority_rank(F.col("priority")).desc(), "created_at", "claim_id")
    return df.withColumn("queue_place", F.row_number().over(order).cast("long"))


def requeue(tried: DataFrame, path: str, attempt: int) -> None:
    """After a retry: claims without errors go to path/completed, the others back to path/queue as attempt number
    `attempt`. tried has errors as text; it is kept for both writes."""
    kept = tried.persist()
    try:
        queue_claims(kept.where("errors <> ''").withColumn("attempt", F.lit(attempt)), f"{path}/queue")
        kept.where("errors = ''").write.mode("append").parquet(f"{path}/completed")
    finally:
        kept.unpersist()


def fetch_batch(claims: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """n claims in queue order; limited before any lines are joined."""
    return claims.orderBy(priority_rank(F.col("priority")).desc(), "created_at", "claim_id").offset(offset).limit(n)
