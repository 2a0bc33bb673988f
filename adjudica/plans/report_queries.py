"""Report queries: failures, revenue, windows, ranked lists, models, privacy, reference-data changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.catalog import CLAIMS
from adjudica.functions.features import FeaturePipeline
from adjudica.functions.scalar import following_codes, hidden, mask_account, priority_rank, sanitized, sanitized_all, where_column
from adjudica.model import adapter as m
from adjudica.model.adapter import CTE, NOW
from adjudica.operators import analytics, models, outcomes, privacy, sync, windows
from adjudica.operators.analytics import as_double
from adjudica.sources import files
from adjudica.sources.keyed_table import KeyedTable

from .claims_queries import _BATCH, CLASS_FILTER, CODE_FILTER, FLOW_FAILED, batch, checked, class_filter, code_filter, failed, flow_failed, judged

SAMPLES = "SELECT event_id, event_type AS name, ts, value FROM events"
#: Seconds that each user's claims took, as batches.
BATCHES = "SELECT user_id AS batch_id, count(*) AS claims, sum(value::DECIMAL(20,6))::DOUBLE AS seconds FROM events GROUP BY user_id"


def days_ago(n: int) -> F.Column:
    return F.date_sub(F.to_date(F.lit(NOW)), n)


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """quality stands for a prediction, toxic for the truth."""
    return m.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("predicted"), F.col("toxic").alias("actual"), F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("version"))


def batches(spark: SparkSession, sf: str) -> DataFrame:
    return m.events(spark, sf).groupBy(F.col("user_id").alias("batch_id")).agg(F.count(F.lit(1)).alias("claims"), F.sum(F.col("value").cast("decimal(20,6)")).cast("double").alias("seconds"))


# --- failures and revenue


@CLAIMS.add("failure_reason_counts", CTE + "SELECT errors AS reason, count(*) AS n FROM failed GROUP BY errors")
def failure_reason_counts(spark, sf):
    return analytics.counts(failed(spark, sf), F.col("errors").alias("reason"))


@CLAIMS.add("failure_counts_by_category", _BATCH + FLOW_FAILED + "SELECT failure_category, count(*) AS n FROM flow_failed GROUP BY failure_category")
def failure_counts_by_category(spark, sf):
    return analytics.counts(flow_failed(spark, sf), "failure_category")


@CLAIMS.add("failure_trend", CTE + f"SELECT failed_on, count(*) AS n FROM failed WHERE failed_on >= DATE '{NOW}' - 180 GROUP BY failed_on")
def failure_trend(spark, sf):
    return analytics.counts(failed(spark, sf).where(F.col("failed_on") >= days_ago(180)), "failed_on").orderBy("failed_on")


@CLAIMS.add("failed_summary", CTE + "SELECT failed_on, count(*) AS failed FROM failed GROUP BY failed_on")
def failed_summary(spark, sf):
    return analytics.counts(failed(spark, sf), "failed_on", name="failed")


@CLAIMS.add("since_days", CTE + f"SELECT claim_id, service_from_date FROM claims WHERE service_from_date >= DATE '{NOW}' - 180")
def since_days(spark, sf):
    return m.claims(spark, sf).where(F.col("service_from_date") >= days_ago(180)).select("claim_id", "service_from_date")


@CLAIMS.add("potential_revenue_loss", CTE + "SELECT coalesce(sum(potential_revenue_loss), 0)::DECIMAL(28,4)::DOUBLE AS loss FROM failed")
def potential_revenue_loss(spark, sf):
    return analytics.revenue_loss(failed(spark, sf))


@CLAIMS.add("revenue_loss_by_category", CTE + "SELECT CASE WHEN facility_id % 4 = 0 THEN 'unknown' ELSE 'f' || facility_id % 4 END AS category, coalesce(sum(potential_revenue_loss), 0)::DECIMAL(28,4)::DOUBLE AS loss FROM failed GROUP BY 1")
def revenue_loss_by_category(spark, sf):
    part = F.when(F.col("facility_id") % 4 != 0, F.concat(F.lit("f"), (F.col("facility_id") % 4).cast("string")))
    return analytics.revenue_loss_by(failed(spark, sf), part, "category")


@CLAIMS.add("facility_totals", CTE + "SELECT facility_id, count(*) AS claims, sum(total_charge_amount)::DECIMAL(28,4)::DOUBLE AS charges FROM claims GROUP BY facility_id")
def facility_totals(spark, sf):
    return analytics.totals(m.claims(spark, sf), "facility_id")


@CLAIMS.add("daily_claim_totals", CTE + "SELECT service_to_date, count(*) AS claims, sum(total_charge_amount)::DECIMAL(28,4)::DOUBLE AS charges FROM claims GROUP BY service_to_date")
def daily_claim_totals(spark, sf):
    return analytics.totals(m.claims(spark, sf), "service_to_date")


@CLAIMS.add("status_counts", CTE + "SELECT processing_status, count(*) AS n FROM claims GROUP BY processing_status")
def status_counts(spark, sf):
    return analytics.counts(m.claims(spark, sf), "processing_status")


@CLAIMS.add("rvu_stats", CTE + "SELECT count(*) AS codes, count(*) FILTER (status = 'ACTIVE') AS active, round(sum(total_rvu)::DECIMAL(28,5)::DOUBLE / count(total_rvu), 6) AS mean_rvu, min(total_rvu)::DOUBLE AS least_rvu, max(total_rvu)::DOUBLE AS most_rvu, count(DISTINCT category) AS categories FROM rvu")
def rvu_stats(spark, sf):
    return analytics.rvu_stats(m.rvu(spark, sf))


@CLAIMS.add("daily_processing_summary", CTE + """, per_claim AS (SELECT claim_id, count(*) AS n_lines, sum(reimbursement) AS paid FROM priced GROUP BY claim_id),
sums AS (SELECT service_from_date AS day, facility_id, count(*) AS claims, count(*) FILTER (errors <> '') AS failed, coalesce(sum(n_lines), 0)::BIGINT AS lines, sum(total_charge_amount)::DECIMAL(28,4)::DOUBLE AS charges, coalesce(sum(paid), 0)::DECIMAL(28,4)::DOUBLE AS reimbursement
  FROM validated LEFT JOIN per_claim USING (claim_id) GROUP BY 1, 2)
SELECT *, round(CASE WHEN charges <> 0 THEN reimbursement / charges ELSE 0 END, 6) AS reimbursement_rate, round(failed::DOUBLE / claims, 6) AS error_rate, round((claims - failed)::DOUBLE / claims, 6) AS pass_rate FROM sums""")
def daily_processing_summary(spark, sf):
    return analytics.daily_summary(judged(spark, sf))


@CLAIMS.add("sla_violations", f"SELECT coalesce(sum(claims), 0)::BIGINT AS violations FROM ({BATCHES}) WHERE claims > 0 AND seconds / claims > 50.0")
def sla_violations(spark, sf):
    return analytics.sla_violations(batches(spark, sf), 50.0)


@CLAIMS.add("alerts", CTE + """, metrics AS (SELECT 'batch_processing_rate_per_sec' AS metric, round(count(*) / 30.0, 4)::DOUBLE AS value FROM claims UNION ALL SELECT 'error_rate', round(avg((errors <> '')::INT), 6) FROM validated UNION ALL SELECT 'cpu_usage_percent', 0.0)
SELECT metric, CASE metric WHEN 'error_rate' THEN printf('High error rate: %.2f%%', value * 100) ELSE printf('Throughput below threshold: %.2f', value) END AS message FROM metrics WHERE metric = 'batch_processing_rate_per_sec' AND value <> 0 AND value < 1000 OR metric = 'error_rate' AND value > 0.05""")
def alerts(spark, sf):
    v = checked(spark, sf).agg(F.round(F.count(F.lit(1)) / 30.0, 4).alias("batch_processing_rate_per_sec"), F.round(F.avg((F.size("errors") > 0).cast("double")), 6).alias("error_rate"), F.lit(0.0).alias("cpu_usage_percent"))
    metrics = v.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in v.columns])).alias("x")).select("x.*")
    return analytics.alerts(metrics)


@CLAIMS.add("compliance_dashboard", _BATCH + FLOW_FAILED + f""", top AS (SELECT errors, count(*) AS n FROM flow_failed GROUP BY errors ORDER BY n DESC, errors LIMIT 5),
days AS (SELECT failed_on, count(*) AS n FROM flow_failed WHERE failed_on >= DATE '{NOW}' - 180 GROUP BY failed_on),
losses AS (SELECT failure_category, sum(potential_revenue_loss)::DECIMAL(28,4)::DOUBLE AS loss FROM flow_failed GROUP BY failure_category)
SELECT (SELECT count(*) FROM events) AS audit_events, (SELECT count(DISTINCT service_to_date) FROM claims WHERE service_to_date < DATE '1996-06-01') AS archives, (SELECT max(service_to_date) FROM claims WHERE service_to_date < DATE '1996-06-01') AS latest_archive,
  (SELECT string_agg(errors || ':' || n, ';' ORDER BY n DESC, errors) FROM top) AS top_errors, (SELECT coalesce(string_agg(failed_on || ':' || n, ';' ORDER BY failed_on), '') FROM days) AS trend,
  (SELECT string_agg(failure_category || ':' || printf('%.2f', loss), ';' ORDER BY failure_category) FROM losses) AS loss_by_category, (SELECT coalesce(sum(potential_revenue_loss), 0)::DECIMAL(28,4)::DOUBLE FROM flow_failed) AS loss""")
def compliance_dashboard(spark, sf):
    archived = m.claims(spark, sf).where("service_to_date < date'1996-06-01'").select(F.col("service_to_date").alias("day")).distinct()
    return analytics.dashboard(flow_failed(spark, sf), m.events(spark, sf), archived, days_ago(180))


@CLAIMS.add("audit_event_count", "SELECT count(*) AS n FROM events")
def audit_event_count(spark, sf):
    return m.events(spark, sf).agg(F.count(F.lit(1)).alias("n"))


@CLAIMS.add("query_log_summary", "SELECT lower(string_split(event_type || ' from t', ' ')[1]) AS verb, CASE WHEN user_id % 2 = 0 THEN 'postgres' ELSE 'sqlserver' END AS database, count(*) AS n, round(sum(value::DECIMAL(20,4))::DECIMAL(28,4)::DOUBLE / count(*), 4) AS mean_duration FROM events GROUP BY 1, 2")
def query_log_summary(spark, sf):
    return analytics.log_summary(query_log(spark, sf))


def query_log(spark: SparkSession, sf: str) -> DataFrame:
    e = m.events(spark, sf)
    return e.select(F.concat("name", F.lit(" from t")).alias("statement"), F.when(F.col("user_id") % 2 == 0, "postgres").otherwise("sqlserver").alias("database"), F.col("value").alias("duration"))


@CLAIMS.add("top_slowest", "SELECT verb, mean_duration FROM (SELECT lower(event_type) AS verb, round(sum(value::DECIMAL(20,4))::DECIMAL(28,4)::DOUBLE / count(*), 4) AS mean_duration FROM events GROUP BY 1) ORDER BY mean_duration DESC, verb LIMIT 3")
def top_slowest(spark, sf):
    return windows.top(analytics.log_summary(query_log(spark, sf).withColumn("database", F.lit("all"))).select("verb", "mean_duration"), 3, F.desc("mean_duration"), F.asc("verb"))


@CLAIMS.add("where_columns", "SELECT regexp_extract('select * from t Where ' || event_type || '_' || user_id || ' = 1', '(?i)where\\s+(\\w+)', 1) AS column_name, event_id FROM events")
def where_columns(spark, sf):
    e = m.events(spark, sf)
    return e.select(where_column(F.concat(F.lit("select * from t Where "), "name", F.lit("_"), F.col("user_id").cast("string"), F.lit(" = 1"))).alias("column_name"), "event_id")


# --- windows and ranked lists

_W = "WINDOW w AS (PARTITION BY name ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@CLAIMS.add("moving_average", f"SELECT event_id, round(sum(value::DECIMAL(20,6)) OVER w::DOUBLE / count(value) OVER w, 6) AS moving_average FROM ({SAMPLES}) {_W}".replace("OVER w::DOUBLE", "OVER w * 1.0::DOUBLE"))
def moving_average(spark, sf):
    return windows.moving_average(m.events(spark, sf), 10).select("event_id", "moving_average")


@CLAIMS.add("trend", f"SELECT event_id, round(value - first_value(value) OVER w, 6) AS trend FROM ({SAMPLES}) {_W}")
def trend(spark, sf):
    return windows.trend(m.events(spark, sf), 10).select("event_id", "trend")


@CLAIMS.add("forecast", f"SELECT event_id, round((sum(value::DECIMAL(20,6)) OVER w)::DOUBLE / count(*) OVER w + (value - first_value(value) OVER w) / greatest(count(*) OVER w - 1, 1), 6) AS forecast FROM ({SAMPLES}) {_W}")
def forecast(spark, sf):
    return windows.forecast(m.events(spark, sf), 10).select("event_id", "forecast")


@CLAIMS.add("latency_p99", f"WITH newest AS (SELECT name, value, event_id FROM ({SAMPLES}) QUALIFY row_number() OVER (PARTITION BY name ORDER BY ts DESC, event_id DESC) <= 1000), ranked AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY name) AS samples FROM newest) SELECT name, samples, value AS p99 FROM ranked WHERE r = least(samples * 99 // 100, samples - 1) + 1")
def latency_p99(spark, sf):
    return windows.latency_p99(m.events(spark, sf))


@CLAIMS.add("rolling_hour", f"SELECT event_id, (sum(value::DECIMAL(20,6)) OVER (PARTITION BY name ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW))::DOUBLE AS hour_sum FROM ({SAMPLES})")
def rolling_hour(spark, sf):
    return windows.rolling_hour(m.events(spark, sf)).select("event_id", "hour_sum")


_RANK = "CASE priority WHEN 'high' THEN 3 WHEN 'normal' THEN 2 ELSE 1 END"


@CLAIMS.add("priority_rank", CTE + f"SELECT claim_id, {_RANK} AS rank FROM claims")
def ranked_priorities(spark, sf):
    return m.claims(spark, sf).select("claim_id", priority_rank(F.col("priority")).alias("rank"))


@CLAIMS.add("priority_order", CTE + f"SELECT claim_id, facility_id, row_number() OVER (PARTITION BY facility_id ORDER BY {_RANK} DESC, created_at, claim_id) AS queue_place FROM claims")
def priority_order(spark, sf):
    return outcomes.queue_order(m.claims(spark, sf), "facility_id").select("claim_id", "facility_id", "queue_place")


@CLAIMS.add("pending_claims", CTE + f"SELECT claim_id, priority FROM claims WHERE processing_status IN ('pending', 'received', 'processing') AND {_RANK} > 1")
def pending_claims(spark, sf):
    c = m.claims(spark, sf)
    return c.where(F.col("processing_status").isin("pending", "received", "processing") & (priority_rank(F.col("priority")) > 1)).select("claim_id", "priority")


@CLAIMS.add("fetch_batch", CTE + f", chosen AS (SELECT * FROM claims ORDER BY {_RANK} DESC, created_at, claim_id LIMIT 200 OFFSET 100) SELECT claim_id, count(line_number) AS n_lines FROM chosen LEFT JOIN (SELECT claim_id, line_number FROM lines) l USING (claim_id) GROUP BY claim_id")
def fetch_batch(spark, sf):
    chosen = outcomes.fetch_batch(m.claims(spark, sf), 200, 100).select("claim_id")
    return chosen.join(m.lines(spark, sf).select("claim_id", "line_number"), "claim_id", "left").groupBy("claim_id").agg(F.count("line_number").alias("n_lines"))


@CLAIMS.add("next_code_counts", "WITH s AS (SELECT event_type AS code, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_code FROM events), n AS (SELECT code, next_code, count(*) AS n FROM s WHERE next_code IS NOT NULL GROUP BY 1, 2) SELECT code, next_code, n, row_number() OVER (PARTITION BY code ORDER BY n DESC, next_code) AS place FROM n QUALIFY place <= 3")
def next_code_counts(spark, sf):
    return windows.next_code_counts(m.events(spark, sf), 3, "user_id", "name", "at", "event_id")


@CLAIMS.add("top_failure_reasons", CTE + "SELECT errors AS reason, count(*) AS n FROM failed GROUP BY errors ORDER BY n DESC, errors LIMIT 5")
def top_failure_reasons(spark, sf):
    return windows.top(failure_reason_counts(spark, sf), 5, F.desc("n"), F.asc("reason"))


@CLAIMS.add("recent_failed", CTE + "SELECT claim_id, failed_on FROM failed ORDER BY failed_on DESC, claim_id DESC LIMIT 100")
def recent_failed(spark, sf):
    return windows.top(failed(spark, sf).select("claim_id", "failed_on"), 100, F.desc("failed_on"), F.desc("claim_id"))


@CLAIMS.add("top_rvu_codes", CTE + "SELECT procedure_code, total_rvu::DOUBLE AS total_rvu FROM rvu WHERE status = 'ACTIVE' ORDER BY rvu.total_rvu DESC NULLS LAST, procedure_code LIMIT 50")
def top_rvu_codes(spark, sf):
    return windows.top(sync.full(m.rvu(spark, sf)), 50, F.col("total_rvu").desc_nulls_last(), F.asc("procedure_code")).select("procedure_code", F.col("total_rvu").cast("double").alias("total_rvu"))


@CLAIMS.add("sort_failed", CTE + "SELECT claim_id, potential_revenue_loss::DOUBLE AS loss FROM failed")
def sort_failed(spark, sf):
    return failed(spark, sf).orderBy(F.desc("potential_revenue_loss"), "claim_id").select("claim_id", F.col("potential_revenue_loss").cast("double").alias("loss"))


@CLAIMS.add("sync_history", "SELECT event_id AS sync_id, event_type AS sync_type FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 20")
def sync_history(spark, sf):
    return windows.top(m.events(spark, sf).where("name <> 'view'"), 20, F.desc("at"), F.desc("event_id")).select(F.col("event_id").alias("sync_id"), F.col("name").alias("sync_type"))


@CLAIMS.add("search_failed", CTE + """SELECT claim_id FROM failed WHERE contains(lower(concat_ws(' ', claim_id, patient_account_number, facility_id, failure_reason, failure_category, 'validation', errors,
  CASE WHEN errors LIKE '%invalid_facility%' THEN 'Verify facility_id' END, CASE WHEN errors LIKE '%invalid_financial_class%' THEN 'Check financial_class' END, CASE WHEN errors LIKE '%invalid_dob%' THEN 'Check date_of_birth' END,
  CASE WHEN errors LIKE '%invalid_service_dates%' THEN 'Correct service dates' END, potential_revenue_loss, failed_on)), 'date_of')""")
def search_failed(spark, sf):
    return outcomes.search(failed(spark, sf), "Date_Of").select("claim_id")


# --- privacy and text


@CLAIMS.add("mask_phi", CTE + "SELECT claim_id, CASE WHEN patient_account_number = '' THEN '' ELSE substr(patient_account_number, 1, 2) || '***' END AS account, '***' AS name, '***' AS dob FROM claims")
def mask_phi(spark, sf):
    return privacy.mask(m.claims(spark, sf)).select("claim_id", F.col("patient_account_number").alias("account"), F.col("patient_name").alias("name"), F.col("date_of_birth").alias("dob"))


@CLAIMS.add("mask_conversations", "SELECT conv_id, turn, CASE WHEN role = '' THEN role ELSE substr(role, 1, 2) || '***' END AS account, CASE WHEN text IS NOT NULL THEN '***' END AS text FROM conversations")
def mask_conversations(spark, sf):
    return m.table(spark, sf, "conversations").select("conv_id", "turn", mask_account(F.col("role")).alias("account"), hidden(F.col("text")).alias("text"))


@CLAIMS.add("phi_round_trip", CTE + "SELECT claim_id, patient_account_number, patient_name, true AS hidden FROM claims")
def phi_round_trip(spark, sf):
    secret = privacy.encrypt(m.claims(spark, sf).withColumn("before", F.col("patient_name")), "key of the claims").withColumn("hidden", F.col("patient_name") != F.col("before"))
    return privacy.decrypt(secret, "key of the claims").select("claim_id", "patient_account_number", "patient_name", "hidden")


@CLAIMS.add("sanitize_pages", "SELECT page_id, md5(replace(replace(html, '<', ''), '>', '')) AS digest FROM pages")
def sanitize_pages(spark, sf):
    return m.table(spark, sf, "pages").select("page_id", F.md5(sanitized(F.col("html"))).alias("digest"))


@CLAIMS.add("sanitize_lists", "SELECT page_id, md5(replace(replace(replace(html, '<', ''), '>', ''), chr(10), '|')) AS digest FROM pages")
def sanitize_lists(spark, sf):
    return m.table(spark, sf, "pages").select("page_id", F.md5(F.array_join(sanitized_all(F.split("html", "\n")), "|")).alias("digest"))


@CLAIMS.add("sequential_codes", CTE + "SELECT procedure_code, 'P' || lpad((procedure_code + 1)::VARCHAR, 7, '0') || ',P' || lpad((procedure_code + 2)::VARCHAR, 7, '0') AS following FROM rvu")
def sequential_codes(spark, sf):
    code = F.concat(F.lit("P"), F.lpad(F.col("procedure_code").cast("string"), 7, "0"))
    return m.rvu(spark, sf).select("procedure_code", F.concat_ws(",", following_codes(code, 2)).alias("following"))


# --- models


@CLAIMS.add("features", CTE + "SELECT claim_id, length(procedure_code::VARCHAR)::DOUBLE AS procedure_code_len, (('0x' || substr(md5(financial_class), 1, 8))::BIGINT % 1000)::DOUBLE AS financial_class_id, (primary_diagnosis IS NOT NULL)::INT::DOUBLE AS has_diagnosis FROM claims")
def features(spark, sf):
    return FeaturePipeline().run(m.claims(spark, sf)).select("claim_id", "procedure_code_len", "financial_class_id", "has_diagnosis")


_AB = "CASE WHEN ('0x' || substr(md5(claim_id::VARCHAR), 1, 8))::BIGINT % 10000 < 3000 THEN 'a' ELSE 'b' END"


@CLAIMS.add("ab_route", CTE + f"SELECT claim_id, {_AB} AS variant FROM claims")
def ab_route(spark, sf):
    return m.claims(spark, sf).select("claim_id", models.ab_variant(F.col("claim_id"), 0.3).alias("variant"))


@CLAIMS.add("ab_exposure", CTE + f", routed AS (SELECT {_AB} AS variant FROM claims) SELECT variant, count(*) AS n, (SELECT count(*) FROM routed) AS total, round(count(*)::DOUBLE / (SELECT count(*) FROM routed), 6) AS share FROM routed GROUP BY variant")
def ab_exposure(spark, sf):
    return analytics.exposure(ab_route(spark, sf))


_LABELS = "WITH l AS (SELECT 'v' || doc_id % 3 AS version, quality AS predicted, toxic AS actual FROM labels)"


@CLAIMS.add("model_prediction_counts", _LABELS + " SELECT version, predicted, count(*) AS n, (sum(count(*)) OVER (PARTITION BY version))::BIGINT AS total FROM l GROUP BY version, predicted")
def model_prediction_counts(spark, sf):
    return analytics.prediction_counts(labels(spark, sf))


@CLAIMS.add("model_accuracy", _LABELS + " SELECT version, count(*) AS total, count(*) FILTER (predicted = actual) AS correct, round(count(*) FILTER (predicted = actual)::DOUBLE / count(*), 6) AS accuracy FROM l GROUP BY version")
def model_accuracy(spark, sf):
    return analytics.accuracy(labels(spark, sf))


@CLAIMS.add("failure_frequency", CTE + "SELECT procedure_code::VARCHAR AS code, count(*) AS total, count(*) FILTER (errors <> '') AS positives, round(count(*) FILTER (errors <> '')::DOUBLE / count(*), 6) AS p FROM validated GROUP BY 1")
def failure_frequency(spark, sf):
    return analytics.failure_frequency(checked(spark, sf), "procedure_code", F.size("errors") > 0)


def learnable(spark: SparkSession, sf: str) -> DataFrame:
    """What the models look at of all validated claims, written once for those that fit on it and predict from it."""
    path = files.shared_folder(spark)
    own = checked(spark, sf).select("claim_id", "facility_id", "procedure_code", "financial_class", "primary_diagnosis", (F.size("errors") > 0).cast("double").alias("bad"))
    own.write.parquet(path)
    return spark.read.schema(own.schema).parquet(path)


@CLAIMS.add("train_filter")
def train_filter(spark, sf):
    data = learnable(spark, sf)
    model, accuracy = models.train_filter(data, "bad")
    return analytics.counts(models.predict_filter(data, model), "filter_number").withColumn("accuracy", F.lit(float(accuracy)))


@CLAIMS.add("failure_probability")
def failure_probability(spark, sf):
    data = checked(spark, sf).withColumn("bad", (F.size("errors") > 0).cast("double"))
    return models.failure_probability(data, "bad").select("claim_id", "p_fail")


@CLAIMS.add("predict_filter", CTE + f"SELECT claim_id, {CODE_FILTER} AS filter_number FROM claims")
def predict_filter(spark, sf):
    return models.predict_filter(m.claims(spark, sf), code_filter).select("claim_id", "filter_number")


@CLAIMS.add("ab_predictions", CTE + f"SELECT claim_id, {_AB} AS variant, CASE {_AB} WHEN 'a' THEN {CODE_FILTER} ELSE {CLASS_FILTER} END AS filter_number FROM claims")
def ab_predictions(spark, sf):
    return models.ab_predict(m.claims(spark, sf), code_filter, class_filter, "claim_id", 0.3).select("claim_id", "variant", "filter_number")


@CLAIMS.add("ab_fitted")
def ab_fitted(spark, sf):
    """Both variants are forests, fitted on claims of either half of the facilities."""
    data = learnable(spark, sf)
    a, b = (models.train_filter(data.where(F.col("facility_id") % 2 == k), "bad")[0] for k in (0, 1))
    return analytics.counts(models.ab_predict(data, a, b, "claim_id", 0.3), "variant", "filter_number")


# --- reference data and records that change

#: The cache lags behind: what changed after LAST_SYNC is missing there, one category has other values.
LAST_SYNC, CHANGED = "1998-11-10", "1998-11-01"
_CACHE = f"cache AS (SELECT procedure_code, CASE WHEN category = 'PROMO' THEN total_rvu + 1 ELSE total_rvu END AS total_rvu, status, updated_on FROM rvu WHERE updated_on <= DATE '{LAST_SYNC}')"
_NEWER = f"r.updated_on > DATE '{CHANGED}'"


def source_and_cache(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rvu = m.rvu(spark, sf).withColumn("total_rvu", F.col("total_rvu").cast("decimal(12,5)"))
    source = rvu.select("procedure_code", "total_rvu", "status", "updated_on")
    stale = F.when(F.col("category") == "PROMO", F.col("total_rvu") + 1).otherwise(F.col("total_rvu")).cast("decimal(12,5)")
    return source, rvu.where(F.col("updated_on") <= F.to_date(F.lit(LAST_SYNC))).withColumn("total_rvu", stale).select(*source.columns)


@CLAIMS.add("upsert_rvu", CTE + f", {_CACHE} SELECT r.procedure_code, CASE WHEN c.procedure_code IS NULL OR {_NEWER} THEN r.total_rvu ELSE c.total_rvu END::DOUBLE AS total_rvu FROM rvu r LEFT JOIN cache c USING (procedure_code) WHERE c.procedure_code IS NOT NULL OR {_NEWER}")
def upsert_rvu(spark, sf):
    source, cache = source_and_cache(spark, sf)
    return outcomes.upsert(cache, source.where(F.col("updated_on") > F.to_date(F.lit(CHANGED))), "procedure_code").select("procedure_code", F.col("total_rvu").cast("double").alias("total_rvu"))


@CLAIMS.add("reconcile_rvu", CTE + f", {_CACHE} SELECT procedure_code, CASE WHEN c.total_rvu IS NULL THEN 'only_source' WHEN abs(r.total_rvu - c.total_rvu) > 0.01 THEN 'differs' ELSE 'same' END AS state FROM rvu r FULL JOIN cache c USING (procedure_code)")
def reconcile_rvu(spark, sf):
    return outcomes.reconcile(*source_and_cache(spark, sf)).select("procedure_code", "state")


@CLAIMS.add("rvu_status", CTE + f", {_CACHE} SELECT count(r.procedure_code) AS source_rows, count(c.procedure_code) AS cache_rows, count(*) FILTER (abs(r.total_rvu - c.total_rvu) > 0.01) AS differing, count(*) FILTER (c.total_rvu IS NULL OR abs(r.total_rvu - c.total_rvu) > 0.01) AS unequal, count(*) FILTER (c.total_rvu IS NULL OR abs(r.total_rvu - c.total_rvu) > 0.01) > 0 AS sync_required FROM (SELECT * FROM rvu WHERE status = 'ACTIVE') r FULL JOIN (SELECT * FROM cache WHERE status = 'ACTIVE') c USING (procedure_code)")
def rvu_status(spark, sf):
    return sync.status(*source_and_cache(spark, sf))


@CLAIMS.add("rvu_incremental_sync", CTE + f", {_CACHE} SELECT r.procedure_code, CASE WHEN c.procedure_code IS NULL OR {_NEWER} THEN r.total_rvu ELSE c.total_rvu END::DOUBLE AS total_rvu FROM rvu r LEFT JOIN cache c USING (procedure_code) WHERE c.procedure_code IS NOT NULL OR {_NEWER}")
def rvu_incremental_sync(spark, sf):
    """Into a standing table: only the changed rows are written."""
    source, cache = source_and_cache(spark, sf)
    table = rvu_table(spark, cache)
    sync.incremental_into(table, source, sync_log(spark, sf))
    return table.read().select("procedure_code", F.col("total_rvu").cast("double").alias("total_rvu"))


def rvu_table(spark: SparkSession, cache: DataFrame) -> KeyedTable:
    """A new keyed table with the rows of the cache."""
    table = KeyedTable(spark, files.shared_folder(spark), cache.schema, ("procedure_code",), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    table.replace(cache)
    return table


@CLAIMS.add("rvu_table_merge", CTE + f", {_CACHE} SELECT r.procedure_code, CASE WHEN c.procedure_code IS NULL OR {_NEWER} THEN r.total_rvu ELSE c.total_rvu END::DOUBLE AS total_rvu FROM rvu r LEFT JOIN cache c USING (procedure_code) WHERE c.procedure_code IS NOT NULL OR {_NEWER}")
def rvu_table_merge(spark, sf):
    """The changes as three batches into a standing table, one of them delivered twice; older versions cleared away."""
    source, cache = source_and_cache(spark, sf)
    table = rvu_table(spark, cache)
    changes = source.where(F.col("updated_on") > F.to_date(F.lit(CHANGED)))
    for batch in (0, 1, 1, 2):
        table.merge(changes.where(F.col("procedure_code") % 3 == batch), "feed", batch)
    table.vacuum()
    return table.read().select("procedure_code", F.col("total_rvu").cast("double").alias("total_rvu"))


def sync_log(spark: SparkSession, sf: str) -> DataFrame:
    """A completed sync a day before CHANGED for each region."""
    return m.table(spark, sf, "region").select(F.lit("completed").alias("sync_status"), F.date_sub(F.to_date(F.lit(CHANGED)), F.col("r_regionkey")).alias("completed_on"))


@CLAIMS.add("rvu_sync_log", CTE + f"SELECT 'incremental' AS sync_type, count(*) AS records_processed, 'completed' AS sync_status, DATE '{NOW}' AS completed_on FROM rvu r WHERE {_NEWER}")
def rvu_sync_log(spark, sf):
    return sync.log_row(source_and_cache(spark, sf)[0], sync_log(spark, sf), F.to_date(F.lit(NOW)))


_STATES = "count(*) FILTER (c.total_rvu IS NULL OR r.total_rvu IS NULL OR abs(r.total_rvu - c.total_rvu) > 0.01) AS unequal"


@CLAIMS.add("rvu_force_sync", CTE + f""", {_CACHE}, synced AS (SELECT r.procedure_code, CASE WHEN c.procedure_code IS NULL OR {_NEWER} THEN r.total_rvu ELSE c.total_rvu END AS total_rvu, r.status FROM rvu r LEFT JOIN cache c USING (procedure_code) WHERE c.procedure_code IS NOT NULL OR {_NEWER})
SELECT 'before' AS phase, {_STATES} FROM (SELECT * FROM rvu WHERE status = 'ACTIVE') r FULL JOIN (SELECT * FROM cache WHERE status = 'ACTIVE') c USING (procedure_code)
UNION ALL SELECT 'after', {_STATES} FROM (SELECT * FROM rvu WHERE status = 'ACTIVE') r FULL JOIN (SELECT * FROM synced WHERE status = 'ACTIVE') c USING (procedure_code)""")
def rvu_force_sync(spark, sf):
    return sync.force_if_needed(*source_and_cache(spark, sf), sync_log(spark, sf))[1].select("phase", "unequal")


@CLAIMS.add("rvu_full_sync", CTE + "SELECT procedure_code, status FROM rvu WHERE status = 'ACTIVE'")
def rvu_full_sync(spark, sf):
    """Swapped in for the standing table's rows as a whole."""
    table = rvu_table(spark, m.rvu(spark, sf).where("status = 'INACTIVE'").select("procedure_code", "status"))
    sync.full_into(table, m.rvu(spark, sf).select("procedure_code", "status"))
    return table.read().select("procedure_code", "status")


@CLAIMS.add("rvu_bulk_update", CTE + "SELECT count(*) FILTER (code <= top) AS updated, count(*) FILTER (code > top) AS failed FROM (SELECT procedure_code * 3 AS code, (SELECT max(procedure_code) FROM rvu) AS top FROM rvu)")
def rvu_bulk_update(spark, sf):
    rvu = m.rvu(spark, sf).select("procedure_code", "category")
    changes = rvu.select((F.col("procedure_code") * 3).alias("procedure_code"), F.lit("NEW").alias("category"))
    return sync.bulk_update(rvu, changes)[1]


_BULK = "(SELECT procedure_code * 3 AS procedure_code, 'changed ' || description AS description, 'NEW' AS category, CASE WHEN procedure_code % 2 = 0 THEN 'SUB' END AS subcategory, total_rvu + 1 AS total_rvu, 'INACTIVE' AS status, updated_on + 1 AS updated_on FROM rvu)"


@CLAIMS.add("rvu_bulk_update_rows", CTE + f"SELECT procedure_code, coalesce(c.description, r.description) AS description, coalesce(c.category, r.category) AS category, coalesce(c.subcategory, r.subcategory) AS subcategory, coalesce(c.total_rvu, r.total_rvu)::DOUBLE AS total_rvu, coalesce(c.status, r.status) AS status, coalesce(c.updated_on, r.updated_on)::DATE AS updated_on FROM rvu r LEFT JOIN {_BULK} c USING (procedure_code)")
def rvu_bulk_update_rows(spark, sf):
    """All six columns; a null in the changes leaves what was there."""
    rvu = m.rvu(spark, sf).withColumn("total_rvu", F.col("total_rvu").cast("decimal(12,5)"))
    changes = rvu.select(
        (F.col("procedure_code") * 3).alias("procedure_code"), F.concat(F.lit("changed "), "description").alias("description"), F.lit("NEW").alias("category"),
        F.when(F.col("procedure_code") % 2 == 0, "SUB").alias("subcategory"), (F.col("total_rvu") + 1).cast("decimal(12,5)").alias("total_rvu"),
        F.lit("INACTIVE").alias("status"), F.date_add("updated_on", 1).alias("updated_on"),
    )
    return sync.bulk_update(rvu, changes)[0].withColumn("total_rvu", F.col("total_rvu").cast("double"))


@CLAIMS.add("recent_changes", CTE + "SELECT procedure_code, updated_on FROM rvu WHERE updated_on >= DATE '1998-12-01' - 10")
def recent_changes(spark, sf):
    return sync.recent(m.rvu(spark, sf), days_ago(10)).select("procedure_code", "updated_on").orderBy(F.desc("updated_on"))


@CLAIMS.add("audit_diff", CTE + f", {_CACHE} SELECT r.procedure_code::VARCHAR AS record_id, CASE WHEN c.procedure_code IS NULL THEN 'insert' ELSE 'update' END AS operation, CASE WHEN c.procedure_code IS NULL THEN 'total_rvu,status' ELSE 'total_rvu' END AS changed FROM rvu r LEFT JOIN cache c USING (procedure_code) WHERE c.procedure_code IS NULL OR r.total_rvu <> c.total_rvu")
def audit_diff(spark, sf):
    source, cache = (x.drop("updated_on") for x in source_and_cache(spark, sf))
    return outcomes.audit_diff(cache, source, "procedure_code", "rvu_data", "sync", "incremental").select("record_id", "operation", "changed")


@CLAIMS.add("seed_classes", CTE + ", pairs AS (SELECT DISTINCT facility_id, financial_class FROM claims WHERE processing_status = 'processing' AND priority = 'low') SELECT facility_id, financial_class, false AS seeded FROM pairs UNION ALL SELECT f.facility_id, k.financial_class, true FROM facilities f, classes k WHERE f.active AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.facility_id = f.facility_id AND p.financial_class = k.financial_class)")
def seed_classes(spark, sf):
    present = m.claims(spark, sf).where("processing_status = 'processing' and priority = 'low'").select("facility_id", "financial_class").distinct()
    return outcomes.seed_classes(m.facilities(spark, sf), m.financial_classes(spark, sf), present)


def letters(spark: SparkSession, sf: str) -> DataFrame:
    """Events as dead letters, a third of them without a claim's id."""
    e = m.events(spark, sf)
    return e.select(F.col("event_id").alias("dlq_id"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("claim_id"), F.col("name").alias("error_reason"), F.col("at").alias("inserted_at"))


@CLAIMS.add("dlq_reprocess", "SELECT event_id AS dlq_id, CASE WHEN user_id % 3 <> 0 THEN user_id END AS claim_id, event_type AS error_reason, CASE WHEN user_id % 3 <> 0 THEN 'inserted' ELSE 'failed' END AS resolution FROM events ORDER BY ts, event_id LIMIT 500")
def dlq_reprocess(spark, sf):
    good, bad = outcomes.reprocess(letters(spark, sf), 500)
    return good.unionByName(bad).drop("inserted_at")


@CLAIMS.add("dlq_counts", "SELECT count(*) AS processed, count(*) FILTER (user_id % 3 <> 0) AS resolved, count(*) FILTER (user_id % 3 = 0) AS failed FROM (SELECT * FROM events ORDER BY ts, event_id LIMIT 500)")
def dlq_counts(spark, sf):
    both = dlq_reprocess(spark, sf)
    return both.agg(F.count(F.lit(1)).alias("processed"), F.count("claim_id").alias("resolved"), F.sum(F.col("claim_id").isNull().cast("long")).alias("failed"))


@CLAIMS.add("stage_transitions", _BATCH + """SELECT batch_id, stage, count(*) AS claims FROM (SELECT claim_id // 1000 AS batch_id, unnest(CASE WHEN errors <> '' THEN ['validation', 'failed'] WHEN rule_errors <> '' THEN ['validation', 'rules', 'failed'] ELSE ['validation', 'rules', 'ml', 'completed'] END) AS stage FROM judged) GROUP BY batch_id, stage""")
def stage_transitions(spark, sf):
    own = batch(spark, sf).withColumn("batch_id", F.expr("claim_id div 1000"))
    return analytics.counts(outcomes.transitions(own, "batch_id"), "batch_id", "stage", name="claims")
