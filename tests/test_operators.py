"""Small literals: nulls, ties, orphans, and the expected results of the claim rules."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from adjudica.functions import scalar
from adjudica.functions.features import FeaturePipeline, extract
from adjudica.operators import analytics, enrichment, models, outcomes, privacy, rules, sync, validation, windows

CLAIM = "claim_id int, facility_id int, financial_class string, date_of_birth date, service_from_date date, service_to_date date"
LINE = "claim_id int, line_number int, service_from_date date, service_to_date date"


def D(text):
    return None if text is None else date.fromisoformat(text)


def one(df, c):
    return [r[c] for r in df.collect()]


@pytest.fixture(scope="module")
def sets(spark):
    return spark.createDataFrame([(1, True), (2, False), (None, True)], "facility_id int, active boolean"), spark.createDataFrame([("A", True)], "financial_class string, active boolean")


def errors(spark, sets, rows, lines=None):
    claims = spark.createDataFrame([(k, f, c, D(b), D(x), D(y)) for k, (f, c, b, x, y) in enumerate(rows)], CLAIM)
    table = spark.createDataFrame([(k, n, D(x), D(y)) for k, n, x, y in lines or []], LINE)
    return {r["claim_id"]: r["errors"] for r in validation.validate(claims, *sets, table).collect()}


def test_validation(spark, sets):
    rows = [(1, "A", "1990-01-01", "1990-01-02", "1990-01-03"), (9, "A", "1990-01-01", "1990-01-02", "1989-12-31"), (None, None, None, None, None), (2, "A", "2000-01-01", "1990-01-02", "1990-01-02"), (1, "A", None, "2020-01-01", "2020-01-31"), (1, "A", None, None, "2020-01-31")]
    lines = [(4, 1, "2019-12-31", "2020-01-02"), (4, 2, "2019-12-31", "2020-03-02"), (5, 1, "2019-12-31", "2021-01-02"), (0, 1, None, None), (77, 1, "2019-12-31", "2020-01-02")]
    assert errors(spark, sets, rows, lines) == {
        0: [], 1: ["invalid_facility", "invalid_service_dates"], 2: ["invalid_facility", "invalid_financial_class"], 3: ["invalid_facility", "invalid_dob"],
        4: ["line_item_date_out_of_range"], 5: [],
    }


def test_inactive_facility_can_count(spark, sets):
    claims = spark.createDataFrame([(0, 2, "A", None, None, None)], CLAIM)
    assert one(validation.validate(claims, *sets, require_active=False), "errors") == [[]]
    assert one(validation.validate(claims.limit(0), *sets), "errors") == []


@pytest.mark.parametrize(("logic", "good", "bad"), [
    ('{"field":"a","operator":"equals","value":1}', 1, 2), ('{"field":"a","operator":"gt","value":6}', 10, 4), ('{"field":"a","operator":"not_equals","value":2}', 1, 2),
    ('{"field":"a","operator":"exists"}', 1, None), ('{"field":"a","operator":"lt","value":10}', 5, 20), ('{"field":"a","operator":"between","values":[1,3]}', 2, 5),
    ('{"field":"a","operator":"in","values":[1,2]}', 1, 3), ('{"field":"a","operator":"not_equals","value":2}', None, 2), ('{"field":"a","value":null}', None, 2),
])
def test_rules(spark, logic, good, bad):
    df = spark.createDataFrame([(good, 1, "x"), (bad, 1, "x")], "a int, facility_id int, financial_class string")
    assert one(rules.evaluate(df, [rules.Rule("r", logic)]), "rule_errors") == [[], ["r"]]


def test_rules_of_odd_shapes(spark):
    df = spark.createDataFrame([(None, 1, "x")], "a int, facility_id int, financial_class string")
    logic = ['{"operator":"equals"}', '{"field":"a","operator":"nope"}', '{"field":"a","operator":"between","values":[1]}', '{"field":"a","operator":"in","values":[]}', '{"field":"a","operator":"gt","value":1}', '{"field":"zz","operator":"exists"}']
    assert one(rules.evaluate(df, [rules.Rule(str(k), x) for k, x in enumerate(logic)]), "rule_errors") == [["1", "2", "3", "4", "5"]]
    assert one(rules.evaluate(df, [rules.Rule("r", logic[1], facilities=(2,)), rules.Rule("s", logic[1], active=False)]), "rule_errors") == [[]]
    stats = rules.rule_stats(rules.evaluate(df, [rules.Rule("r", logic[1], facilities=(1,))]), [rules.Rule("r", logic[1], facilities=(1,))])
    assert [tuple(r) for r in stats.collect()] == [("r", 1, 1)]
    table = spark.createDataFrame([("n", logic[1], "[1]", None, True)], "rule_name string, rule_logic string, applies_to_facilities string, applies_to_financial_classes string, is_active boolean")
    assert rules.rules_from_table(table) == [rules.Rule("n", logic[1], (1,), None, True)]


def test_prices(spark):
    lines = spark.createDataFrame([(1, 99213, 2), (2, 99213, None), (3, 99213, 0), (4, 5, 1), (5, 7, 1), (6, None, 1), (7, 8, 1)], "claim_id int, procedure_code long, units int")
    rvu = spark.createDataFrame([(99213, Decimal("1.69"), "active"), (7, None, "ACTIVE"), (8, Decimal("1"), "INACTIVE")], "procedure_code long, total_rvu decimal(10,5), status string")
    got = {r["claim_id"]: r["reimbursement"] for r in enrichment.enrich(lines, rvu).collect()}
    assert got == {1: Decimal("121.8152"), 2: Decimal("60.9076"), 3: Decimal("60.9076"), 4: None, 5: 0, 6: None, 7: None}
    own = rvu.withColumn("conversion_factor", F.lit(10).cast("decimal(8,2)"))
    assert enrichment.enrich(lines.limit(1), own, None).first()["reimbursement"] == Decimal("33.8")


def test_nesting_keeps_claims_without_lines(spark):
    lines = spark.createDataFrame([(1, 2, 5, 1, Decimal("1.00"), None, None), (1, 1, 6, 1, None, None, None)], "claim_id int, line_number int, procedure_code long, units int, charge_amount decimal(12,2), service_from_date date, service_to_date date")
    got = {r["claim_id"]: [x["line_number"] for x in r["line_items"]] for r in enrichment.nest_lines(spark.createDataFrame([(1,), (2,)], "claim_id int"), lines).collect()}
    assert got == {1: [1, 2], 2: []}


def test_repairs(spark):
    df = spark.createDataFrame([(["invalid_facility", "invalid_service_dates"], None, "A", D("2001-01-01"), D("2000-01-02"), D("2000-01-01")), (["invalid_dob", "invalid_financial_class"], 3, None, D("2001-01-01"), None, D("2000-01-01"))], "errors array<string>, facility_id int, financial_class string, date_of_birth date, service_from_date date, service_to_date date")
    assert one(df.select(outcomes.suggest_repairs(F.col("errors")).alias("s")), "s") == ["Verify facility_id; Correct service dates", "Check financial_class; Check date_of_birth"]
    a, b = outcomes.auto_repair(df).collect()
    assert (a["facility_id"], a["service_to_date"]) == ("UNKNOWN", D("2000-01-02")) and (b["facility_id"], b["financial_class"], b["date_of_birth"]) == ("3", "UNKNOWN", D("2000-01-01"))


def test_changes(spark):
    kv = "k int, a string, b string"
    old, new = spark.createDataFrame([(1, "x", "c1"), (2, "y", "c2")], kv), spark.createDataFrame([(2, "z", "n2"), (3, None, "n3")], kv)
    assert sorted(map(tuple, outcomes.upsert(old, new, "k", keep=("b",)).collect())) == [(1, "x", "c1"), (2, "z", "c2"), (3, None, "n3")]
    assert sorted(map(tuple, outcomes.amend(old, new.drop("b"), "k").collect())) == [(1, "x", "c1"), (2, "z", "c2")]
    diff = {r["record_id"]: (r["operation"], r["changed"]) for r in outcomes.audit_diff(old, new, "k", "t", "u", "r").collect()}
    assert diff == {"1": ("delete", "a,b"), "2": ("update", "a,b"), "3": ("insert", "b")}
    claims = spark.createDataFrame([(1, "pending"), (2, "pending")], "claim_id int, processing_status string")
    assert sorted(map(tuple, outcomes.update_status(claims, spark.createDataFrame([(2, "done", "ml")], "claim_id int, status string, stage string")).collect()), key=str) == [(1, "pending", None), (2, "done", "ml")]
    updated, counts = sync.bulk_update(old.withColumnRenamed("k", "procedure_code"), new.withColumnRenamed("k", "procedure_code"))
    assert tuple(counts.first()) == (1, 1) and updated.count() == 2


def test_insertable_gets_an_id(spark):
    rows = [(None, "1", 1, None, None, D("2020-01-01")), ("7", "", 1, None, None, None), ("8", "1", None, None, None, None)]
    df = outcomes.insertable(spark.createDataFrame(rows, "claim_id string, patient_account_number string, facility_id int, processing_status string, service_to_date date, service_from_date date"), "k")
    got, again = df.collect(), df.collect()
    assert len(got) == 1 and len(got[0]["claim_id"]) == 36 and got[0]["processing_status"] == "completed" and got[0]["service_to_date"] == D("2020-01-01")
    assert got[0]["processing_stage"] == "completed" and got[0]["claim_id"] == again[0]["claim_id"] and len(got[0]["patient_account_number"]) > 20
    assert privacy.decrypt(df, "k").first()["patient_account_number"] == "1"


def test_equal_claims_get_ids_of_their_own(spark):
    kinds = "claim_id string, patient_account_number string, facility_id int, tags array<string>"
    rows = [(None, "1", 1, ["a"])] * 25 + [(None, "2", 1, None), ("7", "1", 1, ["a"]), ("7", "1", 1, ["a"])]
    claims = spark.createDataFrame(rows, kinds).repartition(3)
    got = outcomes.identified(claims, run=10)
    ids = [r["claim_id"] for r in got.collect()]
    assert got.columns == claims.columns and len(ids) == 28 and len(set(ids)) == 27 and all(ids)
    assert sorted(ids) == sorted(r["claim_id"] for r in outcomes.identified(claims.repartition(5), run=4).collect())
    assert sorted(map(str, got.drop("claim_id").collect())) == sorted(map(str, claims.drop("claim_id").collect()))
    assert outcomes.identified(claims.limit(0)).collect() == []


def test_scalars(spark):
    df = spark.createDataFrame([("High",), ("2",), ("odd",), (None,), ("LOW",), ("7",)], "p string")
    assert one(df.select(scalar.priority_rank(F.col("p")).alias("r")), "r") == [3, 2, 2, 2, 1, 7]
    masked = privacy.mask(spark.createDataFrame([("AC-88301", "Ola Quist", D("1971-05-09"), "kept"), ("", None, None, "v")], "patient_account_number string, patient_name string, date_of_birth date, other string"))
    assert [tuple(r) for r in masked.collect()] == [("AC***", "***", "***", "kept"), ("", "***", "***", "v")]
    plain = spark.createDataFrame([("A7", "Ola"), ("", None)], "patient_account_number string, patient_name string")
    secret = privacy.encrypt(plain, "k" * 32)
    assert secret.first()["patient_name"] != "Ola" and [tuple(r) for r in privacy.decrypt(secret, "k" * 32).collect()] == [("A7", "Ola"), ("", None)]
    x = spark.range(1)
    assert x.select(scalar.following_codes(F.lit("A0099"), 2)).first()[0] == ["A0100", "A0101"] and x.select(scalar.following_codes(F.lit("none"), 2)).first()[0] is None
    assert x.select(scalar.where_column(F.lit("SELECT 1 wHeRe  code = 1"))).first()[0] == "code" and x.select(scalar.sanitized(F.lit("a<b>c"))).first()[0] == "abc"
    assert x.select(scalar.remedy(F.lit("other"))).first()[0] == scalar.OTHER_REMEDY


def series(spark, values, step=1):
    return spark.createDataFrame([("m", datetime.fromtimestamp(1_000_000 + step * k), k, float(v)) for k, v in enumerate(values)], "name string, at timestamp, event_id int, value double")


@pytest.mark.parametrize(("values", "want"), [((10, 12, 14), 14), ((50, 55, 60), 60), ((7,), 7)])
def test_forecast(spark, values, want):
    assert windows.forecast(series(spark, values)).orderBy(F.desc("event_id")).first()["forecast"] == want


def test_windows(spark):
    s = series(spark, (1, 2, 3))
    assert windows.moving_average(s, 3).orderBy(F.desc("event_id")).first()["moving_average"] == 2 and one(windows.trend(s, 3).orderBy("event_id"), "trend") == [0, 1, 2]
    assert one(windows.latency_p99(series(spark, (1, 2, 3, 4, 100)), 5), "p99") == [100] and one(windows.latency_p99(series(spark, range(1, 101))), "p99") == [100]
    assert one(windows.rolling_hour(series(spark, (1, 2, 4), 3600)).orderBy("event_id"), "hour_sum") == [1, 3, 6]


def test_reports(spark):
    failed = spark.createDataFrame([("x", "rules", Decimal(50), D("2020-01-01")), (None, None, Decimal(30), D("2020-01-02")), ("x", "rules", None, D("2020-01-02"))], "errors string, failure_category string, potential_revenue_loss decimal(12,2), failed_on date")
    assert {tuple(r) for r in analytics.revenue_loss_by(failed, F.col("errors"), "c").collect()} == {("x", 50.0), ("unknown", 30.0)} and analytics.revenue_loss(failed.limit(0)).first()[0] == 0
    v = spark.createDataFrame([(["invalid_facility"],), (["invalid_facility"],), ([],)], "errors array<string>")
    assert [tuple(r) for r in analytics.error_patterns(v, 2).collect()] == [("invalid_facility", 2, "Verify facility_id mappings in source data")] and analytics.error_patterns(v, 3).collect() == []
    board = analytics.dashboard(failed, spark.range(5), spark.createDataFrame([(D("2024-01-01"),)], "day date"), F.lit(D("2020-01-02")))
    assert tuple(board.first()) == (5, 1, D("2024-01-01"), "x:2;unknown:1", "2020-01-02:2", "rules:50.00;unknown:30.00", 80.0)
    assert tuple(analytics.dashboard(failed.limit(0), spark.range(0), spark.createDataFrame([], "day date"), F.lit(D("2020-01-02"))).first()) == (0, 0, None, "", "", "", 0.0)
    fired = analytics.alerts(spark.createDataFrame([("cpu_usage_percent", 90.0), ("batch_processing_rate_per_sec", 0.0), ("memory_usage_percent", None), ("error_rate", 0.125)], "metric string, value double"))
    assert [tuple(r) for r in fired.collect()] == [("cpu_usage_percent", "CPU usage high: 90.00"), ("error_rate", "High error rate: 12.50%")]
    assert analytics.sla_violations(spark.createDataFrame([(10, 30.0), (0, 9.0), (5, 1.0)], "claims long, seconds double")).first()[0] == 10
    shares = analytics.exposure(spark.createDataFrame([("a",), ("a",)], "variant string"))
    assert {(r["variant"], r["n"], r["share"]) for r in shares.collect()} == {("a", 2, 1.0), ("b", 0, 0.0)}


def test_models(spark):
    df = spark.createDataFrame([(k, "ABC" if k % 2 else "A", "X", "D" if k % 3 else None, float(k % 2)) for k in range(60)], "claim_id int, procedure_code string, financial_class string, primary_diagnosis string, bad double")
    row = FeaturePipeline(extract).add_step(lambda d: {"has_diagnosis": F.lit(9.0)}).run(df).orderBy("claim_id").first()
    assert row["procedure_code_len"] == 1 and row["has_diagnosis"] == 9
    model, accuracy = models.train_filter(df, "bad", trees=5)
    assert accuracy > 0.9 and models.predict_filter(df, model).where("filter_number <> cast(bad as int)").count() == 0
    assert models.predict_filter(df, lambda x: (x["procedure_code_len"] > 2).astype("int32")).where("filter_number = 1").count() == 30
    p = {r["claim_id"] % 2: r["p_fail"] for r in models.failure_probability(df, "bad").collect()}
    assert p[1] > 0.9 > 0.1 > p[0]
    both = models.ab_predict(df, None, model, "claim_id", 0.5)
    assert both.count() == 60 and both.select("variant").distinct().count() == 2
    with pytest.raises(ValueError, match="between"):
        models.ab_variant(F.col("claim_id"), 1.0)


def test_rules_that_cannot_be_read_are_refused():
    for logic in ('{"condition":"procedure_code IS 1","validation":{"type":"dates"}}', '{"condition":"always","validation":{"field":"charge_amount"}}'):
        with pytest.raises(ValueError, match="rule"):
            rules.predicate(rules.json.loads(logic), [])


def test_advice_that_fails_is_none(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "errors array<string>")

    def broken(frame):
        raise RuntimeError("no model")

    assert one(outcomes.advise(df, broken, "errors"), "advice") == [[], []] == one(outcomes.advise(df, None, "errors"), "advice")
    assert one(outcomes.advise(df, lambda f: f["errors"].map(list), "errors"), "advice") == [["a", "b"], []]


def test_rolling_hour_over_hours_and_names(spark):
    rows = [(f"m{k % 2}", datetime.fromtimestamp(1_000_000 + 700 * k), k, float(k)) for k in range(40)] + [("m0", datetime.fromtimestamp(1_000_000), 99, 5.0)]
    got = {r["event_id"]: r["hour_sum"] for r in windows.rolling_hour(spark.createDataFrame(rows, "name string, at timestamp, event_id int, value double")).collect()}
    assert got == {e: sum(v for m, b, _, v in rows if m == n and 0 <= (a - b).total_seconds() <= 3600) for n, a, e, _ in rows}


def test_dead_letters(spark):
    rows = [(k, k if k % 2 else None, "r", datetime.fromtimestamp(1000 - k)) for k in range(6)]
    good, bad = outcomes.reprocess(spark.createDataFrame(rows, "dlq_id int, claim_id int, error_reason string, inserted_at timestamp"), 3)
    assert sorted(one(good, "dlq_id")) == [3, 5] and one(bad, "dlq_id") == [4]


def test_training_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def code(k):
        seen.add(1)
        return k % 5

    df = spark.range(200, numPartitions=4).select(F.udf(code, "long")("id").alias("procedure_code"), F.lit("A").alias("financial_class"), F.lit("D").alias("primary_diagnosis"), (F.col("id") % 2).alias("bad"))
    models.train_filter(df, "bad", trees=3)
    assert seen.value == 200
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0
