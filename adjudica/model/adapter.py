"""Order tables as claim tables.

Every function gives a claim table as a DataFrame over the tables in a folder; ``CTE`` holds the same mapping in SQL,
which the oracle queries start with. The two must stay alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.sources.files import dealt, tasks_for

#: Financial classes and the one that is not active.
CLASSES, INACTIVE_CLASS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), "FURNITURE"
#: The last day of the sample, for jobs that take a present moment.
NOW = "1998-12-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: Column, scale: int = 2) -> Column:
    return c.cast(f"decimal(12,{scale})")


def claims(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """All claims, or those of some rows of orders. Orders that stream in are dealt out by the size of the table, as the first
    micro-batch may hold all of it."""
    every, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    orders = every if orders is None else orders
    customer, day = dealt(customer, "c_custkey", tasks_for(every if orders.isStreaming else orders)), F.to_date("o_orderdate")
    rank = F.substring("o_orderpriority", 1, 1)
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("claim_id"), F.col("c_nationkey").alias("facility_id"), F.col("c_custkey").cast("string").alias("patient_account_number"),
        F.col("c_name").alias("patient_name"), F.col("c_mktsegment").alias("financial_class"),
        F.expr("date_add(date'1940-01-01', cast(c_custkey * 37 % 25000 as int))").alias("date_of_birth"),
        day.alias("service_from_date"), F.when(F.col("o_orderkey") % 97 == 0, F.date_sub(day, 90)).otherwise(F.date_add(day, 90)).alias("service_to_date"),
        F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("D"), (F.col("o_orderkey") % 40).cast("string"))).alias("primary_diagnosis"),
        (F.col("o_orderkey") % 2000 + 1).alias("procedure_code"),
        money(F.col("o_totalprice")).alias("total_charge_amount"),
        F.when(rank <= "2", "high").when(rank <= "4", "normal").otherwise("low").alias("priority"),
        F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "processing").otherwise("completed").alias("processing_status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def lines(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Line numbers repeat within a claim: the lines are a bag. All lines, or those of some rows of orders. Large tables lie by
    claim_id over as many tasks as the lines need."""
    orders, items = (table(spark, sf_dir, "orders") if orders is None else orders).select("o_orderkey", "o_orderdate"), table(spark, sf_dir, "lineitem")
    items = dealt(items, "l_orderkey", tasks_for(items))
    day = F.expr("date_add(to_date(o_orderdate), cast((l_partkey * 7 + l_linenumber) % 93 as int))")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("procedure_code"),
        F.col("l_quantity").cast("int").alias("units"), money(F.col("l_extendedprice")).alias("charge_amount"), day.alias("service_from_date"), day.alias("service_to_date"),
    )


def rvu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("procedure_code"), F.col("p_name").alias("description"), F.col("p_type").alias("category"), F.col("p_brand").alias("subcategory"),
        (money(F.col("p_retailprice")) * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(10,5)").alias("total_rvu"), F.when(F.col("p_size") > 5, "ACTIVE").otherwise("INACTIVE").alias("status"),
        F.expr("date_sub(date'1998-12-01', p_size)").alias("updated_on"),
    )


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("facility_id"), F.col("n_name").alias("facility_name"), F.col("n_regionkey").alias("region_id"), (F.col("n_nationkey") % 5 != 0).alias("active"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region_name"), (F.col("r_regionkey") % 2).alias("organization_id"))


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = (F.col("r_regionkey") % 2).alias("organization_id")
    return table(spark, sf_dir, "region").select(own).distinct().withColumn("organization_name", F.concat(F.lit("Organization "), F.col("organization_id").cast("string")))


def financial_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("financial_class")).distinct()
    return found.withColumn("active", F.col("financial_class") != INACTIVE_CLASS)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, at, value, user_id, event_id: metric samples, latencies, log rows."""
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("at"), "value", "user_id", "props")


#: The same in SQL.
CTE = """WITH claims AS (
  SELECT o_orderkey AS claim_id, c_nationkey AS facility_id, c_custkey::VARCHAR AS patient_account_number, c_name AS patient_name, c_mktsegment AS financial_class,
    DATE '1940-01-01' + (c_custkey * 37 % 25000)::INT AS date_of_birth, o_orderdate::DATE AS service_from_date,
    CASE WHEN o_orderkey % 97 = 0 THEN o_orderdate::DATE - 90 ELSE o_orderdate::DATE + 90 END AS service_to_date,
    CASE WHEN o_orderkey % 7 <> 0 THEN 'D' || (o_orderkey % 40)::VARCHAR END AS primary_diagnosis, o_orderkey % 2000 + 1 AS procedure_code,
    o_totalprice::DECIMAL(12,2) AS total_charge_amount,
    CASE WHEN substr(o_orderpriority, 1, 1) <= '2' THEN 'high' WHEN substr(o_orderpriority, 1, 1) <= '4' THEN 'normal' ELSE 'low' END AS priority,
    CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' ELSE 'completed' END AS processing_status, o_orderdate AS created_at
  FROM orders JOIN customer ON o_custkey = c_custkey),
lines AS (
  SELECT l_orderkey AS claim_id, l_linenumber AS line_number, l_partkey AS procedure_code, l_quantity::INT AS units, l_extendedprice::DECIMAL(12,2) AS charge_amount,
    o_orderdate::DATE + ((l_partkey * 7 + l_linenumber) % 93)::INT AS service_from_date, o_orderdate::DATE + ((l_partkey * 7 + l_linenumber) % 93)::INT AS service_to_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
rvu AS (
  SELECT p_partkey AS procedure_code, p_name AS description, p_type AS category, p_brand AS subcategory, (p_retailprice::DECIMAL(12,2) * 0.001::DECIMAL(4,3))::DECIMAL(10,5) AS total_rvu,
    CASE WHEN p_size > 5 THEN 'ACTIVE' ELSE 'INACTIVE' END AS status, DATE '1998-12-01' - p_size AS updated_on FROM part),
facilities AS (
  SELECT n_nationkey AS facility_id, n_name AS facility_name, n_regionkey AS region_id, n_nationkey % 5 <> 0 AS active FROM nation),
regions AS (SELECT r_regionkey AS region_id, r_name AS region_name, r_regionkey % 2 AS organization_id FROM region),
organizations AS (SELECT DISTINCT r_regionkey % 2 AS organization_id, 'Organization ' || r_regionkey % 2 AS organization_name FROM region),
classes AS (SELECT DISTINCT c_mktsegment AS financial_class, c_mktsegment <> 'FURNITURE' AS active FROM customer),
samples AS (SELECT event_id, event_type AS name, ts AS at, value, user_id, props FROM events),
line_faults AS (
  SELECT claim_id, bool_or(l.service_from_date < c.service_from_date OR l.service_to_date > c.service_to_date) AS outside FROM lines l JOIN claims c USING (claim_id) GROUP BY claim_id),
checked AS (
  SELECT c.*, f.facility_id IS NULL AS e1, k.financial_class IS NULL AS e2, coalesce(c.date_of_birth > c.service_from_date, false) AS e3,
    coalesce(c.service_from_date > c.service_to_date, false) AS e4, coalesce(b.outside, false) AS e5
  FROM claims c LEFT JOIN (SELECT * FROM facilities WHERE active) f USING (facility_id) LEFT JOIN (SELECT * FROM classes WHERE active) k USING (financial_class)
  LEFT JOIN line_faults b USING (claim_id)),
validated AS (
  SELECT *, concat_ws(',', CASE WHEN e1 THEN 'invalid_facility' END, CASE WHEN e2 THEN 'invalid_financial_class' END, CASE WHEN e3 THEN 'invalid_dob' END,
    CASE WHEN e4 THEN 'invalid_service_dates' END, CASE WHEN e5 THEN 'line_item_date_out_of_range' END) AS errors FROM checked),
priced AS (
  SELECT l.*, r.total_rvu AS rvu_value, CASE WHEN r.procedure_code IS NULL THEN NULL ELSE coalesce(r.total_rvu, 0) * coalesce(nullif(l.units, 0), 1) * 36.04::DECIMAL(6,2) END AS reimbursement
  FROM lines l LEFT JOIN (SELECT * FROM rvu WHERE status = 'ACTIVE') r USING (procedure_code)),
failed AS (
  SELECT v.claim_id, v.patient_account_number, v.facility_id, 'validation' AS failure_reason, 'validation' AS failure_category, v.errors,
    coalesce(p.loss, v.total_charge_amount)::DECIMAL(12,2) AS potential_revenue_loss, v.service_from_date AS failed_on
  FROM validated v LEFT JOIN (SELECT claim_id, sum(reimbursement) AS loss FROM priced GROUP BY claim_id) p USING (claim_id) WHERE v.errors <> '')
"""
