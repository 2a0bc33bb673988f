"""Synthetic claims with stated distributions, made row by row from the id and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of our own for the classes of made-up claims.
CLASSES = ("BASIC", "FAMILY", "STAFF", "SENIOR", "TRAVEL", "STATE", "PRIVATE", "YOUTH")
PRIORITIES = ("low", "normal", "high")
#: Parameters of the stated distributions. Procedure codes: families, and codes made for each. Lines and diagnoses of a
#: claim: cumulative shares in percent. Charges of a unit: least and most by family, and otherwise.
FAMILIES, CODES_EACH = ("99", "80", "70", "20", "60", "36", "90"), 12
LINES = ((40, 1), (70, 2), (85, 3), (95, 4), (100, 5))
DIAGNOSES = ((50, 1), (80, 2), (95, 3), (100, 4))
CHARGES = (("99", 200, 600), ("8", 50, 300), ("7", 300, 1500), ("2", 1000, 5000), ("6", 1000, 5000))
OTHER = (100, 800)


def procedure_codes() -> tuple[str, ...]:
    """Codes of five digits: the family and a running number in steps of 37."""
    return tuple(f"{family}{37 * k % 1000:03d}" for family in FAMILIES for k in range(1, CODES_EACH + 1))


def _roll(seed: int, n: int, *keys: str) -> Column:
    """0 .. n-1, evenly, by the keys and the seed."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(n))


def _pick(seed: int, values: tuple, *keys: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (_roll(seed, len(values), *keys) + 1).cast("int"))


def _weighted(seed: int, shares, *keys: str) -> Column:
    roll = _roll(seed, 100, *keys)
    out = F.lit(shares[-1][1])
    for limit, value in reversed(shares[:-1]):
        out = F.when(roll < limit, value).otherwise(out)
    return out


def generate_claims(spark: SparkSession, n: int, seed: int = 42, until: str = "2024-12-31") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims, lines and diagnoses of n claims."""
    base = spark.range(n).withColumnRenamed("id", "claim_id")
    start = F.date_sub(F.to_date(F.lit(until)), _roll(seed, 730, "claim_id").cast("int"))
    base = base.withColumn("service_from_date", start).withColumn("stay", F.when(_roll(seed + 1, 100, "claim_id") < 80, 0).otherwise(_roll(seed + 2, 30, "claim_id") + 1).cast("int"))
    base = base.withColumn("service_to_date", F.date_add("service_from_date", F.col("stay"))).withColumn("date_of_birth", F.date_sub("service_from_date", (_roll(seed + 3, 77 * 365, "claim_id") + 18 * 365 + 5).cast("int")))
    lines = base.select("claim_id", "service_from_date", "service_to_date", F.explode(F.sequence(F.lit(1), _weighted(seed + 4, LINES, "claim_id"))).alias("line_number"))
    lines = lines.withColumn("procedure_code", _pick(seed + 5, procedure_codes(), "claim_id", "line_number")).withColumn("units", (_roll(seed + 6, 3, "claim_id", "line_number") + 1).cast("int"))
    cents = _roll(seed + 7, 10_000, "claim_id", "line_number") / 10_000
    each = F.lit(OTHER[0]) + cents * (OTHER[1] - OTHER[0])
    for prefix, least, most in reversed(CHARGES):
        each = F.when(F.col("procedure_code").startswith(prefix), least + cents * (most - least)).otherwise(each)
    lines = lines.withColumn("charge_amount", (F.round(each, 2) * F.col("units")).cast("decimal(12,2)"))
    codes = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.struct(F.xxhash64("claim_id", i, F.lit(seed)).alias("h"), F.concat(F.lit("D"), F.lpad(i.cast("string"), 3, "0")).alias("code"))))
    diagnoses = base.select("claim_id", F.posexplode(F.slice(codes, 1, _weighted(seed + 8, DIAGNOSES, "claim_id")))).select("claim_id", (F.col("pos") + 1).alias("diagnosis_sequence"), F.col("col.code").alias("diagnosis_code"), F.when(F.col("pos") == 0, "primary").otherwise("secondary").alias("diagnosis_type"))
    total = lines.groupBy("claim_id").agg(F.sum("charge_amount").cast("decimal(12,2)").alias("total_charge_amount"))
    first = diagnoses.where("diagnosis_sequence = 1").select("claim_id", F.col("diagnosis_code").alias("primary_diagnosis"))
    claims = base.drop("stay").withColumns({
        "facility_id": (_roll(seed + 9, 50, "claim_id") + 1).cast("int"), "financial_class": _pick(seed + 10, CLASSES, "claim_id"), "priority": _pick(seed + 11, PRIORITIES, "claim_id"),
        "patient_account_number": F.format_string("ACC%010d", "claim_id"), "secondary_insurance": F.when(_roll(seed + 12, 100, "claim_id") < 30, _pick(seed + 13, CLASSES, "claim_id")),
    }).join(total, "claim_id").join(first, "claim_id")
    return claims, lines, diagnoses
