"""Claim validation against reference sets and date rules. Nothing is keyed by id: every row is judged on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The errors in the order in which a claim lists them.
ERRORS = ("invalid_facility", "invalid_financial_class", "invalid_dob", "invalid_service_dates", "line_item_date_out_of_range")


def active_ids(reference: DataFrame, key: str, require_active: bool = True) -> DataFrame:
    """Distinct non-null ids of a reference table."""
    found = reference.where(F.col(key).isNotNull())
    return (found.where("active") if require_active else found).select(key).distinct()


def later(a: str, b: str) -> Column:
    """a > b, false where either is null."""
    return F.coalesce(F.col(a) > F.col(b), F.lit(False))


def flag_unknown(df: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """A flag for keys that are null or not among the ids. The sets are small reference data; the planner broadcasts
    them by their size and merges where they grow."""
    known = ids.select(F.col(key).alias("_known"))
    return df.join(known, F.col(key) == F.col("_known"), "left").withColumn(flag, F.col("_known").isNull()).drop("_known")


def line_dates(lines: DataFrame) -> DataFrame:
    """The first and last date of each claim's lines: all that the date rule needs, one row a claim."""
    return lines.groupBy("claim_id").agg(F.min("service_from_date").alias("first_from"), F.max("service_to_date").alias("last_to"))


def nested_line_fault(items: str = "line_items") -> Column:
    """The same for claims that hold their lines as an array; null and empty arrays have no fault."""
    dated = F.col("service_from_date").isNotNull() & F.col("service_to_date").isNotNull()
    outside = F.exists(items, lambda x: F.coalesce((x["service_from_date"] < F.col("service_from_date")) | (x["service_to_date"] > F.col("service_to_date")), F.lit(False)))
    return F.coalesce(dated & outside, F.lit(False))


def validate(claims: DataFrame, facilities: DataFrame, classes: DataFrame, lines: DataFrame | None = None, require_active: bool = True) -> DataFrame:
    """The claims with `errors`, an ordered array of names. Lines come as a table, as one row a claim with first_from and
    last_to (whose other columns are joined on too), as first_from and last_to of the claims, or nested in line_items. A line
    that begins before its claim or ends after it is a fault; a missing date is none."""
    out = flag_unknown(claims, active_ids(facilities, "facility_id", require_active), "facility_id", "_e1")
    out = flag_unknown(out, active_ids(classes, "financial_class", require_active), "financial_class", "_e2")
    if lines is not None:
        out = out.join(lines if "first_from" in lines.columns else line_dates(lines), "claim_id", "left")
    if "first_from" in out.columns:
        dated = F.col("service_from_date").isNotNull() & F.col("service_to_date").isNotNull()
        out = out.withColumn("_e5", dated & (later("service_from_date", "first_from") | later("last_to", "service_to_date"))).drop("first_from", "last_to")
    else:
        out = out.withColumn("_e5", nested_line_fault() if "line_items" in claims.columns else F.lit(False))
    flags = (F.col("_e1"), F.col("_e2"), later("date_of_birth", "service_from_date"), later("service_from_date", "service_to_date"), F.col("_e5"))
    errors = F.array_compact(F.array(*[F.when(f, name) for f, name in zip(flags, ERRORS)]))
    return out.withColumn("errors", errors).drop("_e1", "_e2", "_e5")


def known_ids(ids: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Each id with `valid`: whether it is in the reference and active."""
    own = active_ids(reference, key).select(F.col(key).alias("_known"))
    return ids.join(own, F.col(key) == F.col("_known"), "left").withColumn("valid", F.col("_known").isNotNull()).drop("_known")


def pass_rate(validated: DataFrame) -> DataFrame:
    return validated.agg(F.round(F.avg((F.size("errors") == 0).cast("double")), 6).alias("pass_rate"))
