"""Lines nested into claims, and prices from the procedure-value table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from adjudica.sources.files import dealt, tasks_for

#: The configured conversion factor.
FACTOR = "36.04"
LINE = ("line_number", "procedure_code", "units", "charge_amount", "service_from_date", "service_to_date")


def nest_lines(claims: DataFrame, lines: DataFrame) -> DataFrame:
    """Claims with line_items, a sorted array; lines are gathered before the join, and a claim without any has none."""
    own = lines.groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct(*LINE))).alias("line_items"))
    return claims.join(own, "claim_id", "left").withColumn("line_items", F.coalesce("line_items", F.expr("cast(array() as array<struct<line_number:int,procedure_code:bigint,units:int,charge_amount:decimal(12,2),service_from_date:date,service_to_date:date>>)")))


def units_of(c: Column) -> Column:
    """Null and zero count as one."""
    return F.coalesce(F.when(c != 0, c), F.lit(1))


def enrich(df: DataFrame, rvu: DataFrame, factor: str | None = FACTOR, units: str = "units") -> DataFrame:
    """rvu_value and reimbursement = rvu * units * factor; a matched row without value pays 0, an unknown code stays
    null. factor None takes the row's own conversion_factor."""
    own = rvu.where(F.lower("status") == "active").select(F.col("procedure_code").alias("_code"), F.col("total_rvu").alias("rvu_value"), *([F.col("conversion_factor").alias("_factor")] if factor is None else []))
    own = dealt(own, "_code", tasks_for(df))
    rate = F.col("_factor") if factor is None else F.lit(factor).cast("decimal(6,2)")
    n = units_of(F.col(units)) if units in df.columns else F.lit(1)
    paid = F.coalesce("rvu_value", F.lit(0).cast("decimal(10,5)")) * n.cast("decimal(10,0)") * rate
    return df.join(own, F.col("procedure_code") == F.col("_code"), "left").withColumn("reimbursement", F.when(F.col("_code").isNotNull(), paid)).drop("_code", "_factor")


def summarise(priced: DataFrame, nested: bool = False) -> DataFrame:
    """One row a claim: first and last date of its lines, their number, what they pay (null if none has a price), and if
    asked for the lines themselves as a sorted array. One pass over the lines serves validation, prices and rules."""
    return summary(dealt(priced, "claim_id", tasks_for(priced)).groupBy("claim_id"), nested)


def summary(grouped: GroupedData, nested: bool = False) -> DataFrame:
    """What `summarise` says of each group of priced lines."""
    more = [F.sort_array(F.collect_list(F.struct(*LINE))).alias("line_items")] if nested else []
    return grouped.agg(
        F.min("service_from_date").alias("first_from"), F.max("service_to_date").alias("last_to"),
        F.count(F.lit(1)).alias("n_lines"), F.sum("reimbursement").alias("revenue"), *more,
    )


def lookup(rvu: DataFrame, codes: list[int]) -> DataFrame:
    """Active rows of these codes."""
    return rvu.where(F.col("procedure_code").isin(codes) & (F.lower("status") == "active"))


def hierarchy(facilities: DataFrame, regions: DataFrame, organizations: DataFrame) -> DataFrame:
    """Facility, region, and the organization that the region belongs to."""
    return facilities.join(regions, "region_id", "left").join(organizations, "organization_id", "left")
