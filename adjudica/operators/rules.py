"""Business rules held as JSON, compiled to columns once and evaluated in one projection.

A rule is (name, logic, facilities, classes, active). Logic of the first shape is {"field", "operator", "value",
"values"}; of the second {"condition", "validation"} with "field LIKE 'x%'" or "always", checked over the claim's lines: a range of a field ("min", "max"), or {"type": "dates"}. Other shapes are refused.
Nulls compare as values: null equals null, any comparison by size with a null is false.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    logic: str
    facilities: tuple[int, ...] | None = None
    classes: tuple[str, ...] | None = None
    active: bool = True


def predicate(logic: dict[str, Any], columns: list[str]) -> Column:
    """A column that is never null."""
    if "condition" in logic:
        return lines_predicate(logic)
    field = logic.get("field")
    if field is None:
        return F.lit(True)
    operator, value, values = logic.get("operator", "equals"), logic.get("value"), logic.get("values") or []
    held = F.col(field) if field in columns else F.lit(None)
    yes = lambda c: F.coalesce(c, F.lit(False))
    if operator == "equals":
        return held.eqNullSafe(F.lit(value))
    if operator == "not_equals":
        return ~held.eqNullSafe(F.lit(value))
    if operator == "exists":
        return held.isNotNull()
    if operator in ("gt", "lt"):
        return F.lit(False) if value is None else yes(held > value if operator == "gt" else held < value)
    if operator == "between":
        return yes(held.between(*values)) if len(values) == 2 and None not in values else F.lit(False)
    if operator == "in":
        return F.lit(False) if not values else yes(held.isin([v for v in values if v is not None])) | (held.isNull() if None in values else F.lit(False))
    return F.lit(False)


def lines_predicate(logic: dict[str, Any]) -> Column:
    """Every line that the condition selects has its charge in the range, or its dates inside the claim's."""
    check, condition = logic.get("validation", {}), logic["condition"].strip()
    like = re.fullmatch(r"(\w+)\s+LIKE\s+'(\w*)%'", condition)
    if not like and condition.lower() != "always":
        raise ValueError(f"a rule's condition is neither a prefix nor always: {condition}")
    chosen = (lambda x: x[like[1]].cast("string").startswith(like[2])) if like else (lambda x: F.lit(True))
    if "min" in check or "max" in check:
        good = lambda x: x[check.get("field", "charge_amount")].between(check.get("min", 0), check.get("max", 10**12))
    elif check.get("type") == "dates":
        good = lambda x: (x["service_from_date"] >= F.col("service_from_date")) & (x["service_to_date"] <= F.col("service_to_date"))
    else:
        raise ValueError(f"a rule's validation has neither a range nor the type dates: {check}")
    return F.coalesce(F.forall("line_items", lambda x: ~F.coalesce(chosen(x), F.lit(False)) | F.coalesce(good(x), F.lit(False))), F.lit(True))


def scope(rule: Rule) -> Column:
    """Where the rule applies: no list means everywhere."""
    out = F.lit(True)
    if rule.facilities is not None:
        out = out & F.coalesce(F.col("facility_id").isin(list(rule.facilities)), F.lit(False))
    if rule.classes is not None:
        out = out & F.coalesce(F.col("financial_class").isin(list(rule.classes)), F.lit(False))
    return out


def evaluate(df: DataFrame, rules: list[Rule], short_circuit: bool = False) -> DataFrame:
    """rule_errors: names of the active rules that apply and are not satisfied, in their order. With short_circuit a row
    that already has errors is not judged."""
    judged = [F.when(scope(r) & ~predicate(json.loads(r.logic), df.columns), r.name) for r in rules if r.active]
    names = F.array_compact(F.array(*judged)) if judged else F.array().cast("array<string>")
    return df.withColumn("rule_errors", F.when(F.size("errors") > 0, F.array().cast("array<string>")).otherwise(names) if short_circuit else names)


def rule_stats(evaluated: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule_name, executions, failures for every active rule."""
    active = [r for r in rules if r.active]
    runs = evaluated.agg(*[F.coalesce(F.sum(scope(r).cast("long")), F.lit(0)).alias(f"r{k}") for k, r in enumerate(active)], *[F.coalesce(F.sum(F.array_contains("rule_errors", r.name).cast("long")), F.lit(0)).alias(f"f{k}") for k, r in enumerate(active)])
    return runs.select(F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule_name"), F.col(f"r{k}").alias("executions"), F.col(f"f{k}").alias("failures")) for k, r in enumerate(active)])).alias("s")).select("s.*")


def rules_from_table(table: DataFrame) -> list[Rule]:
    """The rows of a rules table (a handful of definitions) as rules."""
    listed = lambda text: None if text is None else tuple(json.loads(text))
    rows = table.select("rule_name", "rule_logic", "applies_to_facilities", "applies_to_financial_classes", "is_active").collect()
    return [Rule(r[0], r[1], listed(r[2]), listed(r[3]), bool(r[4])) for r in rows]
