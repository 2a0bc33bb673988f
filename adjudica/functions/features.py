"""Feature steps: each maps a frame's columns to new ones; a pipeline merges them, later steps win."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import bucket

Step = Callable[[DataFrame], dict[str, Column]]


def extract(df: DataFrame) -> dict[str, Column]:
    """Length of the code, a bucket of the class, whether there is a diagnosis."""
    return {
        "procedure_code_len": F.coalesce(F.length(F.col("procedure_code").cast("string")), F.lit(0)).cast("double"),
        "financial_class_id": bucket(F.coalesce("financial_class", F.lit("")), 1000).cast("double"),
        "has_diagnosis": F.coalesce((F.col("primary_diagnosis") != "").cast("double"), F.lit(0.0)),
    }


class FeaturePipeline:
    def __init__(self, *steps: Step) -> None:
        self.steps = list(steps) or [extract]

    def add_step(self, step: Step) -> FeaturePipeline:
        self.steps.append(step)
        return self

    def columns(self, df: DataFrame) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for step in self.steps:
            out |= step(df)
        return out

    def run(self, df: DataFrame) -> DataFrame:
        """All features in one projection."""
        return df.withColumns(self.columns(df))
