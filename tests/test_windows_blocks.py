"""Frames stitched over blocks give what one window over all samples of a metric gives."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from adjudica.operators import windows

KIND = "event_id long, name string, at timestamp, value double"


def samples(spark, n=700):
    draw = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [(k, draw.choice(["hot"] * 6 + ["cold", None]), None if k % 97 == 0 else start + timedelta(minutes=draw.choice([0, 1, 1, 5, 61, 3000]) * draw.randrange(9)), None if k % 31 == 0 else round(draw.random() * 100, 3)) for k in range(n)]
    return spark.createDataFrame(rows, KIND).repartition(5)


@pytest.mark.parametrize("n, block", [(1, 1), (2, 2), (10, 10), (10, 13), (10, None), (50, 60)])
def test_blocks(spark, n, block):
    df = samples(spark)
    whole = Window.partitionBy("name").orderBy("at", "event_id").rowsBetween(-(n - 1), 0)
    total = F.sum(F.col("value").cast("decimal(20,6)")).over(whole).cast("double")
    size = F.count("value").over(whole)
    first = F.first("value").over(whole)
    want = {
        "moving_average": F.round(total / size, 6), "trend": F.round(F.col("value") - first, 6),
        "forecast": F.round(total / size + (F.col("value") - first) / F.greatest(size - 1, F.lit(1)), 6),
    }
    for name, column in want.items():
        got = getattr(windows, name)(df, n, block)
        assert got.columns == [*df.columns, name]
        assert sorted(map(str, got.collect())) == sorted(map(str, df.withColumn(name, column).collect()))


def test_no_window_holds_a_whole_metric(spark):
    laid = windows.in_blocks(samples(spark), 5, 20)
    assert laid.groupBy("name", "_block").count().agg(F.max("count")).first()[0] == 24
    assert laid.where("_own").count() == 700
    plan = windows.forecast(samples(spark), 10)._jdf.queryExecution().optimizedPlan().toString()
    by = [line.split("windowspecdefinition(")[1].split(", ")[:2] for line in plan.splitlines() if "windowspecdefinition(" in line]
    alone = [line for line in plan.splitlines() if "windowspecdefinition(name" in line and "_n#" not in line and "_at#" not in line.split("windowspecdefinition(")[1][:30] and "_block#" not in line.split("windowspecdefinition(")[1][:30]]
    assert len(by) == 3 and not alone, plan


@pytest.mark.parametrize("seconds", [60, 3600, 10_000])
def test_rolling_hour_is_a_running_total(spark, seconds):
    """With ties, nulls, samples without a time or a name, and both ends of the hour; no frame is summed anew at each row."""
    edges = [(1000 + k, "edge", datetime(2024, 1, 1) + timedelta(seconds=s, microseconds=us), float(k)) for k, (s, us) in enumerate([(0, 0), (3600, 0), (3600, 1), (7199, 999_999), (7200, 0), (7200, 1)])]
    df = samples(spark).unionByName(spark.createDataFrame(edges, KIND))
    micros, one = F.unix_micros("at"), 3_600_000_000
    whole = F.sum(F.col("value").cast("decimal(20,6)")).over(Window.partitionBy("name").orderBy(micros).rangeBetween(-one, 0)).cast("double")
    got = windows.rolling_hour(df, seconds)
    assert got.columns == [*df.columns, "hour_sum"]
    assert sorted(map(str, got.collect())) == sorted(map(str, df.withColumn("hour_sum", whole).collect()))
    frames = [line.split("specifiedwindowframe(")[1].split(",")[1].strip() for line in got._jdf.queryExecution().optimizedPlan().toString().split("windowspecdefinition(") if "specifiedwindowframe(" in line]
    assert frames and set(frames) == {"unboundedpreceding$()"}
