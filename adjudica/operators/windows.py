"""Windows over metric samples, latest rows and ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a metric that one window holds; samples are numbered within stretches of time first.
BLOCK, STRETCH = 100_000, 3600


def in_blocks(samples: DataFrame, n: int, block: int | None = None, seconds: int = STRETCH) -> DataFrame:
    """The samples with _block, and _own, which is false for those that are carried over: each block of a name begins with
    the n - 1 samples before it, so a frame of n rows never looks beyond its block.

    Places of samples in their name come from two numbers: how many stand in earlier stretches of time (sums over one row
    a stretch) and how many before them in their own stretch. No window holds all samples of a name."""
    block = max(block or BLOCK, n)
    own = samples.withColumn("_at", F.coalesce(F.floor(F.unix_micros("at") / (seconds * 1_000_000)), F.lit(-(2**60))))  # nulls come first
    counts = own.groupBy("name", "_at").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("name").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("name").alias("_name"), F.col("_at").alias("_stretch"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("name", "_at").orderBy("at", "event_id"))
    placed = own.withColumn("_inside", inside).join(counts, F.col("name").eqNullSafe(F.col("_name")) & (F.col("_at") == F.col("_stretch")))
    placed = placed.withColumn("_place", F.col("_before") + F.col("_inside") - 1)
    first = F.floor(F.col("_place") / block)
    carried = F.col("_place") % block >= block - (n - 1)
    laid = placed.withColumn("_first", first).withColumn("_block", F.explode(F.when(carried, F.array(first, first + 1)).otherwise(F.array(first))))
    return laid.withColumn("_own", F.col("_block") == F.col("_first")).drop("_at", "_name", "_stretch", "_before", "_inside", "_first")


def _last(n: int):
    return Window.partitionBy("name", "_block").orderBy("_place").rowsBetween(-(n - 1), 0)


def _framed(samples: DataFrame, n: int, block: int | None, **columns: Column) -> DataFrame:
    """samples with columns over their last n, computed block by block."""
    return in_blocks(samples, n, block).withColumns(columns).where("_own").drop("_own", "_block", "_place")


def moving_average(samples: DataFrame, n: int, block: int | None = None) -> DataFrame:
    total = F.sum(F.col("value").cast("decimal(20,6)")).over(_last(n)).cast("double")
    return _framed(samples, n, block, moving_average=F.round(total / F.count("value").over(_last(n)), 6))


def trend(samples: DataFrame, n: int, block: int | None = None) -> DataFrame:
    """Last minus first of the window; 0 for a single sample."""
    return _framed(samples, n, block, trend=F.round(F.col("value") - F.first("value").over(_last(n)), 6))


def forecast(samples: DataFrame, n: int = 10, block: int | None = None) -> DataFrame:
    """Mean of the window plus its mean step."""
    size = F.count("value").over(_last(n))
    total = F.sum(F.col("value").cast("decimal(20,6)")).over(_last(n)).cast("double")
    step = (F.col("value") - F.first("value").over(_last(n))) / F.greatest(size - 1, F.lit(1))
    return _framed(samples, n, block, forecast=F.round(total / size + step, 6))


def latency_p99(samples: DataFrame, n: int = 1000) -> DataFrame:
    """The sample at index min(n * 99 div 100, n - 1) of the sorted last n of each name."""
    newest = Window.partitionBy("name").orderBy(F.col("at").desc(), F.col("event_id").desc())
    last = samples.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= n)
    rank = F.row_number().over(Window.partitionBy("name").orderBy("value", "event_id"))
    size = F.count(F.lit(1)).over(Window.partitionBy("name"))
    return last.select("name", "value", rank.alias("_r"), size.alias("samples")).where("_r = least(samples * 99 div 100, samples - 1) + 1").select("name", "samples", F.col("value").alias("p99"))


def rolling_hour(samples: DataFrame, seconds: int = STRETCH // 60) -> DataFrame:
    """Sum of the last 3600 s at each sample, both ends included. A sample is added at its own time and taken away right after
    its hour, so each sum is one of running totals, however many samples the hour holds. The totals run within stretches of
    `seconds`, on top of what the stretches before leave: a name's window holds one row a stretch, no window all its samples."""
    micros, hour = F.unix_micros("at"), 3_600_000_000
    value = F.col("value").cast("decimal(20,6)")
    own = samples.withColumns({"_at": micros, "_value": value, "_n": F.col("value").isNotNull().cast("long")})
    gone = own.where("_at is not null").select(F.col("name"), (F.col("_at") + hour + 1).alias("_at"), (-F.col("_value")).alias("_value"), (-F.col("_n")).alias("_n"))
    moves = own.withColumn("_own", F.lit(True)).unionByName(gone.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    moves = moves.withColumn("_stretch", F.floor(F.col("_at") / (seconds * 1_000_000)))
    earlier = Window.partitionBy("name").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = moves.where("_stretch is not null").groupBy("name", "_stretch").agg(F.sum("_value").alias("_value"), F.sum("_n").alias("_n"))
    before = totals.select(F.col("name").alias("_name"), F.col("_stretch").alias("_until"), F.sum("_value").over(earlier).alias("_sum_before"), F.sum("_n").over(earlier).alias("_n_before"))
    inside = Window.partitionBy("name", "_stretch").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = moves.withColumns({"_sum": F.sum("_value").over(inside), "_count": F.sum("_n").over(inside)}).where("_own")
    joined = run.join(before, F.col("name").eqNullSafe(F.col("_name")) & (F.col("_stretch") == F.col("_until")), "left")
    zero = F.lit(0).cast("decimal(38,6)")
    total = F.coalesce("_sum", zero) + F.coalesce("_sum_before", zero)
    some = F.col("_count") + F.coalesce("_n_before", F.lit(0)) > 0
    return joined.select(*samples.columns, F.when(some, total).cast("double").alias("hour_sum"))


def next_code_counts(df: DataFrame, k: int, entity: str, code: str, *order: str) -> DataFrame:
    """For each code the k codes that most often come next."""
    following = F.lead(code).over(Window.partitionBy(entity).orderBy(*order))
    pairs = df.withColumn("next_code", following).where("next_code is not null").groupBy(F.col(code).alias("code"), "next_code").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n"), "next_code"))).where(F.col("place") <= k)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows; a sorted limit keeps n rows a task."""
    return df.orderBy(*order).limit(n)
