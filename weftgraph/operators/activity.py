"""Reports over activity logs: days, percentiles, rankings, rolling figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily(events: DataFrame, at: str, first: str, last: str, *measures: Column) -> DataFrame:
    """One row for each calendar day from first to last, days without events with 0. The calendar is as long as the report."""
    spark = events.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    own = events.where((F.col(at) >= F.lit(first).cast("date")) & (F.col(at) < F.date_add(F.lit(last).cast("date"), 1))).groupBy(F.to_date(at).alias("day")).agg(*measures)
    names = [c for c in own.columns if c != "day"]
    return days.join(own, "day", "left").select("day", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names))


def percentiles(df: DataFrame, by: str, value: str, *ps: float) -> DataFrame:
    """Exact percentiles with linear interpolation, by group."""
    return df.groupBy(by).agg(*(F.percentile(value, p).alias(f"p{round(p * 100)}") for p in ps))


def roll_up(events: DataFrame, at: str, *measures: Column) -> DataFrame:
    """Day, week and month totals in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("period"), F.date_trunc(p, F.col(at)).alias("starts")) for p in ("day", "week", "month"))))
    return events.withColumn("_p", each).groupBy(F.col("_p.period").alias("period"), F.col("_p.starts").alias("starts")).agg(*measures)


def top_by(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with their place. n must be small: it is what a report shows."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def rolling_mean(events: DataFrame, by: str, at: str, value: str, seconds: int) -> DataFrame:
    """Adds the mean of the group's values over the last ``seconds`` up to each event, and how many there are.

    A window reaches over two buckets of its own length: the event's and the one before. Each bucket is a task of its
    own, sees the rows of the bucket before it once more, and sums values exactly as decimals, so that neither a large
    group nor a long history makes a task grow or a sum lose digits. NULL times belong to no window.
    """
    length = seconds * 1_000_000
    us = F.unix_micros(F.col(at).cast("timestamp"))
    rows = events.withColumn("_us", us).withColumn("_own", F.floor(F.col("_us") / length))
    # Each row is there for its own bucket and, as history, for the next one.
    seen = rows.withColumn("_b", F.explode(F.array("_own", F.col("_own") + 1)))
    order = Window.partitionBy(by, "_b").orderBy("_us").rangeBetween(-length, 0)
    x = F.col(value).cast("decimal(38,12)")
    n, total = F.count(value).over(order), F.sum(x).over(order)
    held = seen.withColumn("n_rolling", n).withColumn("rolling", F.when(F.col("n_rolling") > 0, total.cast("double") / F.col("n_rolling")))
    return held.where(F.col("_b") == F.col("_own")).drop("_us", "_own", "_b")


def smoothed_by(scores: DataFrame, by: str, order: list[str], value: str, alpha: float = 0.3) -> DataFrame:
    """(by, ema, n): the exponential moving average of each group's values in order; the first value begins it.

    One step is x -> a x + b with a = 1 - alpha and b = alpha * value, and steps combine into such a step. Groups are cut into
    stretches of time; each is folded into its (a, b) and only those are folded again. Values so far back that their part
    is below 1e-18 change nothing.
    """
    keep = Window.partitionBy(by, "_day").orderBy(*order)
    day = F.to_date(order[0])
    own = scores.withColumn("_day", day)
    steps = own.withColumn("_i", F.row_number().over(keep)).withColumn("_of", F.count(F.lit(1)).over(Window.partitionBy(by, "_day")))
    # Within a stretch: b = sum of alpha (1 - alpha)^(later ones) value, a = (1 - alpha)^n; its first value by itself as well.
    decay = F.pow(F.lit(1.0 - alpha), (F.col("_of") - F.col("_i")).cast("double"))
    folded = steps.groupBy(by, "_day").agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(alpha) * decay * F.col(value)).alias("b"), F.min_by(value, "_i").alias("first"))
    late = Window.partitionBy(by).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.coalesce(F.sum("n").over(late), F.lit(0))
    total = folded.withColumn("_after", after).withColumn("_rest", F.pow(F.lit(1.0 - alpha), F.col("_after").cast("double")))
    whole = total.groupBy(by).agg(F.sum("n").alias("n"), F.sum(F.col("b") * F.col("_rest")).alias("b"), F.min_by("first", "_day").alias("first"))
    # The first value begins the average, as if it had stood there before: its step had weight alpha, now it has 1.
    return whole.select(by, (F.col("b") + F.pow(F.lit(1.0 - alpha), F.col("n").cast("double")) * F.col("first")).alias("ema"), "n")


def smoothed(scores: Column, alpha: float = 0.3) -> Column:
    """Exponential moving average of an array in its order; NULL for an empty one."""
    return F.aggregate(scores, F.lit(None).cast("double"), lambda s, v: F.when(s.isNull(), v).otherwise(s * (1 - alpha) + v * alpha))


def adaptive_threshold(ema: Column, default: float, margin: float = 0.05, floor: float = 0.7) -> Column:
    """The threshold that past scores allow: the default, or lower where matches have been good below it."""
    lowered = F.least(F.greatest(ema - margin, F.lit(floor)), F.lit(default))
    return F.when(ema.isNull() | (ema >= default - margin), F.lit(default)).otherwise(lowered)
