"""Scoring an extracted graph against an expected one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def scores(expected: DataFrame, actual: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1): sets of keys compared within each group."""
    a = expected.select(*by, key).where(F.col(key).isNotNull()).distinct().withColumn("_e", F.lit(1))
    b = actual.select(*by, key).where(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(1))
    both = a.join(b, [*by, key], "full_outer")
    out = both.groupBy(*by).agg(F.count(F.when(F.col("_e").isNotNull() & F.col("_a").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("_e").isNull(), 1)).alias("fp"), F.count(F.when(F.col("_a").isNull(), 1)).alias("fn"))
    return with_ratios(out)


def with_ratios(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def micro_macro(scored: DataFrame) -> DataFrame:
    """One row: micro precision, recall and F1 from summed counts, and macro F1 as the mean over groups."""
    sums = scored.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_groups"))
    return with_ratios(sums).select("n_groups", F.col("precision").alias("micro_precision"), F.col("recall").alias("micro_recall"), F.col("f1").alias("micro_f1"), "macro_f1")
