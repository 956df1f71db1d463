"""Equi-joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this part of the rows, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.005
SALTS = 32


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of df's rows: at most ``1 / share`` of them, by counting.

    The count is combined before its shuffle. The bound on the result is what allows a broadcast of it.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    return counts.where(F.col("_n") > F.greatest(F.lit(1000), total * share)).select(*keys)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str,
    salt_of: Column,
    condition: Column | None = None,
    salts: int = SALTS,
    share: float = HOT_SHARE,
) -> DataFrame:
    """``left.join(right, keys, how)`` for a skewed left side and a right side with few rows a key.

    Rows of hot left keys are spread over ``salts`` tasks by ``salt_of``, and only the right rows of
    those keys are repeated. ``how`` is inner, left, left_semi or left_anti; ``condition`` may name further
    columns of both sides, which must differ. Null keys match nothing.
    """
    hot = hot_keys(left.where(~_any_null(keys)), keys, share).withColumn("_hot", F.lit(True))
    spread = left.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(salt_of), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    repeated = (
        right.join(F.broadcast(hot), list(keys), "left")
        .withColumn("_salt_r", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        .drop("_hot")
        .withColumnsRenamed({k: f"_r_{k}" for k in keys})
    )
    on = F.col("_salt") == F.col("_salt_r")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    joined = spread.join(repeated, on if condition is None else on & condition, how)
    return joined.drop("_salt", "_salt_r", *(f"_r_{k}" for k in keys))


def _any_null(keys: Sequence[str]) -> Column:
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return null
