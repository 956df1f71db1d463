"""Incremental state over streams: smoothed scores and latest states by key, and windows of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftgraph.plans.workers import by_value

by_value(__name__)

ALPHA = 0.3


def smoothed_scores(events: DataFrame, key: str, score: str, order: str, alpha: float = ALPHA) -> DataFrame:
    """A running exponential average of scores by key; each micro-batch is taken in order of ``order``."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ema, n = state.get if state.exists else (None, 0)
        own = pd.concat(list(batches)).sort_values(order)
        for value in own[score]:
            if value is not None and value == value:
                ema = float(value) if ema is None else (1 - alpha) * ema + alpha * float(value)
                n += 1
        if ema is not None:
            state.update((ema, n))
            yield pd.DataFrame({key: [k[0]], "ema": [ema], "n": [n]})

    kind = dict(events.dtypes)[key]
    return events.select(key, score, order).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, ema double, n long", "ema double, n long", "update", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, at: str, by: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums in event-time windows, tumbling or sliding; rows later than ``late`` are dropped by the watermark."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), by, "n", "total")


def sessions(events: DataFrame, at: str, by: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of activity that a pause of ``gap`` ends."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), by, "n")


def deduplicated(events: DataFrame, at: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def append_once(df: DataFrame, path: str):
    """A foreachBatch sink that writes each batch to a folder of its own: a batch that is replayed replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(write)
