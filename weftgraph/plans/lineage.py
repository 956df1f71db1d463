"""Cutting lineage of iterative plans with tables that every executor can reach."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is set, a folder of our own on one machine, as in tests; an error on a
    cluster, whose executors would not see it."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="weftgraph-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used. What is left there goes when the program ends."""
    if not _written:
        atexit.register(_clear)
    _written.append(f"{checkpoint_dir(spark)}/weftgraph-{uuid.uuid4().hex}")
    return _written[-1]


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back. Survives lost executors, unlike a local checkpoint."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Deletes what ``cut`` wrote, once no plan reads it any more."""
    discard(df.sparkSession, df.cut_path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table written here that no plan reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clear() -> None:
    """Deletes every table of this program, as far as its session still answers."""
    spark = SparkSession.getActiveSession()
    for path in _written if spark is not None else ():
        try:
            discard(spark, path)
        except Exception:  # noqa: BLE001 (the session is ending; a folder that stays does no harm)
            return
