"""Append-only logs and what is read from them: decisions, claims, audit events, sessions, batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.review import first_rows


def appended(log: DataFrame, path: str) -> None:
    """Adds entries to a log. A log is never changed: what an entry says is taken back by a later one."""
    log.write.mode("append").parquet(path)


def entries(log: DataFrame, **wanted: str) -> DataFrame:
    """The entries whose columns have the values given."""
    for column, value in wanted.items():
        log = log.where(F.col(column) == value)
    return log


def checked_claims(claims: DataFrame) -> DataFrame:
    """Claims with the first ``problem`` that keeps each from being stored, NULL where there is none."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    problem = (
        F.when(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1), "confidence")
        .when(F.col("target_kind").isNull() | ~F.col("target_kind").isin("node", "edge"), "target_kind")
        .when(blank("target_id"), "target_id")
        .when(blank("property_key"), "property_key")
    )
    return claims.withColumn("problem", problem)


def audit_summary(log: DataFrame) -> DataFrame:
    """(what, name, n): successful entries by kind, and all entries by status. log: (kind, status)."""
    sums = log.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))
    by = lambda df, what, c: df.groupBy(F.lit(what).alias("what"), F.col(c).alias("name")).agg(F.sum("n").alias("n"))
    return by(sums.where("status = 'success'"), "type", "kind").unionByName(by(sums, "status", "status"))


def counts(log: DataFrame, by: str) -> DataFrame:
    return log.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def popularity(events: DataFrame, item: str, user: str, newest: list[Column], spread: Column, recent: int = 20) -> DataFrame:
    """(item, n_uses, recent_users, popularity): uses, users among the newest ``recent`` of them, and a figure of at most 10."""
    few = first_rows(events.select(item, user, "ts", "event_id"), [item], newest, recent, spread).groupBy(item).agg(F.count_distinct(user).alias("recent_users"))
    out = events.groupBy(item).agg(F.count(F.lit(1)).alias("n_uses")).join(few, item, "left").withColumn("recent_users", F.coalesce("recent_users", F.lit(0)))
    return out.select(item, "n_uses", "recent_users", F.least(F.col("n_uses") * 0.1 + F.col("recent_users") * 0.5, F.lit(10.0)).alias("popularity"))


def session_counts(log: DataFrame, session: str, at: str) -> DataFrame:
    return log.groupBy(session).agg(F.count(F.lit(1)).alias("n_messages"), F.max(at).alias("last_at"))


def hit_rates(log: DataFrame, by: str, hit: Column) -> DataFrame:
    """(by, hits, misses, hit_rate), the rate 0 without any."""
    own = log.groupBy(by).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))
    n = F.col("hits") + F.col("misses")
    return own.withColumn("hit_rate", F.when(n > 0, F.col("hits") / n).otherwise(F.lit(0.0)))


def batch_summary(batches: DataFrame, by: str) -> DataFrame:
    """(by, n_batches, n_done, success, n_warnings): success only if every batch succeeded. batches: (by, success, warning)."""
    return batches.groupBy(by).agg(F.count(F.lit(1)).alias("n_batches"), F.sum(F.col("success").cast("bigint")).alias("n_done"), F.bool_and("success").alias("success"), F.count_distinct("warning").alias("n_warnings"))


def result_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(transform_id, n_nodes, n_edges, n_node_types, n_edge_types)."""
    a = nodes.groupBy("transform_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("type_").alias("n_node_types"))
    b = edges.groupBy("transform_id").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("relationship").alias("n_edge_types"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return a.join(b, "transform_id", "full_outer").select("transform_id", *(zero(c) for c in ("n_nodes", "n_edges", "n_node_types", "n_edge_types")))


def ready(latest: DataFrame, by: str, settled: Column) -> DataFrame:
    """(by, ready): whether nothing is open any more."""
    return latest.groupBy(by).agg(F.bool_and(settled).alias("ready"))


def visible(rows: DataFrame, user: Column, public: Column) -> DataFrame:
    """A user's own rows and public ones."""
    return rows.where((F.col("user_id") == user) | F.coalesce(public, F.lit(False)))


def has_any(message: Column, parts: Sequence[str]) -> Column:
    low, out = F.lower(message), F.lit(False)
    for p in parts:
        out = out | low.contains(p.lower())
    return out


def classified(message: Column, classes: Mapping[str, Sequence[str]], default: str = "unknown") -> Column:
    """The first class one of whose parts occurs in the message."""
    out = None
    for name, parts in classes.items():
        out = F.when(has_any(message, parts), name) if out is None else out.when(has_any(message, parts), name)
    return out.otherwise(default) if out is not None else F.lit(default)


def two_sides(staging: DataFrame, production: DataFrame) -> DataFrame:
    """Rows of a merge from both graphs, with the side they are on."""
    return staging.withColumn("side", F.lit("staging")).unionByName(production.withColumn("side", F.lit("production")))


def latest_status(events: DataFrame, key: str, at: str) -> DataFrame:
    """(key, started, finished, status, n_events): a life told by start and end events; the last status counts."""
    return events.groupBy(key).agg(F.min(at).alias("started"), F.max(at).alias("finished"), F.max_by("status", F.struct(at, "status")).alias("status"), F.count(F.lit(1)).alias("n_events"))
