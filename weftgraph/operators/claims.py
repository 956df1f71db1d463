"""Claims: statements about a property of a node or edge, and what contradicts what."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import strip
from weftgraph.plans.skew import salted_join


def contradictions(claims: DataFrame, least: float = 0.0) -> DataFrame:
    """(target_id, target_kind, property_key, severity, n_claims): properties with two or more different values.

    severity is the number of different values. Claims below the confidence, NULL values and repeated rows don't count.
    Distinct values are counted from pre-aggregated (property, value) rows, so a hot target is no hot task.
    """
    own = claims.where((F.col("confidence") >= least) & F.col("value").isNotNull()).select("id", "target_id", "target_kind", "property_key", "value").distinct()
    values = own.groupBy("target_id", "target_kind", "property_key", "value").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy("target_id", "target_kind", "property_key").agg(F.count(F.lit(1)).alias("severity"), F.sum("n").alias("n_claims")).where("severity >= 2")


def competing_claims(claims: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Claims of contradictory properties with their place by confidence, then age."""
    w = Window.partitionBy("target_id", "target_kind", "property_key").orderBy(F.desc("confidence"), "created_at", "id")
    own = claims.dropDuplicates(["id"]).join(conflicts.select("target_id", "target_kind", "property_key"), ["target_id", "target_kind", "property_key"], "left_semi")
    return own.withColumn("place", F.row_number().over(w))


def emitted_claims(nodes: DataFrame) -> DataFrame:
    """(target_id, property_key, value, confidence): one claim for each filled property of each node, once."""
    flat = nodes.select(F.col("id").alias("target_id"), F.explode(F.map_entries("properties")).alias("e"), F.col("confidence_score").alias("confidence"))
    return flat.where(strip(F.col("e.value")) != "").groupBy("target_id", F.col("e.key").alias("property_key"), F.col("e.value").alias("value")).agg(F.max("confidence").alias("confidence"))


def claims_on_nodes(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """(claim_id, node_id): claims on nodes by the node's id or one of its aliases; an id counts before an alias."""
    names = F.explode(F.concat(F.array(F.struct(F.lower("id").alias("ref"), F.lit(0).alias("rank"))), F.transform(F.coalesce("original_extraction_ids", F.array().cast("array<string>")), lambda a: F.struct(F.lower(a).alias("ref"), F.lit(1).alias("rank")))))
    table = nodes.select("id", names.alias("n")).groupBy("n.ref").agg(F.min(F.struct("n.rank", "id")).alias("hit")).select("ref", F.col("hit.id").alias("node_id"))
    refs = claims.where("target_kind = 'node'").select(F.col("id").alias("claim_id"), F.lower(F.trim("target_id")).alias("ref")).where("ref <> ''").distinct()
    return salted_join(refs, table, ["ref"], "inner", F.col("claim_id")).select("claim_id", "node_id")
