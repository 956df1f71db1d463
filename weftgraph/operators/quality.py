"""Quality rules on entities, relationships and whole graphs, and the figures and gate that follow from violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import strip
from weftgraph.operators.graph import connection_counts
from weftgraph.plans.skew import salted_join


def _filled_count(properties: Column, keys: Sequence[str]) -> Column:
    return sum((F.when(strip(properties[k]) != "", 1).otherwise(0) for k in keys), F.lit(0))


def incomplete_entities(nodes: DataFrame, expected: Mapping[str, Sequence[str]], least: float) -> DataFrame:
    """(entity_type, entity_id, ratio): entities with too small a part of their type's properties filled."""
    ratio = F.coalesce(*(F.when(F.col("type_") == t, _filled_count(F.col("properties"), keys) / len(keys)) for t, keys in expected.items()))
    return nodes.where(F.col("type_").isin(list(expected))).select(F.col("type_").alias("entity_type"), F.col("id").alias("entity_id"), ratio.alias("ratio")).where(F.col("ratio") < least)


def lacking_relationships(nodes: DataFrame, edges: DataFrame, entity_type: str, relationship: str, direction: str, least: int) -> DataFrame:
    """(entity_id, n): entities of a type with fewer relationships than they need; direction inbound, outbound or either."""
    counts = connection_counts(nodes.where(F.col("type_") == entity_type).select("id").distinct(), edges.where(F.col("relationship") == relationship))
    n = {"inbound": F.col("n_in"), "outbound": F.col("n_out"), "either": F.col("n_in") + F.col("n_out")}[direction]
    return counts.select(F.col("id").alias("entity_id"), n.alias("n")).where(F.col("n") < least)


def property_coverage(nodes: DataFrame, expected: Mapping[str, Sequence[str]]) -> DataFrame:
    """(entity_type, property_name, n_entities, coverage): the part of a type's entities that have the property."""
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for t, keys in expected.items() for k in keys)))
    typed = nodes.where(F.col("type_").isin(list(expected))).select("type_", "properties", each.alias("e")).where("type_ = e.t")
    has = F.when(strip(F.element_at("properties", F.col("e.k"))) != "", 1.0).otherwise(0.0)
    return typed.groupBy(F.col("type_").alias("entity_type"), F.col("e.k").alias("property_name")).agg(F.count(F.lit(1)).alias("n_entities"), F.avg(has).alias("coverage"))


def low_confidence(df: DataFrame, least: float) -> DataFrame:
    """(id, confidence): own confidence, else the provenance's, else 0, below the threshold."""
    c = F.coalesce("confidence_score", "provenance.confidence_score", F.lit(0.0))
    return df.select("id", c.alias("confidence")).where(F.col("confidence") < least)


def type_shares(nodes: DataFrame, type_column: str = "type_") -> DataFrame:
    """(entity_type, n, share). The window runs over types, not over entities."""
    counts = nodes.where(F.col(type_column).isNotNull()).groupBy(F.col(type_column).alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def unbalanced_types(nodes: DataFrame, most: float, tolerance: float = 1e-4) -> DataFrame:
    """Types with more than their share of the entities."""
    return type_shares(nodes).where(F.col("share") > most + tolerance)


def missing_types(nodes: DataFrame, required: Mapping[str, int]) -> DataFrame:
    """(entity_type, least, n): required types with too few entities, absent ones with n 0."""
    spark = nodes.sparkSession
    wanted = spark.createDataFrame(list(required.items()), "entity_type string, least int")
    counts = nodes.groupBy(F.col("type_").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, "entity_type", "left").select("entity_type", "least", F.coalesce("n", F.lit(0)).alias("n")).where("n < least")


def inconsistent_edges(edges: DataFrame, nodes: DataFrame, relationship: str, source_property: str, target_property: str) -> DataFrame:
    """(edge_id, source_value, target_value): edges whose ends disagree on a pair of properties. nodes: one row an id."""
    own = edges.where(F.col("relationship") == relationship).select(F.col("id").alias("edge_id"), "from_", "to_")
    a = nodes.select(F.col("id").alias("from_"), F.lower(strip(F.col("properties")[source_property])).alias("source_value"))
    b = nodes.select(F.col("id").alias("to_"), F.lower(strip(F.col("properties")[target_property])).alias("target_value"))
    both = salted_join(salted_join(own, a, ["from_"], "inner", F.col("edge_id")), b, ["to_"], "inner", F.col("edge_id"))
    return both.where("source_value <> target_value").select("edge_id", "source_value", "target_value")


def violation_counts(violations: DataFrame) -> DataFrame:
    """(entity_type, severity, rule_type, n) with subtotals in one pass; NULL stands for all."""
    sets = violations.groupingSets([["rule_type"], ["severity"], ["entity_type"], ["entity_type", "severity"], []], "entity_type", "severity", "rule_type")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def overall_score(errors: Column, warnings: Column, infos: Column, completeness: Column, confidence: Column) -> Column:
    """0 to 100: violations cost by severity, completeness (in per cent) and confidence add or take away."""
    raw = F.lit(100.0) - errors * 10 - warnings * 5 - infos + (completeness - 50) * 0.2 + (confidence - 0.5) * 20
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def gate(score: Column, errors: Column, warnings: Column, completeness: Column, hard_fail: float = 70.0, warn: float = 80.0, max_errors: int = 0, max_warnings: int = 10, least_completeness: float = 0.5) -> Column:
    """'fail', 'warn' or 'pass'; too little completeness fails even what would only warn."""
    failed = (score < hard_fail) | (errors > max_errors) | (completeness < least_completeness * 100)
    return F.when(failed, "fail").when((score < warn) | (warnings > max_warnings), "warn").otherwise("pass")


def graph_scores(nodes: DataFrame, violations: DataFrame, expected: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row a transform: its figures, score, grade and gate. violations need transform_id and severity: an entity that is in
    several transforms is judged in each by what was found there."""
    filled = F.coalesce(*(F.when(F.col("type_") == t, _filled_count(F.col("properties"), keys)) for t, keys in expected.items()), F.lit(0))
    wanted = F.coalesce(*(F.when(F.col("type_") == t, F.lit(len(keys))) for t, keys in expected.items()), F.lit(0))
    figures = nodes.groupBy("transform_id").agg(F.count(F.lit(1)).alias("n_entities"), F.sum(filled).alias("filled"), F.sum(wanted).alias("wanted"), F.avg("confidence_score").alias("confidence"))
    severities = violations.groupBy("transform_id").agg(*(F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = figures.join(severities, "transform_id", "left").select(
        "transform_id", "n_entities", zero("errors"), zero("warnings"), zero("infos"), F.when(F.col("wanted") > 0, F.col("filled") / F.col("wanted") * 100).otherwise(F.lit(100.0)).alias("completeness"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")
    )
    out = out.withColumn("score", overall_score(*(F.col(c) for c in ("errors", "warnings", "infos", "completeness", "confidence"))))
    return out.withColumn("grade", grade(F.col("score"))).withColumn("gate", gate(F.col("score"), F.col("errors"), F.col("warnings"), F.col("completeness")))
