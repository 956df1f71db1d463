"""Reading quality results: pages, exports, analytics, gate reasons, recommendations, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The columns of the export, in order.
EXPORT = ("rule_id", "rule_type", "severity", "entity_type", "entity_id", "property_name", "relationship_type", "message", "expected", "actual", "confidence", "suggestion")


def violation_page(violations: DataFrame, size: int, after: dict | None = None, **wanted: str) -> DataFrame:
    """The next ``size`` violations in order of rule, entity and property, of the given severity, rule_type or entity_type.

    after: the last row of the page before. Pages go on from a key, so that a deep page costs no more than the first; size <= 0
    gives nothing.
    """
    order = ["rule_id", "entity_id", "property_name"]
    own = violations
    for column, value in wanted.items():
        own = own.where(F.col(column) == value)
    if after is not None:
        own = own.where(F.struct(*order) > F.struct(*(F.lit(after[c]) for c in order)))
    return own.orderBy(*order).limit(max(0, size))


def export_rows(violations: DataFrame) -> DataFrame:
    """The columns of EXPORT as text: what is missing is empty, confidence has two decimals."""
    have = set(violations.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    confidence = F.format_string("%.2f", F.coalesce(F.col("confidence").cast("double"), F.lit(1.0))) if "confidence" in have else F.lit("1.00")
    return violations.select(*((confidence if c == "confidence" else text(c)).alias(c) for c in EXPORT))


def top_rules(violations: DataFrame, n: int = 10) -> DataFrame:
    """(rule_id, n, severity, rule_type) of the rules most often broken; ties in order of rule."""
    counts = violations.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.min("severity").alias("severity"), F.min("rule_type").alias("rule_type"))
    return counts.orderBy(F.desc("n"), "rule_id").limit(n)


def top_entity_types(violations: DataFrame, n: int = 10) -> DataFrame:
    """(entity_type, n); no type counts as unknown."""
    return violations.groupBy(F.coalesce("entity_type", F.lit("unknown")).alias("entity_type")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity_type").limit(n)


def gate_reasons(scores: DataFrame, hard_fail: float = 70.0, warn: float = 80.0, max_errors: int = 0, max_warnings: int = 10, least_completeness: float = 0.5) -> DataFrame:
    """(transform_id, gate, reason): each reason why a graph does not pass. scores: as graph_scores gives them."""
    c = F.col
    reasons = F.array_compact(
        F.array(
            F.when(c("score") < hard_fail, f"Score below {hard_fail:g}"),
            F.when(c("errors") > max_errors, f"More than {max_errors} errors"),
            F.when((c("score") >= hard_fail) & (c("score") < warn), f"Score below {warn:g}"),
            F.when(c("warnings") > max_warnings, f"More than {max_warnings} warnings"),
            F.when(c("completeness") < least_completeness * 100, f"Completeness below {least_completeness:.0%}"),
        )
    )
    return scores.select("transform_id", "gate", F.explode(reasons).alias("reason"))


def ranked_reasons(reasons: DataFrame, n: int = 5) -> DataFrame:
    """(reason, priority, n): reasons of failed graphs first, then the most frequent."""
    priority = F.when(F.lower("gate") == "fail", 1).when(F.lower("gate").isin("warn", "warning"), 2).when(F.lower("gate") == "pass", 3).otherwise(4)
    counts = reasons.groupBy("reason").agg(F.min(priority).cast("bigint").alias("priority"), F.count(F.lit(1)).alias("n"))
    return counts.orderBy("priority", F.desc("n"), F.lower("reason")).limit(n)


def recommendations(scores: DataFrame, types: DataFrame) -> DataFrame:
    """(transform_id, recommendation): what each graph's figures suggest. types: (transform_id, n_types)."""
    c = F.col
    told = F.array_compact(
        F.array(
            F.when(c("score") < 70, "Review the ontology: it guides extraction poorly"),
            F.when(c("errors") > 0, F.concat(F.lit("Mend "), c("errors").cast("string"), F.lit(" errors first"))),
            F.when(c("warnings") > 10, "Many warnings: refine the rules"),
            F.when(c("confidence") < 0.6, "Low confidence: improve the source documents"),
            F.when(c("completeness") < 60, "Few properties are filled: review the required ones"),
            F.when(c("n_types") < 2, "One type of entity only: does the document fit the schema?"),
        )
    )
    return scores.join(types, "transform_id").select("transform_id", F.explode(told).alias("recommendation"))


def confidence_by_type(nodes: DataFrame, low: float = 0.7) -> DataFrame:
    """(transform_id, entity_type, n, confidence, low): mean confidence where it is known."""
    own = nodes.where(F.col("type_").isNotNull()).groupBy("transform_id", F.col("type_").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence_score").alias("confidence"))
    return own.withColumn("low", F.coalesce(F.col("confidence") < low, F.lit(False)))


def runs_summary(runs: DataFrame) -> DataFrame:
    """One row: runs by gate, mean and percentiles of their duration, and runs a day. runs: (started, ms, gate)."""
    gate = F.lower("gate")
    days = F.greatest((F.unix_micros(F.max("started").cast("timestamp")) - F.unix_micros(F.min("started").cast("timestamp"))) / 86_400_000_000, F.lit(1.0))
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"), F.count_if(gate == "pass").alias("pass_count"), F.count_if(gate.isin("warn", "warning")).alias("warn_count"), F.count_if(gate == "fail").alias("fail_count"),
        F.avg("ms").alias("mean_ms"), F.percentile("ms", 0.5).alias("p50_ms"), F.percentile("ms", 0.95).alias("p95_ms"), F.round(F.count(F.lit(1)) / days, 2).alias("runs_a_day"),
    )


def runs_by_day(runs: DataFrame) -> DataFrame:
    """(day, n_runs, mean_ms, p95_ms) of each day with runs."""
    return runs.groupBy(F.to_date("started").alias("day")).agg(F.count(F.lit(1)).alias("n_runs"), F.avg("ms").alias("mean_ms"), F.percentile("ms", 0.95).alias("p95_ms"))


def quality_metrics(nodes: DataFrame, edges: DataFrame, expected: dict[str, tuple[str, ...]]) -> DataFrame:
    """(transform_id, n_entities, n_relationships, n_properties, n_types, entity_confidence, edge_confidence, fill_rate): a graph's
    figures. fill_rate: filled among expected properties of the types that have any, 1 without such entities."""
    filled = lambda k: F.coalesce((F.trim(F.col("properties")[k]) != "").cast("int"), F.lit(0))
    have, want = F.lit(0), F.lit(0)
    for t, keys in expected.items():
        have = have + F.when(F.col("type_") == t, sum((filled(k) for k in keys), F.lit(0))).otherwise(0)
        want = want + F.when(F.col("type_") == t, len(keys)).otherwise(0)
    size = F.coalesce(F.size(F.filter(F.map_values("properties"), lambda v: v.isNotNull())), F.lit(0))
    a = nodes.groupBy("transform_id").agg(F.count(F.lit(1)).alias("n_entities"), F.sum(size).alias("n_properties"), F.count_distinct("type_").alias("n_types"), F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("entity_confidence"), F.sum(have).alias("_h"), F.sum(want).alias("_w"))
    b = edges.groupBy("transform_id").agg(F.count(F.lit(1)).alias("n_relationships"), F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("edge_confidence"))
    out = a.join(b, "transform_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_relationships", "edge_confidence")})
    return out.select("transform_id", "n_entities", "n_relationships", "n_properties", "n_types", "entity_confidence", "edge_confidence", F.when(F.col("_w") > 0, F.col("_h") / F.col("_w")).otherwise(F.lit(1.0)).alias("fill_rate"))


def gap_report(gaps: DataFrame) -> DataFrame:
    """(gap_type, n, advice): gaps by type with what to do about them."""
    n = F.col("n").cast("string")
    advice = (
        F.when(F.col("gap_type") == "INCOMPLETE_ENTITY", F.concat(F.lit("Extract "), n, F.lit(" incomplete entities again")))
        .when(F.col("gap_type") == "ORPHAN_NODE", F.concat(F.lit("Find relationships of "), n, F.lit(" orphan nodes")))
        .when(F.col("gap_type") == "MISSING_RELATIONSHIP", F.concat(F.lit("Look for "), n, F.lit(" missing relationships")))
        .otherwise(F.concat(F.lit("Verify "), n, F.lit(" doubtful entities")))
    )
    return gaps.groupBy("gap_type").agg(F.count(F.lit(1)).alias("n")).withColumn("advice", advice)


def latest_of(events: DataFrame, by: list[str], at: Column, value: str) -> DataFrame:
    """The value of each key's latest event, combined before the shuffle."""
    return events.groupBy(*by).agg(F.max_by(value, F.struct(at, F.col(value))).alias(value), F.count(F.lit(1)).alias("n_events"))


def first_rows(df: DataFrame, by: list[str], order: list[Column], n: int, spread: Column, salts: int = 16) -> DataFrame:
    """The first n rows of each group with their ``place``. Each group is cut down in ``salts`` parts first, so that no
    task orders more than a part of a hot group."""
    parts = df.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(salts)))
    few = parts.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).where(F.col("_n") <= n).drop("_n", "_part")
    return few.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)
