"""Scenarios, merges and versions: sets of changes applied to a graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.identity import sorted_json
from weftgraph.functions.text import strip


def scenario_diff(base: DataFrame, scenario: DataFrame) -> DataFrame:
    """(id, change): 'added', 'removed' or 'updated' against an immutable base, by id and content. One row an id a side."""
    a = base.select("id", sorted_json(F.col("properties")).alias("p"), "type_", F.lit(1).alias("there"))
    b = scenario.select("id", sorted_json(F.col("properties")).alias("q"), F.col("type_").alias("t"), F.lit(1).alias("here"))
    both = a.join(b, "id", "full_outer")
    change = F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "removed").when(~F.col("p").eqNullSafe(F.col("q")) | ~F.col("type_").eqNullSafe(F.col("t")), "updated")
    return both.select("id", change.alias("change")).where("change is not null")


def patched(base: DataFrame, patches: DataFrame) -> DataFrame:
    """(id, key, value): node properties after patches (id, key, value); a NULL value deletes the key."""
    old = base.select("id", F.explode(F.map_entries("properties")).alias("e")).select("id", "e.key", "e.value")
    kept = old.join(patches.select("id", "key"), ["id", "key"], "left_anti")
    return kept.where("value is not null").unionByName(patches.where("value is not null").select("id", "key", "value"))


def materialised(base: DataFrame, removed: DataFrame, added: DataFrame, updated: DataFrame) -> DataFrame:
    """base without removed, with added; updated rows replace those of equal id. All have base's columns but removed, which has id."""
    rest = base.join(removed.select("id"), "id", "left_anti").join(updated.select("id"), "id", "left_anti")
    return rest.unionByName(updated).unionByName(added)


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, missing_end): edges that a change of the nodes would leave without an end."""
    ids = nodes.select(F.col("id").alias("end")).distinct()
    ends = F.explode(F.array(F.struct(F.lit("from_").alias("missing_end"), F.col("from_").alias("end")), F.struct(F.lit("to_").alias("missing_end"), F.col("to_").alias("end"))))
    return edges.select("id", ends.alias("e")).select("id", "e.*").where("end is not null").join(ids, "end", "left_anti").select("id", "missing_end").distinct()


def property_conflicts(staging: DataFrame, production: DataFrame, keys: Sequence[str], on: str = "id") -> DataFrame:
    """(on, key, staging_value, production_value, kind): 'differs', 'new' or 'deleted' for each key, trimmed."""
    each = F.explode(F.array(*(F.lit(k) for k in keys)))
    a = staging.select(on, F.col("properties").alias("s"))
    b = production.select(on, F.col("properties").alias("p"))
    flat = a.join(b, on).select(on, "s", "p", each.alias("key")).select(on, "key", strip(F.element_at("s", F.col("key"))).alias("staging_value"), strip(F.element_at("p", F.col("key"))).alias("production_value"))
    kind = F.when(F.col("production_value").isNull() & F.col("staging_value").isNotNull(), "new").when(F.col("staging_value").isNull() & F.col("production_value").isNotNull(), "deleted").when(F.col("staging_value") != F.col("production_value"), "differs")
    return flat.withColumn("kind", kind).where("kind is not null")


def version_chain(versions: DataFrame) -> DataFrame:
    """(id, version_no, valid_from, closes): each id's distinct versions in order, closed where the next one begins."""
    w = Window.partitionBy("id").orderBy("valid_from")
    one = versions.groupBy("id", "valid_from").agg(F.max("valid_to").alias("valid_to"))
    return one.select("id", F.row_number().over(w).alias("version_no"), "valid_from", F.coalesce(F.least("valid_to", F.lead("valid_from").over(w)), "valid_to", F.lead("valid_from").over(w)).alias("closes"))


def as_of(versions: DataFrame, when: Column) -> DataFrame:
    """The versions that hold at a time."""
    return versions.where((F.col("valid_from") <= when) & (F.col("valid_to").isNull() | (when < F.col("valid_to"))))


def reconciled(matches: DataFrame, least: float) -> DataFrame:
    """(source, target, confidence): each target keeps its most confident source, of equals the smallest; below the threshold none."""
    sure = matches.where(F.col("confidence") >= least)
    best = sure.groupBy("target").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "source")).alias("b"))
    return best.select("b.source", "target", (-F.col("b.c")).alias("confidence"))


def upserted(ledger: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ledger rows after an upsert: first_seen_at stays, canonical_id and updated_at follow the newer row."""
    new = seen.select(*keys, F.col("canonical_id").alias("_id"), F.col("updated_at").alias("_at"))
    both = ledger.join(new, list(keys), "full_outer")
    return both.select(*keys, F.coalesce("_id", "canonical_id").alias("canonical_id"), F.coalesce("first_seen_at", "_at").alias("first_seen_at"), F.coalesce("_at", "updated_at").alias("updated_at"))
