"""Edges over time: diffs between snapshots, versions, sinks, and the pairs they join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.identity import sorted_json
from weftgraph.operators.snapshot_diff import comparable_properties
from weftgraph.plans.skew import salted_join


def edge_diff(base: DataFrame, compare: DataFrame) -> DataFrame:
    """(source_key, target_key, relationship, change): keyed edges added, removed or changed.

    base and compare: (source_key, target_key, relationship, properties), as keyed_edges gives their keys; of several edges
    with one key, the one with the greatest properties counts. Bookkeeping properties don't count.
    """
    key = ["source_key", "target_key", "relationship"]
    side = lambda df, name: df.groupBy(*key).agg(F.max(F.to_json(comparable_properties(F.col("properties")))).alias(name))
    both = side(base, "_b").join(side(compare, "_c"), key, "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_c").isNull(), "removed").when(F.col("_b") != F.col("_c"), "changed")
    return both.select(*key, change.alias("change")).where("change is not null")


def edge_versions(edges: DataFrame, at: str = "loaded_at") -> DataFrame:
    """(from_, to_, relationship, version_no, valid_from, valid_to, n_changed): the versions of each edge.

    A row opens a version if it brings a property value that differs from the last one known for that key, or is the first one; the
    version before is closed then. Rows that change nothing, and rows of edges without any properties after the first, open none.
    The rows of one time are one. Bookkeeping properties don't count; NULL ends are no edge.
    """
    key = ["from_", "to_", "relationship"]
    own = edges.where("from_ is not null and to_ is not null and relationship is not null").select(*key, F.col(at).alias("at"), comparable_properties(F.col("properties")).alias("p"))
    flat = own.select(*key, "at", F.explode_outer("p").alias("e")).select(*key, "at", F.col("e.key").alias("k"), F.col("e.value").alias("v"))
    one = flat.groupBy(*key, "k", "at").agg(F.max("v").alias("v"))
    before = F.lag("v").over(Window.partitionBy(*key, "k").orderBy("at"))
    rows = one.withColumn("changes", F.when(F.col("k").isNotNull() & ~F.col("v").eqNullSafe(before), 1).otherwise(0)).groupBy(*key, "at").agg(F.sum("changes").alias("n_changed"))
    order = Window.partitionBy(*key).orderBy("at")
    opened = rows.withColumn("n", F.row_number().over(order)).where((F.col("n") == 1) | (F.col("n_changed") > 0))
    return opened.select(*key, F.row_number().over(order).alias("version_no"), F.col("at").alias("valid_from"), F.lead("at").over(order).alias("valid_to"), "n_changed")


def edge_sink(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept edges, (id, missing_end)): edges with both ends among the nodes, and a warning for each end that is missing."""
    ids = nodes.select(F.col("id").alias("_end")).distinct()
    ends = F.explode(F.array(F.struct(F.lit("from_").alias("missing_end"), F.col("from_").alias("_end")), F.struct(F.lit("to_").alias("missing_end"), F.col("to_").alias("_end"))))
    flat = edges.select("id", ends.alias("e")).select("id", "e.*").distinct()
    missing = salted_join(flat.where("_end is not null"), ids, ["_end"], "left_anti", F.col("id")).select("id", "missing_end").unionByName(flat.where("_end is null").select("id", "missing_end"))
    return edges.join(missing.select("id").distinct(), "id", "left_anti"), missing


def upserted_nodes(nodes: DataFrame, order: Sequence[str] = ("valid_from", "loaded_at")) -> DataFrame:
    """(id, key, value): rows of one id written in order. Of a property the last value counts; canonical values overwrite others."""
    entries = lambda c, rank: F.transform(F.coalesce(F.map_entries(c), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(F.lit(rank).alias("rank"), e["key"].alias("key"), e["value"].alias("value")))
    flat = nodes.select("id", *order, F.explode(F.concat(entries("properties", 0), entries("canonical_properties", 1))).alias("e")).where("e.value is not null")
    best = flat.groupBy("id", F.col("e.key").alias("key")).agg(F.max(F.struct(*order, "e.rank", "e.value")).alias("m"))
    return best.select("id", "key", F.col("m.value").alias("value"))


def between(edges: DataFrame, pairs: DataFrame, either: bool = False) -> DataFrame:
    """Edges from the first to the second node of each pair (a, b), or either way."""
    wanted = pairs.select(F.col("a").alias("from_"), F.col("b").alias("to_"))
    if either:
        wanted = wanted.unionByName(pairs.select(F.col("b").alias("from_"), F.col("a").alias("to_")))
    return edges.join(wanted.distinct(), ["from_", "to_"], "left_semi")


def reconciled_edges(staging: DataFrame, production: DataFrame) -> DataFrame:
    """(from_, to_, relationship, id, key, value): edges of a merge that is run again. An active production edge of equal ends and
    type lends its id; of a property, staging's value counts before production's."""
    key = ["from_", "to_", "relationship"]
    tag = lambda df, rank: df.select(*key, F.lit(rank).alias("rank"), "id", F.explode_outer(F.map_entries("properties")).alias("e"))
    met = tag(production, 0).join(staging.select(*key).distinct(), key, "left_semi").unionByName(tag(staging, 1))
    ids = met.groupBy(*key).agg(F.min(F.struct("rank", "id")).alias("m")).select(*key, F.col("m.id").alias("id"))
    values = met.where("e.value is not null").groupBy(*key, F.col("e.key").alias("key")).agg(F.max(F.struct("rank", "e.value")).alias("m"))
    return ids.join(values, key, "left").select(*key, "id", "key", F.col("m.value").alias("value"))


def normalised_relationships(edges: DataFrame, definitions: dict[tuple[str, str], dict[str, str]], source_type: str = "source_type") -> DataFrame:
    """(id, relationship, properties): edges with only the properties that their (source type, relationship) declares, as text.

    definitions: property -> type. A pair without definitions gets no properties; a value that doesn't fit its type
    drops the edge.
    """
    from weftgraph.operators.ontology import coerced

    out, fits = F.create_map().cast("map<string,string>"), F.lit(True)
    for (kind, name), props in definitions.items():
        here = (F.col(source_type) == kind) & (F.col("relationship") == name)
        pairs: list[Column] = []
        for p, t in props.items():
            raw = F.col("properties")[p]
            value = coerced(raw, t)
            fits = fits & ~F.coalesce(here & raw.isNotNull() & value.isNull(), F.lit(False))
            pairs += [F.lit(p), value.cast("string")]
        out = F.when(here, F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())).otherwise(out)
    return edges.where(fits).select("id", "relationship", out.alias("properties"))


def flattened(properties: Column, prefix: str = "") -> Column:
    """Entries of a property map whose JSON objects are taken apart one level: key, or key_inner, with the value."""
    entries = F.coalesce(F.map_entries(properties), F.array().cast("array<struct<key:string,value:string>>"))

    def one(e: Column) -> Column:
        inner = F.map_entries(F.from_json(e["value"], "map<string,string>"))
        parts = F.transform(inner, lambda x: F.struct(F.concat(F.lit(prefix), e["key"], F.lit("_"), x["key"]).alias("key"), x["value"].alias("value")))
        return F.when(e["value"].startswith("{"), parts).otherwise(F.array(F.struct(F.concat(F.lit(prefix), e["key"]).alias("key"), e["value"].alias("value"))))

    return F.flatten(F.transform(F.filter(entries, lambda e: e["value"].isNotNull()), one))


def same_properties(a: Column, b: Column) -> Column:
    """Whether two property maps say the same: NULL values count as absent."""
    return sorted_json(F.map_filter(a, lambda k, v: v.isNotNull())).eqNullSafe(sorted_json(F.map_filter(b, lambda k, v: v.isNotNull())))
