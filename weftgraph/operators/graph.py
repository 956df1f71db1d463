"""A property graph as two DataFrames, and the reads and joins on it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.skew import salted_join


@dataclass(frozen=True)
class PropertyGraph:
    """nodes: id, type_, properties, ...; edges: id, from_, to_, relationship, ... Nothing is computed until an action."""

    nodes: DataFrame
    edges: DataFrame

    def of_transform(self, transform_id: str) -> PropertyGraph:
        return PropertyGraph(self.nodes.where(F.col("transform_id") == transform_id), self.edges.where(F.col("transform_id") == transform_id))

    def active(self) -> PropertyGraph:
        """Versions that still hold, once each."""
        return PropertyGraph(latest_versions(self.nodes.where(F.col("valid_to").isNull())), latest_rows(self.edges))

    def of_types(self, types: Sequence[str]) -> PropertyGraph:
        """Nodes of the types, whatever their case, and the edges between them."""
        kept = self.nodes.where(F.lower("type_").isin([t.lower() for t in types]))
        return PropertyGraph(kept, induced_edges(kept, self.edges))


def latest_rows(df: DataFrame, key: str = "id", by: Sequence[str] = ("loaded_at",)) -> DataFrame:
    """One row a key: the one with the greatest ``by``; among equals, the one with the greatest content hash.

    An aggregate that combines before its shuffle: a key with many rows sends few.
    """
    plain = [c for c, t in df.dtypes if "map" not in t]
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    best = df.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.struct(*by, F.xxhash64(*plain))).alias("_r"))
    return best.select("_r.*")


def latest_versions(nodes: DataFrame) -> DataFrame:
    return latest_rows(nodes, "id", ("valid_from", "loaded_at"))


def induced_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes. Hot ends are salted."""
    ids = nodes.select(F.col("id").alias("from_")).distinct()
    kept = salted_join(edges, ids, ["from_"], "left_semi", F.col("id"))
    return salted_join(kept, ids.withColumnRenamed("from_", "to_"), ["to_"], "left_semi", F.col("id"))


def orphan_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at no edge."""
    used = edges.select(F.explode(F.array("from_", "to_")).alias("id")).where("id is not null").distinct()
    return nodes.join(used, "id", "left_anti")


def connection_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_out, n_in): edges at each node, counted before the join."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("from_").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    sums = ends.where("id is not null").groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return nodes.select("id").join(sums, "id", "left").select("id", zero("n_out"), zero("n_in"))


def missing_mirrors(edges: DataFrame, relationship: str, inverse: str) -> DataFrame:
    """Edges of a relationship without its inverse in the other direction."""
    back = edges.where(F.col("relationship") == inverse).select(F.col("to_").alias("from_"), F.col("from_").alias("to_")).distinct()
    return edges.where(F.col("relationship") == relationship).join(back, ["from_", "to_"], "left_anti")


def repointed(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends replaced by their representatives. Loops that this makes are dropped; older loops stay.

    mapping: (id, representative), one row an id.
    """
    one = mapping.select(F.col("id").alias("from_"), F.col("representative").alias("_f"))
    two = mapping.select(F.col("id").alias("to_"), F.col("representative").alias("_t"))
    both = salted_join(salted_join(edges, one, ["from_"], "left", F.col("id")), two, ["to_"], "left", F.col("id"))
    new_from, new_to = F.coalesce("_f", "from_"), F.coalesce("_t", "to_")
    changed = ~(new_from.eqNullSafe(F.col("from_")) & new_to.eqNullSafe(F.col("to_")))
    moved = both.withColumn("_changed", changed).withColumns({"from_": new_from, "to_": new_to})
    return moved.where(~F.col("_changed") | ~F.col("from_").eqNullSafe(F.col("to_"))).drop("_f", "_t", "_changed")


def resolved_endpoints(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """(edge_id, ref, node_id, how): an edge end found as a node id, else canonical id, else canonical key, else alias.

    Of several nodes with one canonical id, key or alias, the smallest id counts.
    """
    refs = edges.where(F.col(end).isNotNull()).select(F.col("id").alias("edge_id"), F.lower(F.trim(F.col(end))).alias("ref")).where("ref <> ''").distinct()
    names = F.explode(
        F.concat(
            F.array(*(F.struct(F.col(c).alias("ref"), F.lit(k).alias("rank")) for k, c in enumerate(("id", "canonical_id", "canonical_key")))),
            F.transform(F.coalesce("original_extraction_ids", F.array().cast("array<string>")), lambda a: F.struct(a.alias("ref"), F.lit(3).alias("rank"))),
        )
    )
    table = nodes.select("id", names.alias("n")).where("n.ref is not null and n.ref <> ''").groupBy(F.lower("n.ref").alias("ref")).agg(F.min(F.struct("n.rank", "id")).alias("hit"))
    rank = F.col("hit.rank")
    how = F.when(F.col("hit.id").isNull(), "unresolved").when(rank == 0, "id").when(rank == 1, "canonical_id").when(rank == 2, "canonical_key").otherwise("alias")
    return salted_join(refs, table, ["ref"], "left", F.col("edge_id")).select("edge_id", "ref", F.col("hit.id").alias("node_id"), how.alias("how"))


def property_keys(df: DataFrame, label: str) -> DataFrame:
    """(label, key, n): the keys that occur with each label, and how often with a value."""
    return df.select(F.col(label).alias("label"), F.explode(F.map_entries("properties")).alias("e")).groupBy("label", F.col("e.key").alias("key")).agg(F.count("e.value").alias("n"))


def in_type_neighbours(nodes: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """(id, rank, neighbour): up to ``most`` neighbours of a node's own type, in order of id."""
    both = F.explode(F.array(F.struct(F.col("from_").alias("id"), F.col("to_").alias("neighbour")), F.struct(F.col("to_").alias("id"), F.col("from_").alias("neighbour"))))
    pairs = edges.where("from_ is not null and to_ is not null and from_ <> to_").select(both.alias("e")).select("e.*").distinct()
    typed = nodes.select("id", "type_").distinct()
    other = typed.select(F.col("id").alias("neighbour"), F.col("type_").alias("other"))
    met = salted_join(salted_join(pairs, typed, ["id"], "inner", F.col("neighbour")), other, ["neighbour"], "inner", F.col("id")).where("type_ = other")
    # The few smallest of each node come out of a bounded aggregate: no node's neighbours are sorted in one task.
    w = Window.partitionBy("id").orderBy("neighbour")
    salted = met.select("id", "neighbour").withColumn("_s", F.pmod(F.xxhash64("neighbour"), F.lit(16)))
    few = salted.withColumn("_r", F.row_number().over(Window.partitionBy("id", "_s").orderBy("neighbour"))).where(F.col("_r") <= most)
    return few.select("id", "neighbour", F.row_number().over(w).alias("rank")).where(F.col("rank") <= most)


def chunk_mates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, mate): orphan nodes with the nodes at some edge that came from one chunk of the same transform."""
    chunks = nodes.select("id", "transform_id", F.explode("provenance.chunk_ids").alias("chunk")).distinct()
    orphans = orphan_nodes(nodes, edges).select("id").distinct()
    alone = chunks.join(orphans, "id", "left_semi")
    linked = chunks.join(orphans, "id", "left_anti").withColumnRenamed("id", "mate")
    return salted_join(linked, alone, ["transform_id", "chunk"], "inner", F.col("mate")).select("id", "mate").distinct()


def merged_edges(edges: DataFrame) -> DataFrame:
    """(from_, to_, relationship, properties): parallel edges as one; of a property the last loaded value counts."""
    flat = edges.select("from_", "to_", "relationship", "loaded_at", "id", F.explode_outer(F.map_entries("properties")).alias("e"))
    one = flat.groupBy("from_", "to_", "relationship", F.col("e.key").alias("key")).agg(F.max(F.struct("loaded_at", "id", "e.value")).alias("v"))
    keyed = F.when(F.col("key").isNotNull(), F.struct("key", F.col("v.value").alias("value")))
    return one.groupBy("from_", "to_", "relationship").agg(F.map_from_entries(F.array_sort(F.collect_list(keyed))).alias("properties"))


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """(id, key, value, confidence): rows of one id folded into one. Of a property the value of the most confident row
    counts, of equal confidence the longest, then the greatest."""
    flat = nodes.select("id", F.coalesce("confidence_score", F.lit(0.0)).alias("c"), F.explode(F.map_entries("properties")).alias("e")).where("e.value is not null")
    best = flat.groupBy("id", F.col("e.key").alias("key")).agg(F.max(F.struct("c", F.length("e.value").alias("n"), F.col("e.value").alias("value"))).alias("b"))
    return best.select("id", "key", "b.value", F.col("b.c").alias("confidence"))


def page(df: DataFrame, size: int, number: int, *order: Column) -> DataFrame:
    """A page of an ordered read; size <= 0 gives nothing."""
    return df.orderBy(*order).offset(max(0, size) * number).limit(max(0, size))
