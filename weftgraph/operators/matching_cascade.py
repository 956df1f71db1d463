"""Cascades: the first strategy that finds something decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.skew import salted_join


def first_match(records: DataFrame, targets: DataFrame, strategies: Sequence[tuple[str, Sequence[tuple[Column, Column]], float]], within: Sequence[str] = ()) -> DataFrame:
    """(*within, id, strategy, target, n_targets, confidence): the first strategy with a hit decides; target is set for exactly one hit.

    strategies: (name, [(record key, target key)], confidence). All strategies are one equi-join on (rank, key hash). records and
    targets need id; a strategy with a NULL key is skipped for that row. A strategy with several targets is ambiguous: its
    confidence counts half and it names no target. Records meet only targets that agree in the columns within.
    """
    def keyed(df: DataFrame, side: int, name: str) -> DataFrame:
        keys = [F.when(_all_set([p[side] for p in pairs]), F.xxhash64(*(p[side] for p in pairs))) for _, pairs, _ in strategies]
        return df.select(*within, F.col("id").alias(name), F.posexplode(F.array(*keys)).alias("rank", "key")).where("key is not null").distinct()

    hits = salted_join(keyed(records, 0, "id"), keyed(targets, 1, "target"), [*within, "rank", "key"], "inner", F.col("id"))
    counted = hits.groupBy(*within, "id", "rank").agg(F.count_distinct("target").alias("n_targets"), F.min("target").alias("target"))
    best = counted.groupBy(*within, "id").agg(F.min(F.struct("rank", "n_targets", "target")).alias("b")).select(*within, "id", "b.*")
    name, sure = F.lit(None).cast("string"), F.lit(None).cast("double")
    for i, (n, _, c) in enumerate(strategies):
        name = F.when(F.col("rank") == i, n).otherwise(name)
        sure = F.when(F.col("rank") == i, F.when(F.col("n_targets") == 1, c).otherwise(c / 2)).otherwise(sure)
    return best.select(*within, "id", name.alias("strategy"), F.when(F.col("n_targets") == 1, F.col("target")).alias("target"), "n_targets", sure.alias("confidence"))


def _all_set(columns: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & (F.trim(c) != "")
    return out


def hydrated(nodes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Nodes whose canonical id is the ledger's wherever user, type and canonical key are known there. ledger: one row a key."""
    known = ledger.select("user_id", "type_", "canonical_key", F.col("canonical_id").alias("_known"))
    joined = salted_join(nodes, known, ["user_id", "type_", "canonical_key"], "left", F.col("id"))
    return joined.withColumn("canonical_id", F.coalesce("_known", "canonical_id")).drop("_known")


def similarity_tiers(pairs: DataFrame, auto: float = 0.85, review: float = 0.70) -> DataFrame:
    """(id, target, score, tier): each id's best target, taken as it is from ``auto`` on, for review from ``review`` on."""
    best = pairs.groupBy("id").agg(F.max(F.struct("score", "target")).alias("b")).select("id", "b.target", "b.score")
    return best.withColumn("tier", F.when(F.col("score") >= auto, "auto").when(F.col("score") >= review, "review")).where("tier is not null")


def keyed_edges(edges: DataFrame, node_keys: DataFrame) -> DataFrame:
    """(source_key, target_key, relationship, id): edges by the keys of their ends; edges without both are dropped, of equal ones the last loaded counts.

    node_keys: (id, key), one row an id.
    """
    a = node_keys.select(F.col("id").alias("from_"), F.col("key").alias("source_key"))
    b = node_keys.select(F.col("id").alias("to_"), F.col("key").alias("target_key"))
    both = salted_join(salted_join(edges.select("id", "from_", "to_", "relationship", "loaded_at"), a, ["from_"], "inner", F.col("id")), b, ["to_"], "inner", F.col("id"))
    return both.groupBy("source_key", "target_key", "relationship").agg(F.max(F.struct("loaded_at", "id")).alias("m")).select("source_key", "target_key", "relationship", "m.id")


def pruned(nodes: DataFrame, edges: DataFrame, ontology_keys: Sequence[str], rel_types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept nodes, added edges): orphans without ontology properties are dropped, unless their type has one possible
    relationship and there is exactly one partner, to which they are then linked. Without any edges nothing changes."""
    used = edges.select(F.explode(F.array("from_", "to_")).alias("id")).where("id is not null").distinct().withColumn("_used", F.lit(True))
    filled = F.lit(False)
    for k in ontology_keys:
        filled = filled | F.coalesce(F.col("properties")[k] != "", F.lit(False))
    marked = nodes.join(used, "id", "left").withColumn("_keep", F.coalesce("_used", F.lit(False)) | filled)
    bare = marked.where(~F.col("_keep")).select("id", "type_").distinct()
    possible = rel_types.select(F.col("source_type").alias("type_"), "rel_type", F.col("target_type").alias("other"), F.lit(True).alias("out")).unionByName(rel_types.select(F.col("target_type").alias("type_"), "rel_type", F.col("source_type").alias("other"), F.lit(False).alias("out"))).distinct()
    single = possible.groupBy("type_").agg(F.count(F.lit(1)).alias("n"), F.first("rel_type").alias("relationship"), F.first("other").alias("other"), F.first("out").alias("out")).where("n = 1").drop("n")
    sizes = nodes.groupBy(F.col("type_").alias("other")).agg(F.count_distinct("id").alias("n_other"), F.min("id").alias("partner")).where("n_other = 1").drop("n_other")
    links = bare.join(single, "type_").join(sizes, "other").where("id <> partner")
    added = links.select(F.when(F.col("out"), F.col("id")).otherwise(F.col("partner")).alias("from_"), F.when(F.col("out"), F.col("partner")).otherwise(F.col("id")).alias("to_"), "relationship", F.lit(0.9).alias("confidence_score"))
    linked = links.select("id").distinct().withColumn("_linked", F.lit(True))
    no_edges = edges.agg(F.count(F.lit(1)) == 0).scalar()
    kept = marked.join(linked, "id", "left").where(F.col("_keep") | F.col("_linked") | no_edges)
    return kept.drop("_used", "_keep", "_linked"), added


def subgraph_page(nodes: DataFrame, edges: DataFrame, size: int, after: str = "") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the next ``size`` nodes by id after the one given, the edges at them, and the nodes at the other ends.

    A page goes on from the last id of the one before, so that a deep page costs no more than the first.
    """
    own = nodes.where(F.col("id") > after).select("id").distinct().orderBy("id").limit(size)
    out = edges.join(own.withColumnRenamed("id", "from_"), "from_", "left_semi").unionByName(edges.join(own.withColumnRenamed("id", "to_"), "to_", "left_semi").select(edges.columns)).dropDuplicates(["id"])
    ids = own.unionByName(out.select(F.explode(F.array("from_", "to_")).alias("id"))).distinct()
    return nodes.join(ids, "id", "left_semi"), out


def evidence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_in, n_out, source_file, page_number, n_chunks): where a node comes from and what it is tied to."""
    from weftgraph.operators.graph import connection_counts

    counts = connection_counts(nodes.select("id").distinct(), edges)
    own = nodes.groupBy("id").agg(F.max_by(F.struct("provenance.source_file", "provenance.page_number", F.size("provenance.chunk_ids").alias("n_chunks")), F.struct("valid_from", "loaded_at")).alias("p"))
    return own.join(counts, "id").select("id", "n_in", "n_out", "p.*")


def extraction_gaps(nodes: DataFrame, edges: DataFrame, required: dict[str, Sequence[str]], least_confidence: float) -> DataFrame:
    """(gap_type, id, detail): incomplete entities, orphans and doubtful entities in one table."""
    missing = F.lit(None).cast("array<string>")
    for t, keys in required.items():
        blank = F.filter(F.array(*(F.lit(k) for k in keys)), lambda k: F.coalesce(F.trim(F.element_at("properties", k)), F.lit("")) == "")
        missing = F.when(F.col("type_") == t, blank).otherwise(missing)
    incomplete = nodes.select(F.lit("INCOMPLETE_ENTITY").alias("gap_type"), "id", missing.alias("m")).where(F.size("m") > 0).select("gap_type", "id", F.array_join("m", ",").alias("detail"))
    used = edges.select(F.explode(F.array("from_", "to_")).alias("id")).where("id is not null").distinct()
    orphans = nodes.select("id").distinct().join(used, "id", "left_anti").select(F.lit("ORPHAN_NODE").alias("gap_type"), "id", F.lit("").alias("detail"))
    c = F.coalesce(F.nullif("confidence_score", F.lit(0.0)), F.lit(1.0))
    doubtful = nodes.where(c < least_confidence).select(F.lit("LOW_CONFIDENCE").alias("gap_type"), "id", F.lit("").alias("detail"))
    return incomplete.unionByName(orphans).unionByName(doubtful).distinct()


def full_text(records: DataFrame, phrase: str, column: str = "text", slack: int = 2) -> DataFrame:
    """(id, how): rows with the phrase, else with a word that begins like its first word, else with one within ``slack`` edits."""
    first = phrase.split()[0].lower()
    low = F.lower(column)
    words = F.split(low, r"[^\p{L}\p{N}]+")
    how = F.when(low.contains(phrase.lower()), "exact").when(F.exists(words, lambda w: w.startswith(first)), "prefix").when(F.exists(words, lambda w: F.levenshtein(w, F.lit(first)) <= slack), "fuzzy")
    return records.select("id", how.alias("how")).where("how is not null")


def term_score(terms: Column, words: Column) -> Column:
    """(exact + half of partial matches) / terms, between 0 and 1."""
    exact = F.size(F.array_intersect(terms, words))
    partial = F.size(F.filter(F.array_except(terms, words), lambda t: F.exists(words, lambda w: w.contains(t) | t.contains(w))))
    return F.least(F.lit(1.0), (exact + partial * 0.5) / F.greatest(F.size(terms), F.lit(1)))


def stamped(properties: Column, provenance: Column, document: Column) -> Column:
    """Properties with provenance added under the usual keys; what a node says itself stays."""
    stamp = F.map_filter(F.create_map(F.lit("source_chunk_id"), F.get(provenance["chunk_ids"], 0), F.lit("document_name"), document, F.lit("extractor_model"), provenance["extractor_model"]), lambda k, v: v.isNotNull())
    own = F.coalesce(properties, F.create_map().cast("map<string,string>"))
    return F.map_concat(own, F.map_filter(stamp, lambda k, v: ~F.map_contains_key(own, k)))


def context_lines(nodes: DataFrame) -> DataFrame:
    """(transform_id, n_nodes, digest): sorted lines of a transform's nodes, as a model would be given them, reduced to counts and a digest."""
    line = F.concat_ws(" ", F.concat(F.lit("["), F.coalesce("type_", F.lit("_")), F.lit("]")), "id")
    w = nodes.select("transform_id", line.alias("line")).distinct()
    return w.groupBy("transform_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.bit_xor(F.conv(F.substring(F.md5("line"), 1, 8), 16, 10).cast("bigint")).alias("digest"))
