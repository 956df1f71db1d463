"""What changed between consecutive full snapshots.

Snapshots are sorted by a hash of each record's identity and cut into content-defined chunks: a chunk ends
where the identity hash itself says so, so that an inserted or removed record disturbs its own chunk only.
Chunks whose digests agree in both snapshots are discarded; the rows of the others are matched in stages.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Property keys that never count as a change.
BOOKKEEPING_KEYS = (
    "id", "confidence_score", "created_at", "updated_at", "extraction_timestamp", "provenance", "chunk_ids",
    "__tid", "__mid", "__valid_from", "__valid_to", "__updated", "source_chunk", "source_chunk_id", "source_text",
    "source", "source_file", "document_id", "document_name", "chunk_offset", "page_number", "extraction_confidence",
    "extractor_model", "prompt_version", "validator_score", "canonical_id", "canonical_key", "canonical_properties",
)

#: Expected rows of a chunk, a power of two.
CHUNK_ROWS = 8
#: Rows that one task may sort at a time when the snapshots are cut into chunks.
SLICE_ROWS = 500_000


def _filled(*cols: Column) -> Column:
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in cols))


def comparable_properties(properties: Column, ignored: Sequence[str] = BOOKKEEPING_KEYS) -> Column:
    """Sorted (key, value) entries that count; a NULL value is the same as an absent key."""
    keys = F.array(*(F.lit(k) for k in ignored))
    entries = F.filter(F.map_entries(properties), lambda e: e["value"].isNotNull() & ~F.array_contains(keys, e["key"]))
    return F.array_sort(F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")))


def snapshot_rows(snapshots: DataFrame, keep_properties: bool = False) -> DataFrame:
    """One row for each id of a snapshot: the copy loaded last; among copies loaded at once, one chosen by a hash of the content.

    Identity and content are reduced to hashes of 64 bits, which are only ever compared within one pair of snapshots. Rows without user_id,
    transform_id, seq_no or id belong to no snapshot and are left out.
    """
    cid = _filled(F.col("canonical_id"), F.col("properties")["canonical_id"])
    ckey = _filled(F.col("canonical_key"), F.col("properties")["canonical_key"])
    rows = snapshots.where(F.col("user_id").isNotNull() & F.col("transform_id").isNotNull() & F.col("seq_no").isNotNull() & F.col("id").isNotNull()).select(
        "user_id", "transform_id", "seq_no", "id", "type", cid.alias("cid"), ckey.alias("ckey"), "loaded_at", comparable_properties(F.col("properties")).alias("props")
    )
    kept = F.struct(
        F.when(F.col("type").isNotNull() & F.col("cid").isNotNull(), F.xxhash64(F.lit("c"), "type", "cid")).alias("k1"),
        F.when(F.col("type").isNotNull() & F.col("ckey").isNotNull(), F.xxhash64(F.lit("k"), "type", "ckey")).alias("k2"),
        F.col("cid").isNotNull().alias("has_cid"),
        F.col("h"),
        *([F.col("props"), F.col("cid")] if keep_properties else []),
    )
    rows = rows.withColumn("h", F.xxhash64("props"))
    last = F.max_by(kept, F.struct("loaded_at", "h"))
    return rows.groupBy("user_id", "transform_id", "id").agg(F.max("seq_no").alias("seq_no"), last.alias("r")).select("user_id", "transform_id", "seq_no", "id", "r.*")


def transform_pairs(snapshots: DataFrame) -> DataFrame:
    """Each transform with the one before and the one after it in its user's order (a small table)."""
    w = Window.partitionBy("user_id").orderBy("seq_no", "transform_id")
    own = snapshots.where(F.col("user_id").isNotNull() & F.col("id").isNotNull() & F.col("transform_id").isNotNull() & F.col("seq_no").isNotNull()).groupBy("user_id", "transform_id").agg(F.max("seq_no").alias("seq_no"))
    return own.select("user_id", "transform_id", F.lag("transform_id").over(w).alias("before"), F.lead("transform_id").over(w).alias("after"))


def _chunked(rows: DataFrame, slice_bits: int, chunk_rows: int) -> DataFrame:
    """Adds the chunk of each row: the identity hash at which the chunk begins, within a slice of the hash range."""
    identity = F.coalesce("k1", "k2", F.xxhash64(F.lit("i"), "id"))
    rows = rows.withColumn("identity", identity).withColumn("slice", F.shiftrightunsigned("identity", 64 - slice_bits).cast("int") if slice_bits else F.lit(0))
    starts = F.when(F.col("identity").bitwiseAND(F.lit(chunk_rows - 1)) == 0, F.col("identity"))
    w = Window.partitionBy("user_id", "transform_id", "slice").orderBy("identity").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("chunk", F.coalesce(F.last(starts, True).over(w), F.lit(-1)))


def unmatched_rows(snapshots: DataFrame, chunk_rows: int = CHUNK_ROWS, keep_properties: bool = False) -> DataFrame:
    """Rows of the chunks that differ, once a side: (pair, side 'b' or 'c', id, stage keys, content hash).

    ``pair`` is the compare transform. The number of slices follows the number of rows, so that no task
    sorts more than about SLICE_ROWS of one snapshot however large a user is. Only the digests are compared across
    snapshots; the rows are met where they lie, by the list of chunks that differ.
    """
    total = snapshots.select("id").count()
    slice_bits = max(0, math.ceil(math.log2(max(1, total) / SLICE_ROWS)))
    rows = _chunked(snapshot_rows(snapshots, keep_properties), slice_bits, chunk_rows).drop("seq_no")
    # In chunks, an id counts only where nothing else identifies the record: ids need not be stable.
    row_hash = F.xxhash64("identity", "h", "k2", F.when(F.col("k1").isNull() & F.col("k2").isNull(), F.col("id")))
    at = ["user_id", "transform_id", "slice", "chunk"]
    digests = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(row_hash).alias("x"), F.sum(F.xxhash64(row_hash, F.lit(11)).cast("decimal(38,0)")).alias("s")).join(transform_pairs(snapshots), ["user_id", "transform_id"])
    roles = F.filter(
        F.array(F.struct(F.lit("c").alias("side"), F.when(F.col("before").isNotNull(), F.col("transform_id")).alias("pair")), F.struct(F.lit("b").alias("side"), F.col("after").alias("pair"))),
        lambda r: r["pair"].isNotNull(),
    )
    compared = digests.withColumn("r", F.explode(roles)).select(*at, "n", "x", "s", "r.side", "r.pair")
    # A chunk that both sides have with one digest is left out; the others are listed with the transforms that hold them.
    holders = compared.groupBy("user_id", "pair", "slice", "chunk").agg(
        *(f(F.when(F.col("side") == side, F.struct("transform_id", "n", "x", "s"))).alias(side) for f, side in ((F.max, "b"), (F.max, "c")))
    )
    same = F.col("b.n").eqNullSafe(F.col("c.n")) & F.col("b.x").eqNullSafe(F.col("c.x")) & F.col("b.s").eqNullSafe(F.col("c.s"))
    sides = F.filter(F.array(*(F.struct(F.lit(side).alias("side"), F.col(f"{side}.transform_id").alias("transform_id")) for side in ("b", "c"))), lambda r: r["transform_id"].isNotNull())
    differing = holders.where(~same).select("user_id", "pair", "slice", "chunk", F.explode(sides).alias("r")).select("user_id", "pair", "slice", "chunk", "r.side", "r.transform_id")
    return rows.join(differing, at).select("user_id", "pair", "side", "id", "k1", "k2", "has_cid", "h", *(["props", "cid"] if keep_properties else []))


def _meet(rows: DataFrame, key: Column, slots: Column | None = None) -> DataFrame:
    """One stage: rows (user_id, pair, b, c) whose key is set pair up by key and slot; the others pass as they are.

    A row that is matched already, or has no key, gets a key of its own, so the plan stays one line of shuffles
    with no row read twice.
    """
    single = F.col("b").isNull() | F.col("c").isNull()
    own = F.struct(F.col("c.id").alias("c"), F.col("b.id").alias("b"))
    keyed = rows.withColumn("_key", F.when(single, key)).withColumn("_own", F.when(F.col("_key").isNull(), own))
    group = ["user_id", "pair", "_key", "_own"]
    keyed = keyed.withColumn("_slot", F.lit(1))
    if slots is not None:
        r = F.coalesce("b", "c")
        keyed = keyed.repartition(*(F.col(c) for c in group)).withColumn("_id", r["id"]).withColumn("_base", F.col("b").isNotNull()).withColumn("_cid", r["has_cid"])
        keyed = keyed.withColumn("_twin", F.count(F.lit(1)).over(Window.partitionBy(*group, "_id"))).withColumn("_slot", slots)
    return keyed.groupBy(*group, "_slot").agg(F.max("b").alias("b"), F.max("c").alias("c")).drop("_key", "_own", "_slot")


def match_stages(rows: DataFrame) -> DataFrame:
    """Matches base and compare rows: equal type and canonical id, then type and canonical key unless both have a
    canonical id, then id. Of several rows with one key, those of equal id are paired first, then by order of id.

    Returns (user_id, pair, b, c); b or c is null for a row without partner. Matched rows of equal content are dropped
    after each stage, so that later stages shuffle little.
    """
    differing = F.col("b").isNull() | F.col("c").isNull() | (F.col("b.h") != F.col("c.h"))
    payload = F.struct(*(c for c in rows.columns if c not in ("user_id", "pair", "side")))
    start = rows.select("user_id", "pair", F.when(F.col("side") == "b", payload).alias("b"), F.when(F.col("side") == "c", payload).alias("c"))
    row, group = F.coalesce("b", "c"), ["user_id", "pair", "_key", "_own"]
    # Stage 1. Rows of equal id on both sides come first and so get equal slots.
    one = _meet(start, row["k1"], F.row_number().over(Window.partitionBy(*group, "_base").orderBy(F.col("_twin").desc(), "_id"))).where(differing)
    # Stage 2. Slots are dealt so that two rows with a canonical id never meet and as many as possible match.
    w = Window.partitionBy(*group)
    b0, c1 = F.count(F.when(F.col("_base") & ~F.col("_cid"), 1)).over(w), F.count(F.when(~F.col("_base") & F.col("_cid"), 1)).over(w)
    place = F.row_number().over(Window.partitionBy(*group, "_base", "_cid").orderBy(F.col("_twin").desc(), "_id"))
    shift = F.when(F.col("_base") & F.col("_cid"), F.greatest(b0, c1)).when(~F.col("_base") & ~F.col("_cid"), c1).otherwise(F.lit(0))
    two = _meet(one, row["k2"], place + shift).where(differing)
    # Stage 3. An id occurs once a side.
    return _meet(two, row["id"]).where(differing)


def snapshot_changes(snapshots: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(user_id, transform_id, change_kind, node_id): nodes added, removed and changed against the transform before.

    Columns needed: user_id, transform_id, seq_no, id, type, properties, canonical_id, canonical_key, loaded_at;
    others are ignored. A user's first transform gives nothing. NULL type never matches by type; empty tables
    give no rows; repeated rows count once.
    """
    return _kinds(match_stages(unmatched_rows(snapshots, chunk_rows))).select("user_id", "transform_id", "change_kind", "node_id")


def _kinds(matched: DataFrame) -> DataFrame:
    kind = F.when(F.col("b").isNull(), "added").when(F.col("c").isNull(), "removed").otherwise("changed")
    return matched.withColumn("change_kind", kind).withColumn("transform_id", F.col("pair")).withColumn("node_id", F.coalesce("c.id", "b.id"))


def property_changes(snapshots: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row for each property of a changed node: canonical_id, key, old and new value (NULL where absent)."""
    changed = _kinds(match_stages(unmatched_rows(snapshots, chunk_rows, keep_properties=True))).where("change_kind = 'changed'")
    before, after = F.map_from_entries("b.props"), F.map_from_entries("c.props")
    return (
        changed.withColumn("b_map", before)
        .withColumn("c_map", after)
        .withColumn("property_key", F.explode(F.array_union(F.map_keys("b_map"), F.map_keys("c_map"))))
        .withColumn("old_value", F.col("b_map")[F.col("property_key")])
        .withColumn("new_value", F.col("c_map")[F.col("property_key")])
        .where(~F.col("old_value").eqNullSafe(F.col("new_value")))
        .select("user_id", "transform_id", "node_id", F.coalesce("c.cid", "b.cid").alias("canonical_id"), "property_key", "old_value", "new_value")
    )


def diff_summary(snapshots: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Counts of each compared transform: nodes_added, nodes_removed, nodes_changed, nodes_unchanged."""
    kinds = snapshot_changes(snapshots, chunk_rows).groupBy("user_id", "transform_id").agg(*(F.count_if(F.col("change_kind") == k).alias(f"nodes_{k}") for k in ("added", "removed", "changed")))
    sizes = snapshots.where("user_id is not null and transform_id is not null and seq_no is not null and id is not null").select("user_id", "transform_id", "id").distinct().groupBy("user_id", "transform_id").agg(F.count(F.lit(1)).alias("n"))
    compared = transform_pairs(snapshots).where("before is not null").select("user_id", "transform_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = compared.join(sizes, ["user_id", "transform_id"]).join(kinds, ["user_id", "transform_id"], "left").select("user_id", "transform_id", "n", zero("nodes_added"), zero("nodes_removed"), zero("nodes_changed"))
    return out.withColumn("nodes_unchanged", F.col("n") - F.col("nodes_added") - F.col("nodes_changed")).drop("n")
