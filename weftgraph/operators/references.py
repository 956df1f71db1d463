"""References to records that do not exist, or did not exist at the time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.skew import salted_join


def clean_id(c: Column) -> Column:
    """Ids compare in lower case and without outer spaces; blank counts as NULL."""
    cleaned = F.lower(F.trim(c))
    return F.when(cleaned != "", cleaned)


def _islands(versions: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, f, end, reached, n, is_last): the stretches that overlapping and adjoining versions (f, t) cover together.

    ``end`` is where a stretch ends (NULL: open), ``reached`` where the one before it ended.
    """
    order = Window.partitionBy(*by).orderBy(F.col("f").asc_nulls_first())
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    v = versions.withColumn("reached", F.max("t").over(prior)).withColumn("open", F.coalesce(F.max(F.col("t").isNull()).over(prior), F.lit(False)))
    v = v.withColumn("last", F.when(~F.max(F.col("t").isNull()).over(every), F.max("t").over(every))).withColumn("n", F.row_number().over(order))
    starts = v.where((F.col("n") == 1) | (~F.col("open") & (F.col("f") > F.col("reached"))))
    starts = starts.withColumn("next", F.lead("reached").over(order))
    return starts.select(*by, "f", F.coalesce("next", "last").alias("end"), "reached", "n", F.col("next").isNull().alias("is_last"))


def lifetimes(versions: DataFrame, keys: Sequence[str], valid_from: str, valid_to: str) -> DataFrame:
    """The whole time line of each key, cut where its state changes: (keys, begins, ends, state).

    ``state`` is 'late' before the first version, 'valid' where a version holds (valid_from <= t < valid_to) and
    'deleted' elsewhere. NULL begins and ends are open; NULL valid_from has held always, NULL valid_to still does.
    Overlapping, adjoining and repeated versions melt into one segment, first within a key's quarters of a year and then across
    them, so that the versions of a hot key are sorted in many tasks and what is left of them is few.
    """
    kind = versions.schema[valid_from].dataType
    never = F.lit(None).cast(kind)
    v = versions.select(*keys, F.col(valid_from).alias("f"), F.when(F.col(valid_to) < F.col(valid_from), F.col(valid_from)).otherwise(F.col(valid_to)).alias("t"))
    quarter = F.date_trunc("quarter", "f") if kind.typeName() in ("timestamp", "timestamp_ntz", "date") else F.lit(0)
    melted = _islands(v.withColumn("_quarter", quarter), [*keys, "_quarter"]).select(*keys, "f", F.col("end").alias("t"))
    segment = lambda state, begins, ends, when: F.when(when, F.struct(F.lit(state).alias("state"), begins.alias("begins"), ends.alias("ends")))
    f = F.col("f")
    segments = F.array_compact(
        F.array(
            segment("late", never, f, (F.col("n") == 1) & f.isNotNull()),
            segment("deleted", F.col("reached"), f, F.col("n") > 1),
            segment("valid", f, F.col("end"), F.lit(True)),
            segment("deleted", F.col("end"), never, F.col("is_last") & F.col("end").isNotNull()),
        )
    )
    return _islands(melted, keys).select(*keys, F.explode(segments).alias("s")).select(*keys, "s.*")


MATCHES = ("simple", "full", "partial")


def orphan_references(
    references: DataFrame,
    reference_columns: Sequence[str],
    targets: DataFrame,
    target_columns: Sequence[str],
    match: str = "simple",
    at: str | None = None,
    valid_from: str | None = None,
    valid_to: str | None = None,
) -> DataFrame:
    """References, with a ``reason``, whose (composite) key no target has, or had at the time ``at``.

    References are grouped by their null mask: which of their columns are NULL. The mask is part of the key they are joined by,
    together with the columns that are not NULL; targets are offered once for each mask that the semantics let match. One
    scan of either side and one anti-join serve all masks.

    match 'simple': a key with any NULL refers to nothing. 'full': all NULL refers to nothing, some NULL is the
    orphan 'partial_key'. 'partial': the columns that are not NULL must agree with some target; all NULL refers to
    nothing. reason: 'missing' (no such target), and with validity 'late' (every version begins after ``at``) or
    'deleted'. With NULL ``at`` only 'missing' can be told: the others are left out. Repeated rows are kept as they are; an empty
    target table makes every reference 'missing'. Hot keys are salted; a target is offered 2^n - 1 times at most for n columns.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}, not {match!r}")
    columns = [f"`{c}`" for c in reference_columns]
    kinds = [references.select(c).schema[0].dataType for c in columns]
    n, whole = len(columns), (1 << len(columns)) - 1
    mask = sum((F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(columns)), F.lit(0))
    key = lambda m, values: F.struct(m.cast("int").alias("mask"), *(v.alias(f"k{i}") for i, v in enumerate(values)))
    # The caller's columns travel as one, so that none can clash with those used here.
    refs = references.select(F.struct(*(F.col(f"`{c}`") for c in references.columns)).alias("_row"), key(mask, [F.col(c) for c in columns]).alias("_key"), *([F.col(at).alias("_at")] if at else []))
    refers = {"simple": F.col("_key.mask") == 0, "full": F.col("_key.mask") < whole, "partial": F.col("_key.mask") < whole}[match]
    offered = range(whole) if match == "partial" else [0]
    own = [F.col(f"`{t}`").cast(k) for t, k in zip(target_columns, kinds)]
    # A target with a NULL column can't answer a mask that needs that column.
    answers = F.array(*(F.when(_all_filled([v for i, v in enumerate(own) if not m >> i & 1]), key(F.lit(m), [F.lit(None).cast(kinds[i]) if m >> i & 1 else v for i, v in enumerate(own)])) for m in offered))
    there = targets.select(F.explode(F.array_compact(answers)).alias("_key"), *([F.col(valid_from).alias("_f"), F.col(valid_to).alias("_t")] if at else []))
    salt_of = F.to_json("_row") if "map<" in dict(refs.dtypes)["_row"] else F.col("_row")
    if at:
        line = lifetimes(there, ["_key"], "_f", "_t").withColumnsRenamed({"state": "_state", "begins": "_begins", "ends": "_ends"})
        when = F.col("_at")
        # A known key is in exactly one segment of its time line, so that the join repeats no reference; without a time, in its first.
        during = (F.col("_begins").isNull() & when.isNull()) | ((F.col("_begins").isNull() | (F.col("_begins") <= when)) & (F.col("_ends").isNull() | (when < F.col("_ends"))))
        placed = salted_join(refs.where(refers), line, ["_key"], "left", salt_of, during)
        placed = placed.where(F.col("_state").isNull() | (when.isNotNull() & (F.col("_state") != "valid")))
    else:
        placed = salted_join(refs.where(refers), there.distinct().withColumn("_state", F.lit("valid")), ["_key"], "left", salt_of).where("_state is null")
    reason = F.when((F.col("_key.mask") > 0) & F.lit(match == "full"), "partial_key").otherwise(F.coalesce("_state", F.lit("missing")))
    kept = [F.col("_row")[c].alias(c) for c in references.columns if c != "reason"]
    return placed.withColumn("_reason", reason).select(*kept, F.col("_reason").alias("reason"))


def _all_filled(columns: Sequence[Column]) -> Column:
    filled = F.lit(True)
    for c in columns:
        filled = filled & c.isNotNull()
    return filled


def graph_references(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """The references to nodes of graph_edges and claims: table_name, field_name, record_id, ref (NULL where blank), created_at."""
    ends = F.explode(F.array(F.struct(F.lit("from_").alias("field_name"), clean_id(F.col("from_")).alias("ref")), F.struct(F.lit("to_").alias("field_name"), clean_id(F.col("to_")).alias("ref"))))
    of_edges = edges.select(F.lit("graph_edges").alias("table_name"), F.col("id").alias("record_id"), "created_at", ends.alias("e")).select("table_name", "e.field_name", "record_id", "e.ref", "created_at")
    of_claims = claims.where(F.col("target_kind") == "node").select(F.lit("claims").alias("table_name"), F.lit("target_id").alias("field_name"), F.col("id").alias("record_id"), clean_id(F.col("target_id")).alias("ref"), "created_at")
    return of_edges.unionByName(of_claims)


def node_versions(graph_nodes: DataFrame, production_nodes: DataFrame) -> DataFrame:
    one = lambda df: df.select(clean_id(F.col("id")).alias("node_id"), "valid_from", "valid_to")
    return one(graph_nodes).unionByName(one(production_nodes))


def graph_orphans(edges: DataFrame, claims: DataFrame, graph_nodes: DataFrame, production_nodes: DataFrame) -> DataFrame:
    """(table_name, field_name, record_id, ref_month, reason), each case once."""
    found = orphan_references(graph_references(edges, claims), ["ref"], node_versions(graph_nodes, production_nodes), ["node_id"], "simple", "created_at", "valid_from", "valid_to")
    return found.select("table_name", "field_name", "record_id", F.date_format("created_at", "yyyy-MM").alias("ref_month"), "reason").distinct()


def orphan_report(edges: DataFrame, claims: DataFrame, graph_nodes: DataFrame, production_nodes: DataFrame) -> DataFrame:
    """Number of orphan references by table, field, month and reason."""
    return graph_orphans(edges, claims, graph_nodes, production_nodes).groupBy("table_name", "field_name", "ref_month", "reason").agg(F.count(F.lit(1)).alias("n_references"))


def typed_orphans(edges: DataFrame, graph_nodes: DataFrame, match: str) -> DataFrame:
    """(field_name, record_id, null_mask, reason): ends of edges, as (user_id, type of the end, id), that name no node of that
    user, type and id at the edge's time, under the match semantics given. null_mask names the columns that are NULL."""
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    end = lambda field, kind: F.struct(F.lit(field).alias("field_name"), filled(F.col(kind)).alias("kind"), clean_id(F.col(field)).alias("ref"))
    refs = edges.select(F.col("id").alias("record_id"), "user_id", "created_at", F.explode(F.array(end("from_", "source_type"), end("to_", "target_type"))).alias("e")).select("record_id", "user_id", "created_at", "e.*")
    nodes = graph_nodes.select("user_id", filled(F.col("type_")).alias("kind"), clean_id(F.col("id")).alias("node_id"), "valid_from", "valid_to")
    found = orphan_references(refs, ["user_id", "kind", "ref"], nodes, ["user_id", "kind", "node_id"], match, "created_at", "valid_from", "valid_to")
    mask = F.concat_ws(",", *(F.when(F.col(c).isNull(), c) for c in ("user_id", "kind", "ref")))
    return found.select("field_name", "record_id", mask.alias("null_mask"), "reason").distinct()
