"""Entity resolution from plan to merged graph: blocking and comparison rules of an ontology, candidate pairs, layered grouping,
merged nodes and rewired edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import filled
from weftgraph.operators.graph import repointed
from weftgraph.operators.resolution import closure, method_keys
from weftgraph.plans.skew import salted_join

# Declared types and the kind of data they hold; others are strings.
KINDS = {"text": "text", "int": "integer", "integer": "integer", "number": "number", "float": "number", "date": "date", "datetime": "date", "email": "identifier", "url": "identifier", "phone": "phone", "id": "identifier", "identifier": "identifier", "code": "identifier"}
# The blocking method of each kind and its options.
METHODS: dict[str, tuple[str, dict[str, int]]] = {
    "identifier": ("exact", {}), "integer": ("exact", {}), "number": ("numeric_bucket", {"width": 10}), "date": ("date_bucket", {"days": 30}), "string": ("first_n_chars", {"n": 4}), "text": ("lsh", {"hashes": 100, "bands": 20}), "phone": ("suffix", {"n": 4}),
}
#: Blocking rules of one type at most, and how many a type without any declared ones gets.
MOST_RULES, DEFAULT_RULES, HIGH_WEIGHT = 5, 3, 1.5


@dataclass(frozen=True)
class BlockingRule:
    prop: str
    method: str
    options: dict[str, int] = field(default_factory=dict)

    def sql(self) -> str:
        """The condition on two rows l and r that the rule stands for."""
        if self.method == "first_n_chars":
            return f"substr(l.{self.prop}, 1, {self.options['n']}) = substr(r.{self.prop}, 1, {self.options['n']})"
        if self.method == "phonetic":
            return f"soundex(l.{self.prop}) = soundex(r.{self.prop})"
        return f"l.{self.prop} = r.{self.prop}"

    def key(self, value: Column) -> Column:
        return F.soundex(value) if self.method == "phonetic" else method_keys(value, self.method, **self.options)


def kind_of(declared: Mapping[str, Any]) -> str:
    return KINDS.get(str(declared.get("type", "string")).lower(), "string")


def blocking_rules(properties: Mapping[str, Mapping[str, Any]], most: int = MOST_RULES) -> list[BlockingRule]:
    """The blocking rules of a type: declared keys, then identifiers, then heavy properties; without any of these the first
    properties that are no long text."""
    of_kind = lambda p: BlockingRule(p, *METHODS[kind_of(properties[p] or {})])
    flagged = lambda flag: [p for p, d in properties.items() if (d or {}).get(flag)]
    weight = lambda p: float((properties[p] or {}).get("matching_weight", 1.0))
    ranked = [of_kind(p) for p in flagged("is_blocking_key")] + [BlockingRule(p, "exact") for p in flagged("is_identifier")]
    ranked += [of_kind(p) for p in sorted((p for p in properties if weight(p) >= HIGH_WEIGHT), key=weight, reverse=True)]
    out: dict[str, BlockingRule] = {}
    for rule in ranked:
        if len(out) < most:
            out.setdefault(rule.prop, rule)
    return list(out.values()) or [of_kind(p) for p in properties if kind_of(properties[p] or {}) != "text"][:DEFAULT_RULES]


def linkage_columns(properties: Mapping[str, Mapping[str, Any]]) -> list[str]:
    """The properties that link rows by equality: all unique ones, two indexed ones, two strings; two of any if there are fewer."""
    of = lambda test: [p for p, d in properties.items() if test(d or {})]
    unique = of(lambda d: d.get("unique"))
    index = of(lambda d: d.get("index") and not d.get("unique"))
    text = of(lambda d: kind_of(d) == "string" and not d.get("unique") and not d.get("index") and "type" in d)
    out = [*unique, *index[:2], *text[:2]]
    rest = [p for p in properties if p not in out]
    return out if len(out) >= 2 else [*out, *rest[: 2 - len(out)]]


@dataclass(frozen=True)
class ComparisonRule:
    """How two values of a property are compared: thresholds from best to worst, m and u by level."""

    prop: str
    method: str
    thresholds: tuple[float, ...]
    weight: float
    m: tuple[float, ...]
    u: tuple[float, ...]


# The chances of each level of agreement among matches (m) and among others (u), by kind of data.
PRIORS: dict[str, tuple[tuple[float, ...], tuple[float, ...]]] = {
    "identifier": ((0.97, 0.03), (0.02, 0.98)),
    "email": ((0.95, 0.05), (0.03, 0.97)),
    "number": ((0.90, 0.10), (0.05, 0.95)),
    "integer": ((0.90, 0.10), (0.05, 0.95)),
    "float": ((0.85, 0.15), (0.10, 0.90)),
    "date": ((0.90, 0.10), (0.05, 0.95)),
    "datetime": ((0.90, 0.10), (0.05, 0.95)),
    "string": ((0.85, 0.10, 0.04, 0.01), (0.05, 0.10, 0.15, 0.70)),
    "text": ((0.80, 0.12, 0.05, 0.03), (0.10, 0.15, 0.20, 0.55)),
    "url": ((0.92, 0.08), (0.08, 0.92)),
    "phone": ((0.93, 0.07), (0.07, 0.93)),
    "boolean": ((0.99, 0.01), (0.50, 0.50)),
    "list": ((0.80, 0.15, 0.05), (0.20, 0.30, 0.50)),
}
UNKNOWN_PRIOR = ((0.82, 0.18), (0.12, 0.88))
# Thresholds of graded comparisons, and the comparison of each kind that is graded.
GRADES = (0.95, 0.85, 0.70)
GRADED = {"string": "jaro_winkler", "text": "cosine"}


def two_levels(levels: tuple[float, ...]) -> tuple[float, ...]:
    """Agreement or not: all levels below the first as one."""
    return (levels[0], sum(levels[1:]))


def comparison_rules(properties: Mapping[str, Mapping[str, Any]]) -> list[ComparisonRule]:
    """One comparison for each property, heaviest first: graded for strings and texts, exact for all else; an identifier's
    chances override its kind's."""
    out = []
    for p, d in properties.items():
        d = d or {}
        declared = str(d.get("type", "string")).lower()
        kind = declared if declared in PRIORS else kind_of(d)
        graded = kind in GRADED and not d.get("is_identifier")
        m, u = PRIORS["identifier"] if d.get("is_identifier") else PRIORS.get(kind, UNKNOWN_PRIOR)
        weight = float(d.get("matching_weight", 1.0))
        out.append(ComparisonRule(p, GRADED[kind], GRADES, weight, m, u) if graded else ComparisonRule(p, "exact", (1.0,), weight, two_levels(m), two_levels(u)))
    return sorted(out, key=lambda r: -r.weight)


def rule_groups(nodes: DataFrame, rules: Sequence[BlockingRule], within: Sequence[str] = ()) -> DataFrame:
    """(*within, rule, value, n, head): the blocks of each rule with two nodes or more, and their smallest id. Blocks, not
    pairs: a hot value is one row. nodes: id, properties."""
    values = F.array(*(rule.key(F.col("properties")[rule.prop]) for rule in rules))
    keyed = nodes.select(*within, "id", F.posexplode(values).alias("rule", "value")).where("value is not null and value <> ''")
    sizes = keyed.groupBy(*within, "rule", "value").agg(F.count_distinct("id").alias("n"), F.min("id").alias("head"))
    return sizes.where("n > 1")


def banded_links(bands: DataFrame) -> DataFrame:
    """(a, b): each id with the smallest id of every bucket that it shares: the links that hold a bucket together, one a
    member, whatever its size. Two ids share a bucket if both are linked with its head or one is the head."""
    heads = bands.groupBy("band").agg(F.min("id").alias("a"), F.count_distinct("id").alias("n")).where("n > 1").drop("n")
    return salted_join(bands, heads, ["band"], "inner", F.col("id")).where("a <> id").select("a", F.col("id").alias("b")).distinct()


def bucket_pairs(bands: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id): the candidates of a stated query set: all ids that share a bucket with a query."""
    asked = bands.join(queries.select("id"), "id", "left_semi").select(F.col("id").alias("query_id"), "band")
    return salted_join(bands, asked, ["band"], "inner", F.col("id")).where("query_id <> id").select("query_id", "id").distinct()


def deduplicated(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, n_members): one row a representative; nodes without one stand for themselves."""
    named = nodes.select("id").distinct().join(mapping, "id", "left")
    return named.groupBy(F.coalesce("representative", "id").alias("id")).agg(F.count(F.lit(1)).alias("n_members"))


def signature_links(nodes: DataFrame, unique: Sequence[str] = (), within: Sequence[str] = ("user_id", "type_")) -> DataFrame:
    """(a, b): nodes of one user and type tied by an equal canonical id, canonical key, or value of a unique property, each with
    the smallest id that has it."""
    value = lambda tag, c: F.when(filled(c).isNotNull(), F.concat(F.lit(tag), F.lower(F.trim(c))))
    signatures = F.array_compact(F.array(value("i:", F.col("canonical_id")), value("k:", F.col("canonical_key")), *(value(f"u:{p}=", F.col("properties")[p]) for p in unique)))
    keyed = nodes.select(*within, "id", F.explode(signatures).alias("signature")).distinct()
    heads = keyed.groupBy(*within, "signature").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head <> last").drop("last")
    return salted_join(keyed, heads, [*within, "signature"], "inner", F.col("id")).where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()


def layered(nodes: DataFrame, layers: Sequence[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(mapping, decisions): layers of links (name, (a, b)) applied in order, each only to what the layers before left apart.

    mapping: (id, representative) of each id in a group; decisions: (representative, layer, n_members), one a group and layer that
    formed or grew it. A layer sees the groups of the layers before as one.
    """
    mapping: DataFrame | None = None
    decisions: DataFrame | None = None
    for name, links in layers:
        own = links.select("a", "b")
        if mapping is not None:
            rep = lambda c: mapping.select(F.col("id").alias(c), F.col("representative").alias(f"_{c}"))  # noqa: B023, E731
            own = own.join(rep("a"), "a", "left").join(rep("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        grown = closure(own)
        if mapping is None:
            mapping = grown
        else:
            moved = mapping.join(grown.select(F.col("id").alias("representative"), F.col("representative").alias("_to")), "representative", "left").select("id", F.coalesce("_to", "representative").alias("representative"))
            new = grown.join(mapping.select("id"), "id", "left_anti")
            mapping = moved.unionByName(new)
        counts = grown.groupBy("representative").agg(F.count(F.lit(1)).alias("n_members")).select("representative", F.lit(name).alias("layer"), "n_members")
        decisions = counts if decisions is None else decisions.unionByName(counts)
    if mapping is None or decisions is None:
        raise ValueError("at least one layer is needed")
    return mapping, decisions


def resolved_graph(nodes: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): of each group its representative, and edges between representatives without loops and repeats."""
    kept = nodes.join(mapping.where("id <> representative").select("id"), "id", "left_anti")
    moved = repointed(edges, mapping)
    return kept, moved.groupBy("from_", "to_", "relationship").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_merged"))


def disputed(groups: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(group, a, b): candidate groups of exactly two that the verdict left apart. groups: (group, id); verdicts: (id, representative)."""
    sizes = groups.groupBy("group").agg(F.count_distinct("id").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("n = 2")
    rep = lambda c: verdicts.select(F.col("id").alias(c), F.col("representative").alias(f"_{c}"))
    met = sizes.join(rep("a"), "a", "left").join(rep("b"), "b", "left")
    return met.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("group", "a", "b")


def production_merge(production: DataFrame, staging: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(id, key, value, version): production nodes after a merge. Staging's filled values of the keys override; of a node
    that changes, the state before stays as version 'previous'. One row an id a side."""
    each = F.explode(F.array(*(F.lit(k) for k in keys)))
    flat = lambda df, name: df.select("id", "properties", each.alias("key")).select("id", "key", filled(F.element_at("properties", F.col("key"))).alias(name))
    both = flat(production, "old").join(flat(staging, "new"), ["id", "key"], "left")
    changed = both.groupBy("id").agg(F.bool_or(F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))).alias("changed"))
    joined = both.join(changed, "id")
    now = joined.select("id", "key", F.coalesce("new", "old").alias("value"), F.lit("current").alias("version"))
    before = joined.where("changed").select("id", "key", F.col("old").alias("value"), F.lit("previous").alias("version"))
    return now.unionByName(before).where("value is not null")


def gaps_by_chunk(gaps: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk, gap_id): gaps at their chunk; a gap without one concerns every chunk of its transform."""
    placed = gaps.where("chunk is not null").select("transform_id", "chunk", "gap_id")
    spread = gaps.where("chunk is null").select("transform_id", "gap_id").join(chunks.select("transform_id", "chunk").distinct(), "transform_id").select("transform_id", "chunk", "gap_id")
    return placed.unionByName(spread).distinct()
