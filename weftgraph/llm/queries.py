"""Queries of the llm operators: name, callable (spark, sf_dir), and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import components, linkage, matching, mixing, packing, text_quality
from weftgraph.plans.lineage import cut
from weftgraph.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


_GROUP_CTE = """
with recursive told as (select least(a, b) as a, greatest(a, b) as b, arg_max(status, struct_pack(x := coalesce(labeled_at, timestamp '0001-01-01'), y := status)) as status
  from (select lower(trim(node_a_id)) as a, lower(trim(node_b_id)) as b, status, labeled_at from disputed_pairs where status in ('labeled_match', 'labeled_not_match'))
  where a <> b group by 1, 2),
keyed as (select distinct user_id, type, properties['canonical_id'] as cid, id from expected_nodes where id is not null and user_id is not null and type is not null and trim(properties['canonical_id']) <> ''),
ties as (select a, b from told where status = 'labeled_match' and a in (select id from expected_nodes) and b in (select id from expected_nodes)
  union select min(id) over (partition by user_id, type, cid), id from keyed),
edges as (select a, b from ties where a <> b union select b, a from ties where a <> b),
reach as (select distinct a as v, a as r from edges union select e.b, x.r from reach x join edges e on e.a = x.v where x.r < e.b),
groups as (select v as node_id, min(r) as group_id from reach group by v)
"""


@query("p3_found", _GROUP_CTE + "select node_id, group_id from groups")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.record_groups(table(spark, sf_dir, "expected_nodes"), table(spark, sf_dir, "disputed_pairs"))


@query("p3_group_sizes", _GROUP_CTE + "select group_id, count(*) as n_members from groups group by group_id")
def p3_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.group_sizes(p3_found(spark, sf_dir))


@query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.graph_canonical_values(*(table(spark, sf_dir, t) for t in ("graph_nodes", "graph_edges", "entity_types", "rel_types")))


@query("p2_unmatched")
def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_nodes = matching.unmatched_report(table(spark, sf_dir, "graph_nodes"), "type_", table(spark, sf_dir, "entity_types"), "entity_type", "node")
    of_edges = matching.unmatched_report(table(spark, sf_dir, "graph_edges"), "relationship", table(spark, sf_dir, "rel_types"), "rel_type", "edge", verbs=True)
    return of_nodes.unionByName(of_edges)


def _candidates_sql(kind: str, records: str, column: str, reference: str, entry: str) -> str:
    plain = lambda c: f"lower(regexp_replace({c}, '[^A-Za-z0-9]', '', 'g'))"
    return f"""select '{kind}' as record_kind, v.value, p.entry, min(levenshtein(v.value, p.path)) as distance from (select distinct {plain(column)} as value from {records} where {plain(column)} <> '') v,
(select distinct {entry} as entry, {plain("unnest(list_append(coalesce(aliases, []), " + entry + "))")} as path from {reference}) p
where abs(length(v.value) - length(p.path)) <= 3 and levenshtein(v.value, p.path) <= case when length(v.value) <= 3 then 0 when length(v.value) <= 10 then 2 else 3 end group by all"""


@query("p2_candidates", f"{_candidates_sql('node', 'graph_nodes', 'type_', 'entity_types', 'entity_type')} union all {_candidates_sql('edge', 'graph_edges', 'relationship', 'rel_types', 'rel_type')}")
def p2_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_nodes = matching.candidates(table(spark, sf_dir, "graph_nodes"), "type_", table(spark, sf_dir, "entity_types"), "entity_type", "node")
    return of_nodes.unionByName(matching.candidates(table(spark, sf_dir, "graph_edges"), "relationship", table(spark, sf_dir, "rel_types"), "rel_type", "edge"))


@query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality.not_prose(table(spark, sf_dir, "documents"))


@query("p8_statistics")
def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality.statistics_report(table(spark, sf_dir, "documents"))


@query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.same_entity_pairs(table(spark, sf_dir, "expected_nodes"))


@query("p5_entities")
def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.entity_sizes(table(spark, sf_dir, "expected_nodes"))


@query("p5_members")
def p5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.entity_members(table(spark, sf_dir, "expected_nodes"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted once and cut into the shared folder: an id, a source and a number each."""
    return cut(mixing.with_tokens(table(spark, sf_dir, "documents")))


@query("p6_pack")
def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_containers(_tokens(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


_TOKENS_CTE = r"""tok as (select doc_id, nullif(replace(lower(trim(source)), '-', '_'), '') as source, coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]+')), 0) as t from documents where doc_id is not null)"""


@query(
    "p6_coverage",
    f"""with {_TOKENS_CTE} select spec_id, count(*) as n_documents, sum(ceil(t / capacity_tokens)::bigint) as n_pieces, sum(t) as tokens, count(*) filter (t > capacity_tokens) as n_split, 0::bigint as n_overfull, 0::bigint as n_loose
from tok, (select distinct spec_id, capacity_tokens from pack_specs where capacity_tokens > 0) where t > 0 group by spec_id""",
)
def p6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.coverage_report(p6_pack(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


@query("p6_mixture")
def p6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.mixture_report(p6_pack(spark, sf_dir))


@query("p6_report")
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p6_pack(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


@query("p7_mix")
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(_tokens(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


@query(
    "p7_allocation",
    f"""with {_TOKENS_CTE}, m as (select mix_id, nullif(replace(lower(trim(source)), '-', '_'), '') as source, greatest(coalesce(weight, 0), 0) as weight, coalesce(max_repeats, 0) as cap, size_ratio from mix_targets where mix_id is not null),
s as (select m.*, max(coalesce(size_ratio, 0)) over (partition by mix_id) * (select sum(t) from tok) as size, sum(weight) over (partition by mix_id) as whole, cap * coalesce((select sum(t) from tok where tok.source = m.source), 0) as supply from m where source is not null)
select mix_id, source, case when whole > 0 then weight / whole else 0 end::double as target_share, round(least(size * weight / whole, supply), 3)::double as due, supply::double as supply from s""",
)
def p7_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allocation(_tokens(spark, sf_dir), table(spark, sf_dir, "mix_targets")).withColumn("due", F.round("due", 3))


@query("p7_report")
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(p7_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
