"""Queries of the core library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.operators import references, snapshot_diff
from weftgraph.registry import ORACLE, QUERIES, query
from weftgraph.sources import table

_SNAPSHOT_CTE = """
with copies as (select *, row_number() over (partition by user_id, transform_id, id order by loaded_at desc) as rn from node_snapshots
  where user_id is not null and transform_id is not null and seq_no is not null and id is not null),
rows as (select user_id, transform_id, id, type, seq_no,
  coalesce(case when trim(canonical_id) <> '' then canonical_id end, case when trim(properties['canonical_id']) <> '' then properties['canonical_id'] end) as cid,
  coalesce(case when trim(canonical_key) <> '' then canonical_key end, case when trim(properties['canonical_key']) <> '' then properties['canonical_key'] end) as ck,
  list_sort(list_filter(map_entries(properties), lambda e: e.value is not null and e.key not in (%s))) as props
  from copies where rn = 1),
pairs as (select user_id, transform_id as pair, lag(transform_id) over (partition by user_id order by seq_no, transform_id) as before
  from (select distinct user_id, transform_id, seq_no from rows)),
b as (select p.pair, r.* from pairs p join rows r on r.user_id = p.user_id and r.transform_id = p.before),
c as (select p.pair, r.* from pairs p join rows r on r.user_id = p.user_id and r.transform_id = p.pair where p.before is not null),
m1 as (select c.user_id, c.pair, b.id as bid, c.id as nid, b.props <> c.props as differs from b join c on b.user_id = c.user_id and b.pair = c.pair and b.type = c.type and b.cid = c.cid),
m2 as (select c.user_id, c.pair, b.id as bid, c.id as nid, b.props <> c.props as differs from b join c on b.user_id = c.user_id and b.pair = c.pair and b.type = c.type and b.ck = c.ck
  and (b.cid is null or c.cid is null)
  where not exists (select 1 from m1 where m1.pair = b.pair and m1.bid = b.id) and not exists (select 1 from m1 where m1.pair = c.pair and m1.nid = c.id)),
m12 as (select * from m1 union all select * from m2),
m3 as (select c.user_id, c.pair, b.id as bid, c.id as nid, b.props <> c.props as differs from b join c on b.user_id = c.user_id and b.pair = c.pair and b.id = c.id
  where not exists (select 1 from m12 where m12.pair = b.pair and m12.bid = b.id) and not exists (select 1 from m12 where m12.pair = c.pair and m12.nid = c.id)),
m as (select * from m12 union all select * from m3),
kinds as (select user_id, pair as transform_id, 'changed' as change_kind, nid as node_id from m where differs
  union all select user_id, pair, 'added', id from c where not exists (select 1 from m where m.pair = c.pair and m.nid = c.id)
  union all select user_id, pair, 'removed', id from b where not exists (select 1 from m where m.pair = b.pair and m.bid = b.id))
""" % ", ".join(f"'{k}'" for k in snapshot_diff.BOOKKEEPING_KEYS)


@query("p1_found", _SNAPSHOT_CTE + "select distinct transform_id, change_kind, node_id from kinds")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_diff.snapshot_changes(table(spark, sf_dir, "node_snapshots")).select("transform_id", "change_kind", "node_id").distinct()


@query(
    "p1_summary",
    _SNAPSHOT_CTE
    + """select c.user_id, c.pair as transform_id, coalesce(k.a, 0) as nodes_added, coalesce(k.r, 0) as nodes_removed, coalesce(k.ch, 0) as nodes_changed, c.n - coalesce(k.a, 0) - coalesce(k.ch, 0) as nodes_unchanged
from (select user_id, pair, count(*) as n from c group by all) c left join (select user_id, transform_id, count(*) filter (change_kind = 'added') as a, count(*) filter (change_kind = 'removed') as r,
count(*) filter (change_kind = 'changed') as ch from kinds group by all) k on k.user_id = c.user_id and k.transform_id = c.pair""",
)
def p1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_diff.diff_summary(table(spark, sf_dir, "node_snapshots"))


@query(
    "p1_property_changes",
    _SNAPSHOT_CTE
    + """, ch as (select m.user_id, m.pair, m.nid, coalesce(c.cid, b.cid) as cid, b.props as old, c.props as new from m join b on b.user_id = m.user_id and b.pair = m.pair and b.id = m.bid join c on c.user_id = m.user_id and c.pair = m.pair and c.id = m.nid where m.differs),
pk as (select *, unnest(list_distinct(list_concat(list_transform(old, lambda e: e.key), list_transform(new, lambda e: e.key)))) as property_key from ch),
v as (select *, list_filter(old, lambda e: e.key = property_key)[1].value as old_value, list_filter(new, lambda e: e.key = property_key)[1].value as new_value from pk)
select user_id, pair as transform_id, nid as node_id, cid as canonical_id, property_key, old_value, new_value from v where old_value is distinct from new_value""",
)
def p1_property_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_diff.property_changes(table(spark, sf_dir, "node_snapshots"))


_ORPHAN_CTE = """
with refs as (
  select 'graph_edges' as table_name, 'from_' as field_name, id as record_id, lower(trim(from_)) as ref, created_at from graph_edges
  union all select 'graph_edges', 'to_', id, lower(trim(to_)), created_at from graph_edges
  union all select 'claims', 'target_id', id, lower(trim(target_id)), created_at from claims where target_kind = 'node'),
versions as (select lower(trim(id)) as id, valid_from, valid_to from graph_nodes union select lower(trim(id)), valid_from, valid_to from production_nodes),
firsts as (select id, min(valid_from) as first_from from versions group by id),
cases as (select distinct r.table_name, r.field_name, r.record_id, strftime(r.created_at, '%Y-%m') as ref_month,
  case when f.id is null then 'missing' when f.first_from > r.created_at then 'late' else 'deleted' end as reason
  from refs r left join firsts f on f.id = r.ref
  where r.ref <> '' and (r.created_at is not null or f.id is null) and not exists (select 1 from versions v where v.id = r.ref and v.valid_from <= r.created_at and (v.valid_to is null or r.created_at < v.valid_to)))
"""


@query("p4_found", _ORPHAN_CTE + "select * from cases")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.graph_orphans(*(table(spark, sf_dir, t) for t in ("graph_edges", "claims", "graph_nodes", "production_nodes")))


@query("p4_report", _ORPHAN_CTE + "select table_name, field_name, ref_month, reason, count(*) as n_references from cases group by all")
def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_report(*(table(spark, sf_dir, t) for t in ("graph_edges", "claims", "graph_nodes", "production_nodes")))


def _typed_orphans_sql(match: str) -> str:
    refers = "u is not null and k is not null and ref is not null" if match == "simple" else "(u is not null or k is not null or ref is not null)"
    agrees = "v.u = r.u and v.k = r.k and v.id = r.ref" if match != "partial" else "(r.u is null or v.u = r.u) and (r.k is null or v.k = r.k) and (r.ref is null or v.id = r.ref)"
    partial = "when r.u is null or r.k is null or r.ref is null then 'partial_key'" if match == "full" else ""
    return f"""with r as (select row_number() over () as n, * from (
  select 'from_' as field_name, id as record_id, user_id as u, nullif(trim(source_type), '') as k, nullif(lower(trim(from_)), '') as ref, created_at as at from graph_edges
  union select 'to_', id, user_id, nullif(trim(target_type), ''), nullif(lower(trim(to_)), ''), created_at from graph_edges) where {refers}),
v as (select distinct user_id as u, nullif(trim(type_), '') as k, nullif(lower(trim(id)), '') as id, valid_from as f, valid_to as t from graph_nodes),
m as (select r.n, min(v.f) as first_from, coalesce(bool_or(v.f <= r.at and (v.t is null or r.at < v.t)), false) as covered from r join v on {agrees} group by r.n)
select distinct field_name, record_id, concat_ws(',', case when r.u is null then 'user_id' end, case when r.k is null then 'kind' end, case when r.ref is null then 'ref' end) as null_mask,
  case {partial} when m.n is null then 'missing' when m.first_from > r.at then 'late' else 'deleted' end as reason
from r left join m on m.n = r.n where not coalesce(m.covered, false) and (r.at is not null or m.n is null)"""


def _typed_orphans(match: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return references.typed_orphans(table(spark, sf_dir, "graph_edges"), table(spark, sf_dir, "graph_nodes"), match)

    return run


for _match in references.MATCHES:
    query(f"p4_{_match}", _typed_orphans_sql(_match))(_typed_orphans(_match))


from weftgraph import queries_cascade, queries_edges, queries_entities, queries_graph, queries_quality, queries_reports, queries_resolution, queries_rules, queries_text  # noqa: E402,F401
