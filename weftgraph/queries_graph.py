"""Queries on the graph itself: projections, filters, joins, versions, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import identity, text
from weftgraph.operators import claims as claim_ops
from weftgraph.operators import graph, versioning
from weftgraph.operators.snapshot_diff import BOOKKEEPING_KEYS, transform_pairs
from weftgraph.registry import query
from weftgraph.sources import table

# Fixed values of the queries: the ontology properties that they use.
ONTOLOGY_KEYS = ("name", "city", "status", "year", "ceo", "publisher")
SYSTEM = ", ".join(f"'{k}'" for k in BOOKKEEPING_KEYS)
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
ACTIVE_NODES = """active_nodes as (select * from (select *, row_number() over (partition by id order by valid_from desc nulls last, loaded_at desc nulls last) as _n from graph_nodes where valid_to is null) where _n = 1)"""
LATEST_EDGES = """latest_edges as (select * from (select *, row_number() over (partition by id order by loaded_at desc nulls last) as _n from graph_edges) where _n = 1)"""


def nodes_edges(spark: SparkSession, d: str) -> graph.PropertyGraph:
    return graph.PropertyGraph(table(spark, d, "graph_nodes"), table(spark, d, "graph_edges"))


@query("prj_whitespace_key", r"select id, lower(trim(regexp_replace(properties['name'], '\s+', ' ', 'g'))) as name_key from expected_nodes where properties['name'] is not null")
def prj_whitespace_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "expected_nodes").where(F.col("properties")["name"].isNotNull()).select("id", F.lower(text.collapse(F.col("properties")["name"])).alias("name_key"))


@query(
    "prj_company_key",
    r"""select id, regexp_replace(trim(regexp_replace(lower(properties['name']), '[^0-9a-z]+', ' ', 'g')), '((^| )(inc|incorporated|corp|corporation|co|company|ltd|limited|llc|plc|gmbh))+$', '') as company_key
from expected_nodes where type = 'Organization' and properties['name'] is not null""",
)
def prj_company_key(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("properties")["name"]
    return table(spark, d, "expected_nodes").where((F.col("type") == "Organization") & name.isNotNull()).select("id", text.company_key(name).alias("company_key"))


@query(
    "prj_canonical_value",
    r"""select id, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(label, '\s+', ' ', 'g'))), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) as canonical
from expected_nodes where label is not null""",
)
def prj_canonical_value(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "expected_nodes").where("label is not null")
    return own.select("id", text.canonical_value(F.col("label"), strip_punctuation=True).alias("canonical"))


@query(
    "prj_canonical_id",
    """with k as (select id, type || ':name=' || lower(trim(properties['name'])) as canonical_key from expected_nodes where trim(properties['name']) <> ''),
h as (select id, canonical_key, sha1(unhex('%s') || encode(canonical_key)) as s from k)
select id, canonical_key, s[1:8] || '-' || s[9:12] || '-5' || s[14:16] || '-' || substr('89ab', ((('0x' || s[17])::int) & 3) + 1, 1) || s[18:20] || '-' || s[21:32] as canonical_id from h"""
    % identity.CANONICAL_NAMESPACE.hex,
)
def prj_canonical_id(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "expected_nodes").where(F.trim(F.col("properties")["name"]) != "")
    key = identity.canonical_key(F.col("type"), F.col("properties"), ["name"])
    return own.select("id", key.alias("canonical_key")).withColumn("canonical_id", identity.canonical_id(F.col("canonical_key")))


@query(
    "prj_node_id",
    """with h as (select distinct id, sha1(unhex('%s') || encode(transform_id || ':' || type || ':' || canonical_key)) as s from node_snapshots where canonical_key is not null)
select id, s[1:8] || '-' || s[9:12] || '-5' || s[14:16] || '-' || substr('89ab', ((('0x' || s[17])::int) & 3) + 1, 1) || s[18:20] || '-' || s[21:32] as node_id from h"""
    % identity.URL_NAMESPACE.hex,
)
def prj_node_id(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "node_snapshots").where(F.col("canonical_key").isNotNull())
    return own.select("id", identity.node_id(F.col("transform_id"), F.col("type"), F.col("canonical_key")).alias("node_id")).distinct()


@query(
    "prj_system_filter",
    f"select id, transform_id, loaded_at, len(list_filter(map_entries(properties), lambda e: e.value is not null and e.key not in ({SYSTEM}))) as n_properties from node_snapshots",
)
def prj_system_filter(spark: SparkSession, d: str) -> DataFrame:
    keys = F.array(*(F.lit(k) for k in BOOKKEEPING_KEYS))
    kept = F.map_filter("properties", lambda k, v: v.isNotNull() & ~F.array_contains(keys, k))
    return table(spark, d, "node_snapshots").select("id", "transform_id", "loaded_at", F.size(kept).cast("bigint").alias("n_properties"))


@query(
    "prj_entity_normalise",
    r"""select id, transform_id, loaded_at, trim(properties['name']) as name, try_cast(trim(properties['year']) as bigint) as year from node_snapshots
where trim(properties['name']) <> '' and (properties['year'] is null or try_cast(trim(properties['year']) as bigint) is not null)""",
)
def prj_entity_normalise(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("properties")
    year = F.trim(p["year"]).try_cast("bigint")
    return table(spark, d, "node_snapshots").where((F.trim(p["name"]) != "") & (p["year"].isNull() | year.isNotNull())).select("id", "transform_id", "loaded_at", F.trim(p["name"]).alias("name"), year.alias("year"))


@query(
    "prj_type_coercion",
    r"""with v as (select id, trim(value, '"') as v from claims where value is not null)
select id, try_cast(v as bigint) as as_int, try_cast(v as double) as as_float, case when lower(v) in ('true', '1', 'yes') then true when lower(v) in ('false', '0', 'no') then false end as as_bool,
len(list_filter(string_split(v, ','), lambda x: trim(x) <> '')) as n_items from v""",
)
def prj_type_coercion(spark: SparkSession, d: str) -> DataFrame:
    v = F.regexp_replace("value", '^"+|"+$', "")
    low = F.lower("v")
    boolean = F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)
    own = table(spark, d, "claims").where("value is not null").select("id", v.alias("v"))
    whole = F.when(F.col("v").rlike(r"^\s*[+-]?\d+\s*$"), F.col("v").try_cast("bigint"))
    return own.select("id", whole.alias("as_int"), F.col("v").try_cast("double").alias("as_float"), boolean.alias("as_bool"), F.size(F.filter(F.split("v", ","), lambda x: F.trim(x) != "")).cast("bigint").alias("n_items"))


@query(
    "prj_diff_key",
    "select distinct id, case when canonical_id <> '' then type || ':' || canonical_id when canonical_key <> '' then type || ':' || canonical_key else '__local__:' || id end as diff_key from node_snapshots",
)
def prj_diff_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "node_snapshots").select("id", identity.diff_key(F.col("type"), F.col("canonical_id"), F.col("canonical_key"), F.col("id")).alias("diff_key")).distinct()


@query("prj_latency", "select id, created_at, loaded_at, ((epoch_us(loaded_at) - epoch_us(created_at)) // 1000)::bigint as latency_ms from claims where created_at is not null and loaded_at is not null")
def prj_latency(spark: SparkSession, d: str) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return table(spark, d, "claims").where("created_at is not null and loaded_at is not null").select("id", "created_at", "loaded_at", F.floor((us("loaded_at") - us("created_at")) / 1000).cast("bigint").alias("latency_ms"))


@query(
    "prj_embedding_text",
    f"""select id, valid_from, loaded_at, array_to_string(list_transform(list_filter(list_sort(map_entries(properties)), lambda e: e.value is not null and len(e.value) > 1 and e.key not in ({SYSTEM}))[1:5], lambda e: e.value), ' | ') as text from graph_nodes""",
)
def prj_embedding_text(spark: SparkSession, d: str) -> DataFrame:
    keys = F.array(*(F.lit(k) for k in BOOKKEEPING_KEYS))
    kept = F.filter(F.array_sort(F.map_entries("properties")), lambda e: e["value"].isNotNull() & (F.length(e["value"]) > 1) & ~F.array_contains(keys, e["key"]))
    return table(spark, d, "graph_nodes").select("id", "valid_from", "loaded_at", F.array_join(F.transform(F.slice(kept, 1, 5), lambda e: e["value"]), " | ").alias("text"))


@query("prj_typed_view", "select distinct id, transform_id, properties['name'] as name, properties['city'] as city, properties['status'] as status, lower(trim(properties['name'])) as canonical__name from node_snapshots where type = 'Person'")
def prj_typed_view(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("properties")
    return table(spark, d, "node_snapshots").where("type = 'Person'").select("id", "transform_id", *(p[k].alias(k) for k in ("name", "city", "status")), F.lower(F.trim(p["name"])).alias("canonical__name")).distinct()


@query("prj_version_bump", "select distinct source_prompt_version, split_part(source_prompt_version, '.', 1) || '.' || cast(coalesce(try_cast(split_part(source_prompt_version, '.', 2) as int), 0) + 1 as varchar) as bumped from claims where source_prompt_version is not null")
def prj_version_bump(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("source_prompt_version")
    minor = F.coalesce(F.split_part(v, F.lit("."), F.lit(2)).try_cast("int"), F.lit(0)) + 1
    return table(spark, d, "claims").where(v.isNotNull()).select("source_prompt_version", F.concat_ws(".", F.split_part(v, F.lit("."), F.lit(1)), minor.cast("string")).alias("bumped")).distinct()


@query("flt_tenant", "select user_id, transform_id, count(*) as n_nodes from graph_nodes where user_id is not null and transform_id is not null group by all")
def flt_tenant(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_nodes").where("user_id is not null and transform_id is not null").groupBy("user_id", "transform_id").agg(F.count(F.lit(1)).alias("n_nodes"))


@query("flt_type_induced", "with k as (select distinct id from graph_nodes where lower(type_) in ('wallet', 'company')) select distinct id from graph_edges where from_ in (select id from k) and to_ in (select id from k)")
def flt_type_induced(spark: SparkSession, d: str) -> DataFrame:
    return nodes_edges(spark, d).of_types(["Wallet", "Company"]).edges.select("id").distinct()


@query("flt_property_search", "select distinct id from graph_nodes where contains(lower(properties['name']), 'berg') or properties['city'] = 'Quillan'")
def flt_property_search(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("properties")
    return table(spark, d, "graph_nodes").where(F.lower(p["name"]).contains("berg") | (p["city"] == "Quillan")).select("id").distinct()


@query("flt_claim_confidence", "select distinct id from claims where confidence >= 0.8")
def flt_claim_confidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claims").where("confidence >= 0.8").select("id").distinct()


@query("flt_low_confidence", "select id, valid_from, loaded_at, coalesce(nullif(confidence_score, 0), 1.0) as confidence from graph_nodes where coalesce(nullif(confidence_score, 0), 1.0) < 0.6")
def flt_low_confidence(spark: SparkSession, d: str) -> DataFrame:
    c = F.coalesce(F.nullif("confidence_score", F.lit(0.0)), F.lit(1.0))
    return table(spark, d, "graph_nodes").select("id", "valid_from", "loaded_at", c.alias("confidence")).where("confidence < 0.6")


@query("flt_month_window", "select count(*) as n, count(distinct id) as n_ids from graph_edges where created_at >= date_trunc('month', timestamp '2024-03-15') and created_at < date_trunc('month', timestamp '2024-03-15') + interval 1 month")
def flt_month_window(spark: SparkSession, d: str) -> DataFrame:
    start = F.date_trunc("month", F.lit("2024-03-15").cast("timestamp_ntz"))
    return table(spark, d, "graph_edges").where((F.col("created_at") >= start) & (F.col("created_at") < start + F.expr("interval 1 month"))).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


@query("flt_active", f"with {ACTIVE_NODES} select id, valid_from from active_nodes")
def flt_active(spark: SparkSession, d: str) -> DataFrame:
    return graph.latest_versions(table(spark, d, "graph_nodes").where("valid_to is null")).select("id", "valid_from")


@query(
    "jn_endpoint_cascade",
    """with names as (select id, id as ref, 0 as rank from graph_nodes union all select id, canonical_id, 1 from graph_nodes union all select id, canonical_key, 2 from graph_nodes
  union all select id, unnest(original_extraction_ids), 3 from graph_nodes),
t as (select lower(ref) as ref, min(struct_pack(rank := rank, id := id)) as hit from names where ref is not null and ref <> '' group by 1),
refs as (select distinct id as edge_id, lower(trim(from_)) as ref from graph_edges where trim(from_) <> '')
select edge_id, refs.ref, hit.id as node_id, case hit.rank when 0 then 'id' when 1 then 'canonical_id' when 2 then 'canonical_key' when 3 then 'alias' else 'unresolved' end as how from refs left join t on t.ref = refs.ref""",
)
def jn_endpoint_cascade(spark: SparkSession, d: str) -> DataFrame:
    g = nodes_edges(spark, d)
    return graph.resolved_endpoints(g.edges, g.nodes, "from_")


_REP = "rep as (select id, min(id) over (partition by user_id, type_, canonical_id) as representative from (select distinct id, user_id, type_, canonical_id from graph_nodes where canonical_id <> '') )"


@query(
    "jn_repoint",
    f"""with {_REP}, one as (select id, min(representative) as representative from rep group by id),
m as (select e.id, e.loaded_at, e.from_, e.to_, coalesce(a.representative, e.from_) as f, coalesce(b.representative, e.to_) as t from graph_edges e left join one a on a.id = e.from_ left join one b on b.id = e.to_)
select id, loaded_at, f as from_, t as to_ from m where (f is not distinct from from_ and t is not distinct from to_) or f is distinct from t""",
)
def jn_repoint(spark: SparkSession, d: str) -> DataFrame:
    g = nodes_edges(spark, d)
    keyed = g.nodes.where("canonical_id <> ''").select("id", "user_id", "type_", "canonical_id").distinct()
    heads = keyed.groupBy("user_id", "type_", "canonical_id").agg(F.min("id").alias("representative"))
    mapping = keyed.withColumn("_k", F.struct("user_id", "type_", "canonical_id")).drop("user_id", "type_", "canonical_id").join(heads.select(F.struct("user_id", "type_", "canonical_id").alias("_h"), "representative"), F.col("_k").eqNullSafe(F.col("_h")))
    return graph.repointed(g.edges.select("id", "loaded_at", "from_", "to_"), mapping.groupBy("id").agg(F.min("representative").alias("representative")))


@query("jn_edge_existence", "select distinct id from graph_edges where from_ in (select id from graph_nodes) and to_ in (select id from graph_nodes)")
def jn_edge_existence(spark: SparkSession, d: str) -> DataFrame:
    g = nodes_edges(spark, d)
    return graph.induced_edges(g.nodes, g.edges.select("id", "from_", "to_")).select("id").distinct()


@query("jn_orphan_nodes", "select distinct id from graph_nodes where id not in (select from_ from graph_edges where from_ is not null union select to_ from graph_edges where to_ is not null)")
def jn_orphan_nodes(spark: SparkSession, d: str) -> DataFrame:
    g = nodes_edges(spark, d)
    return graph.orphan_nodes(g.nodes.select("id").distinct(), g.edges.select("from_", "to_"))


@query("jn_symmetric", "select distinct id from graph_edges e where relationship = 'PARENT_OF' and not exists (select 1 from graph_edges b where b.relationship = 'SUBSIDIARY_OF' and b.from_ = e.to_ and b.to_ = e.from_)")
def jn_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return graph.missing_mirrors(table(spark, d, "graph_edges").select("id", "from_", "to_", "relationship"), "PARENT_OF", "SUBSIDIARY_OF").select("id").distinct()


@query(
    "jn_connections",
    """with ends as (select from_ as id, 1 as o, 0 as i from graph_edges union all select to_, 0, 1 from graph_edges), s as (select id, sum(o) as n_out, sum(i) as n_in from ends where id is not null group by id)
select n.id, coalesce(n_out, 0) as n_out, coalesce(n_in, 0) as n_in from (select distinct id from graph_nodes) n left join s on s.id = n.id""",
)
def jn_connections(spark: SparkSession, d: str) -> DataFrame:
    g = nodes_edges(spark, d)
    return graph.connection_counts(g.nodes.select("id").distinct(), g.edges.select("from_", "to_"))


@query(
    "jn_neighbours",
    """with p as (select distinct from_ as id, to_ as neighbour from graph_edges where from_ <> to_ union select distinct to_, from_ from graph_edges where from_ <> to_),
t as (select distinct id, type_ from graph_nodes), m as (select distinct p.id, p.neighbour from p join t a on a.id = p.id join t b on b.id = p.neighbour where a.type_ = b.type_)
select id, neighbour, rank from (select id, neighbour, row_number() over (partition by id order by neighbour) as rank from m) where rank <= 3""",
)
def jn_neighbours(spark: SparkSession, d: str) -> DataFrame:
    g = nodes_edges(spark, d)
    return graph.in_type_neighbours(g.nodes, g.edges)


@query(
    "jn_chunk_mates",
    """with c as (select distinct id, transform_id, unnest(provenance.chunk_ids) as chunk from graph_nodes), o as (select distinct id from graph_nodes where id not in (select from_ from graph_edges where from_ is not null union select to_ from graph_edges where to_ is not null))
select distinct a.id, b.id as mate from c a join o on o.id = a.id join c b on b.transform_id = a.transform_id and b.chunk = a.chunk where b.id not in (select id from o)""",
)
def jn_chunk_mates(spark: SparkSession, d: str) -> DataFrame:
    g = nodes_edges(spark, d)
    return graph.chunk_mates(g.nodes, g.edges)


@query(
    "jn_claim_target",
    """with names as (select id, lower(id) as ref, 0 as rank from graph_nodes union all select id, lower(unnest(original_extraction_ids)), 1 from graph_nodes), t as (select ref, min(struct_pack(rank := rank, id := id)) as hit from names group by ref),
r as (select distinct id as claim_id, lower(trim(target_id)) as ref from claims where target_kind = 'node' and trim(target_id) <> '')
select claim_id, hit.id as node_id from r join t on t.ref = r.ref""",
)
def jn_claim_target(spark: SparkSession, d: str) -> DataFrame:
    return claim_ops.claims_on_nodes(table(spark, d, "claims"), table(spark, d, "graph_nodes"))


@query("grf_property_keys", "select type_ as label, e.key as key, count(e.value) as n from (select type_, unnest(map_entries(properties)) as e from graph_nodes) group by all")
def grf_property_keys(spark: SparkSession, d: str) -> DataFrame:
    return graph.property_keys(table(spark, d, "graph_nodes"), "type_")


@query("grf_counts", "select transform_id, sum(n) as n_nodes, sum(e) as n_edges from (select transform_id, 1 as n, 0 as e from graph_nodes union all select transform_id, 0, 1 from graph_edges) group by transform_id")
def grf_counts(spark: SparkSession, d: str) -> DataFrame:
    g = nodes_edges(spark, d)
    count = lambda df, n, e: df.groupBy("transform_id").agg(F.count(F.lit(1)).alias("c")).select("transform_id", (F.col("c") * n).alias("n"), (F.col("c") * e).alias("e"))
    return count(g.nodes, 1, 0).unionByName(count(g.edges, 0, 1)).groupBy("transform_id").agg(F.sum("n").alias("n_nodes"), F.sum("e").alias("n_edges"))


@query("grf_summary", "select source_type, relationship, target_type, count(*) as n from graph_edges group by all order by n desc, source_type, relationship, target_type limit 10")
def grf_summary(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "graph_edges").groupBy("source_type", "relationship", "target_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_last("source_type"), F.asc_nulls_last("relationship"), F.asc_nulls_last("target_type")).limit(10)


@query("clu_edge_dedupe", "select from_, to_, relationship, min(id) as id, count(distinct id) as n_merged from graph_edges group by from_, to_, relationship")
def clu_edge_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_edges").groupBy("from_", "to_", "relationship").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n_merged"))


@query(
    "clu_edge_merge",
    """with f as (select from_, to_, relationship, loaded_at, id, unnest(map_entries(properties)) as e from graph_edges)
select from_, to_, relationship, e.key as key, arg_max(e.value, struct_pack(a := loaded_at, b := id)) as value from f where e.value is not null group by from_, to_, relationship, e.key""",
)
def clu_edge_merge(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "graph_edges").withColumn("properties", F.map_filter("properties", lambda k, v: v.isNotNull()))
    return graph.merged_edges(own).select("from_", "to_", "relationship", F.explode("properties"))


@query(
    "clu_merge_nodes",
    """with f as (select id, coalesce(confidence_score, 0.0) as c, unnest(map_entries(properties)) as e from graph_nodes), b as (select id, e.key as key, max(struct_pack(c := c, n := length(e.value), v := e.value)) as b from f where e.value is not null group by id, e.key)
select id, key, b.v as value, b.c as confidence from b""",
)
def clu_merge_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.merged_nodes(table(spark, d, "graph_nodes"))


@query(
    "clu_disputed_upsert",
    """select user_id, transform_id, source_stage, least(a, b) as lo, greatest(a, b) as hi, max(similarity_score)::double as similarity, count(*) as n_rows
from (select *, lower(trim(node_a_id)) as a, lower(trim(node_b_id)) as b from disputed_pairs) where a <> b group by all""",
)
def clu_disputed_upsert(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.lower(F.trim("node_a_id")), F.lower(F.trim("node_b_id"))
    own = table(spark, d, "disputed_pairs").where(a != b)
    return own.groupBy("user_id", "transform_id", "source_stage", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).agg(F.max("similarity_score").cast("double").alias("similarity"), F.count(F.lit(1)).alias("n_rows"))


@query(
    "agg_contradictions",
    """with o as (select distinct id, target_id, target_kind, property_key, value from claims where confidence >= 0.3 and value is not null)
select target_id, target_kind, property_key, count(distinct value) as severity, count(*) as n_claims from o group by all having count(distinct value) >= 2""",
)
def agg_contradictions(spark: SparkSession, d: str) -> DataFrame:
    return claim_ops.contradictions(table(spark, d, "claims"), 0.3)


@query(
    "win_competing_claims",
    """with o as (select distinct id, target_id, target_kind, property_key, value, confidence, created_at from claims where value is not null and confidence >= 0),
k as (select target_id, target_kind, property_key from o group by all having count(distinct value) >= 2)
select id, place from (select o.id, row_number() over (partition by target_id, target_kind, property_key order by confidence desc, created_at, id) as place from (select distinct id, target_id, target_kind, property_key, confidence, created_at from claims) o
semi join k using (target_id, target_kind, property_key)) where place <= 3""",
)
def win_competing_claims(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "claims")
    return claim_ops.competing_claims(c, claim_ops.contradictions(c)).where("place <= 3").select("id", "place")


@query(
    "set_emit_claims",
    r"select id as target_id, e.key as property_key, e.value as value, max(confidence_score) as confidence from (select id, confidence_score, unnest(map_entries(properties)) as e from graph_nodes) where regexp_replace(e.value, '^\s+|\s+$', '', 'g') <> '' group by all",
)
def set_emit_claims(spark: SparkSession, d: str) -> DataFrame:
    return claim_ops.emitted_claims(table(spark, d, "graph_nodes"))


@query(
    "set_scenario_diff",
    """with a as (select id, type_, list_sort(map_entries(properties)) as p from graph_nodes where valid_to is null qualify row_number() over (partition by id order by valid_from desc nulls last, loaded_at desc nulls last) = 1),
b as (select id, type_, list_sort(map_entries(properties)) as p from graph_nodes qualify row_number() over (partition by id order by valid_from nulls last, loaded_at nulls last) = 1)
select coalesce(a.id, b.id) as id, case when a.id is null then 'added' when b.id is null then 'removed' else 'updated' end as change from a full join b on a.id = b.id
where a.id is null or b.id is null or a.p is distinct from b.p or a.type_ is distinct from b.type_""",
)
def set_scenario_diff(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "graph_nodes")
    w = Window.partitionBy("id").orderBy(F.col("valid_from").asc_nulls_last(), F.col("loaded_at").asc_nulls_last())
    first = nodes.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return versioning.scenario_diff(graph.latest_versions(nodes.where("valid_to is null")), first)


@query(
    "set_version_chain",
    """with o as (select id, valid_from, max(valid_to) as valid_to from graph_nodes group by id, valid_from)
select id, row_number() over w as version_no, valid_from, coalesce(case when valid_to is not null and lead(valid_from) over w is not null then least(valid_to, lead(valid_from) over w) end, valid_to, lead(valid_from) over w) as closes from o window w as (partition by id order by valid_from)""",
)
def set_version_chain(spark: SparkSession, d: str) -> DataFrame:
    return versioning.version_chain(table(spark, d, "graph_nodes"))


@query("set_as_of", "select distinct id, valid_from from graph_nodes where valid_from <= timestamp '2024-06-01' and (valid_to is null or timestamp '2024-06-01' < valid_to)")
def set_as_of(spark: SparkSession, d: str) -> DataFrame:
    return versioning.as_of(table(spark, d, "graph_nodes"), F.lit("2024-06-01").cast("timestamp_ntz")).select("id", "valid_from").distinct()


@query(
    "set_property_conflicts",
    r"""with o as (select * from node_snapshots where user_id is not null and transform_id is not null and id is not null qualify row_number() over (partition by user_id, transform_id, id order by loaded_at desc) = 1),
pairs as (select user_id, transform_id, lag(transform_id) over (partition by user_id order by seq_no, transform_id) as before from (select user_id, transform_id, max(seq_no) as seq_no from node_snapshots where user_id is not null and id is not null and transform_id is not null and seq_no is not null group by all)),
f as (select s.transform_id, s.id, k.key as key, regexp_replace(s.properties[k.key], '^\s+|\s+$', '', 'g') as a, regexp_replace(p.properties[k.key], '^\s+|\s+$', '', 'g') as b from pairs q join o s on s.user_id = q.user_id and s.transform_id = q.transform_id
join o p on p.user_id = q.user_id and p.transform_id = q.before and p.id = s.id cross join (select unnest(['name', 'city', 'status', 'year', 'ceo', 'publisher']) as key) k)
select transform_id, id, key, case when b is null then 'new' when a is null then 'deleted' else 'differs' end as kind from f where a is distinct from b""",
)
def set_property_conflicts(spark: SparkSession, d: str) -> DataFrame:
    snap = table(spark, d, "node_snapshots").where("user_id is not null and transform_id is not null and id is not null")
    one = graph.latest_rows(snap.withColumn("_at", F.struct("user_id", "transform_id", "id")), "_at")
    # Each transform stages against the one before it of its user.
    pairs = transform_pairs(snap).where("before is not null").select("user_id", "transform_id", "before")
    staging = one.join(pairs, ["user_id", "transform_id"]).select(F.struct("user_id", "transform_id", "id").alias("at"), "properties")
    production = one.withColumnRenamed("transform_id", "before").join(pairs, ["user_id", "before"]).select(F.struct("user_id", "transform_id", "id").alias("at"), "properties")
    return versioning.property_conflicts(staging, production, ONTOLOGY_KEYS, "at").select("at.transform_id", "at.id", "key", "kind")


@query(
    "set_dangling",
    """with k as (select distinct id from graph_nodes where valid_to is null), e as (select id, 'from_' as missing_end, from_ as x from graph_edges union all select id, 'to_', to_ from graph_edges)
select distinct id, missing_end from e where x is not null and x not in (select id from k)""",
)
def set_dangling(spark: SparkSession, d: str) -> DataFrame:
    g = nodes_edges(spark, d)
    return versioning.dangling_edges(g.nodes.where("valid_to is null"), g.edges.select("id", "from_", "to_"))


@query(
    "set_reconciled",
    """with m as (select distinct lower(trim(node_a_id)) as source, lower(trim(node_b_id)) as target, similarity_score::double as confidence from disputed_pairs where similarity_score >= 0.8),
b as (select target, max(confidence) as confidence from m where source is not null and target is not null group by target) select min(m.source) as source, m.target, m.confidence from m join b on b.target = m.target and b.confidence = m.confidence group by m.target, m.confidence""",
)
def set_reconciled(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "disputed_pairs").select(F.lower(F.trim("node_a_id")).alias("source"), F.lower(F.trim("node_b_id")).alias("target"), F.col("similarity_score").cast("double").alias("confidence"))
    return versioning.reconciled(m.where("source is not null and target is not null").distinct(), 0.8)


@query(
    "set_patched",
    """with b as (select id, unnest(map_entries(properties)) as e from production_nodes), o as (select id, e.key as key, e.value as value from b),
p as (select id, 'name' as key, cast(null as varchar) as value from production_nodes where valid_to is not null union all select id, 'reviewed', 'yes' from production_nodes)
select id, key, value from o where value is not null and not exists (select 1 from p where p.id = o.id and p.key = o.key) union all select id, key, value from p where value is not null""",
)
def set_patched(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "production_nodes")
    patches = base.where("valid_to is not null").select("id", F.lit("name").alias("key"), F.lit(None).cast("string").alias("value")).unionByName(base.select("id", F.lit("reviewed").alias("key"), F.lit("yes").alias("value")))
    return versioning.patched(base, patches)


@query(
    "win_ledger_cap",
    "select id from (select id, row_number() over (partition by user_id, type order by updated_at desc nulls last, id) as n from (select id, user_id, type, max(updated_at) as updated_at from node_snapshots group by all)) where n <= 10000",
)
def win_ledger_cap(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "node_snapshots").groupBy("id", "user_id", "type").agg(F.max("updated_at").alias("updated_at"))
    w = Window.partitionBy("user_id", "type").orderBy(F.col("updated_at").desc_nulls_last(), "id")
    return own.withColumn("n", F.row_number().over(w)).where("n <= 10000").select("id")


@query("win_pending_page", "select id from (select id, max(created_at) as created_at from disputed_pairs where status = 'pending' group by id) order by created_at desc, id limit 20 offset 20")
def win_pending_page(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "disputed_pairs").where("status = 'pending'").groupBy("id").agg(F.max("created_at").alias("created_at"))
    return graph.page(own, 20, 1, F.desc("created_at"), F.asc("id")).select("id")
