"""Queries of entity resolution: plans from an ontology, blocks, links, layers, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import entity_resolution as er
from weftgraph.operators import resolution, review
from weftgraph.operators.graph import latest_versions
from weftgraph.registry import query
from weftgraph.sources import table

# Fixed value of the queries: the properties of a type that they plan for.
PROPERTIES = {
    "name": {"type": "string", "is_blocking_key": True, "matching_weight": 2.0}, "registry_id": {"type": "identifier", "is_identifier": True, "unique": True}, "founded": {"type": "number", "matching_weight": 1.5},
    "city": {"type": "string", "index": True}, "notes": {"type": "text", "matching_weight": 3.0}, "since": {"type": "date"},
}


@query("blk_rules", "select * from (values (0, 'name', 'first_n_chars'), (1, 'registry_id', 'exact'), (2, 'notes', 'lsh'), (3, 'founded', 'numeric_bucket')) t(rule, prop, method)")
def blk_rules(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, r.prop, r.method) for i, r in enumerate(er.blocking_rules(PROPERTIES))], "rule int, prop string, method string")


@query("blk_rule_sql", "select * from (values ('name', 'substr(l.name, 1, 4) = substr(r.name, 1, 4)'), ('registry_id', 'l.registry_id = r.registry_id'), ('notes', 'l.notes = r.notes'), ('founded', 'l.founded = r.founded')) t(prop, condition)")
def blk_rule_sql(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(r.prop, r.sql()) for r in er.blocking_rules(PROPERTIES)], "prop string, condition string")


@query("blk_linkage_columns", "select * from (values (0, 'registry_id'), (1, 'city'), (2, 'name')) t(place, prop)")
def blk_linkage_columns(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(er.linkage_columns(PROPERTIES))), "place int, prop string")


@query("sim_comparison_rules", "select prop, method, levels, m0::double as m0, u0::double as u0 from (values ('name', 'jaro_winkler', 4, 0.85, 0.05), ('registry_id', 'exact', 2, 0.97, 0.02), ('founded', 'exact', 2, 0.90, 0.05), ('city', 'jaro_winkler', 4, 0.85, 0.05), ('notes', 'cosine', 4, 0.80, 0.10), ('since', 'exact', 2, 0.90, 0.05)) t(prop, method, levels, m0, u0)")
def sim_comparison_rules(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(r.prop, r.method, len(r.m), r.m[0], r.u[0]) for r in er.comparison_rules(PROPERTIES)], "prop string, method string, levels int, m0 double, u0 double")


@query(
    "blk_rule_blocks",
    """with k as (select distinct user_id, id, r.rule, r.value from (select user_id, id, unnest([struct_pack(rule := 0, value := lower(substr(trim(properties['name']), 1, 4))), struct_pack(rule := 1, value := floor(try_cast(trim(properties['founded']) as double) / 10)::bigint::varchar)]) as r from expected_nodes where type = 'Organization' and id is not null and user_id is not null))
select user_id, rule, value, count(*) as n, min(id) as head from k where value <> '' group by all having count(*) > 1""",
)
def blk_rule_blocks(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "expected_nodes").where("type = 'Organization' and id is not null and user_id is not null")
    return er.rule_groups(own, [er.BlockingRule("name", "first_n_chars", {"n": 4}), er.BlockingRule("founded", "numeric_bucket", {"width": 10})], ["user_id"])


_BANDS = """g as (select id, list_distinct(case when length(v) >= 3 then list_transform(range(1, length(v) - 1), lambda i: substr(v, i, 3)) else [v] end) as grams from (select distinct id, lower(trim(label)) as v from expected_nodes where length(trim(label)) > 0)),
h as (select id, list_transform(grams, lambda x: ('0x' || substr(md5(x), 1, 7))::bigint) as h from g), s as (select id, [%s] as s from h), bands as (select distinct id, unnest([%s]) as band from s)""" % (
    ", ".join(f"list_min(list_transform(h, lambda x: (x * {(k * 2 + 1) * 7919 % 65521 + 1} + {(k + 1) * 104729}) % {resolution.MERSENNE}))" for k in range(100)),
    ", ".join("substr(md5(concat_ws('|', '%d', %s)), 1, 12)" % (i, ", ".join(f"s[{i * 5 + r + 1}]" for r in range(5))) for i in range(20)),
)


def _bands(spark: SparkSession, d: str) -> DataFrame:
    return resolution.banded(table(spark, d, "expected_nodes").select("id", "label").distinct(), "label")


@query("blk_lsh_links", f"with {_BANDS}, b as (select band, min(id) as a from bands group by band having count(distinct id) > 1) select distinct b.a, bands.id as b from bands join b on b.band = bands.band where bands.id <> b.a")
def blk_lsh_links(spark: SparkSession, d: str) -> DataFrame:
    return er.banded_links(_bands(spark, d))


@query("blk_lsh_candidates", f"with {_BANDS}, q as (select distinct id from expected_nodes where ('0x' || substr(md5(id), 1, 6))::bigint % 100 = 0), a as (select bands.id as query_id, band from bands join q on q.id = bands.id) select distinct a.query_id, bands.id from bands join a on a.band = bands.band where bands.id <> a.query_id")
def blk_lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "expected_nodes").select("id").where("id is not null").distinct()
    return er.bucket_pairs(_bands(spark, d), ids.where(F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("bigint") % 100 == 0))


@query("sim_matrix", "select a.vec_id as query_id, b.label, count(*) as n, round(avg(least(1, greatest(0, list_cosine_similarity(a.embedding::double[], b.embedding::double[])))), 6) as mean_score from embeddings a, embeddings b where a.vec_id % 100 = 0 group by all")
def sim_matrix(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    # The stated query set is a hundredth of the rows.
    return e.join(asked, how="cross").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(resolution.cosine(F.col("q"), F.col("embedding"))), 6).alias("mean_score"))


_SIGNATURES = """n0 as (select user_id, type as type_, id, properties, properties['canonical_id'] as canonical_id, properties['canonical_key'] as canonical_key from expected_nodes where id is not null),
e0 as (select id, lower(trim(node_a_id)) as from_, lower(trim(node_b_id)) as to_, status as relationship from disputed_pairs),
k as (select distinct user_id, type_, id, unnest(list_filter([case when regexp_replace(canonical_id, '\\s+', '', 'g') <> '' then 'i:' || lower(trim(canonical_id)) end, case when regexp_replace(canonical_key, '\\s+', '', 'g') <> '' then 'k:' || lower(trim(canonical_key)) end], lambda x: x is not null)) as s from n0 where user_id is not null and type_ is not null),
h as (select user_id, type_, s, min(id) as head from k group by all having min(id) <> max(id)), links as (select distinct h.head as a, k.id as b from k join h on h.user_id = k.user_id and h.type_ = k.type_ and h.s = k.s where k.id <> h.head)"""


def _entities(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("properties")
    return table(spark, d, "expected_nodes").where("id is not null").select("user_id", F.col("type").alias("type_"), "id", "properties", p["canonical_id"].alias("canonical_id"), p["canonical_key"].alias("canonical_key"))


@query("clu_signatures", f"with {_SIGNATURES} select a, b from links")
def clu_signatures(spark: SparkSession, d: str) -> DataFrame:
    return er.signature_links(_entities(spark, d))


_NAMED = """nm as (select distinct user_id, type_, lower(trim(properties['name'])) as v, id from n0 where trim(properties['name']) <> '' and user_id is not null and type_ is not null), nh as (select user_id, type_, v, min(id) as head from nm group by all having min(id) <> max(id)),
all_links as (select a, b from links union select nh.head, nm.id from nm join nh on nh.user_id = nm.user_id and nh.type_ = nm.type_ and nh.v = nm.v where nm.id <> nh.head), e as (select a, b from all_links union select b, a from all_links),
r as (select distinct a as v, a as x from e union select e.b, r.x from r join e on e.a = r.v where r.x < e.b), mapping as (select v as id, min(x) as representative from r group by v)"""


def _mapping(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = _entities(spark, d)
    named = nodes.select("user_id", "type_", F.lower(F.trim(F.col("properties")["name"])).alias("canonical_id"), F.lit(None).cast("string").alias("canonical_key"), "properties", "id").where("canonical_id <> ''")
    return er.layered(nodes, [("signature", er.signature_links(nodes)), ("name", er.signature_links(named))])


@query("clu_layers", f"with recursive {_SIGNATURES}, {_NAMED} select id, representative from mapping")
def clu_layers(spark: SparkSession, d: str) -> DataFrame:
    return _mapping(spark, d)[0]


@query("clu_deduplicated", f"with recursive {_SIGNATURES}, {_NAMED} select coalesce(m.representative, n.id) as id, count(*) as n_members from (select distinct id from n0) n left join mapping m on m.id = n.id group by 1")
def clu_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return er.deduplicated(_entities(spark, d), _mapping(spark, d)[0])


@query(
    "clu_rewired",
    f"""with recursive {_SIGNATURES}, {_NAMED}, m as (select e.id, e.relationship, e.from_, e.to_, coalesce(a.representative, e.from_) as f, coalesce(b.representative, e.to_) as t from e0 e left join mapping a on a.id = e.from_ left join mapping b on b.id = e.to_)
select f as from_, t as to_, relationship, min(id) as id, count(*) as n_merged from m where (f is not distinct from from_ and t is not distinct from to_) or f is distinct from t group by f, t, relationship""",
)
def clu_rewired(spark: SparkSession, d: str) -> DataFrame:
    end = lambda c, name: F.lower(F.trim(c)).alias(name)
    edges = table(spark, d, "disputed_pairs").select("id", end("node_a_id", "from_"), end("node_b_id", "to_"), F.col("status").alias("relationship"))
    return er.resolved_graph(_entities(spark, d).select("id"), edges, _mapping(spark, d)[0])[1]


@query(
    "clu_disputed",
    f"""with recursive {_SIGNATURES}, {_NAMED}, s as (select distinct user_id || '|' || type_ || '|' || lower(properties['city']) as g, id from n0 where properties['city'] is not null and type_ is not null), t as (select g, min(id) as a, max(id) as b from s group by g having count(distinct id) = 2)
select g as "group", t.a, t.b from t left join mapping x on x.id = t.a left join mapping y on y.id = t.b where coalesce(x.representative, t.a) <> coalesce(y.representative, t.b)""",
)
def clu_disputed(spark: SparkSession, d: str) -> DataFrame:
    nodes = _entities(spark, d).where(F.col("properties")["city"].isNotNull() & F.col("type_").isNotNull())
    groups = nodes.where("user_id is not null").select(F.concat("user_id", F.lit("|"), "type_", F.lit("|"), F.lower(F.col("properties")["city"])).alias("group"), "id").distinct()
    return er.disputed(groups, _mapping(spark, d)[0])


@query("clu_decisions", f"with recursive {_SIGNATURES}, e as (select a, b from links union select b, a from links), r as (select distinct a as v, a as x from e union select e.b, r.x from r join e on e.a = r.v where r.x < e.b), m as (select v as id, min(x) as representative from r group by v) select representative, 'signature' as layer, count(*) as n_members from m group by representative")
def clu_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _mapping(spark, d)[1].where("layer = 'signature'")


@query(
    "clu_production_merge",
    r"""with p as (select id, properties from graph_nodes qualify row_number() over (partition by id order by valid_from nulls last, loaded_at nulls last) = 1), st as (select id, properties from graph_nodes where valid_to is null qualify row_number() over (partition by id order by valid_from desc nulls last, loaded_at desc nulls last) = 1),
f as (select p.id, k.key, case when regexp_replace(p.properties[k.key], '\s+', '', 'g') <> '' then p.properties[k.key] end as old, case when regexp_replace(st.properties[k.key], '\s+', '', 'g') <> '' then st.properties[k.key] end as new from p left join st on st.id = p.id cross join (select unnest(['name', 'city', 'status']) as key) k),
c as (select id, bool_or(new is not null and new is distinct from old) as changed from f group by id)
select f.id, key, coalesce(new, old) as value, 'current' as version from f where coalesce(new, old) is not null union all select f.id, key, old, 'previous' from f join c on c.id = f.id where c.changed and old is not null""",
)
def clu_production_merge(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "graph_nodes")
    # Each node's first version is in production, its latest active one is staged.
    first = nodes.groupBy("id").agg(F.min_by("properties", F.struct(F.coalesce("valid_from", F.lit("9999-12-31").cast("timestamp_ntz")), F.coalesce("loaded_at", F.lit("9999-12-31").cast("timestamp_ntz")))).alias("properties"))
    return er.production_merge(first, latest_versions(nodes.where("valid_to is null")).select("id", "properties"), ["name", "city", "status"])


@query("clu_gap_chunks", "with c as (select distinct transform_id, unnest(provenance.chunk_ids) as chunk from graph_nodes), g as (select distinct transform_id, id as gap_id, provenance.chunk_ids[1] as chunk from graph_nodes where coalesce(trim(properties['city']), '') = '') select transform_id, chunk, gap_id from g where chunk is not null union select g.transform_id, c.chunk, gap_id from g join c on c.transform_id = g.transform_id where g.chunk is null")
def clu_gap_chunks(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "graph_nodes")
    gaps = nodes.where(F.coalesce(F.trim(F.col("properties")["city"]), F.lit("")) == "").select("transform_id", F.col("id").alias("gap_id"), F.get("provenance.chunk_ids", F.lit(0)).alias("chunk")).distinct()
    return er.gaps_by_chunk(gaps, nodes.select("transform_id", F.explode("provenance.chunk_ids").alias("chunk")))


@query("win_representative", "select canonical_id, arg_min(id, struct_pack(a := -coalesce(confidence_score, 0), b := id)) as id, count(*) as n from graph_nodes where canonical_id <> '' group by canonical_id")
def win_representative(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "graph_nodes").where("canonical_id <> ''")
    return own.groupBy("canonical_id").agg(F.min(F.struct((-F.coalesce("confidence_score", F.lit(0.0))).alias("c"), "id")).alias("m"), F.count(F.lit(1)).alias("n")).select("canonical_id", F.col("m.id").alias("id"), "n")


@query("win_popular", "select relationship, count(*) as usage_count, max(created_at) as updated_at from graph_edges where relationship is not null group by 1 order by usage_count desc, updated_at desc, relationship limit 10")
def win_popular(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "graph_edges").where("relationship is not null").groupBy("relationship").agg(F.count(F.lit(1)).alias("usage_count"), F.max("created_at").alias("updated_at"))
    return own.orderBy(F.desc("usage_count"), F.desc("updated_at"), "relationship").limit(10)


@query("win_context_nodes", "select transform_id, id, place from (select transform_id, id, row_number() over (partition by transform_id order by type_ nulls first, id) as place from (select distinct transform_id, type_, id from graph_nodes)) where place <= 5")
def win_context_nodes(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "graph_nodes").select("transform_id", "type_", "id").distinct()
    return review.first_rows(own, ["transform_id"], [F.asc_nulls_first("type_"), F.asc("id")], 5, F.col("id")).select("transform_id", "id", "place")


@query("win_best_match", "select node_a_id, arg_max(node_b_id, struct_pack(a := similarity_score, b := node_b_id)) as best, max(similarity_score)::double as score from disputed_pairs where node_a_id is not null and node_b_id is not null and similarity_score is not null group by node_a_id")
def win_best_match(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "disputed_pairs").where("node_a_id is not null and node_b_id is not null and similarity_score is not null")
    return own.groupBy("node_a_id").agg(F.max(F.struct("similarity_score", "node_b_id")).alias("m")).select("node_a_id", F.col("m.node_b_id").alias("best"), F.col("m.similarity_score").cast("double").alias("score"))
