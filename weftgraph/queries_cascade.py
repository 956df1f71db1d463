"""Queries of matching cascades, pages, gaps, ontologies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import identity
from weftgraph.operators import matching_cascade as cascade
from weftgraph.operators import ontology, versioning
from weftgraph.operators.graph import latest_rows
from weftgraph.operators.snapshot_diff import transform_pairs
from weftgraph.registry import query
from weftgraph.sources import table

# Fixed value of the queries: the ontology that they use.
ONTOLOGY = {"entities": {"Person": {"properties": {"name": {"required": True, "unique": True}, "birth_year": {"type": "integer"}, "city": {}}}, "Organization": {"properties": {"name": {"required": True}, "founded": {"type": "integer"}}}}}


_PAIRS = "pairs as (select user_id, transform_id, lag(transform_id) over (partition by user_id order by seq_no, transform_id) as before from (select user_id, transform_id, max(seq_no) as seq_no from node_snapshots group by all))"


def _match_keys(name: str, at: str) -> str:
    """Keys of the rows of each pair of transforms, on the side that ``at`` names."""
    rows = f"from pairs p join node_snapshots s on s.user_id = p.user_id and s.transform_id = p.{at} where p.before is not null"
    own = f"p.user_id, p.transform_id, s.id as {name}"
    return f"""select distinct {own}, 0 as rank, s.type || '|' || s.canonical_id as key {rows} and trim(s.canonical_id) <> '' union select distinct {own}, 1, s.type || '|' || lower(s.properties['name']) {rows}
and trim(s.properties['name']) <> '' union select distinct {own}, 2, s.id {rows}"""


@query(
    "jn_production_match",
    f"""with {_PAIRS}, k as ({_match_keys("id", "transform_id")}), t as ({_match_keys("target", "before")}),
c as (select k.user_id, k.transform_id, k.id, k.rank, count(distinct target) as n_targets, min(target) as target from k join t on t.user_id = k.user_id and t.transform_id = k.transform_id and t.rank = k.rank and t.key = k.key group by all),
b as (select user_id, transform_id, id, min(struct_pack(rank := rank, n_targets := n_targets, target := target)) as b from c group by all)
select user_id, transform_id, id, case b.rank when 0 then 'canonical_id' when 1 then 'name' else 'id' end as strategy, case when b.n_targets = 1 then b.target end as target, b.n_targets as n_targets, (case b.rank when 0 then 0.95 when 1 then 0.9 else 0.7 end / case when b.n_targets = 1 then 1 else 2 end)::double as confidence from b""",
)
def jn_production_match(spark: SparkSession, d: str) -> DataFrame:
    c, name, t = F.col("canonical_id"), F.col("name"), F.col("type")
    strategies = [("canonical_id", [(t, t), (c, c)], 0.95), ("name", [(t, t), (name, name)], 0.9), ("id", [(F.col("id"), F.col("id"))], 0.7)]
    snap = table(spark, d, "node_snapshots").select("user_id", "transform_id", "seq_no", "id", "type", "canonical_id", F.lower(F.col("properties")["name"]).alias("name"))
    # Each transform against the one before it in its user's order.
    pairs = transform_pairs(snap).where("before is not null")
    records = snap.join(pairs.select("user_id", "transform_id"), ["user_id", "transform_id"])
    targets = snap.withColumnRenamed("transform_id", "before").join(pairs.select("user_id", "transform_id", "before"), ["user_id", "before"])
    return cascade.first_match(records, targets, strategies, ["user_id", "transform_id"])


@query(
    "jn_ledger_hydration",
    """with l as (select user_id, type as type_, canonical_key, min(canonical_id) as known from node_snapshots where canonical_id is not null and canonical_key is not null group by all)
select n.id, n.valid_from, n.loaded_at, coalesce(l.known, n.canonical_id) as canonical_id from graph_nodes n left join l on l.user_id = n.user_id and l.type_ = n.type_ and l.canonical_key = n.canonical_key""",
)
def jn_ledger_hydration(spark: SparkSession, d: str) -> DataFrame:
    ledger = table(spark, d, "node_snapshots").where("canonical_id is not null and canonical_key is not null").groupBy("user_id", F.col("type").alias("type_"), "canonical_key").agg(F.min("canonical_id").alias("canonical_id"))
    return cascade.hydrated(table(spark, d, "graph_nodes"), ledger).select("id", "valid_from", "loaded_at", "canonical_id")


@query(
    "jn_ledger_tiers",
    """with s as (select a.vec_id as id, b.vec_id as target, least(1, greatest(0, list_cosine_similarity(a.embedding::double[], b.embedding::double[]))) as score from embeddings a join embeddings b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
b as (select id, max(round(score, 6)) as score from s group by id) select id, score, case when score >= 0.4 then 'auto' else 'review' end as tier from b where score >= 0.2""",
)
def jn_ledger_tiers(spark: SparkSession, d: str) -> DataFrame:
    from weftgraph.operators.resolution import nearest

    base = table(spark, d, "embeddings").select("vec_id", "embedding")
    near = nearest(base.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), base, 2).where("query_id <> vec_id")
    return cascade.similarity_tiers(near.select(F.col("query_id").alias("id"), F.col("vec_id").alias("target"), F.round("score", 6).alias("score")), 0.4, 0.2).select("id", "score", "tier")


_NODE_KEYS = "k as (select id, min(coalesce(case when canonical_id <> '' then type_ || ':' || canonical_id end, case when canonical_key <> '' then type_ || ':' || canonical_key end, '__local__:' || id)) as key from graph_nodes group by id)"


@query("jn_edge_keying", f"with {_NODE_KEYS} select a.key as source_key, b.key as target_key, relationship, arg_max(e.id, struct_pack(l := e.loaded_at, i := e.id)) as id from graph_edges e join k a on a.id = e.from_ join k b on b.id = e.to_ where a.key is not null and b.key is not null group by all")
def jn_edge_keying(spark: SparkSession, d: str) -> DataFrame:
    key = identity.diff_key(F.col("type_"), F.col("canonical_id"), F.col("canonical_key"), F.col("id"))
    keys = table(spark, d, "graph_nodes").groupBy("id").agg(F.min(key).alias("key"))
    return cascade.keyed_edges(table(spark, d, "graph_edges"), keys).where("source_key is not null and target_key is not null")


@query(
    "jn_subgraph_page",
    """with p as (select distinct id from graph_nodes where id > '8' order by id limit 50), e as (select distinct id, from_, to_ from graph_edges where from_ in (select id from p) or to_ in (select id from p))
select 'edge' as kind, id from e union select 'node', id from graph_nodes where id in (select id from p union select from_ from e union select to_ from e)""",
)
def jn_subgraph_page(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = cascade.subgraph_page(table(spark, d, "graph_nodes").select("id"), table(spark, d, "graph_edges").select("id", "from_", "to_"), 50, "8")
    return edges.select(F.lit("edge").alias("kind"), "id").unionByName(nodes.select(F.lit("node").alias("kind"), "id")).distinct()


@query(
    "clu_prune",
    """with u as (select from_ as id from graph_edges where from_ is not null union select to_ from graph_edges where to_ is not null), r as (select id, type_, id in (select id from u) or coalesce(properties['industry'] <> '', false) as keep from graph_nodes),
bare as (select distinct id, type_ from r where not keep), possible as (select distinct source_type as t, rel_type as rel, target_type as other, true as out_ from rel_types union select distinct target_type, rel_type, source_type, false from rel_types),
single as (select t, min(rel) as rel, min(other) as other, bool_or(out_) as out_ from possible group by t having count(*) = 1), sizes as (select type_ as other, min(id) as partner from graph_nodes group by type_ having count(distinct id) = 1),
l as (select bare.id, partner, rel, out_ from bare join single on single.t = bare.type_ join sizes on sizes.other = single.other where bare.id <> partner)
select distinct 'kept' as kind, id from r where keep or id in (select id from l) union all select 'added', case when out_ then id || '>' || partner else partner || '>' || id end from l""",
)
def clu_prune(spark: SparkSession, d: str) -> DataFrame:
    kept, added = cascade.pruned(table(spark, d, "graph_nodes"), table(spark, d, "graph_edges"), ["industry"], table(spark, d, "rel_types"))
    return kept.select(F.lit("kept").alias("kind"), "id").distinct().unionByName(added.select(F.lit("added").alias("kind"), F.concat("from_", F.lit(">"), "to_").alias("id")))


@query(
    "qr_extraction_gaps",
    r"""with n as (select id, type_, properties, confidence_score from graph_nodes), u as (select from_ as id from graph_edges where from_ is not null union select to_ from graph_edges where to_ is not null)
select distinct 'INCOMPLETE_ENTITY' as gap_type, id, array_to_string(list_filter(['name', 'city'], lambda k: coalesce(trim(properties[k]), '') = ''), ',') as detail from n where type_ = 'Company' and len(list_filter(['name', 'city'], lambda k: coalesce(trim(properties[k]), '') = '')) > 0
union select 'ORPHAN_NODE', id, '' from n where id not in (select id from u) union select 'LOW_CONFIDENCE', id, '' from n where coalesce(nullif(confidence_score, 0), 1.0) < 0.5""",
)
def qr_extraction_gaps(spark: SparkSession, d: str) -> DataFrame:
    return cascade.extraction_gaps(table(spark, d, "graph_nodes"), table(spark, d, "graph_edges"), {"Company": ["name", "city"]}, 0.5)


@query(
    "grf_evidence",
    """with e as (select from_ as id, 1 as o, 0 as i from graph_edges union all select to_, 0, 1 from graph_edges), s as (select id, sum(o) as n_out, sum(i) as n_in from e where id is not null group by id), p as (select id, arg_max(len(provenance.chunk_ids), struct_pack(a := valid_from, b := loaded_at)) as n_chunks from graph_nodes group by id)
select p.id, coalesce(n_in, 0) as n_in, coalesce(n_out, 0) as n_out, n_chunks from p left join s on s.id = p.id""",
)
def grf_evidence(spark: SparkSession, d: str) -> DataFrame:
    return cascade.evidence(table(spark, d, "graph_nodes"), table(spark, d, "graph_edges")).select("id", "n_in", "n_out", F.col("n_chunks").cast("bigint").alias("n_chunks"))


@query("sim_full_text", r"select doc_id as id, case when contains(lower(text), 'invoice') then 'exact' else 'fuzzy' end as how from documents where contains(lower(text), 'invoice') or len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: regexp_full_match(w, '[ -~]*') and levenshtein(w, 'invoice') <= 1)) > 0")
def sim_full_text(spark: SparkSession, d: str) -> DataFrame:
    return cascade.full_text(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "invoice", slack=1)


@query(
    "sim_term_score",
    r"""with w as (select entity_type, string_split_regex(lower(description), '[^a-z]+') as w from entity_types) select entity_type, round(least(1.0, (len(list_intersect(['named', 'software', 'court'], w)) + 0.5 * len(list_filter(['named', 'software', 'court'], lambda t: not list_contains(w, t) and len(list_filter(w, lambda x: contains(x, t) or contains(t, x))) > 0))) / 3), 6)::double as score from w""",
)
def sim_term_score(spark: SparkSession, d: str) -> DataFrame:
    words = F.split(F.lower("description"), "[^a-z]+")
    terms = F.array(*(F.lit(t) for t in ("named", "software", "court")))
    return table(spark, d, "entity_types").select("entity_type", F.round(cascade.term_score(terms, words), 6).alias("score"))


@query(
    "prj_provenance",
    "select id, valid_from, loaded_at, coalesce(properties['source_chunk_id'], provenance.chunk_ids[1]) as chunk, coalesce(properties['extractor_model'], provenance.extractor_model) as model from graph_nodes",
)
def prj_provenance(spark: SparkSession, d: str) -> DataFrame:
    p = cascade.stamped(F.map_filter("properties", lambda k, v: v.isNotNull()), F.col("provenance"), F.col("provenance")["source_file"])
    return table(spark, d, "graph_nodes").withColumn("p", p).select("id", "valid_from", "loaded_at", F.col("p")["source_chunk_id"].alias("chunk"), F.col("p")["extractor_model"].alias("model"))


@query("txt_context", "with l as (select distinct transform_id, '[' || coalesce(type_, '_') || '] ' || id as line from graph_nodes) select transform_id, count(*) as n_nodes, bit_xor(('0x' || substr(md5(line), 1, 8))::bigint) as digest from l group by transform_id")
def txt_context(spark: SparkSession, d: str) -> DataFrame:
    return cascade.context_lines(table(spark, d, "graph_nodes"))


@query(
    "sch_typed_view",
    "select id, transform_id_ as slug, trim(properties['name']) as name, try_cast(trim(properties['birth_year']) as bigint) as birth_year, trim(properties['city']) as city from (select *, slug as transform_id_ from expected_nodes) where type = 'Person' and trim(properties['name']) <> '' and (properties['birth_year'] is null or trim(properties['birth_year']) = '' or try_cast(trim(properties['birth_year']) as bigint) is not null)",
)
def sch_typed_view(spark: SparkSession, d: str) -> DataFrame:
    defs = ontology.normalised(ONTOLOGY)["prop_defs"]
    own = table(spark, d, "expected_nodes").withColumn("id", F.struct("id", "slug"))
    return ontology.typed_view(own, "Person", defs, "type").select("id.id", "id.slug", "name", "birth_year", "city")


@query(
    "set_materialised",
    """with b as (select * from production_nodes), u as (select id from b where valid_to is not null), r as (select id from b where substr(id, 1, 1) = 'a')
select id, 'kept' as origin from b where id not in (select id from r) and id not in (select id from u) union all select id, 'updated' from u union all select 'new-' || id, 'added' from r""",
)
def set_materialised(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "production_nodes").select("id", "valid_to", F.lit("kept").alias("origin"))
    removed = base.where(F.substring("id", 1, 1) == "a")
    updated = base.where("valid_to is not null").withColumn("origin", F.lit("updated"))
    added = removed.withColumn("id", F.concat(F.lit("new-"), "id")).withColumn("origin", F.lit("added"))
    return versioning.materialised(base, removed, added, updated).select("id", "origin")


@query(
    "set_ledger_upsert",
    """with a as (select user_id, type, canonical_key, max(canonical_id) as canonical_id, min(created_at) as first_seen_at, max(updated_at) as updated_at from node_snapshots where seq_no <= 2 and canonical_key is not null group by all),
b as (select user_id, type, canonical_key, max(canonical_id) as canonical_id, max(updated_at) as updated_at from node_snapshots where seq_no > 2 and canonical_key is not null group by all)
select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.type, b.type) as type, coalesce(a.canonical_key, b.canonical_key) as canonical_key, coalesce(b.canonical_id, a.canonical_id) as canonical_id, coalesce(a.first_seen_at, b.updated_at) as first_seen_at, coalesce(b.updated_at, a.updated_at) as updated_at
from a full join b on a.user_id = b.user_id and a.type = b.type and a.canonical_key = b.canonical_key""",
)
def set_ledger_upsert(spark: SparkSession, d: str) -> DataFrame:
    keys = ["user_id", "type", "canonical_key"]
    snap = table(spark, d, "node_snapshots").where("canonical_key is not null")
    a = snap.where("seq_no <= 2").groupBy(*keys).agg(F.max("canonical_id").alias("canonical_id"), F.min("created_at").alias("first_seen_at"), F.max("updated_at").alias("updated_at"))
    b = snap.where("seq_no > 2").groupBy(*keys).agg(F.max("canonical_id").alias("canonical_id"), F.max("updated_at").alias("updated_at"))
    return versioning.upserted(a, b, keys)


@query("clu_content_dedupe", "select min(id) as id, type_, count(*) as n from (select id, type_, list_sort(map_entries(properties)) as p from graph_nodes) group by type_, p")
def clu_content_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_nodes").groupBy("type_", identity.sorted_json(F.col("properties")).alias("p")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).drop("p")


@query("clu_id_dedupe", "select id, max(confidence_score) as confidence, count(*) as n_versions from graph_nodes group by id")
def clu_id_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_nodes").groupBy("id").agg(F.max("confidence_score").alias("confidence"), F.count(F.lit(1)).alias("n_versions"))


@query("src_edge_upsert", "select id, max(loaded_at) as loaded_at, count(*) as n from graph_edges group by id")
def src_edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "graph_edges")
    return latest_rows(e).select("id", "loaded_at").join(e.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id")
