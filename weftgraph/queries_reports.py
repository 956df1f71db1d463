"""Queries of contexts, summaries, progress, benches and schema search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators import extraction, graph, logs, matching_cascade, resolution, review
from weftgraph.plans.ontology_rules import iso_time
from weftgraph.registry import query
from weftgraph.sources import table


@query(
    "txt_context_text",
    """with l as (select distinct transform_id, '[' || coalesce(type_, '_') || '] ' || id || case when len(t) > 0 then ': ' || array_to_string(t, '; ') else '' end as line from (select transform_id, type_, id, list_filter([case when trim(properties['name']) <> '' then 'name=' || trim(properties['name']) end, case when trim(properties['city']) <> '' then 'city=' || trim(properties['city']) end], lambda x: x is not null) as t from graph_nodes)),
r as (select *, row_number() over (partition by transform_id order by line) as place from l) select transform_id, count(*) as n_lines, md5(array_to_string(list(line order by line), chr(10))) as digest from r where place <= 20 group by transform_id""",
)
def txt_context_text(spark: SparkSession, d: str) -> DataFrame:
    line = extraction.context_line(F.col("type_"), F.col("id"), F.col("properties"), ["name", "city"])
    out = extraction.context_texts(table(spark, d, "graph_nodes").select("transform_id", line.alias("line")), "transform_id", 20)
    return out.select("transform_id", "n_lines", F.md5("text").alias("digest"))


@query(
    "grf_type_summary",
    """with s as (select type_, count(*) as n from graph_nodes where type_ is not null group by 1), c as (select type_, k, count(*) as c from (select type_, unnest(map_keys(properties)) as k from graph_nodes where type_ is not null) group by all),
t as (select type_, array_to_string(list(k order by c desc, k), ',') as keys from (select *, row_number() over (partition by type_ order by c desc, k) as p from c) where p <= 6 group by type_),
m as (select type_, array_to_string(list(v order by v), ',') as samples from (select *, row_number() over (partition by type_ order by v) as p from (select distinct type_, properties['name'] as v from graph_nodes where type_ is not null and properties['name'] is not null)) where p <= 5 group by type_)
select s.type_, n, keys, samples from s left join t on t.type_ = s.type_ left join m on m.type_ = s.type_""",
)
def grf_type_summary(spark: SparkSession, d: str) -> DataFrame:
    return extraction.type_summary(table(spark, d, "graph_nodes"))


@query("evl_bench", "with m as (select distinct source_extractor_model as extractor from claims where source_extractor_model is not null), u as (select distinct user_id as entry from expected_nodes where user_id is not null), r as (select source_extractor_model as extractor, user_id as entry, count(*) as n from claims group by all) select m.extractor, u.entry, coalesce(r.n, 0) as n, case when r.n is null then 'missing' else 'scored' end as status from m cross join u left join r on r.extractor = m.extractor and r.entry = u.entry")
def evl_bench(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "claims").select(F.col("source_extractor_model").alias("extractor"), F.col("user_id").alias("entry"))
    entries = table(spark, d, "expected_nodes").where("user_id is not null").select(F.col("user_id").alias("entry")).distinct()
    # Every extractor is run on every entry: extractors are a handful of names.
    runs = entries.join(F.broadcast(claims.where("extractor is not null").select("extractor").distinct()), how="cross")
    return runs.join(claims.groupBy("extractor", "entry").agg(F.count(F.lit(1)).alias("n")), ["extractor", "entry"], "left").select("extractor", "entry", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "missing").otherwise("scored").alias("status"))


@query(
    "sch_search",
    r"""with w as (select entity_type, string_split_regex(lower(description), '[^a-z]+') as w from entity_types), u as (select type_ as entity_type, count(*) as uses from graph_nodes group by 1),
s as (select w.entity_type, round(least(1.0, (len(list_intersect(['service', 'software', 'security'], w)) + 0.5 * len(list_filter(['service', 'software', 'security'], lambda t: not list_contains(w, t) and len(list_filter(w, lambda x: contains(x, t) or contains(t, x))) > 0))) / 3), 6)::double as score, coalesce(u.uses, 0) as uses from w left join u on u.entity_type = w.entity_type)
select * from s where score > 0 order by score desc, uses desc, entity_type limit 5""",
)
def sch_search(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array(*(F.lit(t) for t in ("service", "software", "security")))
    uses = table(spark, d, "graph_nodes").groupBy(F.col("type_").alias("entity_type")).agg(F.count(F.lit(1)).alias("uses"))
    scored = table(spark, d, "entity_types").select("entity_type", F.round(matching_cascade.term_score(terms, F.split(F.lower("description"), "[^a-z]+")), 6).alias("score"))
    found = scored.where("score > 0").join(uses, "entity_type", "left").select("entity_type", "score", F.coalesce("uses", F.lit(0)).alias("uses"))
    return found.orderBy(F.desc("score"), F.desc("uses"), "entity_type").limit(5)


@query("src_usage_runs", "select user_id, min(ts) as started, max(ts) as finished, arg_max(case when value < 20 then 'failed' else 'success' end, struct_pack(a := ts, b := case when value < 20 then 'failed' else 'success' end)) as status, count(*) as n_events from events group by user_id")
def src_usage_runs(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").select("user_id", "ts", F.when(F.col("value") < 20, "failed").otherwise("success").alias("status"))
    return logs.latest_status(own, "user_id", "ts")


@query("str_progress", "select transform_id, source_stage, count(*) as n, count(*) filter (status <> 'pending') as n_done, round(100.0 * count(*) filter (status <> 'pending') / count(*), 2)::double as percent, max(created_at) as last_at from disputed_pairs group by all")
def str_progress(spark: SparkSession, d: str) -> DataFrame:
    done = F.count_if(F.col("status") != "pending")
    return table(spark, d, "disputed_pairs").groupBy("transform_id", "source_stage").agg(F.count(F.lit(1)).alias("n"), done.alias("n_done"), F.round(done * 100.0 / F.count(F.lit(1)), 2).alias("percent"), F.max("created_at").alias("last_at"))


@query("str_stale", "select transform_id, max(loaded_at) as last_at from graph_nodes group by transform_id having max(loaded_at) < (select max(loaded_at) from graph_nodes) - interval 30 days")
def str_stale(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "graph_nodes")
    last = n.groupBy("transform_id").agg(F.max("loaded_at").alias("last_at"))
    return last.where(F.col("last_at") < n.agg(F.max("loaded_at")).scalar() - F.expr("interval 30 days"))


@query("str_prompts", "select md5(text) as key, count(*) as n, min(length(text)) as answer from documents where text is not null group by 1")
def str_prompts(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("prompt"))
    answers = extraction.answered_once(own, lambda p: str(len(p)))
    return own.join(answers, "id").groupBy(F.md5("prompt").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("answer").cast("bigint").alias("answer"))


@query("fn_formats", "select id, printf('%.2f', confidence) as two, printf('%.0f%%', confidence * 100) as percent, printf('%08.3f', confidence) as padded from claims where confidence is not null and abs(confidence * 1000 - floor(confidence * 1000)) not between 0.45 and 0.55 and abs(confidence * 100 - floor(confidence * 100)) not between 0.45 and 0.55")
def fn_formats(spark: SparkSession, d: str) -> DataFrame:
    # Halves are left out: engines round them to different sides.
    c = F.col("confidence")
    half = lambda n: F.abs(c * n - F.floor(c * n)).between(0.45, 0.55)
    own = table(spark, d, "claims").where(c.isNotNull() & ~half(1000) & ~half(100))
    return own.select("id", F.format_string("%.2f", c).alias("two"), F.format_string("%.0f%%", c * 100).alias("percent"), F.format_string("%08.3f", c).alias("padded"))


@query("fn_iso_times", r"select property_key, count(*) filter (regexp_full_match(v, '\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?') and try_cast(v as timestamp) is not null) as n_times, count(*) as n from (select property_key, regexp_replace(value, '^\"+|\"+$', '', 'g') as v from claims where value is not null) group by property_key")
def fn_iso_times(spark: SparkSession, d: str) -> DataFrame:
    v = F.regexp_replace("value", '^"+|"+$', "")
    return table(spark, d, "claims").where("value is not null").groupBy("property_key").agg(F.count(iso_time(v)).alias("n_times"), F.count(F.lit(1)).alias("n"))


@query(
    "agg_learning_text",
    "with r as (select distinct entity_type, label_reason, status, id from disputed_pairs where label_reason is not null and status in ('labeled_match', 'labeled_not_match')), p as (select *, row_number() over (partition by entity_type order by id, status, label_reason) as place from r) select entity_type, count(*) as n, array_to_string(list(place || '. ' || status || ': ' || label_reason order by place), chr(10)) as text from p where place <= 10 group by entity_type",
)
def agg_learning_text(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "disputed_pairs").where("label_reason is not null and status in ('labeled_match', 'labeled_not_match')").select("entity_type", "label_reason", "status", "id").distinct()
    few = review.first_rows(own, ["entity_type"], [F.asc("id"), F.asc("status"), F.asc("label_reason")], 10, F.col("id"))
    line = F.concat(F.col("place").cast("string"), F.lit(". "), "status", F.lit(": "), "label_reason")
    return few.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


@query("set_feedback_history", "select user_id, id, place from (select user_id, id, row_number() over (partition by user_id order by created_at desc, id) as place from (select user_id, id, max(created_at) as created_at from disputed_pairs where label_reason is not null group by all)) where place <= 3")
def set_feedback_history(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "disputed_pairs").where("label_reason is not null").groupBy("user_id", "id").agg(F.max("created_at").alias("created_at"))
    return review.first_rows(own, ["user_id"], [F.desc("created_at"), F.asc("id")], 3, F.col("id")).select("user_id", "id", "place")


@query(
    "prj_neighbour_properties",
    """with p as (select distinct from_ as id, to_ as neighbour from graph_edges where from_ <> to_ union select distinct to_, from_ from graph_edges where from_ <> to_), t as (select distinct id, type_ from graph_nodes),
m as (select distinct p.id, p.neighbour from p join t a on a.id = p.id join t b on b.id = p.neighbour where a.type_ = b.type_), r as (select *, row_number() over (partition by id order by neighbour) as n from m), nm as (select id, max(properties['name']) as name from graph_nodes group by id)
select r.id, 'neighbor_' || n || '_name' as key, nm.name as value from r join nm on nm.id = r.neighbour where n <= 3 and nm.name is not null""",
)
def prj_neighbour_properties(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = table(spark, d, "graph_nodes"), table(spark, d, "graph_edges")
    names = nodes.groupBy(F.col("id").alias("neighbour")).agg(F.max(F.col("properties")["name"]).alias("value"))
    near = graph.in_type_neighbours(nodes, edges).join(names, "neighbour").where("value is not null")
    return near.select("id", F.concat(F.lit("neighbor_"), F.col("rank").cast("string"), F.lit("_name")).alias("key"), "value")


@query("grf_transform_data", "with t as (select min(transform_id) as t from graph_nodes) select 'node' as kind, id from graph_nodes, t where transform_id = t union select 'edge', id from graph_edges, t where transform_id = t")
def grf_transform_data(spark: SparkSession, d: str) -> DataFrame:
    g = graph.PropertyGraph(table(spark, d, "graph_nodes"), table(spark, d, "graph_edges")).of_transform(g_first(spark, d))
    return g.nodes.select(F.lit("node").alias("kind"), "id").unionByName(g.edges.select(F.lit("edge").alias("kind"), "id")).distinct()


def g_first(spark: SparkSession, d: str) -> str:
    return table(spark, d, "graph_nodes").agg(F.min("transform_id")).first()[0]


@query("qr_validator_backfill", "with m as (select transform_id, round(avg(provenance.validator_score), 6) as pass_score from graph_nodes group by 1) select n.id, n.valid_from, n.loaded_at, round(coalesce(n.provenance.validator_score, m.pass_score), 6) as validator_score from graph_nodes n join m on m.transform_id = n.transform_id")
def qr_validator_backfill(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "graph_nodes").select("id", "valid_from", "loaded_at", "transform_id", F.col("provenance")["validator_score"].alias("own"))
    means = n.groupBy("transform_id").agg(F.round(F.avg("own"), 6).alias("pass_score"))
    return n.join(means, "transform_id").select("id", "valid_from", "loaded_at", F.round(F.coalesce("own", "pass_score"), 6).alias("validator_score"))


@query("clu_multi_pass", "select type_, coalesce(case when canonical_id <> '' then 'c:' || canonical_id end, 'i:' || id) as key, min(id) as id, count(distinct id) as n_ids, max(coalesce(confidence_score, 0)) as confidence from graph_nodes group by all")
def clu_multi_pass(spark: SparkSession, d: str) -> DataFrame:
    key = F.coalesce(F.when(F.col("canonical_id") != "", F.concat(F.lit("c:"), "canonical_id")), F.concat(F.lit("i:"), "id"))
    return table(spark, d, "graph_nodes").groupBy("type_", key.alias("key")).agg(F.min("id").alias("id"), F.count_distinct("id").alias("n_ids"), F.max(F.coalesce("confidence_score", F.lit(0.0))).alias("confidence"))


@query("jn_typed_cosine", "with s as (select a.vec_id as query_id, b.vec_id, round(least(1, greatest(0, list_cosine_similarity(a.embedding::double[], b.embedding::double[]))), 6) as score from embeddings a join embeddings b on a.vec_id % 100 = 0 and a.label = b.label and a.vec_id <> b.vec_id) select * from s where score >= 0.2")
def jn_typed_cosine(spark: SparkSession, d: str) -> DataFrame:
    pairs = resolution.query_pairs(table(spark, d, "embeddings"), ["label"], F.col("vec_id") % 100 == 0).where("vec_id_a <> vec_id_b")
    return pairs.select(F.col("vec_id_a").alias("query_id"), F.col("vec_id_b").alias("vec_id"), F.round(resolution.cosine(F.col("embedding_a"), F.col("embedding_b")), 6).alias("score")).where("score >= 0.2")


@query("txt_extracted")
def txt_extracted(spark: SparkSession, d: str) -> DataFrame:
    from weftgraph.operators import chunking

    return extraction.extracted_nodes(chunking.chunks(table(spark, d, "documents")))


@query("agg_type_shares_by_user", "with c as (select user_id, type_, count(*) as n from graph_nodes where type_ is not null group by all) select user_id, type_, n, round(n / sum(n) over (partition by user_id), 6)::double as share from c")
def agg_type_shares_by_user(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "graph_nodes").where("type_ is not null").groupBy("user_id", "type_").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("user_id")), 6))
