"""Queries on edges over time, sinks, merges and append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import edges as edge_ops
from weftgraph.operators import logs, matching_cascade, review
from weftgraph.functions import identity, text
from weftgraph.operators.snapshot_diff import BOOKKEEPING_KEYS
from weftgraph.registry import query
from weftgraph.sources import files, table

SYSTEM = ", ".join(f"'{k}'" for k in BOOKKEEPING_KEYS)
_PROPS = f"list_sort(list_filter(map_entries(properties), lambda e: e.value is not null and e.key not in ({SYSTEM})))"
_KEYS = "k as (select id, min(coalesce(case when canonical_id <> '' then type_ || ':' || canonical_id end, case when canonical_key <> '' then type_ || ':' || canonical_key end, '__local__:' || id)) as key from graph_nodes group by id)"


@query(
    "set_edge_diff",
    f"""with {_KEYS}, e as (select a.key as source_key, b.key as target_key, relationship, e.created_at < timestamp '2024-01-01' as old, to_json({_PROPS})::varchar as p from graph_edges e join k a on a.id = e.from_ join k b on b.id = e.to_ where relationship is not null),
x as (select source_key, target_key, relationship, max(p) as p from e where old group by all), y as (select source_key, target_key, relationship, max(p) as p from e where not old group by all)
select coalesce(x.source_key, y.source_key) as source_key, coalesce(x.target_key, y.target_key) as target_key, coalesce(x.relationship, y.relationship) as relationship, case when x.p is null then 'added' when y.p is null then 'removed' else 'changed' end as change
from x full join y on x.source_key = y.source_key and x.target_key = y.target_key and x.relationship = y.relationship where x.p is null or y.p is null or x.p <> y.p""",
)
def set_edge_diff(spark: SparkSession, d: str) -> DataFrame:
    from weftgraph.plans.skew import salted_join

    keys = table(spark, d, "graph_nodes").groupBy("id").agg(F.min(identity.diff_key(F.col("type_"), F.col("canonical_id"), F.col("canonical_key"), F.col("id"))).alias("key"))
    e = table(spark, d, "graph_edges").where("relationship is not null").select("id", "from_", "to_", "relationship", "properties", "created_at")
    both = salted_join(e, keys.select(F.col("id").alias("from_"), F.col("key").alias("source_key")), ["from_"], "inner", F.col("id"))
    both = salted_join(both, keys.select(F.col("id").alias("to_"), F.col("key").alias("target_key")), ["to_"], "inner", F.col("id")).where("source_key is not null and target_key is not null")
    old = F.col("created_at") < F.lit("2024-01-01").cast("timestamp_ntz")
    return edge_ops.edge_diff(both.where(old), both.where(~old))


@query(
    "set_edge_versions",
    f"""with f as (select from_, to_, relationship, loaded_at as ts, unnest(case when len({_PROPS}) > 0 then {_PROPS} else [null] end) as e from graph_edges where from_ is not null and to_ is not null and relationship is not null),
o as (select from_, to_, relationship, ts, e.key as k, max(e.value) as v from f group by all), c as (select *, case when k is not null and v is distinct from lag(v) over (partition by from_, to_, relationship, k order by ts) then 1 else 0 end as changes from o),
r as (select from_, to_, relationship, ts, sum(changes) as n_changed from c group by all), n as (select *, row_number() over (partition by from_, to_, relationship order by ts) as n from r)
select from_, to_, relationship, row_number() over w as version_no, ts as valid_from, lead(ts) over w as valid_to, n_changed::bigint as n_changed from n where n = 1 or n_changed > 0 window w as (partition by from_, to_, relationship order by ts)""",
)
def set_edge_versions(spark: SparkSession, d: str) -> DataFrame:
    return edge_ops.edge_versions(table(spark, d, "graph_edges"))


@query("src_edge_sink", "with k as (select distinct id from graph_nodes) select distinct id, 'from_' as missing_end from graph_edges where from_ is null or from_ not in (select id from k) union select distinct id, 'to_' from graph_edges where to_ is null or to_ not in (select id from k)")
def src_edge_sink(spark: SparkSession, d: str) -> DataFrame:
    return edge_ops.edge_sink(table(spark, d, "graph_edges").select("id", "from_", "to_"), table(spark, d, "graph_nodes"))[1]


@query(
    "src_node_upsert",
    """with f as (select id, valid_from, loaded_at, 0 as rank, unnest(map_entries(properties)) as e from graph_nodes union all select id, valid_from, loaded_at, 1, unnest(map_entries(canonical_properties)) from graph_nodes)
select id, e.key as key, arg_max(e.value, struct_pack(a := valid_from, b := loaded_at, c := rank, d := e.value)) as value from f where e.value is not null group by id, e.key""",
)
def src_node_upsert(spark: SparkSession, d: str) -> DataFrame:
    return edge_ops.upserted_nodes(table(spark, d, "graph_nodes"))


@query("jn_between", "with p as (select distinct from_ as a, to_ as b from graph_edges where relationship = 'OWNS' and from_ is not null and to_ is not null) select distinct id from graph_edges e where exists (select 1 from p where (p.a = e.from_ and p.b = e.to_) or (p.b = e.from_ and p.a = e.to_))")
def jn_between(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "graph_edges").select("id", "from_", "to_", "relationship")
    pairs = e.where("relationship = 'OWNS' and from_ is not null and to_ is not null").select(F.col("from_").alias("a"), F.col("to_").alias("b"))
    return edge_ops.between(e, pairs, either=True).select("id").distinct()


@query(
    "jn_remerge",
    """with e as (select from_, to_, relationship, id, properties, created_at >= timestamp '2024-03-01' as staged from graph_edges where from_ is not null and to_ is not null and relationship is not null), k as (select distinct from_, to_, relationship from e where staged),
m as (select e.from_, e.to_, e.relationship, e.id, staged, properties from e join k on k.from_ = e.from_ and k.to_ = e.to_ and k.relationship = e.relationship),
i as (select from_, to_, relationship, arg_min(id, struct_pack(a := staged, b := id)) as id from m group by all), f as (select from_, to_, relationship, staged, unnest(map_entries(properties)) as e from m),
v as (select from_, to_, relationship, e.key as key, arg_max(e.value, struct_pack(a := staged, b := e.value)) as value from f where e.value is not null group by all)
select i.from_, i.to_, i.relationship, i.id, v.key, v.value from i left join v on v.from_ = i.from_ and v.to_ = i.to_ and v.relationship = i.relationship""",
)
def jn_remerge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "graph_edges").where("from_ is not null and to_ is not null and relationship is not null")
    staged = F.col("created_at") >= F.lit("2024-03-01").cast("timestamp_ntz")
    return edge_ops.reconciled_edges(e.where(staged), e.where(~staged))


@query(
    "prj_relationship_normalise",
    """select id, relationship, case when source_type = 'Company' and relationship = 'OWNS' and trim(properties['since']) is not null then trim(properties['since']) end as since,
case when source_type = 'Person' and relationship = 'WORKS_AT' then trim(properties['role']) end as role from graph_edges
where not coalesce(source_type = 'Company' and relationship = 'OWNS' and properties['since'] is not null and not regexp_full_match(trim(properties['since']), '[+-]?[0-9]+'), false)""",
)
def prj_relationship_normalise(spark: SparkSession, d: str) -> DataFrame:
    out = edge_ops.normalised_relationships(table(spark, d, "graph_edges"), {("Company", "OWNS"): {"since": "integer"}, ("Person", "WORKS_AT"): {"role": "string"}})
    return out.select("id", "relationship", F.col("properties")["since"].alias("since"), F.col("properties")["role"].alias("role"))


@query("prj_case_formats", r"select distinct id, lower(label) as low, upper(label) as up, array_to_string(list_transform(regexp_extract_all(lower(label), '\p{L}+|\P{L}+'), lambda w: upper(w[1]) || substr(w, 2)), '') as title from expected_nodes where label is not null and regexp_full_match(label, '[ -~]*')")
def prj_case_formats(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "expected_nodes").where("label is not null and label rlike '^[ -~]*$'")
    return own.select("id", *(text.case_format(F.col("label"), s).alias(n) for n, s in (("low", "lowercase"), ("up", "uppercase"), ("title", "titlecase")))).distinct()


@query("prj_enum", "select id, case lower(trim(properties['status'])) when 'active' then 'Active' when 'closed' then 'Closed' when 'pending' then 'Pending' end as status from node_snapshots where properties['status'] is not null")
def prj_enum(spark: SparkSession, d: str) -> DataFrame:
    from weftgraph.operators.ontology import snapped

    own = table(spark, d, "node_snapshots").where(F.col("properties")["status"].isNotNull())
    return own.select("id", snapped(F.col("properties")["status"], ["Active", "Closed", "Pending"]).alias("status"))


@query(
    "prj_canonical_map",
    """select id, valid_from, loaded_at, e.key as key, lower(trim(regexp_replace(e.value, '\\s+', ' ', 'g'))) as value from (select id, valid_from, loaded_at, unnest(map_entries(properties)) as e from graph_nodes) where e.value is not null""",
)
def prj_canonical_map(spark: SparkSession, d: str) -> DataFrame:
    canonical = F.transform_values(F.map_filter("properties", lambda k, v: v.isNotNull()), lambda k, v: F.lower(text.collapse(v)))
    return table(spark, d, "graph_nodes").select("id", "valid_from", "loaded_at", F.explode(canonical).alias("key", "value"))


@query("prj_flattened", "select id, transform_id, loaded_at, 'p_' || e.key as key, e.value as value from (select id, transform_id, loaded_at, unnest(map_entries(properties)) as e from node_snapshots) where e.value is not null and not starts_with(e.value, '{')")
def prj_flattened(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "node_snapshots").select("id", "transform_id", "loaded_at", F.explode(edge_ops.flattened(F.col("properties"), "p_")).alias("e"))
    return own.select("id", "transform_id", "loaded_at", "e.key", "e.value")


@query("src_chunk_page", r"select document_name, try_cast(nullif(regexp_extract(document_name, '_(\d+)\.', 1), '') as int) as page from (select distinct document_name from documents where document_name is not null)")
def src_chunk_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("document_name is not null").select("document_name").distinct().select("document_name", files.page_number(F.col("document_name")).alias("page"))


@query("src_evidence_text", "select doc_id, case when length(text) <= 2000 then text end as source_text from documents")
def src_evidence_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", files.evidence_text(F.col("text"), 2000).alias("source_text"))


@query(
    "src_capabilities",
    """select * from (values ('memory', false, false, true, false, false, ''), ('neo4j', true, true, true, false, true, ''), ('postgres_age', true, false, true, false, false, 'full_text_indexes')) t(backend, persistent, full_text_indexes, similarity_search, embedding_similarity, per_user_routing, told_at_run_time)""",
)
def src_capabilities(spark: SparkSession, d: str) -> DataFrame:
    return files.backend_capabilities(spark)


@query("set_decisions", "select entity_type, status, count(*) as n, count(distinct transform_id) as n_transforms from disputed_pairs where status <> 'pending' group by all")
def set_decisions(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "disputed_pairs").where("status <> 'pending'").select("user_id", "transform_id", F.col("id").alias("target_id"), F.lit("pair").alias("target_kind"), F.col("status").alias("decision_type"), F.col("created_at").alias("at"), "entity_type")
    return logs.entries(log, target_kind="pair").groupBy("entity_type", F.col("decision_type").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("transform_id").alias("n_transforms"))


@query("set_claims_valid", "select id, case when confidence is null or confidence < 0 or confidence > 1 then 'confidence' when target_kind is null or target_kind not in ('node', 'edge') then 'target_kind' when trim(target_id) = '' or target_id is null then 'target_id' when trim(property_key) = '' or property_key is null then 'property_key' end as problem from claims")
def set_claims_valid(spark: SparkSession, d: str) -> DataFrame:
    return logs.checked_claims(table(spark, d, "claims")).select("id", "problem")


@query(
    "agg_audit",
    """with l as (select event_type as kind, case when value < 20 then 'failure' else 'success' end as status from events)
select 'type' as what, kind as name, count(*) as n from l where status = 'success' group by kind union all select 'status', status, count(*) from l group by status""",
)
def agg_audit(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.when(F.col("value") < 20, "failure").otherwise("success").alias("status"))
    return logs.audit_summary(log)


@query("agg_feedback", "select lower(label_reason) as feedback_type, count(*) as n from disputed_pairs where label_reason is not null group by 1")
def agg_feedback(spark: SparkSession, d: str) -> DataFrame:
    return logs.counts(table(spark, d, "disputed_pairs").where("label_reason is not null").select(F.lower("label_reason").alias("feedback_type")), "feedback_type")


@query(
    "agg_popularity",
    """with e as (select event_type, user_id, row_number() over (partition by event_type order by ts desc, event_id) as n from events), a as (select event_type, count(*) as n_uses, count(distinct case when n <= 20 then user_id end) as recent_users from e group by event_type)
select event_type, n_uses, recent_users, round(least(0.1 * n_uses + 0.5 * recent_users, 10), 4)::double as popularity from a""",
)
def agg_popularity(spark: SparkSession, d: str) -> DataFrame:
    return logs.popularity(table(spark, d, "events"), "event_type", "user_id", [F.desc("ts"), F.asc("event_id")], F.col("event_id")).withColumn("popularity", F.round("popularity", 4))


@query("agg_session_counts", "select user_id, count(*) as n_messages, max(ts) as last_at from events group by user_id")
def agg_session_counts(spark: SparkSession, d: str) -> DataFrame:
    return logs.session_counts(table(spark, d, "events"), "user_id", "ts")


@query("agg_hit_rates", "with h as (select event_type, count(*) filter (value >= 50) as hits, count(*) filter (value < 50) as misses from events group by event_type) select event_type, hits, misses, round(case when hits + misses = 0 then 0 else hits / (hits + misses) end, 6)::double as hit_rate from h")
def agg_hit_rates(spark: SparkSession, d: str) -> DataFrame:
    return logs.hit_rates(table(spark, d, "events"), "event_type", F.col("value") >= 50).withColumn("hit_rate", F.round("hit_rate", 6))


@query(
    "agg_batches",
    "select transform_id, count(*) as n_batches, sum(case when confidence >= 0.2 then 1 else 0 end)::bigint as n_done, bool_and(coalesce(confidence >= 0.2, false)) as success, count(distinct case when not coalesce(confidence >= 0.2, false) then property_key end) as n_warnings from claims where transform_id is not null group by transform_id",
)
def agg_batches(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "claims").where("transform_id is not null")
    ok = F.coalesce(F.col("confidence") >= 0.2, F.lit(False))
    return logs.batch_summary(own.select("transform_id", ok.alias("success"), F.when(~ok, F.col("property_key")).alias("warning")), "transform_id")


@query("agg_profile", "select coalesce(n.transform_id, e.transform_id) as transform_id, coalesce(n_nodes, 0) as n_nodes, coalesce(n_edges, 0) as n_edges, coalesce(n_node_types, 0) as n_node_types, coalesce(n_edge_types, 0) as n_edge_types from (select transform_id, count(*) as n_nodes, count(distinct type_) as n_node_types from graph_nodes group by 1) n full join (select transform_id, count(*) as n_edges, count(distinct relationship) as n_edge_types from graph_edges group by 1) e on e.transform_id = n.transform_id")
def agg_profile(spark: SparkSession, d: str) -> DataFrame:
    return logs.result_profile(table(spark, d, "graph_nodes"), table(spark, d, "graph_edges"))


@query("agg_claim_count", "select user_id, count(*) as n from claims where confidence >= 0.5 group by user_id")
def agg_claim_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claims").where("confidence >= 0.5").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("jn_run_hydration", "with c as (select transform_id, count(*) as n_claims, round(avg(confidence), 6) as mean_confidence from claims group by 1) select n.transform_id, n.n_nodes, coalesce(c.n_claims, 0) as n_claims, c.mean_confidence from (select transform_id, count(*) as n_nodes from graph_nodes group by 1) n left join c on c.transform_id = n.transform_id")
def jn_run_hydration(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "graph_nodes").groupBy("transform_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    usage = table(spark, d, "claims").groupBy("transform_id").agg(F.count(F.lit(1)).alias("n_claims"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return runs.join(usage, "transform_id", "left").select("transform_id", "n_nodes", F.coalesce("n_claims", F.lit(0)).alias("n_claims"), "mean_confidence")


@query("jn_conflict_summary", "select user_id, entity_type, count(*) as n from disputed_pairs where status = 'pending' and lower(trim(node_a_id)) in (select id from expected_nodes) group by all")
def jn_conflict_summary(spark: SparkSession, d: str) -> DataFrame:
    open_pairs = table(spark, d, "disputed_pairs").where("status = 'pending'")
    known = table(spark, d, "expected_nodes").select(F.col("id").alias("node")).distinct()
    return open_pairs.withColumn("node", F.lower(F.trim("node_a_id"))).join(known, "node", "left_semi").groupBy("user_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))


@query("set_pairs_of_transform", "select transform_id, id, status, created_at from disputed_pairs where transform_id = (select min(transform_id) from disputed_pairs) group by all")
def set_pairs_of_transform(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "disputed_pairs")
    return p.where(F.col("transform_id") == p.agg(F.min("transform_id")).scalar()).select("transform_id", "id", "status", "created_at").distinct()


@query("set_review_queue", "select transform_id, count(*) as n_open from (select id, transform_id, arg_max(status, struct_pack(a := coalesce(labeled_at, created_at), b := status)) as status from disputed_pairs group by all) where status in ('pending', 'skipped') group by transform_id")
def set_review_queue(spark: SparkSession, d: str) -> DataFrame:
    latest = review.latest_of(table(spark, d, "disputed_pairs"), ["id", "transform_id"], F.coalesce("labeled_at", "created_at"), "status")
    return latest.where("status in ('pending', 'skipped')").groupBy("transform_id").agg(F.count(F.lit(1)).alias("n_open"))


@query("set_merge_ready", "select transform_id, bool_and(status in ('labeled_match', 'labeled_not_match')) as ready from (select id, transform_id, arg_max(status, struct_pack(a := coalesce(labeled_at, created_at), b := status)) as status from disputed_pairs group by all) group by transform_id")
def set_merge_ready(spark: SparkSession, d: str) -> DataFrame:
    latest = review.latest_of(table(spark, d, "disputed_pairs"), ["id", "transform_id"], F.coalesce("labeled_at", "created_at"), "status")
    return logs.ready(latest, "transform_id", F.col("status").isin("labeled_match", "labeled_not_match"))


@query("flt_time_window", "select count(*) as n, count(distinct user_id) as n_users from events where ts >= (select max(ts) from events) - interval 14 days")
def flt_time_window(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.where(F.col("ts") >= e.agg(F.max("ts")).scalar() - F.expr("interval 14 days")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"))


@query("flt_visible", "select doc_id from documents where (user_id = (select min(user_id) from documents) or lower(trim(source)) = 'journal') and lang = 'en'")
def flt_visible(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "user_id", "source", "lang")
    mine = docs.agg(F.min("user_id")).scalar()
    return logs.visible(docs, mine, F.lower(F.trim("source")) == "journal").where("lang = 'en'").select("doc_id")


@query(
    "flt_failures",
    """with m as (select label_reason as message, count(*) as n from disputed_pairs where label_reason is not null group by 1) select message, n, case when contains(lower(message), 'typo') or contains(lower(message), 'spell') then 'input' when contains(lower(message), 'same') or contains(lower(message), 'match') then 'duplicate' when contains(lower(message), 'differ') then 'conflict' else 'unknown' end as reason,
not (contains(lower(message), 'typo') or contains(lower(message), 'differ')) as recoverable from m""",
)
def flt_failures(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "disputed_pairs").where("label_reason is not null").groupBy(F.col("label_reason").alias("message")).agg(F.count(F.lit(1)).alias("n"))
    reason = logs.classified(F.col("message"), {"input": ("typo", "spell"), "duplicate": ("same", "match"), "conflict": ("differ",)})
    return own.select("message", "n", reason.alias("reason"), (~logs.has_any(F.col("message"), ("typo", "differ"))).alias("recoverable"))


@query("flt_required", r"select distinct id, array_to_string(list_filter(['name', 'city', 'status'], lambda k: coalesce(trim(properties[k]), '') = ''), ',') as missing from graph_nodes where type_ = 'Vessel' and len(list_filter(['name', 'city', 'status'], lambda k: coalesce(trim(properties[k]), '') = '')) > 0")
def flt_required(spark: SparkSession, d: str) -> DataFrame:
    gaps = matching_cascade.extraction_gaps(table(spark, d, "graph_nodes"), table(spark, d, "graph_edges").limit(0), {"Vessel": ["name", "city", "status"]}, 0.0)
    return gaps.where("gap_type = 'INCOMPLETE_ENTITY'").select("id", F.col("detail").alias("missing"))


@query("grf_merge_view", "select id, 'staging' as side from graph_nodes where valid_to is null union select id, 'production' from production_nodes where valid_to is null")
def grf_merge_view(spark: SparkSession, d: str) -> DataFrame:
    return logs.two_sides(table(spark, d, "graph_nodes").where("valid_to is null").select("id"), table(spark, d, "production_nodes").where("valid_to is null").select("id")).distinct()


@query("set_conflict_groups", "with b as (select id, type, properties['status'] as s, transform_id from node_snapshots) select type, count(distinct id) as n_nodes, count(distinct s) as n_values from b where s is not null group by type having count(distinct s) > 1")
def set_conflict_groups(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "node_snapshots").select("type", "id", F.col("properties")["status"].alias("s")).where("s is not null")
    return own.groupBy("type").agg(F.count_distinct("id").alias("n_nodes"), F.count_distinct("s").alias("n_values")).where("n_values > 1")
