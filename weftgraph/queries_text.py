"""Queries on documents and activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators import activity, chunking
from weftgraph.registry import query
from weftgraph.sources import files, table

_LINES = r"list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"
_COUNTS = rf"""c as (select doc_id, text, len(list_filter({_LINES}, lambda x: regexp_matches(x, '^(#+\s+|[#*-]\s+)'))) as h, len(list_filter({_LINES}, lambda x: regexp_matches(x, '^(\d+\.\s+|[-*+]\s+)'))) as i, len(list_filter({_LINES}, lambda x: length(x) > 50)) as p from documents where text is not null)"""


@query(
    "txt_classify",
    f"""with {_COUNTS} select doc_id, h as n_headings, i as n_items, p as n_paragraphs, case when h > 3 or i > 3 then 'structured' when length(text) > 5000 and p > 10 then 'narrative'
when contains(lower(text), 'function') or contains(lower(text), 'class') or contains(lower(text), 'api') then 'technical' else 'mixed' end as doc_class from c""",
)
def txt_classify(spark: SparkSession, d: str) -> DataFrame:
    h, i, p = chunking.line_counts(F.col("text"))
    big = lambda c, n: c.cast("bigint").alias(n)
    return table(spark, d, "documents").where("text is not null").select("doc_id", big(h, "n_headings"), big(i, "n_items"), big(p, "n_paragraphs"), chunking.document_class(F.col("text")).alias("doc_class"))


@query("txt_fixed_slices", "select doc_id, i - 1 as slice_index, length(substr(text, (i - 1) * 800 + 1, 800)) as n_chars, sha256(substr(text, (i - 1) * 800 + 1, 800)) as digest from (select doc_id, text, unnest(range(1, (length(text) + 799) // 800 + 1)) as i from documents where length(text) > 0)")
def txt_fixed_slices(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.fixed_slices(F.col("text"), 800)).alias("slice_index", "s"))
    return own.select("doc_id", F.col("slice_index").cast("bigint").alias("slice_index"), F.length("s").cast("bigint").alias("n_chars"), F.sha2("s", 256).alias("digest"))


@query(
    "txt_chunk_quality",
    rf"""with {_COUNTS} select doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) as n_words, len(list_filter(string_split(text, '.'), lambda s: regexp_replace(s, '\s+', '', 'g') <> '')) as n_sentences,
round(least(1.0, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) / 100)::double + case when (h > 3 or i > 3) and regexp_matches(text, '(?m)^(\d+\.\s+|#+\s+|[-*+]\s+)') then 0.2 else 0.0 end, 6)::double as score from c""",
)
def txt_chunk_quality(spark: SparkSession, d: str) -> DataFrame:
    m = chunking.chunk_measures(F.col("text"), chunking.document_class(F.col("text")))
    return table(spark, d, "documents").where("text is not null").select("doc_id", m["n_words"].cast("bigint").alias("n_words"), m["n_sentences"].cast("bigint").alias("n_sentences"), F.round(m["score"], 6).alias("score"))


@query(
    "txt_chunk_gate",
    r"""select doc_id, least(1.0, length(text) / 1000) >= 0.6 and coalesce(n_tokens, 0) > 0 and least(1.0, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) / 100) >= 0.5 as passes from documents where text is not null""",
)
def txt_chunk_gate(spark: SparkSession, d: str) -> DataFrame:
    m = chunking.chunk_measures(F.col("text"))
    scored = table(spark, d, "documents").where("text is not null").select("doc_id", F.least(F.lit(1.0), F.length("text") / 1000).alias("coherence"), F.when(F.coalesce("n_tokens", F.lit(0)) > 0, 1.0).otherwise(0.0).alias("relevance"), m["score"].alias("size_score"))
    return chunking.chunk_gate(scored)


@query(
    "txt_structure",
    rf"""with l as (select doc_id, unnest({_LINES}) as t from documents where text is not null)
select doc_id, count(*) filter (regexp_matches(t, '^#+\s+') or (regexp_matches(t, '^[A-Z][^.!?]*$') and length(t) < 100)) as n_headings, count(*) filter (regexp_matches(t, '^(\d+\.\s+|[-*+]\s+)')) as n_items,
count(*) filter (starts_with(t, '>') or starts_with(t, '"') or starts_with(t, '***')) as n_quotes from l group by doc_id""",
)
def txt_structure(spark: SparkSession, d: str) -> DataFrame:
    flags = chunking.structural_flags(F.col("line"))
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(*(F.count_if(flags[k]).alias(n) for k, n in (("heading", "n_headings"), ("item", "n_items"), ("quote", "n_quotes"))))


@query(
    "txt_chunk_summary",
    rf"""with {_COUNTS} select doc_id, case when h > 3 or i > 3 then 'structural' when length(text) > 5000 and p > 10 then 'semantic' else 'recursive' end as method from c where regexp_replace(text, '\s+', '', 'g') <> ''""",
)
def txt_chunk_summary(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(table(spark, d, "documents")).select("doc_id", "method").distinct()


@query(
    "txt_analysis",
    r"""with w as (select doc_id, length(text) as n_chars, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') as w from documents where text is not null)
select doc_id, n_chars, len(w) as n_words, (len(list_distinct(w)) / greatest(len(w), 1))::double as diversity from w""",
)
def txt_analysis(spark: SparkSession, d: str) -> DataFrame:
    from weftgraph.functions.text import words

    own = table(spark, d, "documents").where("text is not null").select("doc_id", F.length("text").cast("bigint").alias("n_chars"), words(F.lower("text")).alias("w"))
    return own.select("doc_id", "n_chars", F.size("w").cast("bigint").alias("n_words"), (F.size(F.array_distinct("w")) / F.greatest(F.size("w"), F.lit(1))).alias("diversity"))


@query(
    "txt_truncated",
    r"""with c as (select doc_id, text, regexp_replace(substr(text, 1, 290), chr(10) || '+$', '') || chr(10) || '[...truncated...]' || chr(10) || regexp_replace(right(text, 291), '^' || chr(10) || '+', '') as cut from documents where text is not null)
select doc_id, case when length(text) <= 600 then text else substr(regexp_replace(substr(cut, 1, 600), '\s+$', '') || chr(10), 1, 600) end as text from c""",
)
def txt_truncated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", chunking.truncated(F.col("text"), 600).alias("text"))


@query("txt_positions", "select doc_id, i - 1 as slice_index, (strpos(text, substr(text, (i - 1) * 800 + 1, 50)) - 1)::bigint as at from (select doc_id, text, unnest(range(1, (length(text) + 799) // 800 + 1)) as i from documents where length(text) > 0)")
def txt_positions(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select("doc_id", "text", F.posexplode(chunking.fixed_slices(F.col("text"), 800)).alias("slice_index", "s"))
    return own.select("doc_id", F.col("slice_index").cast("bigint").alias("slice_index"), chunking.positions(F.col("text"), F.col("s")).cast("bigint").alias("at"))


@query("txt_excerpts", r"select doc_id, contains(lower(regexp_replace(text, '\s+', ' ', 'g')), lower(trim(regexp_replace(substr(text, 20, 60), '\s+', ' ', 'g')))) as found from documents where text is not null")
def txt_excerpts(spark: SparkSession, d: str) -> DataFrame:
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    return table(spark, d, "documents").where("text is not null").select("doc_id", flat(F.col("text")).contains(F.trim(flat(F.substring("text", 20, 60)))).alias("found"))


@query("txt_chunks")
def txt_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(table(spark, d, "documents"))


@query("txt_html", r"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<(?:script\b.*?</script|style\b.*?</style|noscript\b.*?</noscript)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as text from documents where text is not null")
def txt_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", files.html_text(F.col("text")).alias("text"))


@query("txt_filenames", r"select distinct document_name, regexp_replace(regexp_replace(regexp_replace(document_name, '^.*[/\\]', ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+', '')[1:120] as safe from documents where document_name is not null")
def txt_filenames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("document_name is not null").select("document_name", files.safe_filename(F.col("document_name")).alias("safe")).distinct()


@query(
    "agg_daily_fill",
    """with d as (select unnest(generate_series(date '2024-01-01', date '2024-03-31', interval 1 day))::date as day), e as (select created_at::date as day, count(*) as n_documents, count(distinct user_id) as n_users from documents where created_at >= '2024-01-01' and created_at < '2024-04-01' group by 1)
select strftime(d.day, '%Y-%m-%d') as day, coalesce(n_documents, 0) as n_documents, coalesce(n_users, 0) as n_users from d left join e on e.day = d.day""",
)
def agg_daily_fill(spark: SparkSession, d: str) -> DataFrame:
    out = activity.daily(table(spark, d, "documents"), "created_at", "2024-01-01", "2024-03-31", F.count(F.lit(1)).alias("n_documents"), F.count_distinct("user_id").alias("n_users"))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("agg_percentiles", "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by event_type")
def agg_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = activity.percentiles(table(spark, d, "events"), "event_type", "value", 0.5, 0.95)
    return out.select("event_type", *(F.round(c, 6).alias(c) for c in ("p50", "p95")))


@query(
    "agg_roll_up",
    "select 'day' as period, date_trunc('day', ts)::timestamp as starts, count(*) as n, round(sum(value), 4) as total from events group by all union all select 'week', date_trunc('week', ts)::timestamp, count(*), round(sum(value), 4) from events group by all union all select 'month', date_trunc('month', ts)::timestamp, count(*), round(sum(value), 4) from events group by all",
)
def agg_roll_up(spark: SparkSession, d: str) -> DataFrame:
    out = activity.roll_up(table(spark, d, "events"), "ts", F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.withColumn("starts", F.col("starts").cast("timestamp_ntz"))


@query("agg_model_usage", "select source_extractor_model, count(*) as n, round(avg(confidence), 6) as mean_confidence, count(distinct target_id) as n_targets from claims group by 1")
def agg_model_usage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claims").groupBy("source_extractor_model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_distinct("target_id").alias("n_targets"))


@query("win_recent", "select user_id, doc_id, place from (select user_id, doc_id, row_number() over (partition by user_id order by created_at desc nulls last, doc_id) as place from documents where user_id is not null) where place <= 3")
def win_recent(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").where("user_id is not null").select("user_id", "doc_id", "created_at")
    return activity.top_by(own, ["user_id"], [F.col("created_at").desc_nulls_last(), F.col("doc_id")], 3).select("user_id", "doc_id", "place")


@query(
    "win_reason_rank",
    "select lower(label_reason) as reason, count(*) as n, min(similarity_score)::double as least from disputed_pairs where label_reason is not null group by 1 order by least, n desc, reason limit 5",
)
def win_reason_rank(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "disputed_pairs").where("label_reason is not null").groupBy(F.lower("label_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min("similarity_score").cast("double").alias("least"))
    return own.orderBy("least", F.desc("n"), "reason").limit(5)


@query(
    "str_rolling",
    "select event_id, round((sum(value::decimal(38, 12)) over w)::double / nullif(count(value) over w, 0), 9) as rolling, count(value) over w as n_rolling from events window w as (partition by event_type order by ts range between interval 1 day preceding and current row)",
)
def str_rolling(spark: SparkSession, d: str) -> DataFrame:
    return activity.rolling_mean(table(spark, d, "events"), "event_type", "ts", "value", 86_400).select("event_id", F.round("rolling", 9).alias("rolling"), "n_rolling")


@query(
    "str_ema",
    """with s as (select entity_type, list(similarity_score::double order by created_at, id) as s from (select distinct entity_type, similarity_score, created_at, id from disputed_pairs where similarity_score is not null and entity_type is not null) group by entity_type),
e as (select entity_type, len(s) as n, list_reduce(s, lambda a, x: a * 0.7 + x * 0.3) as ema from s)
select entity_type, n, round(ema, 6) as ema, round(case when ema >= 0.95 - 0.05 then 0.95 else least(greatest(ema - 0.05, 0.7), 0.95) end, 6) as threshold from e""",
)
def str_ema(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "disputed_pairs").where("similarity_score is not null and entity_type is not null").select("entity_type", "created_at", "id", F.col("similarity_score").cast("double").alias("x")).distinct()
    out = activity.smoothed_by(own, "entity_type", ["created_at", "id"], "x")
    return out.select("entity_type", "n", F.round("ema", 6).alias("ema"), F.round(activity.adaptive_threshold(F.col("ema"), 0.95), 6).alias("threshold"))


@query("str_label_states", "select id, status from (select id, status, row_number() over (partition by id order by coalesce(labeled_at, created_at) desc, status) as n from disputed_pairs) where n = 1")
def str_label_states(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.coalesce("labeled_at", "created_at").desc(), "status")
    return table(spark, d, "disputed_pairs").withColumn("n", F.row_number().over(w)).where("n = 1").select("id", "status")


@query(
    "str_windows",
    "select time_bucket(interval 1 hour, ts)::timestamp as starts, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
)
def str_windows(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")).groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return own.select(F.col("w.start").cast("timestamp_ntz").alias("starts"), "event_type", "n", "total")


@query(
    "str_sessions",
    """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as s from events), n as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as starts, count(*) as n from n group by user_id, k""",
)
def str_sessions(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")).groupBy(F.session_window("at", "6 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return own.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("starts"), "n")


@query(
    "txt_schema_hints",
    "select distinct source_type as entity_type, rel_type, target_type as other, 'outgoing' as direction, cardinality from rel_types union select distinct target_type, rel_type, source_type, 'incoming', cardinality from rel_types",
)
def txt_schema_hints(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "rel_types")
    out = r.select(F.col("source_type").alias("entity_type"), "rel_type", F.col("target_type").alias("other"), F.lit("outgoing").alias("direction"), "cardinality")
    return out.unionByName(r.select(F.col("target_type").alias("entity_type"), "rel_type", F.col("source_type").alias("other"), F.lit("incoming").alias("direction"), "cardinality")).distinct()


@query(
    "txt_expected_types",
    "with t as (select transform_id, type_ from graph_nodes where transform_id is not null group by all), w as (select distinct t.transform_id, r.target_type as entity_type from t join rel_types r on r.source_type = t.type_) select transform_id, entity_type from w where not exists (select 1 from t where t.transform_id = w.transform_id and t.type_ = w.entity_type)",
)
def txt_expected_types(spark: SparkSession, d: str) -> DataFrame:
    present = table(spark, d, "graph_nodes").where("transform_id is not null").select("transform_id", F.col("type_").alias("entity_type")).distinct()
    hints = table(spark, d, "rel_types").select(F.col("source_type").alias("entity_type"), F.col("target_type").alias("wanted")).distinct()
    return present.join(hints, "entity_type").select("transform_id", F.col("wanted").alias("entity_type")).distinct().join(present, ["transform_id", "entity_type"], "left_anti")


@query(
    "sch_profile",
    "select type as entity_type, e.key as prop, count(*) as n, count(try_cast(e.value as bigint)) = count(e.value) as is_integer, count(distinct e.value) as n_values from (select type, unnest(map_entries(properties)) as e from expected_nodes) where e.value is not null and (try_cast(e.value as bigint) is null or regexp_full_match(e.value, '[+-]?[0-9]+')) group by all",
)
def sch_profile(spark: SparkSession, d: str) -> DataFrame:
    flat = table(spark, d, "expected_nodes").select(F.col("type").alias("entity_type"), F.explode(F.map_entries("properties")).alias("e")).select("entity_type", F.col("e.key").alias("prop"), F.col("e.value").alias("v")).where("v is not null")
    return flat.groupBy("entity_type", "prop").agg(F.count(F.lit(1)).alias("n"), (F.count(F.col("v").try_cast("bigint")) == F.count("v")).alias("is_integer"), F.count_distinct("v").alias("n_values"))
