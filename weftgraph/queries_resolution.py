"""Queries of blocking, similarity, clustering, evaluation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text
from weftgraph.operators import evaluation, resolution
from weftgraph.registry import query
from weftgraph.sources import table

_KEYED = r"""keyed as (select distinct id, unnest(case when len(k) > 0 then k else [t || '|_all'] end) as block_key from (select id, t, list_filter([case when canonical_key <> '' then t || '|canon:' || canonical_key end,
case when regexp_replace(nm, '[^\p{L}\p{N}]', '', 'g') <> '' then t || '|name3:' || lower(regexp_replace(nm, '[^\p{L}\p{N}]', '', 'g'))[1:3] end], lambda x: x is not null) as k
from (select id, case when regexp_replace(type_, '^\s+|\s+$', '', 'g') <> '' then type_ else '_' end as t, canonical_key, coalesce(case when regexp_replace(properties['name'], '^\s+|\s+$', '', 'g') <> '' then properties['name'] end, properties['title']) as nm from graph_nodes)))"""


@query("blk_keys", f"with {_KEYED} select block_key, id from keyed")
def blk_keys(spark: SparkSession, d: str) -> DataFrame:
    return resolution.blocks(table(spark, d, "graph_nodes")).select("block_key", "id")


@query("blk_groups", f"with {_KEYED}, s as (select block_key, count(*) as n from keyed group by block_key having count(*) > 1) select id, min(struct_pack(m := -n, k := keyed.block_key)).k as block_key from keyed join s on s.block_key = keyed.block_key group by id")
def blk_groups(spark: SparkSession, d: str) -> DataFrame:
    return resolution.candidate_groups(resolution.blocks(table(spark, d, "graph_nodes")))


@query(
    "blk_methods",
    r"""select distinct id, lower(trim(properties['name']))[1:4] as prefix, lower(right(trim(properties['name']), 4)) as suffix, floor(try_cast(properties['birth_year'] as double) / 10)::bigint::varchar as decade from expected_nodes where properties['name'] is not null""",
)
def blk_methods(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("properties")
    own = table(spark, d, "expected_nodes").where(p["name"].isNotNull())
    return own.select("id", resolution.method_keys(p["name"], "first_n_chars").alias("prefix"), resolution.method_keys(p["name"], "suffix").alias("suffix"), resolution.method_keys(p["birth_year"], "numeric_bucket").alias("decade")).distinct()


_ASKED = "('0x' || substr(md5(id), 1, 6))::bigint % 100 = 0"


def _asked(column: str = "id") -> Column:
    """The stated query set: a hundredth of the ids, told by their digest."""
    return F.conv(F.substring(F.md5(column), 1, 6), 16, 10).cast("bigint") % 100 == 0


@query(
    "blk_rule_pairs",
    f"""with r as (select distinct user_id || '|' || id as id, {_ASKED} as q, user_id, lower(trim(properties['name'])) as nm, properties['city'] || properties['birth_year'] as ctx from expected_nodes where id is not null and user_id is not null),
k as (select id, q, 0 as rule, user_id || nm as value from r union select id, q, 1, user_id || ctx from r)
select a.id as a, b.id as b, min(a.rule) as rule from k a join k b on a.rule = b.rule and a.value = b.value and a.id <> b.id where a.q and a.value <> '' group by a.id, b.id""",
)
def blk_rule_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("properties")
    own = table(spark, d, "expected_nodes").where("id is not null and user_id is not null").withColumn("_asked", _asked())
    rules = [F.concat("user_id", F.lower(F.trim(p["name"]))), F.concat("user_id", p["city"], p["birth_year"])]
    return resolution.rule_pairs(own.withColumn("id", F.concat_ws("|", "user_id", "id")), rules, F.col("_asked"))


@query(
    "blk_minhash",
    "with g as (select id, list_distinct(case when length(v) >= 3 then list_transform(range(1, length(v) - 1), lambda i: substr(v, i, 3)) else [v] end) as grams from (select distinct id, lower(trim(label)) as v from expected_nodes where length(trim(label)) > 0)), "
    "h as (select id, list_transform(grams, lambda x: ('0x' || substr(md5(x), 1, 7))::bigint) as h from g), "
    "s as (select id, ["
    + ", ".join(f"list_min(list_transform(h, lambda x: (x * {(k * 2 + 1) * 7919 % 65521 + 1} + {(k + 1) * 104729}) % {resolution.MERSENNE}))" for k in range(100))
    + "] as s from h) select distinct id, unnest(["
    + ", ".join("substr(md5(concat_ws('|', '%d', %s)), 1, 12)" % (i, ", ".join(f"s[{i * 5 + r + 1}]" for r in range(5))) for i in range(20))
    + "]) as band from s",
)
def blk_minhash(spark: SparkSession, d: str) -> DataFrame:
    return resolution.banded(table(spark, d, "expected_nodes").select("id", "label").distinct(), "label")


_PLANES = [[math.sin((p + 1) * (i + 1) * 0.7) for i in range(64)] for p in range(8)]


@query("blk_hyperplane", "select vec_id, " + " || ".join(f"case when list_dot_product(embedding[1:64]::double[], {p}::double[]) >= 0 then '1' else '0' end" for p in _PLANES) + " as signature from embeddings")
def blk_hyperplane(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", resolution.hyperplane_key(F.slice("embedding", 1, 64), _PLANES).alias("signature"))


@query(
    "sim_cosine_topk",
    """with q as (select vec_id as query_id, embedding from embeddings where vec_id % 100 = 0), s as (select query_id, vec_id, least(1, greatest(0, list_cosine_similarity(q.embedding::double[], e.embedding::double[]))) as score from q, embeddings e where q.query_id <> e.vec_id)
select query_id, vec_id, round(score, 6) as score, case when score >= 0.95 then 0 when score >= 0.85 then 1 when score >= 0.7 then 2 else 3 end as level from s qualify row_number() over (partition by query_id order by round(score, 9) desc, vec_id) <= 5""",
)
def sim_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "embeddings").select("vec_id", "embedding")
    queries = base.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    # One more than shown, since a query's nearest is itself.
    near = resolution.nearest(queries, base, 6).where("query_id <> vec_id")
    w = "row_number() over (partition by query_id order by place)"
    return near.withColumn("p", F.expr(w)).where("p <= 5").select("query_id", "vec_id", F.round("score", 6).alias("score"), resolution.similarity_level(F.col("score")).alias("level"))


def _ascii(name: Column) -> Column:
    """Engines differ in how they count letters outside ASCII, so each stands for one unknown letter."""
    return F.regexp_replace(F.lower(F.trim(name)), "[^ -~]", "?")


_TYPED = f"""r as (select distinct id, user_id, type, {_ASKED} as q, regexp_replace(lower(trim(properties['name'])), '[^ -~]', '?', 'g') as nm, properties['affiliation'] as aff, properties['city'] as c, properties['birth_year'] as y from expected_nodes where id is not null and user_id is not null and type is not null and trim(properties['name']) <> ''),
p as (select a.id as a, b.id as b, a.nm as na, b.nm as nb, a.c as ca, b.c as cb, a.y as ya, b.y as yb from r a join r b on a.q and a.user_id = b.user_id and a.type = b.type and a.id <> b.id)"""


def _typed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The names of the query set beside all names of their user and type."""
    p = F.col("properties")
    cols = {"nm": _ascii(p["name"]), "aff": p["affiliation"], "c": p["city"], "y": p["birth_year"]}
    r = table(spark, d, "expected_nodes").where("id is not null and user_id is not null and type is not null").select("id", "user_id", "type", _asked().alias("q"), *(c.alias(k) for k, c in cols.items())).where("nm <> ''").distinct()
    return resolution.query_pairs(r, ["user_id", "type"], F.col("q")).where("id_a <> id_b").withColumnsRenamed({"id_a": "a", "id_b": "b"})


@query("sim_edit_distance", f"with {_TYPED} select distinct a, b, levenshtein(na, nb) as distance from p where levenshtein(na, nb) < 5")
def sim_edit_distance(spark: SparkSession, d: str) -> DataFrame:
    met = resolution.edit_and_sound(_typed_pairs(spark, d), "nm_a", "nm_b")
    return met.where("distance is not null").select("a", "b", F.col("distance").cast("bigint").alias("distance")).distinct()


@query("sim_jaro_winkler", f"with {_TYPED} select distinct a, b, round(jaro_winkler_similarity(na, nb), 5) as score from p where round(jaro_winkler_similarity(na, nb), 5) >= 0.8")
def sim_jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    return _typed_pairs(spark, d).select("a", "b", F.round(resolution.jaro_winkler(F.col("nm_a"), F.col("nm_b")), 5).alias("score")).where("score >= 0.8").distinct()


_LEVELS = {"g_name": ((0.9, 0.08, 0.02), (0.01, 0.09, 0.9)), "g_city": ((0.8, 0.2), (0.1, 0.9)), "g_year": ((0.85, 0.15), (0.02, 0.98))}
_WEIGHT_SQL = " + ".join("coalesce([" + ", ".join(repr(math.log2(a / b)) for a, b in zip(m, u)) + f"][{c} + 1], 0.0)" for c, (m, u) in _LEVELS.items())


@query(
    "sim_match_weight",
    f"""with {_TYPED}, g as (select a, b, case when na = nb then 0 when levenshtein(na, nb) <= 2 then 1 else 2 end as g_name, case when ca = cb then 0 when ca <> cb then 1 end as g_city, case when ya = yb then 0 when ya <> yb then 1 end as g_year from p), w as (select *, {_WEIGHT_SQL} as weight from g)
select distinct a, b, round(weight, 5)::double as weight, round((pow(2, weight) * {0.01 / 0.99!r}) / (1 + pow(2, weight) * {0.01 / 0.99!r}), 5) as probability from w where round(weight, 5) > 0""",
)
def sim_match_weight(spark: SparkSession, d: str) -> DataFrame:
    same = lambda k: F.when(F.col(f"{k}_a") == F.col(f"{k}_b"), 0).when(F.col(f"{k}_a") != F.col(f"{k}_b"), 1)
    near = F.levenshtein("nm_a", "nm_b", 2) >= 0
    gammas = _typed_pairs(spark, d).select("a", "b", F.when(F.col("nm_a") == F.col("nm_b"), 0).when(near, 1).otherwise(2).alias("g_name"), same("c").alias("g_city"), same("y").alias("g_year"))
    w = gammas.withColumn("weight", resolution.match_weight(_LEVELS)).where(F.round("weight", 5) > 0)
    return w.select("a", "b", F.round("weight", 5).alias("weight"), F.round(resolution.match_probability(F.col("weight"), 0.01), 5).alias("probability")).distinct()


@query(
    "sim_contains",
    r"""select distinct id from (select id, avg(case when contains(lower(e.value), 'berg') then 1.0 else 0.0 end) as s from (select id, valid_from, loaded_at, unnest(map_entries(properties)) as e from graph_nodes) where e.value is not null group by id, valid_from, loaded_at) where s >= 0.3""",
)
def sim_contains(spark: SparkSession, d: str) -> DataFrame:
    values = F.filter(F.map_values("properties"), lambda v: v.isNotNull())
    hit = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.lower(v).contains("berg").cast("double"))
    per = table(spark, d, "graph_nodes").groupBy("id", "valid_from", "loaded_at").agg(F.sum(hit).alias("h"), F.sum(F.size(values)).alias("n"))
    return per.where(F.col("h") / F.greatest("n", F.lit(1)) >= 0.3).select("id").distinct()


@query(
    "clu_closure",
    """with recursive p as (select distinct least(lower(trim(node_a_id)), lower(trim(node_b_id))) as a, greatest(lower(trim(node_a_id)), lower(trim(node_b_id))) as b from disputed_pairs where similarity_score >= 0.9 and lower(trim(node_a_id)) <> lower(trim(node_b_id))),
e as (select a, b from p union select b, a from p), r as (select distinct a as v, a as x from e union select e.b, r.x from r join e on e.a = r.v where r.x < e.b) select v as id, min(x) as representative from r group by v""",
)
def clu_closure(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.lower(F.trim("node_a_id")), F.lower(F.trim("node_b_id"))
    pairs = table(spark, d, "disputed_pairs").where("similarity_score >= 0.9").select(a.alias("a"), b.alias("b")).where("a is not null and b is not null").distinct()
    return resolution.closure(pairs)


@query(
    "jn_property_overlap",
    """with f as (select distinct id, type_ as type, e.key as k, lower(trim(e.value)) as v from (select id, type_, unnest(map_entries(properties)) as e from graph_nodes) where trim(e.value) <> ''),
s as (select distinct p.id, p.type_ as type, e.key as k, lower(trim(e.value)) as v from (select id, type_, unnest(map_entries(properties)) as e from production_nodes) p where trim(e.value) <> ''),
n as (select id, type, count(*) as n from f group by all) select f.id as query_id, s.id, count(*) as m, max(n.n) as n from f join s on s.type = f.type and s.k = f.k and s.v = f.v join n on n.id = f.id and n.type = f.type group by f.id, s.id having count(*) / max(n.n) >= 0.5""",
)
def jn_property_overlap(spark: SparkSession, d: str) -> DataFrame:
    return resolution.property_overlap(table(spark, d, "graph_nodes"), table(spark, d, "production_nodes"), 0.5).select("query_id", "id", "m", "n")


_SCORED = """a as (select distinct user_id, properties['canonical_id'] as k from expected_nodes where properties['canonical_id'] is not null), b as (select distinct user_id, canonical_id as k from node_snapshots where canonical_id is not null),
c as (select coalesce(a.user_id, b.user_id) as user_id, count(*) filter (a.k is not null and b.k is not null) as tp, count(*) filter (a.k is null) as fp, count(*) filter (b.k is null) as fn from a full join b on a.user_id = b.user_id and a.k = b.k group by 1),
s as (select *, case when tp + fp = 0 then 0.0 else tp / (tp + fp) end as precision, case when tp + fn = 0 then 0.0 else tp / (tp + fn) end as recall, case when 2 * tp + fp + fn = 0 then 0.0 else 2 * tp / (2 * tp + fp + fn) end as f1 from c)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "expected_nodes").select("user_id", F.col("properties")["canonical_id"].alias("k"))
    return evaluation.scores(a, table(spark, d, "node_snapshots").select("user_id", F.col("canonical_id").alias("k")), ["user_id"], "k")


@query("evl_scores", f"with {_SCORED} select user_id, tp, fp, fn, precision::double as precision, recall::double as recall, f1::double as f1 from s")
def evl_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


@query("evl_micro_macro", f"with {_SCORED}, t as (select sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, avg(f1) as macro_f1, count(*) as n_groups from s) select n_groups, case when tp + fp = 0 then 0.0 else tp / (tp + fp) end::double as micro_precision, case when tp + fn = 0 then 0.0 else tp / (tp + fn) end::double as micro_recall, (2 * tp / greatest(2 * tp + fp + fn, 1))::double as micro_f1, macro_f1::double as macro_f1 from t")
def evl_micro_macro(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.micro_macro(_scored(spark, d))


@query("blk_ngrams", r"select distinct id, unnest(list_distinct(case when length(v) >= 3 then list_transform(range(1, length(v) - 1), lambda i: substr(v, i, 3)) else [v] end)) as gram from (select id, lower(trim(label)) as v from expected_nodes where length(trim(label)) > 0)")
def blk_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "expected_nodes").where(F.length(F.trim("label")) > 0).select("id", F.explode(text.ngrams(F.col("label"))).alias("gram")).distinct()
