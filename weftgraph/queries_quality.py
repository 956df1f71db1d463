"""Queries of the quality rules, scores and gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import quality
from weftgraph.operators.graph import latest_versions
from weftgraph.plans.rules import Rule, property_violations
from weftgraph.registry import query
from weftgraph.sources import table

# Fixed values of the queries: the rules they apply.
RULES = (
    Rule("person-name-length", "length", "Person", "name", "warning", {"least": 8, "most": 24}),
    Rule("person-name-case", "case_format", "Person", "name", "info", {"style": "upper"}),
    Rule("person-name-pattern", "pattern", "Person", "name", "error", {"pattern": "[A-Z][a-z]+ "}),
    Rule("company-name-required", "required", "Company", "name", "error", {}),
    Rule("company-status", "allowed_values", "Company", "status", "warning", {"values": ("active", "closed", "pending", "Active")}),
    Rule("company-status-placeholder", "forbidden_values", "Company", "status", "warning", {"values": ("n/a", "unknown", "tbd")}),
    Rule("company-year-range", "range", "Company", "year", "error", {"least": 1900, "most": 2020}),
    Rule("company-year-window", "date_window", "Company", "year", "warning", {"earliest": 1950, "latest": 2024}),
)
EXPECTED = {"Person": ("name", "city"), "Company": ("name", "city", "status", "year"), "Vessel": ("name", "status")}
S = r"regexp_replace(v, '^\s+|\s+$', '', 'g')"

def _violations_sql(source: str, type_column: str) -> str:
    return rf"""
p as (select id, {type_column} as type, transform_id, loaded_at, properties, properties['name'] as nm, properties['status'] as st, properties['year'] as yr from {source}),
a as (select id, transform_id, loaded_at, type, 'name' as prop, nm as v, true as present from p where type = 'Person' and nm is not null),
violations as (
  select 'person-name-length' as rule_id, 'warning' as severity, type as entity_type, id as entity_id, transform_id from a where length({S}) < 8
  union all select 'person-name-length', 'warning', type, id, transform_id from a where length({S}) > 24
  union all select 'person-name-case', 'info', type, id, transform_id from a where {S} <> '' and {S} <> upper({S})
  union all select 'person-name-pattern', 'error', type, id, transform_id from a where {S} <> '' and not regexp_matches({S}, '^(?:[A-Z][a-z]+ )')
  union all select 'company-name-required', 'error', type, id, transform_id from (select *, nm as v from p) where type = 'Company' and map_contains(properties, 'name') and (v is null or {S} = '')
  union all select 'company-status', 'warning', type, id, transform_id from (select *, st as v from p) where type = 'Company' and v is not null and {S} not in ('active', 'closed', 'pending', 'Active')
  union all select 'company-status-placeholder', 'warning', type, id, transform_id from (select *, st as v from p) where type = 'Company' and v is not null and lower({S}) in ('n/a', 'unknown', 'tbd')
  union all select 'company-year-range', 'error', type, id, transform_id from (select *, yr as v from p) where type = 'Company' and v is not null and try_cast({S} as double) is null
  union all select 'company-year-range', 'error', type, id, transform_id from (select *, yr as v from p) where type = 'Company' and try_cast({S} as double) < 1900
  union all select 'company-year-range', 'error', type, id, transform_id from (select *, yr as v from p) where type = 'Company' and try_cast({S} as double) > 2020
  union all select 'company-year-window', 'warning', type, id, transform_id from (select *, yr as v from p) where type = 'Company' and v is not null and (not regexp_full_match({S}, '[+-]?\d+') )
  union all select 'company-year-window', 'warning', type, id, transform_id from (select *, yr as v from p) where type = 'Company' and regexp_full_match({S}, '[+-]?\d+') and try_cast({S} as int) < 1950
  union all select 'company-year-window', 'warning', type, id, transform_id from (select *, yr as v from p) where type = 'Company' and regexp_full_match({S}, '[+-]?\d+') and try_cast({S} as int) > 2024)"""


_VIOLATIONS = _violations_sql("node_snapshots", "type")


def _snapshot_violations(spark: SparkSession, d: str) -> DataFrame:
    return property_violations(table(spark, d, "node_snapshots"), RULES, entity_type="type")


@query("qr_property_rules", f"with {_VIOLATIONS} select rule_id, severity, entity_type, entity_id, count(*) as n from violations group by all")
def qr_property_rules(spark: SparkSession, d: str) -> DataFrame:
    return _snapshot_violations(spark, d).groupBy("rule_id", "severity", "entity_type", "entity_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_violation_groups",
    f"""with {_VIOLATIONS} select entity_type, severity, rule_id as rule_type, count(*) as n from violations group by grouping sets ((rule_id), (severity), (entity_type), (entity_type, severity), ())""",
)
def agg_violation_groups(spark: SparkSession, d: str) -> DataFrame:
    v = _snapshot_violations(spark, d).select("entity_type", "severity", F.col("rule_id").alias("rule_type"))
    return quality.violation_counts(v).drop("level")


@query("agg_top_rules", f"with {_VIOLATIONS} select rule_id, count(*) as n from violations group by rule_id order by n desc, rule_id limit 5")
def agg_top_rules(spark: SparkSession, d: str) -> DataFrame:
    return _snapshot_violations(spark, d).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id").limit(5)



def _filled_sql(column: str) -> str:
    one = lambda k: rf"coalesce((regexp_replace(properties['{k}'], '^\s+|\s+$', '', 'g') <> '')::int, 0)"
    return "case " + column + " " + " ".join(f"when '{t}' then {' + '.join(map(one, keys))}" for t, keys in EXPECTED.items()) + " end"


_WANTED = "case {0} " + " ".join(f"when '{t}' then {len(k)}" for t, k in EXPECTED.items()) + " end"


@query("qr_completeness", f"select type_ as entity_type, id as entity_id, ({_filled_sql('type_')}) / ({_WANTED.format('type_')})::double as ratio from graph_nodes where type_ in ('Person', 'Company', 'Vessel') and ({_filled_sql('type_')}) / ({_WANTED.format('type_')})::double < 0.75")
def qr_completeness(spark: SparkSession, d: str) -> DataFrame:
    return quality.incomplete_entities(table(spark, d, "graph_nodes"), EXPECTED, 0.75)


@query(
    "qr_presence",
    """with n as (select distinct id from graph_nodes where type_ = 'Company'), e as (select from_ as id from graph_edges where relationship = 'PARTY_TO' union all select to_ from graph_edges where relationship = 'PARTY_TO')
select n.id as entity_id, count(e.id) as n from n left join e on e.id = n.id group by n.id having count(e.id) < 2""",
)
def qr_presence(spark: SparkSession, d: str) -> DataFrame:
    return quality.lacking_relationships(table(spark, d, "graph_nodes"), table(spark, d, "graph_edges"), "Company", "PARTY_TO", "either", 2)


@query(
    "qr_coverage",
    " union all ".join(
        rf"select '{t}' as entity_type, '{k}' as property_name, count(*) as n_entities, avg(case when regexp_replace(properties['{k}'], '^\s+|\s+$', '', 'g') <> '' then 1.0 else 0.0 end)::double as coverage from graph_nodes where type_ = '{t}' having count(*) > 0"
        for t, keys in EXPECTED.items()
        for k in keys
    ),
)
def qr_coverage(spark: SparkSession, d: str) -> DataFrame:
    return quality.property_coverage(table(spark, d, "graph_nodes"), EXPECTED)


@query("qr_confidence", "select id, coalesce(confidence_score, provenance.confidence_score, 0.0) as confidence from graph_edges where coalesce(confidence_score, provenance.confidence_score, 0.0) < 0.5")
def qr_confidence(spark: SparkSession, d: str) -> DataFrame:
    return quality.low_confidence(table(spark, d, "graph_edges"), 0.5)


@query("qr_balance", "with c as (select type_ as entity_type, count(*) as n from graph_nodes where type_ is not null group by type_), s as (select *, n / sum(n) over () as share from c) select entity_type, n, share::double as share from s where share > 0.03 + 0.0001")
def qr_balance(spark: SparkSession, d: str) -> DataFrame:
    return quality.unbalanced_types(table(spark, d, "graph_nodes"), 0.03)


@query("qr_required_types", "with w(entity_type, least) as (values ('Company', 10), ('Spaceship', 1), ('Wallet', 1000000)) select w.entity_type, w.least, coalesce(c.n, 0) as n from w left join (select type_, count(*) as n from graph_nodes group by type_) c on c.type_ = w.entity_type where coalesce(c.n, 0) < w.least")
def qr_required_types(spark: SparkSession, d: str) -> DataFrame:
    return quality.missing_types(table(spark, d, "graph_nodes"), {"Company": 10, "Spaceship": 1, "Wallet": 1_000_000})


@query("qr_minimum_entities", "select count(distinct id) as n_entities, count(distinct id) >= 100 as enough from graph_nodes")
def qr_minimum_entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_nodes").agg(F.count_distinct("id").alias("n_entities")).withColumn("enough", F.col("n_entities") >= 100)


@query(
    "qr_cross_entity",
    r"""with n as (select id, properties from graph_nodes where valid_to is null qualify row_number() over (partition by id order by valid_from desc nulls last, loaded_at desc nulls last) = 1),
v as (select e.id as edge_id, lower(regexp_replace(a.properties['city'], '^\s+|\s+$', '', 'g')) as source_value, lower(regexp_replace(b.properties['city'], '^\s+|\s+$', '', 'g')) as target_value from graph_edges e join n a on a.id = e.from_ join n b on b.id = e.to_ where e.relationship = 'OWNS')
select distinct edge_id, source_value, target_value from v where source_value <> target_value""",
)
def qr_cross_entity(spark: SparkSession, d: str) -> DataFrame:
    nodes = latest_versions(table(spark, d, "graph_nodes").where("valid_to is null"))
    return quality.inconsistent_edges(table(spark, d, "graph_edges"), nodes, "OWNS", "city", "city").distinct()


@query(
    "qr_graph_scores",
    f"""with {_violations_sql('graph_nodes', 'type_')}, f as (select transform_id, count(*) as n_entities, sum(coalesce({_filled_sql('type_')}, 0)) as filled, sum(coalesce({_WANTED.format('type_')}, 0)) as wanted, coalesce(avg(confidence_score), 0.0) as confidence from graph_nodes group by transform_id),
s as (select transform_id, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings, count(*) filter (severity = 'info') as infos from violations group by transform_id),
r as (select f.transform_id, n_entities, confidence, coalesce(errors, 0) as errors, coalesce(warnings, 0) as warnings, coalesce(infos, 0) as infos, case when wanted > 0 then filled / wanted * 100 else 100.0 end as completeness from f left join s on s.transform_id = f.transform_id),
q as (select *, greatest(0.0, least(100.0, 100.0 - errors * 10 - warnings * 5 - infos + (completeness - 50) * 0.2 + (confidence - 0.5) * 20)) as score from r)
select transform_id, n_entities, errors, warnings, infos, round(completeness, 6)::double as completeness, round(confidence, 6)::double as confidence, round(score, 6)::double as score, case when score >= 90 then 'A' when score >= 80 then 'B' when score >= 70 then 'C' when score >= 60 then 'D' else 'F' end as grade,
case when score < 70 or errors > 0 or completeness < 50 then 'fail' when score < 80 or warnings > 10 then 'warn' else 'pass' end as gate from q""",
)
def qr_graph_scores(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "graph_nodes")
    scores = quality.graph_scores(nodes, property_violations(nodes, RULES, keep=["transform_id"]), EXPECTED)
    return scores.withColumns({c: F.round(c, 6) for c in ("completeness", "confidence", "score")})
