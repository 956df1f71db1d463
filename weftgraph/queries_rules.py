"""Queries of declared rules and of reading quality results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import matching_cascade, quality, review
from weftgraph.plans import ontology_rules
from weftgraph.plans.rules import property_violations
from weftgraph.queries_quality import EXPECTED, RULES, _VIOLATIONS, _filled_sql, _violations_sql, _WANTED
from weftgraph.registry import query
from weftgraph.sources import table

# Fixed value of the queries: the ontology whose rules they compile.
DECLARED = {
    "entities": {
        "Person": {
            "properties": {"name": {"required": True, "quality": {"format": {"minLength": 8, "maxLength": 24, "caseFormat": "titleCase"}, "business": {"forbiddenValues": ["N/A", "unknown"]}}}, "city": {}},
            "quality": {"entityLevel": {"completeness": {"minPropertyFillRate": 0.75}}},
        },
        "Company": {
            "properties": {
                "status": {"quality": {"business": {"allowedValues": ["active", "closed", "pending"], "requiredWords": ["act", "clos"], "forbiddenPatterns": ["^p"]}}},
                "year": {"quality": {"business": {"minValue": 1900, "maxValue": 2020}, "format": {"pattern": r"\d{4}$"}}},
            },
            "relationships": {"PARTY_TO": {"target": "Contract", "quality": {"relationshipLevel": {"cardinality": {"minPerEntity": 1, "severity": "info"}}}}},
        },
    },
    "quality": {
        "gating": {"warnScore": 85, "maxWarnings": 4},
        "extractionStandards": {"confidenceThresholds": {"entityExtraction": 0.5, "severity": "warning"}, "completenessRequirements": {"minEntitiesPerDocument": 1_000_000_000, "requiredEntityTypes": ["Company", "Spaceship"]}},
        "distributionRules": {"entityBalance": {"maxSingleTypeRatio": 0.03}},
        "coverageRules": [{"entityType": "Person", "property": "city", "minCoverage": 0.9}],
        "crossValidationRules": [{"ruleType": "symmetric_relationship", "relationshipType": "PARENT_OF", "inverseType": "SUBSIDIARY_OF"}],
        "temporalRules": [{"entityType": "Company", "property": "year", "latest": "2020-01-01", "allowMissing": False}],
    },
}
S = r"regexp_replace(v, '^\s+|\s+$', '', 'g')"


@query(
    "qr_declared_rules",
    """select * from (values ('Person.name.length', 'length', 'warning'), ('Person.name.case_format', 'case_format', 'info'), ('Person.name.forbidden_values', 'forbidden_values', 'error'), ('Person.name.required', 'required', 'error'),
('Company.status.allowed_values', 'allowed_values', 'error'), ('Company.status.required_words', 'words', 'warning'), ('Company.status.forbidden_pattern_0', 'forbidden_pattern', 'warning'), ('Company.year.pattern', 'pattern', 'warning'), ('Company.year.range', 'range', 'error'),
('Person.completeness.min_fill_rate', 'completeness', 'warning'), ('relationship.PARTY_TO.cardinality', 'presence', 'info'), ('global.confidence_threshold', 'confidence', 'warning'), ('global.completeness.min_entities', 'minimum', 'error'),
('global.completeness.required_entity_types', 'required_types', 'error'), ('global.entity_balance', 'balance', 'warning'), ('global.property_coverage.0', 'coverage', 'warning'), ('global.symmetric_relationship.0', 'symmetric', 'warning'),
('global.temporal.Company.year.0', 'temporal', 'warning')) t(rule_id, kind, severity)""",
)
def qr_declared_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = ontology_rules.compiled(DECLARED)
    return spark.createDataFrame([(r.rule_id, r.kind, r.severity) for r in (*rules.properties, *rules.graph)], "rule_id string, kind string, severity string")


@query(
    "qr_declared_violations",
    rf"""with p as (select type_ as type, id, properties, properties['name'] as nm, properties['status'] as st, properties['year'] as yr, confidence_score as c1, provenance.confidence_score as c2 from graph_nodes),
a as (select id, nm as v from p where type = 'Person'), b as (select id, st as v from p where type = 'Company'), c as (select id, yr as v from p where type = 'Company'),
u as (select from_ as id from graph_edges where relationship = 'PARTY_TO'),
o as (select 'Person.name.length' as rule_id, id from a where length({S}) < 8 union all select 'Person.name.length', id from a where length({S}) > 24
union all select 'Person.name.case_format', id from a where {S} <> '' and {S} <> array_to_string(list_transform(regexp_extract_all(lower({S}), '\p{{L}}+|\P{{L}}+'), lambda w: upper(w[1]) || substr(w, 2)), '')
union all select 'Person.name.forbidden_values', id from a where lower({S}) in ('n/a', 'unknown')
union all select 'Person.name.required', id from p where type = 'Person' and map_contains(properties, 'name') and (nm is null or regexp_replace(nm, '\s+', '', 'g') = '')
union all select 'Company.status.allowed_values', id from b where v is not null and {S} not in ('active', 'closed', 'pending')
union all select 'Company.status.required_words', id from b where {S} <> '' and not regexp_matches({S}, '(?i)act|clos')
union all select 'Company.status.forbidden_pattern_0', id from b where {S} <> '' and starts_with({S}, 'p')
union all select 'Company.year.pattern', id from c where {S} <> '' and not regexp_matches({S}, '^\d{{4}}$')
union all select 'Company.year.range', id from c where v is not null and try_cast({S} as double) is null
union all select 'Company.year.range', id from c where try_cast({S} as double) < 1900 union all select 'Company.year.range', id from c where try_cast({S} as double) > 2020
union all select distinct 'Person.completeness.min_fill_rate', id || '|' || r from (select id, ((coalesce(regexp_replace(properties['name'], '\s+', '', 'g'), '') <> '')::int + (coalesce(regexp_replace(properties['city'], '\s+', '', 'g'), '') <> '')::int) / 2 as r from p where type = 'Person') where r < 0.75
union all select distinct 'relationship.PARTY_TO.cardinality', id from p where type = 'Company' and id not in (select id from u where id is not null)
union all select distinct 'global.confidence_threshold', id || coalesce(type, '') || round(coalesce(c1, c2, 0.0), 4) from p where coalesce(c1, c2, 0.0) < 0.5
union all select 'global.completeness.min_entities', '' union all select 'global.completeness.required_entity_types', ''
union all select 'global.entity_balance', type from (select type, count(*) as n, sum(count(*)) over () as t from p where type is not null group by type) where n / t > 0.03 + 1e-4
union all select 'global.property_coverage.0', '' from p where type = 'Person' having avg((coalesce(regexp_replace(properties['city'], '\s+', '', 'g'), '') <> '')::int) < 0.9
union all select distinct 'global.symmetric_relationship.0', id from graph_edges e where relationship = 'PARENT_OF' and not exists (select 1 from graph_edges b where b.relationship = 'SUBSIDIARY_OF' and b.from_ = e.to_ and b.to_ = e.from_)
union all select distinct 'global.temporal.Company.year.0', id || coalesce(yr, '') from p where type = 'Company')
select rule_id, count(*) as n from o group by rule_id""",
)
def qr_declared_violations(spark: SparkSession, d: str) -> DataFrame:
    found = ontology_rules.validate(table(spark, d, "graph_nodes"), table(spark, d, "graph_edges"), ontology_rules.compiled(DECLARED))
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "qr_temporal",
    r"""with v as (select distinct id, regexp_replace(value, '^"+|"+$', '', 'g') as raw from claims where property_key in ('since', 'date', 'effective_date', 'year', 'founded') and value is not null),
t as (select id, raw, case when regexp_full_match(raw, '\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?') then try_cast(raw as timestamp) end as ts from v)
select id, raw, case when ts is null then 'a date' when ts < timestamp '2010-01-01' then '>= 2010-01-01' when ts > timestamp '2022-12-31' then '<= 2022-12-31' end as expected from t where ts is null or ts < timestamp '2010-01-01' or ts > timestamp '2022-12-31'""",
)
def qr_temporal(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "claims").where(F.col("property_key").isin("since", "date", "effective_date", "year", "founded") & F.col("value").isNotNull())
    raw = F.regexp_replace("value", '^"+|"+$', "")
    nodes = own.select("id", F.lit("Claim").alias("type_"), F.create_map(F.lit("at"), raw).alias("properties"))
    rules = ontology_rules.compiled({"quality": {"temporalRules": [{"entityType": "Claim", "property": "at", "earliest": "2010-01-01", "latest": "2022-12-31", "allowMissing": False}]}})
    return ontology_rules.validate(nodes, nodes, rules).select(F.col("entity_id").alias("id"), F.col("actual").alias("raw"), "expected")


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    return property_violations(table(spark, d, "node_snapshots"), RULES, entity_type="type").withColumn("rule_type", F.col("rule_id"))


@query("flt_violation_page", f"with {_VIOLATIONS}, o as (select distinct rule_id, entity_id from violations where severity = 'error' and (rule_id > 'company-year-range' or (rule_id = 'company-year-range' and entity_id > 'm'))) select * from o order by rule_id, entity_id limit 25")
def flt_violation_page(spark: SparkSession, d: str) -> DataFrame:
    own = _snapshots(spark, d).select("rule_id", "entity_id", "severity", F.lit("").alias("property_name")).distinct()
    return review.violation_page(own, 25, {"rule_id": "company-year-range", "entity_id": "m", "property_name": ""}, severity="error").select("rule_id", "entity_id")


@query("src_violation_export", f"with {_VIOLATIONS} select rule_id, entity_type, entity_id, severity, '' as relationship_type, '1.00' as confidence, '' as suggestion, count(*) as n from violations group by all")
def src_violation_export(spark: SparkSession, d: str) -> DataFrame:
    return review.export_rows(_snapshots(spark, d)).groupBy("rule_id", "entity_type", "entity_id", "severity", "relationship_type", "confidence", "suggestion").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_violation_analytics",
    f"""with {_VIOLATIONS}, r as (select 'rule' as kind, rule_id as name, min(severity) as severity, count(*) as n from violations group by rule_id order by n desc, name limit 10), e as (select 'entity' as kind, coalesce(entity_type, 'unknown') as name, '' as severity, count(*) as n from violations group by 2 order by n desc, name limit 10)
select * from r union all select * from e""",
)
def agg_violation_analytics(spark: SparkSession, d: str) -> DataFrame:
    v = _snapshots(spark, d)
    rules = review.top_rules(v).select(F.lit("rule").alias("kind"), F.col("rule_id").alias("name"), "severity", "n")
    return rules.unionByName(review.top_entity_types(v).select(F.lit("entity").alias("kind"), F.col("entity_type").alias("name"), F.lit("").alias("severity"), "n"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "graph_nodes")
    return quality.graph_scores(nodes, property_violations(nodes, RULES, keep=["transform_id"]), EXPECTED)


_SCORES = f"""{_violations_sql('graph_nodes', 'type_')}, f as (select transform_id, count(*) as n_entities, sum(coalesce({_filled_sql('type_')}, 0)) as filled, sum(coalesce({_WANTED.format('type_')}, 0)) as wanted, coalesce(avg(confidence_score), 0.0) as confidence, count(distinct type_) as n_types from graph_nodes group by transform_id),
s as (select transform_id, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings, count(*) filter (severity = 'info') as infos from violations group by transform_id),
r as (select f.transform_id, n_entities, n_types, confidence, coalesce(errors, 0) as errors, coalesce(warnings, 0) as warnings, coalesce(infos, 0) as infos, case when wanted > 0 then filled / wanted * 100 else 100.0 end as completeness from f left join s on s.transform_id = f.transform_id),
q as (select *, greatest(0.0, least(100.0, 100.0 - errors * 10 - warnings * 5 - infos + (completeness - 50) * 0.2 + (confidence - 0.5) * 20)) as score from r),
g as (select *, case when score < 70 or errors > 0 or completeness < 50 then 'fail' when score < 80 or warnings > 10 then 'warn' else 'pass' end as gate from q),
reasons as (select transform_id, gate, unnest(list_filter([case when score < 70 then 'Score below 70' end, case when errors > 0 then 'More than 0 errors' end, case when score >= 70 and score < 80 then 'Score below 80' end, case when warnings > 10 then 'More than 10 warnings' end, case when completeness < 50 then 'Completeness below 50%' end], lambda x: x is not null)) as reason from g)"""


@query("qr_gate_reasons", f"with {_SCORES} select transform_id, gate, reason from reasons")
def qr_gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    return review.gate_reasons(_scores(spark, d))


@query("win_gate_reasons", f"with {_SCORES} select reason, min(case gate when 'fail' then 1 when 'warn' then 2 else 3 end)::bigint as priority, count(*) as n from reasons group by reason order by priority, n desc, lower(reason) limit 5")
def win_gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    return review.ranked_reasons(review.gate_reasons(_scores(spark, d)))


@query(
    "qr_recommendations",
    f"""with {_SCORES} select transform_id, unnest(list_filter([case when score < 70 then 'Review the ontology: it guides extraction poorly' end, case when errors > 0 then 'Mend ' || errors || ' errors first' end, case when warnings > 10 then 'Many warnings: refine the rules' end,
case when confidence < 0.6 then 'Low confidence: improve the source documents' end, case when completeness < 60 then 'Few properties are filled: review the required ones' end, case when n_types < 2 then 'One type of entity only: does the document fit the schema?' end], lambda x: x is not null)) as recommendation from q""",
)
def qr_recommendations(spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "graph_nodes").groupBy("transform_id").agg(F.count_distinct("type_").alias("n_types"))
    return review.recommendations(_scores(spark, d), types)


@query("qr_detailed", "select transform_id, type_ as entity_type, count(*) as n, round(avg(confidence_score), 6) as confidence, coalesce(avg(confidence_score) < 0.7, false) as low from graph_nodes where type_ is not null group by all")
def qr_detailed(spark: SparkSession, d: str) -> DataFrame:
    return review.confidence_by_type(table(spark, d, "graph_nodes")).withColumn("confidence", F.round("confidence", 6))


@query(
    "agg_quality_metrics",
    """with a as (select transform_id, count(*) as n_entities, sum(len(list_filter(map_values(properties), lambda v: v is not null)))::bigint as n_properties, count(distinct type_) as n_types, coalesce(avg(confidence_score), 0) as entity_confidence,
sum(case when type_ = 'Person' then coalesce((trim(properties['name']) <> '')::int, 0) + coalesce((trim(properties['city']) <> '')::int, 0) when type_ = 'Vessel' then coalesce((trim(properties['name']) <> '')::int, 0) + coalesce((trim(properties['status']) <> '')::int, 0) else 0 end) as h,
sum(case when type_ in ('Person', 'Vessel') then 2 else 0 end) as w from graph_nodes group by transform_id), b as (select transform_id, count(*) as n_relationships, coalesce(avg(confidence_score), 0) as edge_confidence from graph_edges group by transform_id)
select a.transform_id, n_entities, coalesce(n_relationships, 0) as n_relationships, n_properties, n_types, round(entity_confidence, 6) as entity_confidence, round(coalesce(edge_confidence, 0), 6) as edge_confidence, round(case when w > 0 then h / w else 1 end, 6)::double as fill_rate from a left join b on b.transform_id = a.transform_id""",
)
def agg_quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = review.quality_metrics(table(spark, d, "graph_nodes"), table(spark, d, "graph_edges"), {"Person": ("name", "city"), "Vessel": ("name", "status")})
    return out.withColumns({c: F.round(c, 6) for c in ("entity_confidence", "edge_confidence", "fill_rate")})


_RUNS = "runs as (select c.transform_id, c.started, c.ms, g.gate from (select transform_id, min(created_at) as started, (epoch_us(max(loaded_at)) - epoch_us(min(created_at))) / 1000 as ms from claims where transform_id is not null group by transform_id) c join g on g.transform_id = c.transform_id)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    own = table(spark, d, "claims").where("transform_id is not null").groupBy("transform_id").agg(F.min("created_at").alias("started"), ((us(F.max("loaded_at")) - us(F.min("created_at"))) / 1000).alias("ms"))
    return own.join(_scores(spark, d).select("transform_id", "gate"), "transform_id")


@query(
    "agg_runs_summary",
    f"""with {_SCORES}, {_RUNS} select count(*) as total_runs, count(*) filter (gate = 'pass') as pass_count, count(*) filter (gate = 'warn') as warn_count, count(*) filter (gate = 'fail') as fail_count, round(avg(ms), 3) as mean_ms, round(quantile_cont(ms, 0.5), 3) as p50_ms, round(quantile_cont(ms, 0.95), 3) as p95_ms,
round(count(*) / greatest((epoch_us(max(started)) - epoch_us(min(started))) / 86400000000, 1.0), 2)::double as runs_a_day from runs""",
)
def agg_runs_summary(spark: SparkSession, d: str) -> DataFrame:
    return review.runs_summary(_runs(spark, d)).withColumns({c: F.round(c, 3) for c in ("mean_ms", "p50_ms", "p95_ms")})


@query("agg_runs_by_day", f"with {_SCORES}, {_RUNS} select strftime(started, '%Y-%m-%d') as day, count(*) as n_runs, round(avg(ms)) as mean_ms, round(quantile_cont(ms, 0.95)) as p95_ms from runs group by 1")
def agg_runs_by_day(spark: SparkSession, d: str) -> DataFrame:
    out = review.runs_by_day(_runs(spark, d))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n_runs", F.round("mean_ms", 0).alias("mean_ms"), F.round("p95_ms", 0).alias("p95_ms"))


@query(
    "agg_gap_report",
    r"""with u as (select from_ as id from graph_edges where from_ is not null union select to_ from graph_edges where to_ is not null),
g as (select distinct 'INCOMPLETE_ENTITY' as gap_type, id, array_to_string(list_filter(['name', 'city'], lambda k: coalesce(trim(properties[k]), '') = ''), ',') as detail from graph_nodes where type_ = 'Company' and len(list_filter(['name', 'city'], lambda k: coalesce(trim(properties[k]), '') = '')) > 0
union select 'ORPHAN_NODE', id, '' from graph_nodes where id not in (select id from u) union select 'LOW_CONFIDENCE', id, '' from graph_nodes where coalesce(nullif(confidence_score, 0), 1.0) < 0.5)
select gap_type, count(*) as n, case gap_type when 'INCOMPLETE_ENTITY' then 'Extract ' || count(*) || ' incomplete entities again' when 'ORPHAN_NODE' then 'Find relationships of ' || count(*) || ' orphan nodes' else 'Verify ' || count(*) || ' doubtful entities' end as advice from g group by gap_type""",
)
def agg_gap_report(spark: SparkSession, d: str) -> DataFrame:
    return review.gap_report(matching_cascade.extraction_gaps(table(spark, d, "graph_nodes"), table(spark, d, "graph_edges"), {"Company": ["name", "city"]}, 0.5))
