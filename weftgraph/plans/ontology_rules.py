"""Quality rules as an ontology declares them, compiled into property rules (one scan) and checks of whole graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import strip
from weftgraph.operators import quality
from weftgraph.operators.graph import missing_mirrors
from weftgraph.plans.rules import Rule, property_violations

SEVERITIES = ("error", "warning", "info")


def severity_of(declared: Any, default: str) -> str:
    named = str(declared or "").lower()
    return named if named in SEVERITIES else default


@dataclass(frozen=True)
class GraphCheck:
    """One check of a whole graph: its kind in GRAPH_CHECKS and its options."""

    rule_id: str
    kind: str
    severity: str
    options: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class RuleSet:
    properties: tuple[Rule, ...]
    graph: tuple[GraphCheck, ...]
    gating: dict[str, Any]

    def __len__(self) -> int:
        return len(self.properties) + len(self.graph)


# The declared names of options by section, with the check they give, its options and severity.
_SCALAR: tuple[tuple[str, str, str, dict[str, str], str], ...] = (
    ("format", "pattern", "pattern", {"pattern": "pattern", "flags": "flags"}, "warning"),
    ("format", "length", "length", {"minLength": "least", "maxLength": "most"}, "warning"),
    ("format", "case_format", "case_format", {"caseFormat": "style"}, "info"),
    ("business", "forbidden_values", "forbidden_values", {"forbiddenValues": "values"}, "error"),
    ("business", "allowed_values", "allowed_values", {"allowedValues": "values"}, "error"),
    ("business", "range", "range", {"minValue": "least", "maxValue": "most"}, "error"),
    ("business", "required_words", "words", {"requiredWords": "words"}, "warning"),
)
# The declared names of the gate's bounds, with the gate's arguments and their defaults.
GATING = {"hardFailScore": ("hard_fail", 70.0), "warnScore": ("warn", 80.0), "passScore": ("pass_score", 80.0), "maxErrors": ("max_errors", 0), "maxWarnings": ("max_warnings", 10), "minPropertyCompleteness": ("least_completeness", 0.5)}


def property_rules(entity_type: str, prop: str, declared: Mapping[str, Any]) -> list[Rule]:
    """The rules of one property. What an option leaves out is not checked."""
    out = []
    for section, suffix, kind, names, severity in _SCALAR:
        given = declared.get(section) or {}
        options = {mine: given[theirs] for theirs, mine in names.items() if given.get(theirs) not in (None, [], "")}
        if options and set(options) != {"flags"}:
            if kind == "range":
                options["inclusive"] = bool(given.get("inclusive", True))
            out.append(Rule(f"{entity_type}.{prop}.{suffix}", kind, entity_type, prop, severity, options))
    for n, pattern in enumerate((declared.get("business") or {}).get("forbiddenPatterns") or ()):
        out.append(Rule(f"{entity_type}.{prop}.forbidden_pattern_{n}", "forbidden_pattern", entity_type, prop, "warning", {"pattern": pattern}))
    window = (declared.get("validation") or {}).get("dateWindow")
    if window:
        options = {"earliest": window.get("earliest"), "latest": window.get("latest"), "allow_future": bool(window.get("allowFuture", False))}
        out.append(Rule(f"{entity_type}.{prop}.date_window", "iso_window", entity_type, prop, severity_of(window.get("severity"), "warning"), options))
    return out


def _presence(rule_id: str, body: Mapping[str, Any], entity_type: Any, relationship: Any, least: Any) -> GraphCheck:
    return GraphCheck(rule_id, "presence", severity_of(body.get("severity"), "warning"), {"entity_type": entity_type, "relationship": relationship, "direction": body.get("direction", "outbound"), "least": int(least)})


def global_checks(declared: Mapping[str, Any]) -> list[GraphCheck]:
    """Checks that an ontology declares for whole graphs, in the order of their sections."""
    out: list[GraphCheck] = []
    standards = declared.get("extractionStandards") or {}
    confidence, complete = standards.get("confidenceThresholds") or {}, standards.get("completenessRequirements") or {}
    if confidence:
        out.append(GraphCheck("global.confidence_threshold", "confidence", severity_of(confidence.get("severity"), "error"), {"entities": confidence.get("entityExtraction"), "relationships": confidence.get("relationshipExtraction")}))
    base = severity_of(complete.get("severity"), "error")
    if complete.get("minEntitiesPerDocument") is not None:
        out.append(GraphCheck("global.completeness.min_entities", "minimum", severity_of(complete.get("minEntitiesSeverity"), base), {"least": int(complete["minEntitiesPerDocument"])}))
    wanted = complete.get("requiredEntityTypes")
    if wanted:
        types = dict(wanted) if isinstance(wanted, Mapping) else dict.fromkeys(wanted, 1)
        out.append(GraphCheck("global.completeness.required_entity_types", "required_types", severity_of(complete.get("requiredTypesSeverity"), base), {"types": types}))
    spread = declared.get("distributionRules") or {}
    for n, need in enumerate(spread.get("relationshipRequirements") or ()):
        out.append(_presence(f"global.relationship_requirement.{n}", need, need.get("entityType"), need.get("relationshipType"), need.get("minCount", 1)))
    balance = spread.get("entityBalance")
    if isinstance(balance, Mapping):
        out.append(GraphCheck("global.entity_balance", "balance", severity_of(balance.get("severity"), "warning"), {"most": balance.get("maxSingleTypeRatio"), "ratios": balance.get("expectedRatios") or {}}))
    for n, need in enumerate(declared.get("coverageRules") or ()):
        if None not in (need.get("entityType"), need.get("property"), need.get("minCoverage")):
            out.append(GraphCheck(f"global.property_coverage.{n}", "coverage", severity_of(need.get("severity"), "warning"), {"entity_type": need["entityType"], "prop": need["property"], "least": float(need["minCoverage"])}))
    for n, need in enumerate(declared.get("crossValidationRules") or ()):
        severity = severity_of(need.get("severity"), "warning")
        if need.get("ruleType") == "symmetric_relationship":
            out.append(GraphCheck(f"global.symmetric_relationship.{n}", "symmetric", severity, {"relationship": need.get("relationshipType"), "inverse": need.get("inverseType") or need.get("relationshipType")}))
        elif need.get("ruleType") == "property_alignment":
            out.append(GraphCheck(f"global.property_alignment.{n}", "alignment", severity, {"relationship": need.get("relationshipType"), "source": need.get("sourceProperty"), "target": need.get("targetProperty")}))
    for n, need in enumerate(declared.get("temporalRules") or ()):
        if need.get("entityType") and need.get("property"):
            options = {"entity_type": need["entityType"], "prop": need["property"], "earliest": need.get("earliest"), "latest": need.get("latest"), "allow_missing": bool(need.get("allowMissing", True))}
            out.append(GraphCheck(f"global.temporal.{need['entityType']}.{need['property']}.{n}", "temporal", severity_of(need.get("severity"), "warning"), options))
    return out


def compiled(ontology: Mapping[str, Any]) -> RuleSet:
    """All rules of an ontology: of its properties (a required one gets a rule of its own), entities and relationships, and
    global ones under ``quality``."""
    rules: list[Rule] = []
    checks: list[GraphCheck] = []
    for entity_type, body in (ontology.get("entities") or {}).items():
        body = body or {}
        for prop, d in (body.get("properties") or {}).items():
            d = d or {}
            rules += property_rules(entity_type, prop, d.get("quality") or {})
            if d.get("required"):
                rules.append(Rule(f"{entity_type}.{prop}.required", "required", entity_type, prop, "error"))
        complete = ((body.get("quality") or {}).get("entityLevel") or {}).get("completeness") or {}
        if complete.get("minPropertyFillRate") is not None:
            keys = tuple(body.get("properties") or {})
            checks.append(GraphCheck(f"{entity_type}.completeness.min_fill_rate", "completeness", severity_of(complete.get("severity"), "warning"), {"entity_type": entity_type, "keys": keys, "least": float(complete["minPropertyFillRate"])}))
        for name, d in (body.get("relationships") or {}).items():
            bounds = (((d or {}).get("quality") or {}).get("relationshipLevel") or {}).get("cardinality") or {}
            if bounds.get("minPerEntity") is not None:
                checks.append(_presence(f"relationship.{name}.cardinality", bounds, bounds.get("entityType", entity_type), name, bounds["minPerEntity"]))
    declared = ontology.get("quality") or {}
    given = declared.get("gating") or {}
    gating = {mine: type(default)(given.get(theirs, default)) for theirs, (mine, default) in GATING.items()}
    return RuleSet(tuple(rules), tuple(checks + global_checks(declared)), gating)


def _row(check: GraphCheck, **columns: Column) -> list[Column]:
    text = lambda c: columns.get(c, F.lit(None)).cast("string").alias(c)
    return [F.lit(check.rule_id).alias("rule_id"), F.lit(check.kind).alias("rule_type"), F.lit(check.severity).alias("severity"), *(text(c) for c in ("entity_type", "entity_id", "property_name", "expected", "actual"))]


def _confidence(check: GraphCheck, nodes: DataFrame, edges: DataFrame) -> DataFrame | None:
    out = None
    for df, least, kind in ((nodes, check.options["entities"], "type_"), (edges, check.options["relationships"], "relationship")):
        if least is None:
            continue
        c = F.coalesce("confidence_score", "provenance.confidence_score", F.lit(0.0))
        own = df.where(c < float(least)).select(*_row(check, entity_type=F.col(kind), entity_id=F.col("id"), expected=F.lit(f">= {least:g}"), actual=F.round(c, 4))).distinct()
        out = own if out is None else out.unionByName(own)
    return out


def _balance(check: GraphCheck, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    shares = quality.type_shares(nodes)
    t, share = F.col("entity_type"), F.col("share")
    off = F.lit(False)
    if check.options["most"] is not None:
        off = off | (share > float(check.options["most"]) + 1e-4)
    for name, bounds in check.options["ratios"].items():
        off = off | ((t == name) & ((share < float(bounds.get("min", 0))) | (share > float(bounds.get("max", 1)))))
    return shares.where(off).select(*_row(check, entity_type=t, expected=F.lit("a share within bounds"), actual=F.round(share, 4)))


def _temporal(check: GraphCheck, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    o = check.options
    raw = F.col("properties")[o["prop"]]
    at = iso_time(raw)
    found = F.when(at.isNull(), F.lit(None) if o["allow_missing"] else F.lit("a date"))
    if o["earliest"]:
        found = found.when(at < F.lit(o["earliest"]).cast("timestamp_ntz"), f">= {o['earliest']}")
    if o["latest"]:
        found = found.when(at > F.lit(o["latest"]).cast("timestamp_ntz"), f"<= {o['latest']}")
    own = nodes.where(F.col("type_") == o["entity_type"]).select("type_", "id", raw.alias("raw"), found.alias("found")).where("found is not null")
    return own.select(*_row(check, entity_type=F.col("type_"), entity_id=F.col("id"), property_name=F.lit(o["prop"]), expected=F.col("found"), actual=F.col("raw"))).distinct()


def _minimum(check: GraphCheck, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count_distinct("id").alias("n")).where(F.col("n") < check.options["least"])
    return n.select(*_row(check, expected=F.lit(f">= {check.options['least']}"), actual=F.col("n")))


def _required_types(check: GraphCheck, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return quality.missing_types(nodes, check.options["types"]).select(*_row(check, entity_type=F.col("entity_type"), expected=F.col("least"), actual=F.col("n")))


def _presence_check(check: GraphCheck, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    o = check.options
    few = quality.lacking_relationships(nodes, edges, o["entity_type"], o["relationship"], o["direction"], o["least"])
    return few.select(*_row(check, entity_type=F.lit(o["entity_type"]), entity_id=F.col("entity_id"), property_name=F.lit(o["relationship"]), expected=F.lit(o["least"]), actual=F.col("n")))


def _completeness(check: GraphCheck, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    o = check.options
    few = quality.incomplete_entities(nodes, {o["entity_type"]: o["keys"]}, o["least"]).distinct()
    return few.select(*_row(check, entity_type=F.col("entity_type"), entity_id=F.col("entity_id"), expected=F.lit(f">= {o['least']:g}"), actual=F.round("ratio", 4)))


def _coverage(check: GraphCheck, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    o = check.options
    low = quality.property_coverage(nodes, {o["entity_type"]: [o["prop"]]}).where(F.col("coverage") < o["least"])
    return low.select(*_row(check, entity_type=F.col("entity_type"), property_name=F.col("property_name"), expected=F.lit(f">= {o['least']:g}"), actual=F.round("coverage", 4)))


def _symmetric(check: GraphCheck, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    o = check.options
    alone = missing_mirrors(edges.select("id", "from_", "to_", "relationship"), o["relationship"], o["inverse"]).select("id").distinct()
    return alone.select(*_row(check, entity_id=F.col("id"), property_name=F.lit(o["relationship"]), expected=F.lit(o["inverse"])))


def _alignment(check: GraphCheck, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    o = check.options
    off = quality.inconsistent_edges(edges, nodes, o["relationship"], o["source"], o["target"]).distinct()
    return off.select(*_row(check, entity_id=F.col("edge_id"), property_name=F.lit(o["relationship"]), expected=F.col("source_value"), actual=F.col("target_value")))


GRAPH_CHECKS: dict[str, Callable[[GraphCheck, DataFrame, DataFrame], DataFrame | None]] = {
    "confidence": _confidence, "balance": _balance, "temporal": _temporal, "minimum": _minimum, "required_types": _required_types, "presence": _presence_check, "completeness": _completeness, "coverage": _coverage,
    "symmetric": _symmetric, "alignment": _alignment,
}


def iso_time(value: Column) -> Column:
    """An ISO date or time as TIMESTAMP without zone, a Z or offset taken into account; NULL where it is none."""
    v = strip(value)
    zoned = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"), v.try_cast("timestamp")).cast("timestamp_ntz")
    plain = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), v.try_cast("timestamp_ntz"))
    return F.coalesce(zoned, plain)


def validate(nodes: DataFrame, edges: DataFrame, rules: RuleSet) -> DataFrame:
    """(rule_id, rule_type, severity, entity_type, entity_id, property_name, expected, actual): all violations of a rule set.

    nodes: one row an entity. All property rules are one scan; each check of the graph is one plan more. An empty rule set
    gives no rows.
    """
    columns = ["rule_id", "rule_type", "severity", "entity_type", "entity_id", "property_name", "expected", "actual"]
    parts = [property_violations(nodes, rules.properties).select(columns)] if rules.properties else []
    for check in rules.graph:
        found = GRAPH_CHECKS[check.kind](check, nodes, edges)
        if found is not None:
            parts.append(found.select(columns))
    out = nodes.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    for p in parts:
        out = out.unionByName(p)
    return out


def instructions(rules: Iterable[Rule | GraphCheck]) -> list[str]:
    """Rules as sentences for a prompt."""
    told = lambda options: ", ".join(f"{k} {v}" for k, v in options.items() if v is not None)
    return [f"{r.entity_type}.{r.property_name}: {r.kind} {told(r.options)}".strip() if isinstance(r, Rule) else f"graph: {r.kind} {told(r.options)}".strip() for r in rules]


def names(rules: Sequence[Rule | GraphCheck]) -> list[str]:
    return [r.rule_id for r in rules]
