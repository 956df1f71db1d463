from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftgraph.functions.text import title_case
from weftgraph.operators import activity, chunking, edges, extraction, logs, resolution, review
from weftgraph.operators import entity_resolution as er
from weftgraph.plans import lineage, ontology_rules
from weftgraph.plans.rules import Rule, property_violations

T = lambda n: datetime(2024, 1, n)
NODE = "id string, type_ string, properties map<string,string>, confidence_score double, provenance struct<confidence_score:double>"


def test_compiled_rules_and_their_defaults():
    o = {
        "entities": {"A": {"properties": {"n": {"required": True, "quality": {"format": {"pattern": "x"}, "business": {"minValue": 1, "inclusive": False}, "validation": {"dateWindow": {"earliest": "2020-01-01", "severity": "ERROR"}}}}}}, "B": None},
        "quality": {"gating": {"maxErrors": "2"}, "temporalRules": [{"entityType": "A"}], "coverageRules": [{"entityType": "A", "property": "n"}]},
    }
    rules = ontology_rules.compiled(o)
    assert [(r.rule_id, r.severity) for r in rules.properties] == [("A.n.pattern", "warning"), ("A.n.range", "error"), ("A.n.date_window", "error"), ("A.n.required", "error")]
    assert rules.properties[1].options == {"least": 1, "inclusive": False} and rules.gating["max_errors"] == 2 and rules.gating["warn"] == 80.0
    assert rules.graph == () and len(rules) == 4 and len(ontology_rules.compiled({})) == 0
    assert ontology_rules.severity_of("loud", "info") == "info" and ontology_rules.instructions(rules.properties)[0].startswith("A.n: pattern")


def test_declared_checks_find_violations(spark):
    nodes = spark.createDataFrame([("1", "A", {"n": "2019-05-05", "m": "ab"}, 0.9, None), ("2", "A", {"n": "soon"}, None, (0.2,)), ("3", "B", None, None, None)], NODE)
    links = spark.createDataFrame([("e", "1", "2", "OF", 0.9, (0.9,))], "id string, from_ string, to_ string, relationship string, confidence_score double, provenance struct<confidence_score:double>")
    declared = {
        "entities": {"A": {"properties": {"n": {"quality": {"validation": {"dateWindow": {"earliest": "2020-01-01", "allowFuture": True}}}}, "m": {"quality": {"business": {"forbiddenPatterns": ["^a"], "requiredWords": ["zz"]}}}}, "quality": {"entityLevel": {"completeness": {"minPropertyFillRate": 0.9}}}}},
        "quality": {"extractionStandards": {"confidenceThresholds": {"entityExtraction": 0.5}}, "crossValidationRules": [{"ruleType": "symmetric_relationship", "relationshipType": "OF"}], "temporalRules": [{"entityType": "A", "property": "n", "allowMissing": False, "latest": "2019-01-01"}]},
    }
    got = sorted((r.rule_id, r.entity_id) for r in ontology_rules.validate(nodes, links, ontology_rules.compiled(declared)).collect())
    assert got == [
        ("A.completeness.min_fill_rate", "2"), ("A.m.forbidden_pattern_0", "1"), ("A.m.required_words", "1"), ("A.n.date_window", "1"), ("A.n.date_window", "2"), ("global.confidence_threshold", "2"), ("global.confidence_threshold", "3"),
        ("global.symmetric_relationship.0", "e"), ("global.temporal.A.n.0", "1"), ("global.temporal.A.n.0", "2"),
    ]
    assert ontology_rules.validate(nodes, links, ontology_rules.compiled({})).count() == 0


def test_patterns_with_flags_and_title_case(spark):
    df = spark.createDataFrame([("1", "T", {"a": "ABC", "b": "o'neil mc-fly"}), ("2", "T", {"a": "x\nbad", "b": "O'Neil Mc-Fly"})], "id string, type_ string, properties map<string,string>")
    rules = [Rule("p", "pattern", "T", "a", options={"pattern": "abc", "flags": 2}), Rule("f", "forbidden_pattern", "T", "a", options={"pattern": "zzz"}), Rule("c", "case_format", "T", "b", options={"style": "titleCase"})]
    assert sorted((r.rule_id, r.entity_id) for r in property_violations(df, rules).collect()) == [("c", "1"), ("f", "2"), ("p", "2")]
    assert spark.range(1).select(title_case(F.lit("o'NEIL 3rd ünit")).alias("x")).first().x == "o'NEIL 3rd ünit".title()


def test_pages_exports_and_reasons(spark):
    v = spark.createDataFrame([(f"r{i % 3}", f"e{i}", "p", "error" if i % 2 else "info") for i in range(10)], "rule_id string, entity_id string, property_name string, severity string")
    first = review.violation_page(v, 4).collect()
    second = review.violation_page(v, 4, first[-1].asDict()).collect()
    assert len(first) == len(second) == 4 and not {tuple(r) for r in first} & {tuple(r) for r in second} and first[-1].rule_id <= second[0].rule_id
    assert review.violation_page(v, 0).count() == 0 and review.violation_page(v, 99, severity="error").count() == 5
    row = review.export_rows(v.limit(1)).first()
    assert list(row.asDict()) == list(review.EXPORT) and row.confidence == "1.00" and row.message == ""
    reasons = spark.createDataFrame([("fail", "b"), ("warn", "a"), ("warn", "a"), ("fail", "a"), (None, "z")], "gate string, reason string")
    assert [tuple(r) for r in review.ranked_reasons(reasons).collect()] == [("a", 1, 3), ("b", 1, 1), ("z", 4, 1)]


def test_first_rows_of_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4900, "hot").otherwise("cold").alias("g"), "id")
    got = review.first_rows(df, ["g"], [F.desc("id")], 3, F.col("id")).collect()
    assert {(r.g, r.id, r.place) for r in got} == {("hot", 4899, 1), ("hot", 4898, 2), ("hot", 4897, 3), ("cold", 4999, 1), ("cold", 4998, 2), ("cold", 4997, 3)}


def test_edge_versions_and_diffs(spark):
    s = "from_ string, to_ string, relationship string, loaded_at timestamp, id string, properties map<string,string>"
    e = spark.createDataFrame([("a", "b", "R", T(1), "1", {"x": "1", "source": "q"}), ("a", "b", "R", T(2), "2", {"x": "1", "source": "z"}), ("a", "b", "R", T(3), "3", {"y": "2"}), ("a", "b", "R", T(4), "4", {}), ("c", "d", "R", T(1), "5", None), ("c", "d", "R", T(2), "6", {}), (None, "d", "R", T(1), "7", {})], s)
    assert {(r.from_, r.version_no, r.valid_from, r.valid_to) for r in edges.edge_versions(e).collect()} == {("a", 1, T(1), T(3)), ("a", 2, T(3), None), ("c", 1, T(1), None)}
    k = "source_key string, target_key string, relationship string, properties map<string,string>"
    base = spark.createDataFrame([("a", "b", "R", {"x": "1"}), ("a", "c", "R", {}), ("q", "r", "R", {"source": "1"})], k)
    compare = spark.createDataFrame([("a", "b", "R", {"x": "2"}), ("a", "d", "R", None), ("q", "r", "R", {"source": "2"})], k)
    assert {(r.target_key, r.change) for r in edges.edge_diff(base, compare).collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    kept, missing = edges.edge_sink(spark.createDataFrame([("1", "a", "b"), ("2", "a", "z"), ("3", None, "b")], "id string, from_ string, to_ string"), spark.createDataFrame([("a",), ("b",)], "id string"))
    assert [r.id for r in kept.collect()] == ["1"] and {tuple(r) for r in missing.collect()} == {("2", "to_"), ("3", "from_")}


def test_plans_of_blocking_and_comparison():
    props = {"a": {"type": "text"}, "b": {"type": "phone"}, "c": {}, "d": {"type": "float"}, "e": {}}
    assert [(r.prop, r.method) for r in er.blocking_rules(props)] == [("b", "suffix"), ("c", "first_n_chars"), ("d", "numeric_bucket")]
    assert er.blocking_rules({}) == [] and er.linkage_columns({"x": {"unique": True}, "y": {}, "z": {}}) == ["x", "y"]
    assert all(abs(sum(r.m) - 1) < 1e-9 and abs(sum(r.u) - 1) < 1e-9 for r in er.comparison_rules(props))


def test_layers_see_groups_as_one(spark):
    links = lambda rows: spark.createDataFrame(rows, "a string, b string")
    mapping, decisions = er.layered(spark.range(1), [("one", links([("b", "c"), ("x", "y")])), ("two", links([("c", "d"), ("a", "c"), ("q", "q")]))])
    assert {(r.id, r.representative) for r in mapping.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")}
    assert {(r.representative, r.layer, r.n_members) for r in decisions.collect()} == {("b", "one", 2), ("x", "one", 2), ("a", "two", 3)}
    groups = spark.createDataFrame([("g", "a"), ("g", "x"), ("h", "b"), ("h", "c")], "group string, id string")
    assert [tuple(r) for r in er.disputed(groups, mapping).collect()] == [("g", "a", "x")]


def test_vector_search_equals_brute_force(spark, monkeypatch):
    rows = [(i, [float((i * k) % 7 + 1) for k in (1, 2, 3)]) for i in range(60)] + [(99, None)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = base.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = {(r.query_id, r.vec_id, r.place) for r in resolution.nearest(asked, base, 4).collect()}
    monkeypatch.setattr(resolution, "QUERY_BLOCK", 1)
    assert {(r.query_id, r.vec_id, r.place) for r in resolution.nearest(asked, base.repartition(5), 4).collect()} == want and len(want) == 12


def test_property_overlap_skips_common_values(spark):
    s = "id string, type_ string, properties map<string,string>"
    store = spark.createDataFrame([(str(i), "T", {"status": "open", "n": str(i), "m": str(i // 2)}) for i in range(30)], s)
    asked = spark.createDataFrame([("q", "T", {"status": " OPEN", "n": "4", "m": "2"}), ("r", "T", {"status": "open"}), ("s", "T", None), ("t", "U", {"n": "4"})], s)
    got = {(r.query_id, r.id): (r.m, r.n) for r in resolution.property_overlap(asked, store, 0.6).collect()}
    assert got[("q", "4")] == (3, 3) and got[("q", "5")] == (2, 3) and sum(k[0] == "q" for k in got) == 2 and sum(k[0] == "r" for k in got) == 30


def test_averages_by_stretches(spark):
    rows = [("a", T(1 + i // 7), i, float((i * 37) % 11)) for i in range(60)] + [("b", T(1), 0, 5.0)]
    got = {r.k: (r.ema, r.n) for r in activity.smoothed_by(spark.createDataFrame(rows, "k string, at timestamp, i int, x double"), "k", ["at", "i"], "x").collect()}
    want = rows[0][3]
    for r in rows[1:60]:
        want = 0.7 * want + 0.3 * r[3]
    assert abs(got["a"][0] - want) < 1e-9 and got["a"][1] == 60 and got["b"] == (5.0, 1)


def test_chunks_by_kind_of_document(spark):
    story = "".join(f"The ship number {i} left the port in the north at dawn. The judge heard the case {i} and set a date for it.\n" for i in range(90))
    rows = [(1, "# A\ntext\n" + "- x\n" * 9), (2, story), (3, "one. two"), (4, " "), (5, None), (6, "y" * 9000)]
    got = chunking.chunks(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    kinds = {r.doc_id: r.method for r in got}
    assert kinds == {1: "structural", 2: "semantic", 3: "recursive", 6: "recursive"}
    assert max(len(r.chunk) for r in got) <= 4000 and [r.chunk_id for r in got if r.doc_id == 3] == ["3_chunk_0"]
    assert chunking.coalesced(list("abcdefg"), 3) == ["a\n\nb\n\nc", "d\n\ne\n\nf", "g"] and chunking.packed_paragraphs("ab\n\ncd\n\n" + "x" * 25, 10) == ["ab\n\ncd", "x" * 10, "x" * 10, "x" * 5]
    with pytest.raises(ValueError):
        chunking.ChunkConfig(least=10, most=5)


def test_model_calls(spark):
    chunks = spark.createDataFrame([(1, 0, "Yesterday Anna Berg met Dorn Logistics Ltd there."), (1, 1, None), (2, 0, "x")], "doc_id bigint, chunk_index int, chunk string")
    nodes = extraction.extracted_nodes(chunks)
    assert {(r.name, r.type_) for r in nodes.collect()} == {("Anna Berg", "Person"), ("Dorn Logistics Ltd", "Organization")}
    assert [(r.from_, r.to_, r.relationship) for r in extraction.extracted_edges(nodes, lambda a, b: "WORKS_AT" if (a, b) == ("Person", "Organization") else None).collect()] == [("1:0:0", "1:0:1", "WORKS_AT")]

    def fails(text):
        if text == "x":
            raise ValueError
        return [{"type_": "T", "name": "n"}]

    assert extraction.extracted_nodes(chunks, fails).count() == 2
    members = spark.createDataFrame([("g", str(i), "even" if i % 2 == 0 else "odd") for i in range(8)], "group string, id string, text string")
    assert {(r.id, r.representative) for r in extraction.judged_groups(members, lambda texts: [[t] for t in texts]).collect()} == {(str(i), str(i % 2)) for i in range(8)}
    assert extraction.answered_once(spark.createDataFrame([("1", "p"), ("2", "p")], "id string, prompt string"), str.upper).where("answer = 'P'").count() == 2


def test_logs_and_claims(spark):
    c = spark.createDataFrame([("1", "t", "node", "k", 0.5), ("2", " ", "node", "k", 0.5), ("3", "t", "x", "k", 0.5), ("4", "t", "edge", None, 0.5), ("5", "t", "node", "k", 1.5), ("6", "t", "node", "k", None)], "id string, target_id string, target_kind string, property_key string, confidence double")
    assert [r.problem for r in logs.checked_claims(c).orderBy("id").collect()] == [None, "target_id", "target_kind", "property_key", "confidence", "confidence"]
    assert spark.range(1).select(logs.classified(F.lit("Time OUT"), {"net": ("reset",), "time": ("out",)}).alias("x")).first().x == "time"


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.checkpoint_dir(Session())
