import pytest
from pyspark.sql import functions as F

from weftgraph.operators import matching_cascade as cascade
from weftgraph.operators import ontology, versioning
from weftgraph.plans.skew import hot_keys, salted_join
from weftgraph.queries import QUERIES
from weftgraph.registry import ORACLE


def test_first_match_wins_and_ambiguity_names_nobody(spark):
    r = spark.createDataFrame([("1", "a", "x"), ("2", "zz", "y"), ("3", None, "q"), ("4", "a", None)], "id string, k string, n string")
    t = spark.createDataFrame([("A", "a", "x"), ("B", "b", "y"), ("C", "c", "y")], "id string, k string, n string")
    s = [("key", [(F.col("k"), F.col("k"))], 0.9), ("name", [(F.col("n"), F.col("n"))], 0.8)]
    assert {tuple(x) for x in cascade.first_match(r, t, s).collect()} == {("1", "key", "A", 1, 0.9), ("2", "name", None, 2, 0.4), ("4", "key", "A", 1, 0.9)}
    assert cascade.first_match(r.where("false"), t, s).count() == 0


def test_salted_join_equals_the_plain_one(spark):
    left = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id").unionByName(spark.createDataFrame([(None, 1)], "k string, id bigint"))
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), (None, 4)], "k string, v int")
    assert [r.k for r in hot_keys(left.where("k is not null"), ["k"], 0.2).collect()] == ["hot"]
    for how in ("inner", "left", "left_semi", "left_anti"):
        a, b = salted_join(left, right, ["k"], how, F.col("id"), share=0.2), left.join(right, "k", how)
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect())), how


def test_pruning(spark):
    nodes = spark.createDataFrame([("a", "P", {}), ("b", "P", {"name": "x"}), ("c", "P", {}), ("d", "Q", {}), ("e", "R", {})], "id string, type_ string, properties map<string,string>")
    edges = spark.createDataFrame([("1", "a", "zz")], "id string, from_ string, to_ string")
    rels = spark.createDataFrame([("Q", "OF", "R")], "source_type string, rel_type string, target_type string")
    kept, added = cascade.pruned(nodes, edges, ["name"], rels)
    assert {r.id for r in kept.collect()} == {"a", "b", "d", "e"}
    assert {(r.from_, r.to_, r.relationship) for r in added.collect()} == {("d", "e", "OF")}
    assert cascade.pruned(nodes, edges.where("false"), ["name"], rels)[0].count() == 5


def test_ontology_shapes_and_views(spark):
    nested = {"entities": {"A": {"properties": {"n": {"type": "integer", "required": True}, "s": {"enum": ["Red", "Blue"]}}, "relationships": {"OF": {"target": "B"}}}, "B": None}}
    top = {"entities": {"A": {}, "B": {}}, "relationships": {"OF": {"source": "A", "target": "B"}}}
    one = [r["rel_type"] + r["source_type"] + r["target_type"] for o in (nested, top) for r in ontology.normalised(o)["rel_types"]]
    assert one == ["OFAB", "OFAB"]
    defs = ontology.normalised(nested)["prop_defs"]
    assert ontology.row_type(defs).simpleString() == "struct<n:bigint,s:string>"
    df = spark.createDataFrame([("1", "A", {"n": " 4 ", "s": "red"}), ("2", "A", {"n": "x"}), ("3", "A", {"s": "Red"}), ("4", "A", {"n": "1", "s": "green"}), ("5", "B", {"n": "1"}), ("6", "A", None)], "id string, type_ string, properties map<string,string>")
    assert {tuple(r) for r in ontology.typed_view(df, "A", defs).collect()} == {("1", 4, "Red")}
    with pytest.raises(ValueError):
        ontology.normalised({"entities": ["A"]})
    assert {k: v.count() for k, v in ontology.tables(spark, nested).items()} == {"entity_types": 2, "prop_defs": 2, "rel_types": 1}
    ontology.register_canonicalizer("A.n", F.upper)
    assert ontology.canonicalizer("A", "n", F.lower) is F.upper and ontology.canonicalizer("B", "n", F.lower) is F.lower


def test_scenarios(spark):
    schema = "id string, type_ string, properties map<string,string>"
    a = spark.createDataFrame([("1", "T", {"x": "1", "y": "2"}), ("2", "T", {}), ("3", "T", None)], schema)
    b = spark.createDataFrame([("1", "T", {"y": "2", "x": "1"}), ("2", "U", {}), ("4", "T", {})], schema)
    assert versioning.scenario_diff(a, a).count() == 0
    assert {tuple(r) for r in versioning.scenario_diff(a, b).collect()} == {("2", "updated"), ("3", "removed"), ("4", "added")}
    mirror = {"added": "removed", "removed": "added", "updated": "updated"}
    assert {(r.id, mirror[r.change]) for r in versioning.scenario_diff(b, a).collect()} == {tuple(r) for r in versioning.scenario_diff(a, b).collect()}


def test_every_twin_has_its_query():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 100


def test_every_transform_is_matched_with_the_one_before(spark, tmp_path):
    from weftgraph.queries_cascade import jn_production_match

    rows = [("u", "t1", 1, "a", "k1"), ("u", "t2", 2, "b", "k1"), ("u", "t3", 3, "c", "k1"), ("v", "s2", 2, "x", "k1"), ("v", "s5", 5, "y", "k1"), ("v", "s5", 5, "z", "k2")]
    df = spark.createDataFrame([(*r, "T", {"name": r[3]}) for r in rows], "user_id string, transform_id string, seq_no int, id string, canonical_id string, type string, properties map<string,string>")
    df.write.parquet(str(tmp_path / "node_snapshots.parquet"))
    got = {(r.user_id, r.transform_id, r.id, r.strategy, r.target) for r in jn_production_match(spark, str(tmp_path)).collect()}
    assert got == {("u", "t2", "b", "canonical_id", "a"), ("u", "t3", "c", "canonical_id", "b"), ("v", "s5", "y", "canonical_id", "x")}
