from datetime import datetime

from weftgraph.operators.references import lifetimes, orphan_references

D = lambda n: datetime(2024, 1, n)
REFS = "r string, k string, l string, at timestamp, reason string, _k0 string, _salt int"
NODES = "id string, id2 string, f timestamp, t timestamp, _state string"


def found(spark, refs, nodes, **options):
    r = spark.createDataFrame([(a, k, l, at, "own", "x", 1) for a, k, l, at in refs], REFS)
    n = spark.createDataFrame([(i, j, f, t, "s") for i, j, f, t in nodes], NODES)
    cols = (["k", "l"], ["id", "id2"]) if options.pop("both", False) else (["k"], ["id"])
    return sorted((x.r, x.reason) for x in orphan_references(r, cols[0], n, cols[1], **options).collect())


def test_reasons(spark):
    nodes = [("a", None, D(5), D(10)), ("a", None, D(12), None), ("b", None, D(20), None)]
    refs = [("1", "a", None, D(4)), ("2", "a", None, D(5)), ("3", "a", None, D(10)), ("4", "a", None, D(11)), ("5", "a", None, D(30)), ("6", "b", None, D(1)), ("7", "z", None, D(1)), ("8", None, None, D(1)), ("9", "a", None, None), ("A", "z", None, None)]
    assert found(spark, refs, nodes, at="at", valid_from="f", valid_to="t") == [("1", "late"), ("3", "deleted"), ("4", "deleted"), ("6", "late"), ("7", "missing"), ("A", "missing")]


def test_empty_tables(spark):
    assert found(spark, [], [("a", None, D(1), None)]) == []
    assert found(spark, [("1", "a", None, D(1))], []) == [("1", "missing")]


def test_match_semantics_of_composite_keys(spark):
    nodes = [("a", "x", None, None), ("b", None, None, None)]
    refs = [("1", "a", "x", None), ("2", "a", None, None), ("3", "q", None, None), ("4", None, "x", None), ("5", None, None, None), ("6", "a", "y", None)]
    assert found(spark, refs, nodes, both=True) == [("6", "missing")]
    assert found(spark, refs, nodes, both=True, match="full") == [("2", "partial_key"), ("3", "partial_key"), ("4", "partial_key"), ("6", "missing")]
    assert found(spark, refs, nodes, both=True, match="partial") == [("3", "missing"), ("6", "missing")]


def test_repeated_rows_stay_and_hot_keys_are_salted(spark):
    refs = [(str(i), "hot" if i % 2 else f"k{i}", None, D(5)) for i in range(4000)] + [("1", "hot", None, D(5))]
    got = found(spark, refs, [("hot", None, D(9), None)], at="at", valid_from="f", valid_to="t")
    assert sum(r == "late" for _, r in got) == 2001 and sum(r == "missing" for _, r in got) == 2000


def test_lifetimes_cover_the_whole_line_once(spark):
    v = spark.createDataFrame([("a", D(3), D(5)), ("a", D(4), D(8)), ("a", D(8), D(9)), ("a", D(15), D(12)), ("b", None, D(2)), ("c", D(1), None), ("c", D(2), D(3))], "id string, f timestamp, t timestamp")
    rows = lifetimes(v, ["id"], "f", "t").collect()
    assert {(r.begins, r.ends, r.state) for r in rows if r.id == "a"} == {(None, D(3), "late"), (D(3), D(9), "valid"), (D(9), D(15), "deleted"), (D(15), D(15), "valid"), (D(15), None, "deleted")}
    assert {(r.begins, r.ends, r.state) for r in lifetimes(v, ["id"], "f", "t").collect() if r.id == "b"} == {(None, D(2), "valid"), (D(2), None, "deleted")}
    assert {(r.begins, r.ends, r.state) for r in lifetimes(v, ["id"], "f", "t").collect() if r.id == "c"} == {(None, D(1), "late"), (D(1), None, "valid")}


def test_versions_melt_across_quarters(spark):
    months = [datetime(2023, m, 1) for m in range(1, 13)]
    v = spark.createDataFrame([("a", f, t) for f, t in zip(months, [*months[1:], None])] * 2 + [("b", months[0], months[2]), ("b", months[5], months[11])], "id string, f timestamp, t timestamp")
    rows = {(r.id, r.begins, r.ends, r.state) for r in lifetimes(v, ["id"], "f", "t").collect()}
    assert rows == {("a", None, months[0], "late"), ("a", months[0], None, "valid"), ("b", None, months[0], "late"), ("b", months[0], months[2], "valid"), ("b", months[2], months[5], "deleted"), ("b", months[5], months[11], "valid"), ("b", months[11], None, "deleted")}


def test_partial_keys_in_time(spark):
    nodes = [("a", "x", D(5), D(10)), ("a", "y", D(12), None)]
    refs = [("1", "a", None, D(11)), ("2", "a", None, D(13)), ("3", None, "y", D(6)), ("4", None, None, D(6)), ("5", "b", None, D(6))]
    assert found(spark, refs, nodes, both=True, match="partial", at="at", valid_from="f", valid_to="t") == [("1", "deleted"), ("3", "late"), ("5", "missing")]
