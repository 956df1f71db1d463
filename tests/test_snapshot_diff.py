from datetime import datetime

from weftgraph.operators.snapshot_diff import diff_summary, property_changes, snapshot_changes

SCHEMA = "user_id string, transform_id string, seq_no int, id string, type string, properties map<string,string>, canonical_id string, canonical_key string, loaded_at timestamp, pair string, side string, k1 string"
T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def row(t, seq, i, props=None, cid=None, ckey=None, kind="P", at=T1, user="u"):
    return (user, t, seq, i, kind, props, cid, ckey, at, "x", "y", "z")


def changes(spark, rows):
    return {tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA)).select("transform_id", "change_kind", "node_id").collect()}


def test_first_snapshot_and_empty_table_give_nothing(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [row("a", 1, "1"), row("a", 1, "2")]) == set()


def test_added_removed_changed(spark):
    rows = [row("a", 1, "1", {"x": "1"}), row("a", 1, "2", {"x": "1"}), row("b", 3, "1", {"x": "2"}), row("b", 3, "3", {})]
    assert changes(spark, rows) == {("b", "changed", "1"), ("b", "removed", "2"), ("b", "added", "3")}


def test_latest_copy_counts_and_repeats_count_once(spark):
    rows = [row("a", 1, "1", {"x": "1"}), row("b", 2, "1", {"x": "2"}), row("b", 2, "1", {"x": "1"}, at=T2), row("b", 2, "1", {"x": "1"}, at=T2)]
    assert changes(spark, rows) == set()


def test_stages(spark):
    base = [row("a", 1, "1", {}, cid="C"), row("a", 1, "2", {}, ckey="K"), row("a", 1, "3", {}, cid="X", ckey="K2"), row("a", 1, "4", {"v": "1"})]
    compare = [row("b", 2, "9", {"p": "1"}, cid="C"), row("b", 2, "8", {}, cid="N", ckey="K"), row("b", 2, "7", {}, cid="Y", ckey="K2"), row("b", 2, "4", {"v": "2"}, kind="Q")]
    # 1-9 by canonical id (changed), 2-8 by key, 3 and 7 have ids that differ, 4 by id whatever its type.
    assert changes(spark, base + compare) == {("b", "changed", "9"), ("b", "removed", "3"), ("b", "added", "7"), ("b", "changed", "4")}


def test_identity_in_properties_blank_columns_and_bookkeeping(spark):
    rows = [row("a", 1, "1", {"canonical_id": "C", "page_number": "1"}, cid=" "), row("b", 2, "2", {"page_number": "7", "n": None}, cid="C")]
    assert changes(spark, rows) == set()


def test_empty_string_is_a_value(spark):
    assert changes(spark, [row("a", 1, "1", {"x": ""}), row("b", 2, "1", {})]) == {("b", "changed", "1")}


def test_rows_sharing_a_key_pair_once_each(spark):
    rows = [row("a", 1, i, {}, cid="C") for i in "123"] + [row("b", 2, i, {}, cid="C") for i in "234"] + [row("b", 2, "5", {}, cid="C")]
    assert changes(spark, rows) == {("b", "added", "5")}


def test_nulls_anywhere_and_users_apart(spark):
    rows = [(None,) * 12, row("a", 1, None), row("a", 1, "1", None, user="v"), row("b", 2, "1", None, kind=None, user="v"), row("a", 1, "1"), row("b", 2, "2")]
    assert changes(spark, rows) == {("b", "added", "2"), ("b", "removed", "1")}


def test_chunk_size_does_not_matter(spark):
    rows = [row("a", 1, str(i), {"x": str(i)}, cid=f"c{i}") for i in range(200)] + [row("b", 2, str(i), {"x": str(i if i % 17 else -1)}, cid=f"c{i}") for i in range(5, 205)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [{tuple(r) for r in snapshot_changes(df, chunk_rows=n).collect()} for n in (1, 64)]
    assert got[0] == got[1] and len(got[0]) == 5 + 5 + len([i for i in range(5, 200) if i % 17 == 0])
    s = diff_summary(df).first()
    assert (s.nodes_added, s.nodes_removed) == (5, 5) and s.nodes_unchanged + s.nodes_changed == 195


def test_property_changes(spark):
    rows = [row("a", 1, "1", {"x": "1", "y": "2"}, cid="C"), row("b", 2, "1", {"x": "3", "z": "4"}, cid="C")]
    got = {(r.canonical_id, r.property_key, r.old_value, r.new_value) for r in property_changes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("C", "x", "1", "3"), ("C", "y", "2", None), ("C", "z", None, "4")}
