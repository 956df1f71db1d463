import random
from datetime import datetime

import pytest

from weftgraph.llm.components import hash_to_min, record_groups


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize(("seed", "hub"), [(0, 50_000), (1, 10)])
def test_random_graphs(spark, seed, hub):
    random.seed(seed)
    edges = [(f"{random.randrange(120):03d}", f"{random.randrange(120):03d}") for _ in range(80)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(50)]
    edges += [("h", f"s{i}") for i in range(60)]
    rows = hash_to_min(spark.createDataFrame([*edges, *edges[:5], (None, "x")], "a string, b string"), hub_rows=hub).collect()
    assert {r.vertex: r.component for r in rows} == union_find(edges) and len(rows) == len(union_find(edges))


def test_no_edges(spark):
    assert hash_to_min(spark.createDataFrame([], "a string, b string")).count() == 0


def test_verdicts_and_canonical_ids(spark):
    nodes = spark.createDataFrame(
        [(i, "u", "T", {"canonical_id": c}, "clash") for i, c in (("a", "1"), ("b", "1"), ("c", None), ("d", " "), ("e", " "), ("f", None), ("g", "2"))] + [(None, "u", "T", {"canonical_id": "1"}, "x"), ("z", None, "T", {"canonical_id": "1"}, "x")],
        "id string, user_id string, type string, properties map<string,string>, head string",
    )
    t = lambda n: datetime(2024, 1, n)
    pairs = [("B ", "c", "labeled_match", t(1)), ("c", "f", "labeled_match", t(1)), ("f", "c", "labeled_not_match", t(2)), ("f", "c", "skipped", t(3)), ("g", "nobody", "labeled_match", t(1)), ("g", "g", "labeled_match", t(1)), (None, "a", "labeled_match", t(1))]
    df = spark.createDataFrame(pairs + pairs[:1], "node_a_id string, node_b_id string, status string, labeled_at timestamp")
    assert {tuple(r) for r in record_groups(nodes, df).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    assert record_groups(nodes.where("false"), df.where("false")).count() == 0
