from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm.packing import coverage_report, mixture_report, pack, packed_containers, packing_report

SIZES = st.lists(st.tuples(st.sampled_from("abc"), st.integers(1, 300)), max_size=60)


@settings(max_examples=150, deadline=None)
@given(SIZES, st.integers(1, 100))
def test_round_trip(items, capacity):
    pieces = [(s, i, n) for i, (s, n) in enumerate(items)]
    out = pack(pieces, capacity, {"a": 0.5, "b": 0.3, "c": 0.2}, {})
    assert all(0 < sum(p[4] for p in c) <= capacity for c in out)
    for _, doc, n in pieces:
        own = sorted(p[2:] for c in out for p in c if p[0] == doc)
        assert [p[0] for p in own] == list(range(len(own))) and sum(p[2] for p in own) == n
        assert [p[1] for p in own] == [sum(q[2] for q in own[:k]) for k in range(len(own))]
        assert n > capacity or len(own) == 1


def test_windows_keep_the_proportions():
    pieces = [("a", i, 10) for i in range(300)] + [("b", 1000 + i, 10) for i in range(100)]
    out = pack(pieces, 200, {"a": 0.75, "b": 0.25}, {"a": 0.0, "b": 0.0})
    shares = [sum(p[0] < 1000 for p in c) / len(c) for c in out]
    assert len(out) == 20 and all(abs(s - 0.75) <= 0.05 for s in shares)


def test_partitions_and_edge_cases(spark):
    rows = [(i, "a" if i % 3 else None, 50 + i % 90, "x") for i in range(500)] + [(900, "a", 0, "x"), (901, "a", None, "x"), (None, "a", 5, "x"), (902, "b", 5000, "x")]
    tokens = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, part string")
    specs = spark.createDataFrame([("s", 256), ("t", 1024), ("bad", 0), (None, 5)], "spec_id string, capacity_tokens int")
    out = packed_containers(tokens, specs, partition_tokens=10_000).cache()
    want = sum(n for i, _, n, _ in rows if i is not None and n)
    assert {r.spec_id: r.tokens for r in packing_report(out, specs).collect()} == {"s": want, "t": want}
    assert out.groupBy("spec_id", "container_id").agg({"tokens": "sum"}).join(specs, "spec_id").where("`sum(tokens)` > capacity_tokens").count() == 0
    assert packed_containers(tokens.where("false"), specs).count() == 0 and packed_containers(tokens, specs.where("false")).count() == 0
    kept = {r.spec_id: r for r in coverage_report(out, specs).collect()}
    n = sum(1 for i, _, t, _ in rows if i is not None and t)
    assert all((r.n_documents, r.tokens, r.n_overfull, r.n_loose) == (n, want, 0, 0) for r in kept.values())
    assert kept["s"].n_split == 1 and kept["s"].n_pieces == n - 1 + -(-5000 // 256) and kept["t"].n_pieces == n - 1 + 5


def test_every_window_holds_the_mixture(spark):
    rows = [(i, "abc"[i % 10 // 5 + i % 10 // 8], 20 + i * 37 % 30) for i in range(3000)]
    tokens = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    specs = spark.createDataFrame([("s", 1024)], "spec_id string, capacity_tokens int")
    for partition_tokens, most in ((10**6, 0.03), (40_000, 0.08)):  # small partitions hold chance mixtures of their own
        got = mixture_report(packed_containers(tokens, specs, partition_tokens=partition_tokens)).collect()
        assert len(got) == 3 and abs(sum(r.share for r in got) - 1) < 1e-9
        assert all(r.window_error < most and r.without < 0.05 for r in got), got
