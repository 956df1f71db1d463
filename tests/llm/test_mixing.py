from weftgraph.llm import mixing
from weftgraph.llm.mixing import allocation, copies_a_size, draw, report, with_tokens

TARGETS = "mix_id string, source string, weight double, max_repeats int, size_ratio double, class string"


def test_tokens_and_sources(spark):
    df = spark.createDataFrame([(1, "Ab, c!! é1", " Trial-Registry ", "x"), (2, None, None, "x"), (3, "", "a", "x"), (None, "a", "a", "x"), (4, "x " * 20000, "a", "x")], "doc_id bigint, text string, source string, tokens string")
    assert {r.doc_id: (r.source, r.tokens) for r in with_tokens(df).collect()} == {1: ("trial_registry", 5), 2: (None, 0), 3: ("a", 0), 4: ("a", 20000)}


def test_copies_meet_the_target_under_the_cap():
    sizes = {8: [4, 5, 6, 5], 16: [17, 18, 19], 24: [65, 66]}
    classes = {k: (sum(v), sum(x**1.5 for x in v), max(v)) for k, v in sizes.items()}
    whole = sum(sum(v) for v in sizes.values())
    for target in (10, 150, 400, 500, 800):
        c = copies_a_size(target, 3, classes)
        copies = {x: min(3, c * x**0.5) for v in sizes.values() for x in v}
        reached = sum(copies[x] * x for v in sizes.values() for x in v)
        assert reached <= min(target, 3 * whole) + 1e-6 and reached >= 0.98 * min(target, 3 * whole)
    assert copies_a_size(5, 2, {}) == float("inf")


def test_shares_and_caps(spark):
    rows = [(i, s, 20 + (i * 37) % 200) for i, s in enumerate(["a"] * 600 + ["b"] * 300 + ["c"] * 10 + ["other"] * 100)] + [(5000, "a", 0), (5001, None, 7)]
    tokens = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("m", "A", 2.0, 3, 0.5, "x"), ("m", "b", 2.0, 3, 0.5, "x"), ("n", "c", 1.0, 2, 1.0, "x"), ("n", "none", 1.0, 9, 1.0, "x"), ("n", "a", None, 3, 1.0, "x"), (None, "a", 1.0, 1, 1.0, "x")], TARGETS)
    out = draw(tokens, targets).cache()
    assert out.count() == out.dropDuplicates(["mix_id", "doc_id"]).count()
    got = {(r.mix_id, r.source): r for r in report(out, targets).collect()}
    assert abs(got["m", "a"].actual_share - 0.5) < 0.01 and got["m", "a"].most_copies <= 3
    assert got["n", "c"].most_copies == 2 and got["n", "c"].n_documents == 10 and got["n", "none"].tokens == 0 and got["n", "a"].tokens == 0
    assert out.where("doc_id = 5000").count() == 0 and draw(tokens.where("false"), targets).count() == 0
    assert {tuple(r) for r in draw(tokens, targets).collect()} == {tuple(r) for r in out.collect()}


def test_inclusion_follows_the_odds(spark):
    tokens = spark.createDataFrame([(i, "a", 100) for i in range(400)], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("m", "a", 1.0, 2, 0.3, "x")], TARGETS)
    sizes = [draw(tokens, targets, seed=s).count() for s in range(4)]
    assert sizes == [120] * 4


def test_the_sample_is_the_same_however_its_end_is_found(spark, monkeypatch):
    rows = [(i, "a" if i % 3 else "b", 1 + (i * 53) % 400) for i in range(3000)]
    tokens = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("m", "a", 3.0, 2, 0.4, "x"), ("m", "b", 1.0, 2, 0.4, "x"), ("k", "b", 1.0, 5, 0.9, "x")], TARGETS)
    out = []
    for ranges in (1, 3, 4096):
        monkeypatch.setattr(mixing, "RANGES", ranges)
        out.append({tuple(r) for r in draw(tokens, targets).collect()})
    assert out[0] == out[1] == out[2]
    due = {(r.mix_id, r.source): r.due for r in allocation(tokens, targets).collect()}
    for key, want in due.items():
        got = sum(r[3] * r[4] for r in out[0] if r[:2] == key)
        assert abs(got - want) <= 200  # half of the longest document


def test_each_document_has_its_own_chance(spark):
    rows = [(i, "a", 16 if i % 2 else 19) for i in range(2000)]  # one class of length
    tokens = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("m", "a", 1.0, 1, 0.3, "x")], TARGETS)
    n = {16: 0, 19: 0}
    for seed in range(8):
        for r in draw(tokens, targets, seed=seed, power=2.0).collect():
            n[r.tokens] += 1
    assert abs(n[19] / n[16] - (19 / 16) ** 2) < 0.15
