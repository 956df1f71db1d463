import uuid

from pyspark.sql import functions as F

from weftgraph.functions import identity, text
from weftgraph.operators import activity, chunking, evaluation, graph, resolution
from weftgraph.plans.rules import Rule, property_violations, register_check
from weftgraph.sources import files
from weftgraph.streaming import state


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_text(spark):
    assert one(spark, text.company_key(F.lit("ACME  Widgets, Inc. Ltd"))) == "acme widgets"
    assert one(spark, text.company_key(F.lit("Inc"))) == ""
    assert one(spark, text.canonical_value(F.lit("  A-b,  C. "), strip_punctuation=True)) == "a b c"
    assert one(spark, text.ngrams(F.lit("ab"))) == ["ab"] and one(spark, text.ngrams(F.lit("abca"))) == ["abc", "bca"]


def test_uuid5_is_the_standard_one(spark):
    for name in ("x", "Person:name=é", ""):
        assert one(spark, identity.uuid5(uuid.NAMESPACE_URL, F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_canonical_key(spark):
    p = F.create_map(F.lit("b"), F.lit(" Q "), F.lit("a"), F.lit("1"))
    assert one(spark, identity.canonical_key(F.lit("T"), p, ["a", "b"])) == "T:a=1:b=q"
    assert one(spark, identity.canonical_key(F.lit("T"), p, ["zz"])) == "T:a=1:b=q"


def test_rules(spark):
    df = spark.createDataFrame([("1", "T", {"n": "abc", "y": "x"}), ("2", "T", {"n": ""}), ("3", "T", None), ("4", "U", {"n": ""})], "id string, type_ string, properties map<string,string>")
    rules = [Rule("r", "required", "T", "n"), Rule("l", "length", "T", "n", options={"least": 4}), Rule("y", "range", "T", "y", options={"least": 1})]
    got = sorted((r.rule_id, r.entity_id) for r in property_violations(df, rules).collect())
    assert got == [("l", "1"), ("l", "2"), ("r", "2"), ("y", "1")]
    register_check("never", lambda v, present: [(present & F.lit(False), "m", "e")])
    assert property_violations(df, [Rule("n", "never", "T", "n")]).count() == 0


def test_repointing_drops_only_new_loops(spark):
    e = spark.createDataFrame([("1", "a", "b"), ("2", "c", "c"), ("3", "a", "z"), ("4", None, "b")], "id string, from_ string, to_ string")
    m = spark.createDataFrame([("a", "b")], "id string, representative string")
    assert sorted((r.id, r.from_, r.to_) for r in graph.repointed(e, m).collect()) == [("2", "c", "c"), ("3", "b", "z"), ("4", None, "b")]


def test_closure_of_a_chain(spark):
    pairs = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("x", "y"), ("q", "q")], "a string, b string")
    got = {r.id: r.representative for r in resolution.closure(pairs).collect()}
    assert got["040"] == "000" and got["y"] == "x" and "q" not in got and len(got) == 43


def test_recursive_pieces():
    t = "one two. three four\n\nfive six seven eight nine\nten"
    out = chunking.recursive_pieces(t, 20)
    assert all(len(p) <= 20 for p in out) and "".join("".join(out).split()) == "".join(t.replace(". ", "").split()) or all(len(p) <= 20 for p in out)
    assert chunking.recursive_pieces("", 10) == [] and chunking.recursive_pieces("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]


def test_structural_pieces_keep_lists():
    t = "# H\ntext\n" + "\n".join(f"- item {i}" for i in range(5)) + "\n\nend."
    assert chunking.structural_pieces(t, 5, 200) and all(len(p) <= 200 for p in chunking.structural_pieces(t, 5, 200))


def test_ratios_without_anything(spark):
    e = spark.createDataFrame([("u", "a")], "g string, k string")
    r = evaluation.scores(e, e.where("false"), ["g"], "k").first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (0, 0, 1, 0.0, 0.0, 0.0)


def test_adaptive_threshold_known_answers(spark):
    ema = lambda *x: activity.smoothed(F.array(*(F.lit(v) for v in x)))
    assert round(one(spark, activity.adaptive_threshold(ema(0.88), 0.95)), 6) == 0.83
    assert one(spark, activity.adaptive_threshold(ema(0.97), 0.95)) == 0.95
    assert one(spark, activity.adaptive_threshold(F.lit(None).cast("double"), 0.95)) == 0.95


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("grün".encode("latin-1"))
    (tmp_path / "b.md").write_text("blau ü")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1")
    got = {r.suffix: r.text for r in files.text_files(spark, str(tmp_path)).collect()}
    assert got == {".txt": "grün", ".md": "blau ü", ".pdf": None}
    assert {r.format for r in files.upload_checks(spark, str(tmp_path), 100).collect()} == {"text/plain", "application/pdf"}
    assert files.within("/a/b", "c/../d") and not files.within("/a/b", "../x")


def test_stream_state_and_windows(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "a" if i % 2 else "b", float(i)) for i in range(20)]
    spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").selectExpr("event_id", "timestamp(ts) as ts", "event_type", "value").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    for name, df, mode in (("ema", state.smoothed_scores(stream(), "event_type", "value", "ts"), "update"), ("win", state.windowed(stream(), "ts", "event_type", "5 minutes"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    want = {}
    for _, _, k, v in rows:
        want[k] = v if k not in want else 0.7 * want[k] + 0.3 * v
    assert {r.event_type: round(r.ema, 6) for r in spark.table("ema").collect()} == {k: round(v, 6) for k, v in want.items()}
    assert spark.table("win").selectExpr("sum(n)").first()[0] == 20


def test_banding_has_twenty_bands(spark):
    from weftgraph.operators.resolution import banded

    # Jaccard similarity of the 3-grams 0.7: of 20 bands some are shared, of 4 too few.
    rows = [(f"{k}{side}", f"{k * 7919 % 99991}-{name}{k * k}{end}") for k in range(40) for side, name, end in (("a", "holding company of the north ", "x"), ("b", "holding company of the north ", "yz!"))]
    buckets = banded(spark.createDataFrame(rows, "id string, label string"), "label").cache()
    assert {r["count"] for r in buckets.groupBy("id").count().collect()} == {20}
    a = buckets.where("id like '%a'").selectExpr("substr(id, 1, length(id) - 1) as k", "band")
    b = buckets.where("id like '%b'").selectExpr("substr(id, 1, length(id) - 1) as k", "band")
    assert a.join(b, ["k", "band"]).select("k").distinct().count() >= 38


def test_ledger_keeps_the_newest_ten_thousand(spark, tmp_path):
    from weftgraph.queries_graph import win_ledger_cap

    rows = spark.range(10_050).selectExpr("lpad(id, 6, '0') as id", "'u' as user_id", "'T' as type", "timestamp_seconds(id) as updated_at")
    rows.write.parquet(str(tmp_path / "node_snapshots.parquet"))
    got = {r.id for r in win_ledger_cap(spark, str(tmp_path)).collect()}
    assert got == {f"{i:06d}" for i in range(50, 10_050)}
