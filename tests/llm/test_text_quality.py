import random

import numpy as np

from weftgraph.llm.prose import COMMON, STATISTICS, Neighbours, line_kinds, text_statistics
from weftgraph.llm.text_quality import SENSELESS, fitted_statistics, not_prose

PROSE = ["The office in the north has not yet said who paid for the boxes, and so the matter was put off.", "It was the third time that the same case had come before the court, which was no surprise to them.", "Nobody on the ward knew which of the tablets was the real one until the code was broken by the team.", "They asked both sides to explain why the clause had never been read before it was signed by the board."]
LIST = "\n".join(f"- valve Nor{i}\n- pump Sel{i}" for i in range(8))
TABLE = "item;qty;price\n" + "\n".join(f"bolt;{i};{i * 3}.5" for i in range(12))


def docs(n=160):
    random.seed(3)
    out = [(i, " ".join(random.choice(PROSE) for _ in range(random.randrange(2, 9))), "x") for i in range(n)]
    salad = " ".join(PROSE).lower().replace(",", "").replace(".", "").split()
    random.shuffle(salad)
    extra = [LIST, TABLE, "7f3a 99b2 c0de " * 30, " ".join(salad), "", None, PROSE[0] + "\n\n" + LIST, PROSE[0] + "\n\n- one valve", "The the the " * 80, "{{ a.b }} {% if c %}" * 9]
    return out + [(1000 + i, t, "x") for i, t in enumerate(extra)] + [(None, LIST, "x")]


def test_found_kinds(spark):
    df = spark.createDataFrame(docs(), "doc_id bigint, text string, kind string")
    got = {r.doc_id: r.kind for r in not_prose(df).collect()}
    assert got == {1000: "list", 1001: "table", 1002: "junk", 1003: "junk", 1004: "junk", 1005: "junk", 1006: "list", 1008: "junk", 1009: "junk"}


def test_contributions_add_up(spark):
    df = spark.createDataFrame(docs(), "doc_id bigint, text string, kind string")
    rows = fitted_statistics(df).collect()
    assert len(rows) == 170 and all(abs(sum(r.contributions) - r.distance2) < 1e-6 * max(1, r.distance2) for r in rows)
    assert not_prose(df.where("false")).count() == 0


def test_line_kinds():
    assert line_kinds("| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |", 0.0)["table"] > 0
    k = line_kinds(PROSE[0] + "\n\n" + TABLE, 0.2)
    assert k["prose"] > 0 and k["table"] > k["list"] + k["junk"]


def test_neighbours_tell_order_from_shuffle():
    n = Neighbours()
    words = [w.strip(",.").lower() for p in PROSE for w in p.split()] * 20
    size = (len(n.place["en"]) + 1) ** 2
    n.fit({"en": np.bincount(n.cells(words, "en"), minlength=size)})
    mixed = words[:]
    random.Random(1).shuffle(mixed)
    def mean(*texts):
        each = [np.unique(n.cells(t, "en"), return_counts=True) for t in texts]
        starts = np.cumsum([0, *(len(c) for c, _ in each[:-1])])
        return n.means("en", np.concatenate([c for c, _ in each]), np.concatenate([k for _, k in each]), starts, np.array([len(t) for t in texts]))

    both = mean(words, mixed)
    assert both[0] > 0.3 > both[1] and "the" in COMMON["en"]
    assert abs(both[0] - mean(words)[0]) < 1e-9 and mean(["x"])[0] == 0


def test_long_and_odd_texts():
    for t in ("x" * 200_000, "\n" * 5000, "a " * 100_000, "é" * 999, None):
        assert len(text_statistics(t, Neighbours())[2]) == 12


def test_a_sentence_does_not_hide_a_table(spark):
    table = "\n".join(f"{i}\t{i * 17 % 90}.25\t{i * 31 % 700}\t{i * 7 % 100} %" for i in range(20))
    text = PROSE[1] + "\n\n" + table
    lang, _, stats, chars, _, _ = text_statistics(text, Neighbours())
    assert lang == "en" and chars["table"] > chars["prose"] > 0 and stats[STATISTICS.index("common_line_characters")] < 0.5
    df = spark.createDataFrame(docs() + [(2000, text, "x")], "doc_id bigint, text string, kind string")
    assert {r.doc_id: r.kind for r in not_prose(df).collect()}.get(2000) == "table"


def test_the_distance_decides(spark):
    df = spark.createDataFrame(docs(), "doc_id bigint, text string, kind string")
    assert not_prose(df, outlying=float("inf")).count() == 0
    # Words without order are told from sentences by what their neighbours contribute, whatever their lines look like.
    s = {r.doc_id: r for r in fitted_statistics(df).collect()}
    assert s[1003].prose_chars > 0 == s[1003].list_chars + s[1003].table_chars + s[1003].junk_chars and not s[1003].broken
    worst = sorted(range(len(STATISTICS)), key=lambda i: -s[1003].contributions[i])[:3]
    assert STATISTICS.index("neighbour_fit") in worst and s[1003].senseless > SENSELESS > s[0].senseless
    assert not any(x in STATISTICS for x in ("list_lines", "table_lines", "junk_lines"))


def test_repeated_rows_and_few_documents(spark):
    rows = [(1, PROSE[0], "x"), (1, PROSE[0], "x"), (2, LIST, "x"), (3, "", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    assert {(r.doc_id, r.kind) for r in not_prose(df).collect()} >= {(3, "junk")}
