import random

from weftgraph.llm.linkage import BUCKET_NODES, TARGET_RECALL, TARGET_SIMILARITY, MinHash, bands_for, candidate_pairs, collision, common_words, padded_grams, same_entity_pairs, spellings_of_one_record, star_clusters
from weftgraph.llm.names import Form, canonical_form, edits, parse_organisation, parse_person, similarity

COMMON = frozenset({"anthony", "abigail", "robert", "roberta", "logistics", "group", "systems", "university"})


def test_parsing():
    assert parse_person("Dr. Yarvald, Tony (author)") == (["tony"], ["yarvald"])
    assert parse_person("  ") == ([], [])
    assert parse_organisation("The Dorn & Vell Log. Grp, S.A. (Oslo)") == (["dorn", "vell", "logistics", "group"], "sa")


def test_forms():
    assert canonical_form("Person", "Yarvald, Tony", COMMON).text == canonical_form("Person", "ANTHONY YARVALD", COMMON).text
    assert canonical_form("Person", "", COMMON) is None and canonical_form("Organization", "&", COMMON) is None
    f = canonical_form("Organization", "BMG", COMMON)
    assert f.acronym and Form.read(f.text).text == f.text


def score(kind, a, b, ctx_a=("", "", ""), ctx_b=("", "", "")):
    return similarity(kind, canonical_form(kind, a, COMMON), canonical_form(kind, b, COMMON), ctx_a, ctx_b, COMMON)


def test_similarity():
    assert score("Person", "Anthony Yarvald", "Yarvlad, Anthony") > 0.8
    assert score("Person", "Robert Yarvald", "Roberta Yarvald") == 0
    assert score("Person", "A. Yarvald", "Anthony Yarvald") > 0.8 > score("Person", "A. Yarvald", "Anthony Yarvald", ("x", "1950", "Q"), ("y", "1977", "R"))
    assert score("Organization", "Dorn Logistics Ltd", "Dorn Systems Ltd") == 0 and score("Organization", "Dorn Logistics Ltd", "Dorn Logistics PLC") == 0
    assert score("Organization", "Dorn Log. Group", "Dorn Logistics") > 0.8


def test_bands_follow_the_collision_curve():
    b = bands_for(0.5, 0.9, 2)
    assert collision(0.5, 2, b) >= 0.9 > collision(0.5, 2, b - 1)
    m = MinHash(400, 1)
    x, y = padded_grams("yarvald"), padded_grams("yarwald")
    assert abs((m.of("yarvald") == m.of("yarwald")).mean() - len(x & y) / len(x | y)) < 0.1


def test_edits():
    assert edits("abcd", "abdc") == 1 and edits("", "ab") == 2 and edits("abc", "xyz", 1) == 2


def test_pairs(spark):
    given = ["Anthony", "Abigail", "Robert", "Roberta", "Wanda", "Hugo"]
    filler = [(f"f{i:03d}", "u", "Person", f"{g} {'bcdfgklmn'[i % 9]}{'aeiou'[i % 5]}r{'ptvz'[i % 4]}o{i}n".replace(str(i), "xyzw"[i % 4] + "aeiou"[i // 5 % 5] + "klmn"[i // 25 % 4]), {}) for i, g in enumerate(given * 25)]
    rows = [
        ("1", "u", "Person", "Anthony Yarvald", {"name": "Anthony Yarvald", "city": "X"}), ("1", "u", "Person", "Anthony Yarvald", {"name": "Anthony Yarvald", "city": "X"}), ("2", "u", "Person", "Yarvlad, Tony", None), ("3", "u", "Person", None, {"name": "A. Yarvald", "city": "X"}),
        ("4", "v", "Person", "Anthony Yarvald", {}), ("5", "u", "Drug", "Anthony Yarvald", {}), ("6", "u", "Person", None, {"name": " "}), (None, "u", "Person", "Anthony Yarvald", {}), ("7", None, "Person", "Anthony Yarvald", {}), ("8", "u", "Person", "x" * 3000, {}),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows + filler], "id string, user_id string, type string, label string, properties map<string,string>, node string")
    got = {tuple(r) for r in same_entity_pairs(df).collect()}
    assert {p for p in got if p[0] in "12345678"} == {("1", "2"), ("1", "3"), ("2", "3")}
    assert same_entity_pairs(df.where("false")).count() == 0


def test_crowded_buckets_lose_no_pair(spark):
    n = 2 * BUCKET_NODES + 100
    words = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("rn", "lk", "st", "mp", "nd", "rt", "sk", "lt", "nk", "rd", "ft", "lm", "pt", "xt", "ng")]
    # One acronym for many organisations, and many people of one family name and initial.
    rows = [("u", "Organization", "bxl|||A", False, "")] + [("u", "Organization", f"{w} x{w[::-1]}|logistics||F", True, "bxl") for w in words[:n]]
    rows += [("u", "Person", f"yarvald|a{w}||F", True, "") for w in words[:n]]
    df = spark.createDataFrame(rows, "user_id string, type string, form string, full boolean, acronym string").selectExpr("*", "xxhash64(type, form) as node")
    pairs = candidate_pairs(df, 2)
    kinds = df.select("node", "type", "form")
    met = pairs.join(kinds.withColumnRenamed("node", "a"), "a").join(kinds.selectExpr("node as b", "form as form_b"), "b").cache()
    assert met.where("type = 'Person'").count() == n * (n - 1) // 2
    assert met.where("form = 'bxl|||A' or form_b = 'bxl|||A'").count() == n
    assert pairs.where("a >= b").count() == 0


def test_few_names_are_linked_like_many(spark):
    rows = [("1", "Person", "Farid Yarvald", {}), ("2", "Person", "Farid Yarvlad", {}), ("3", "Person", "Wanda Yarvald", {}), ("4", "Organization", "Dornvik Logistics", {}), ("5", "Organization", "Dornvikk Logistics", {})]
    # Incomplete spellings, whose context agrees or contradicts.
    rows += [("6", "Person", "H. Kronstad", {"city": "X", "birth_year": "1950"}), ("7", "Person", "H. Kronsatd", {"city": "X", "birth_year": "1950"}), ("8", "Person", "H. Kronstda", {"city": "Y", "birth_year": "1977"})]
    df = spark.createDataFrame([("u", *r) for r in rows], "user_id string, id string, type string, label string, properties map<string,string>")
    assert {tuple(r) for r in same_entity_pairs(df).collect()} == {("1", "2"), ("4", "5"), ("6", "7")}


def test_given_names_are_told_at_any_size(spark):
    def given(n):
        words = [a + b + c + d for a in "bdfgk" for b in "aeiou" for c in ("rn", "lk", "st", "mp") for d in ("ad", "ov", "ik", "un", "el", "os", "em", "ir")]
        # One given name in a hundred beside ten family names only; family names are rare.
        names = [("farid " + words[i // 100 % 10]) if i % 100 == 0 else f"{words[i % 800]} {words[(i * 7 + 3) % 800]}x" for i in range(n)]
        df = spark.createDataFrame([("u", "Person", str(i), x) for i, x in enumerate(names)], "user_id string, type string, id string, raw string")
        return common_words(df)["Person"]

    assert given(1000) == given(8000) == {"farid"}


def test_measured_recall_of_planted_variants_whatever_the_bucket_limit(spark):
    rng = random.Random(5)
    letters = "abcdefghiklmnoprstuvz"
    # Family names of 6 to 10 letters, each with two variants of one or two typing errors beside the same initial.
    pairs, forms = {}, {}
    for k in range(300):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 11)))
        own = [word]
        for _ in range(2):
            w = list(word)
            for _ in range(rng.randrange(1, 3)):
                at = rng.randrange(len(w))
                w[at] = rng.choice(letters)
            own.append("".join(w))
        for w in own:
            forms[w] = f"{w}|anna||F"
        for i, x in enumerate(own):
            for y in own[i + 1 :]:
                gx, gy = padded_grams(x), padded_grams(y)
                if x != y and len(gx & gy) / len(gx | gy) >= TARGET_SIMILARITY:
                    pairs[forms[x], forms[y]] = True
    df = spark.createDataFrame([("u", "Person", f, "") for f in sorted(set(forms.values()))], "user_id string, type string, form string, acronym string").selectExpr("*", "xxhash64(type, form) as node")
    found = [{tuple(r) for r in candidate_pairs(df, bands_for(), n).collect()} for n in (5, BUCKET_NODES)]
    assert found[0] == found[1]
    at = {r.form: r.node for r in df.collect()}
    hit = sum((min(at[x], at[y]), max(at[x], at[y])) in found[1] for x, y in pairs)
    assert len(pairs) > 300 and hit / len(pairs) >= TARGET_RECALL - 0.02


def test_all_spellings_of_a_record_are_tied_and_long_chains_settle(spark):
    members = spark.createDataFrame([("u", "Person", "1", n) for n in (5, 3, 9, 3)] + [("u", "Person", "2", 3)], "user_id string, type string, id string, node long")
    assert {(r.a, r.b) for r in spellings_of_one_record(members).collect()} == {(3, 5), (3, 9)}
    # A chain whose ranks fall from end to end: one centre a round.
    n = 65
    nodes = spark.createDataFrame([(i, True, n - i) for i in range(n)], "node long, full boolean, size int")
    links = spark.createDataFrame([(i, i + 1, 0.9) for i in range(n - 1)], "a long, b long, score double")
    got = {r.node: r.center for r in star_clusters(nodes, links).collect()}
    assert all(got[i] == i - i % 2 for i in range(n - 1))
