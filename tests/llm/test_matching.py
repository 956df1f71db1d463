import random

from weftgraph.llm.matching import UNMATCHED, LevenshteinAutomaton, ReferenceList, Trie, candidates, canonical_values, described_names

ENTRIES = [("CourtCase", ["litigation"], "A dispute, also called lawsuit."), ("Vendor", ["supplier"], ""), ("Wallet", [], ""), ("Component", [], "A piece, such as a module.")]


def osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_the_full_matrix():
    random.seed(4)
    for _ in range(1500):
        a, b = ("".join(random.choice("abc") for _ in range(random.randrange(7))) for _ in "12")
        for limit in (0, 1, 2, 3):
            m = LevenshteinAutomaton(a, limit)
            s = m.start()
            for c in b:
                s = m.step(s, c)
            d = osa(a, b)
            assert m.distance(s) == (d if d <= limit else None), (a, b, limit)


def test_trie_returns_every_entry_within_the_distance():
    t = Trie()
    for w in ("abc", "abd", "xyz"):
        t.add(w, w.upper())
    assert t.search("abe", 1) == {"ABC": 1, "ABD": 1} and t.search("zzz", 1) == {} and t.below("ab") == {"ABC": 1, "ABD": 1}


def test_values():
    known = ReferenceList(ENTRIES, verbs=False)
    for value, entry in {
        "court  case": "CourtCase", "COURT_CASES": "CourtCase", "Lawsuit node": "CourtCase", "kg:litigtaion": "CourtCase", "wllt": "Wallet", "w4llet": "Wallet", "supplíer [?]": "Vendor", "vend.": "Vendor", "the modul": "Component",
        "vendor/supplier": "Vendor", "vendor/wallet": UNMATCHED, "glacier": UNMATCHED, "": UNMATCHED, "  ": UNMATCHED, "???": UNMATCHED, "x" * 5000: UNMATCHED,
    }.items():
        assert known.lookup(value) == entry, value
    assert known.lookup(None) == UNMATCHED


def test_verbs():
    known = ReferenceList([("ENROLLED_IN", ["SIGNED_UP_FOR"], ""), ("TAUGHT_BY", [], ""), ("OWNS", ["POSSESSES"], "")], verbs=True)
    for value, entry in {"enrols in": "ENROLLED_IN", "teachedBy": "TAUGHT_BY", "edge_owned": "OWNS", "is owning": "OWNS", "PSSSSS": "OWNS", "signed-up-foe": "ENROLLED_IN", "hates": UNMATCHED}.items():
        assert known.lookup(value) == entry, value


def test_records(spark):
    ref = spark.createDataFrame([(e, a, d, "x") for e, a, d in ENTRIES], "entity_type string, aliases array<string>, description string, value string")
    rows = [("1", "walet", "c"), ("1", "walet", "c"), ("2", "Wallet", "c"), ("3", None, "c"), ("4", " ", "c"), (None, "walet", "c"), ("5", "fog", "c")]
    df = spark.createDataFrame(rows, "id string, type_ string, canonical_value string")
    assert sorted(tuple(r) for r in canonical_values(df, "id", "type_", ref, "entity_type").collect()) == [("1", "Wallet"), ("5", UNMATCHED)]
    assert canonical_values(df.where("false"), "id", "type_", ref, "entity_type").count() == 0
    assert {r.canonical_value for r in canonical_values(df, "id", "type_", ref.where("false"), "entity_type").collect()} == {UNMATCHED}


def test_names_read_from_descriptions():
    assert described_names("A body such as an association, agency or institution that is not run for profit.") == ["association", "agency", "institution"]
    assert described_names("A registered sign for goods.") == ["registered sign"] and described_names("A scholarly publication or research article.") == ["scholarly publication", "research article"]
    assert described_names("") == [] and described_names("A site that admits patients; includes any clinic.") == ["clinic"]
    known = ReferenceList([("DIRECTOR_OF", [], "Person sits on the board."), ("OWNS", [], "")], verbs=True)
    assert known.lookup("Directs") == "DIRECTOR_OF" and known.lookup("sits on the board") == UNMATCHED


def test_all_entries_within_the_distance(spark):
    known = ReferenceList([("Grant", [], ""), ("Giant", [], ""), ("Wallet", [], "")], verbs=False)
    assert known.within("graint") == {"Grant": 1, "Giant": 2} and known.within("...") == {}
    ref = spark.createDataFrame([("Grant", ["Stipend"], ""), ("Giant", None, None), ("Wallet", [], "")], "e string, aliases array<string>, description string")
    df = spark.createDataFrame([("GRAINT",), ("gra-int",), ("stipend",), ("?",), (None,), ("fog",)], "v string")
    assert {tuple(r) for r in candidates(df, "v", ref, "e", "node").collect()} == {("node", "graint", "Grant", 1), ("node", "graint", "Giant", 2), ("node", "stipend", "Grant", 0)}
    assert candidates(df, "v", ref.where("false"), "e", "node").count() == 0
