"""Mapping freely typed values to the entries of a reference list.

Every spelling that may stand for an entry (its name, its aliases, their inflected forms and abbreviations) is a path
in one trie. A value is walked through the trie by a Levenshtein automaton, which returns every entry with a path
within a distance that depends on the value's length. The nearest entry counts; a tie between entries, or a value that
names several, is reported as UNMATCHED.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.skew import salted_join
from weftgraph.plans.workers import by_value

by_value(__name__)

UNMATCHED = "UNMATCHED"

# Digits typed for letters.
DIGIT_LETTERS = {"0": "o", "1": "i", "3": "e", "5": "s"}
# Words and marks put around a value that say nothing about it.
LEADING = re.compile(r"^(?:[\s\"'`#:\->\[\]()*.]+|(?:a|an|the)\s+|\w{1,4}:|(?:type|kind|class|label|relation|edge|node)\s*[:=]|(?:edge|node|rel)_)", re.I)
TRAILING = re.compile(r"(?:[\s\"'`#:\->*,;!?]+|\[\?*\]|\(\)|\((?:entity|node|type|edge)\)|\s+(?:entity|node|type|edge))$", re.I)
SEPARATOR = re.compile(r"\s*[/|,;&+]\s*|\s+(?:and|or)\s+", re.I)
# Phrases of a description that introduce other names of the entry.
ALSO_CALLED = re.compile(r"\b(?:also called|sometimes called|such as|includes any|any|named)\s+((?:an? |the )?[a-z]+(?:(?:, or |, | or )(?:an? |the )?[a-z]+)*)|; an? ([a-z]+)", re.I)
ITEM = re.compile(r"\s*(?:,|\bor\b)\s*(?:an? |the )?", re.I)
# Words that end the phrase with which a description begins.
PHRASE_ENDS = frozenset("a an the of or and in on at to for from by with that which who whose is are was were has have had not such any into over under inside between before".split())
# Irregular verbs of relationship names, with their base forms.
BASE_FORMS = {"taught": "teach", "bought": "buy", "took": "take", "run": "run", "running": "run", "held": "hold", "written": "write", "upkept": "upkeep"}
VOWELS = frozenset("aeiou")


def distance_limit(length: int) -> int:
    """Edits allowed for a value of so many letters."""
    return 0 if length <= 3 else 2 if length <= 10 else 3


class LevenshteinAutomaton:
    """Accepts the words within ``limit`` edits (insert, delete, replace, and with ``swaps`` swap of neighbours) of ``word``.

    A state is the sparse row of the edit matrix: the positions of the word that can still be reached within the
    limit, with their distances, and the row before for swaps. An empty row is the dead state.
    """

    def __init__(self, word: str, limit: int, swaps: bool = True) -> None:
        self.word, self.limit, self.swaps = word, limit, swaps

    def start(self) -> tuple[dict[int, int], dict[int, int], str]:
        return {i: i for i in range(min(self.limit, len(self.word)) + 1)}, {}, ""

    def step(self, state: tuple[dict[int, int], dict[int, int], str], char: str) -> tuple[dict[int, int], dict[int, int], str]:
        row, older, last = state
        word, limit, n = self.word, self.limit, len(self.word)
        out: dict[int, int] = {}
        for i, d in row.items():
            if d < limit and d + 1 < out.get(i, 99):  # char is extra
                out[i] = d + 1
            if i < n:
                cost = d + (word[i] != char)
                if cost <= limit and cost < out.get(i + 1, 99):
                    out[i + 1] = cost
        if last and self.swaps:
            for i, d in older.items():
                if i + 1 < n and word[i] == char and word[i + 1] == last and char != last and d + 1 <= limit and d + 1 < out.get(i + 2, 99):
                    out[i + 2] = d + 1
        for i in sorted(out):  # letters of the word left out
            d, j = out[i], i + 1
            while d < limit and j <= n and d + 1 < out.get(j, 99):
                d += 1
                out[j] = d
                j += 1
        return out, row, char

    def distance(self, state: tuple[dict[int, int], dict[int, int], str]) -> int | None:
        return state[0].get(len(self.word))


class Trie:
    """Paths that each lead to the entries they stand for."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, path: str, entry: str) -> None:
        node = self.root
        for char in path:
            node = node.setdefault(char, {})
        node.setdefault("", set()).add(entry)

    def search(self, word: str, limit: int, swaps: bool = True) -> dict[str, int]:
        """Every entry with a path within ``limit`` of ``word``, with the least distance."""
        automaton, found = LevenshteinAutomaton(word, limit, swaps), {}
        stack = [(self.root, automaton.start())]
        while stack:
            node, state = stack.pop()
            for char, child in node.items():
                if char == "":
                    if (d := automaton.distance(state)) is not None:
                        for entry in child:
                            found[entry] = min(d, found.get(entry, 99))
                elif (after := automaton.step(state, char))[0]:
                    stack.append((child, after))
        return found

    def below(self, prefix: str) -> dict[str, int]:
        """Every entry with a path that begins with ``prefix``, with the fewest letters that are missing."""
        node, found = self.root, {}
        for char in prefix:
            node = node.get(char)
            if node is None:
                return {}
        level = [node]
        missing = 0
        while level:
            for at in level:
                for entry in at.get("", ()):
                    found.setdefault(entry, missing)
            level = [child for at in level for char, child in at.items() if char]
            missing += 1
        return found


def words(value: str) -> list[str]:
    """Lower-case words: accents off, camel case and punctuation split, digits within words read as letters."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    plain = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", plain)
    out = []
    for w in re.findall(r"[^\W_]+", plain.lower()):
        if any(c.isalpha() for c in w) or w in DIGIT_LETTERS:
            w = "".join(DIGIT_LETTERS.get(c, c) for c in w)
        out.append(w)
    return out


def bare(value: str) -> str:
    """The value without the words and marks around it."""
    while True:
        shorter = TRAILING.sub("", LEADING.sub("", value, count=1).strip(), count=1).strip()
        if shorter == value or not re.search(r"\w", shorter):
            return value
        value = shorter


def skeleton(joined: str) -> str:
    """The first letter and the consonants after it: how names are abbreviated by leaving vowels out."""
    return joined[:1] + "".join(c for c in joined[1:] if c not in VOWELS)


def inflections(first: str) -> set[str]:
    """Other forms of a verb that a relationship begins with: base, -s, -ed, -ing. A word that is not inflected is a noun
    and has a plural only."""
    if first not in BASE_FORMS and not first.endswith(("ing", "ed", "s")):
        return {first, first + "s", first + "es", first[:-1] + "ies" if first.endswith("y") else first + "s"}
    bases = {BASE_FORMS.get(first, first), first}
    for ending in ("ing", "ied", "ies", "ed", "es", "s", "d"):
        if first.endswith(ending) and len(first) - len(ending) >= 2:
            stem = first[: -len(ending)]
            bases.add(stem + "y" if ending in ("ied", "ies") else stem)
            if ending in ("ing", "ed"):
                bases.add(stem + "e")
                if stem[-1] == stem[-2:-1]:
                    bases.add(stem[:-1])
            break
    out = set()
    for b in bases:
        out |= {b, b + "s", b + "es", b + "ed", b + "d", b + "ing"}
        if b.endswith("y"):
            out |= {b[:-1] + "ies", b[:-1] + "ied"}
        if b.endswith("e"):
            out.add(b[:-1] + "ing")
    return out


def described_names(description: str) -> list[str]:
    """Other names that a description gives: those it introduces as such, and the phrases of two words or more that it begins
    with ("A registered sign for goods", "A scholarly publication or research article")."""
    out = []
    for listed, one in ALSO_CALLED.findall(description):
        out += [w for w in ITEM.split(re.sub(r"^(?:an?|the) ", "", listed or one, flags=re.I)) if w]
    for clause in re.split(r"[;.]", description):
        for part in re.split(r"\bor\b", clause):
            head = []
            for w in re.findall(r"[a-z]+", part.lower()):
                if w in PHRASE_ENDS:
                    if head:
                        break
                    continue
                head.append(w)
            if 2 <= len(head) <= 3:
                out.append(" ".join(head))
            if len(head) < 2 or not part.lower().strip().endswith(head[-1]):
                break  # what follows the first phrase is about it, and names nothing
    return out


class ReferenceList:
    """The trie of a reference list and the way a value is looked up in it.

    entries: (entry, aliases, description) rows. The list must be small; its trie is built in every Python worker.
    Names without their vowels are paths of a second trie.
    """

    def __init__(self, entries: Iterable[tuple[str, Sequence[str], str]], verbs: bool) -> None:
        self.entries: set[str] = set()
        self.paths, self.bones = Trie(), Trie()
        self.exact: dict[str, set[str]] = {}
        self.skeletons: dict[str, set[str]] = {}
        self.initials: dict[str, set[str]] = {}
        rows = list(entries)
        for entry, aliases, _ in rows:
            self.entries.add(entry)
            for name in (entry, *(aliases or ())):
                self._add(name, entry, verbs, own=True)
        # Names read from descriptions come last: they give way to names and aliases of any entry.
        for entry, _, description in rows:
            for name in described_names(description or "") if not verbs else ():
                self._add(name, entry, verbs, own=False)

    def _add(self, name: str, entry: str, verbs: bool, own: bool) -> None:
        w = words(name)
        if not w:
            return
        forms = {tuple(w)}
        if verbs:
            for f in inflections(w[0]):
                forms.add((f, *w[1:]))
                if f.endswith("ing"):
                    forms.add(("is", f, *w[1:]))
            if len(w) == 2 and w[1] == "of" and w[0].endswith(("or", "er")):  # whoever is the director of something directs it
                forms |= {(w[0][:-2] + e,) for e in ("s", "ed", "ing")}
        else:
            forms |= {(*w[:-1], f) for f in (w[-1] + "s", w[-1] + "es", w[-1][:-1] + "ies" if w[-1].endswith("y") else w[-1] + "s")}
        for form in forms:
            joined = "".join(form)
            if not own and joined in self.exact and entry not in self.exact[joined]:
                continue
            self.paths.add(joined, entry)
            self.bones.add(skeleton(joined), entry)
            self.exact.setdefault(joined, set()).add(entry)
            self.skeletons.setdefault(skeleton(joined), set()).add(entry)
            self.initials.setdefault(entry, set()).add(joined[0])

    def lookup(self, value: str | None) -> str:
        """The one entry that the value means, or UNMATCHED."""
        if value is None or not value.strip():
            return UNMATCHED
        if value in self.entries:
            return value
        whole = self._one(value)
        parts = [p for p in SEPARATOR.split(bare(value)) if p and p.strip()]
        if len(parts) > 1 and not (whole and "".join(words(bare(value))) in self.exact):
            named = {m for p in parts for m in self._one(p)}
            return named.pop() if len(named) == 1 else UNMATCHED
        return whole.pop() if len(whole) == 1 else UNMATCHED

    def within(self, value: str) -> dict[str, int]:
        """Every entry with a name, alias, inflection or described name within the distance that the value's length allows."""
        joined = "".join(words(bare(value)))
        return self.paths.search(joined, distance_limit(len(joined))) if joined else {}

    def _one(self, value: str) -> set[str]:
        """The nearest entries: none, one, or several that are equally near."""
        core = bare(value)
        cut_off = core.endswith((".", "…"))
        joined = "".join(words(core))
        if not joined:
            return set()
        if joined in self.exact:  # what the search would find at distance 0
            return set(self.exact[joined])
        found = self.paths.search(joined, distance_limit(len(joined)))
        if cut_off:
            # Cut short: at least half of the name must be there, else a full stop could stand for anything.
            begun = {e: m for e, m in self.paths.below(joined).items() if m <= len(joined)}
            if begun and len(joined) >= 3:
                least = min(begun.values())
                near = {e for e, d in found.items() if d <= 1}
                return near & set(begun) or {e for e, m in begun.items() if m == least}
        without_vowels = not any(c in VOWELS for c in joined[1:])
        if len(joined) >= 3 and without_vowels and joined in self.skeletons:
            return set(self.skeletons[joined])
        if found:
            least = min(found.values())
            best = {e for e, d in found.items() if d == least}
            if len(joined) > 5 or least < 2 or all(joined[0] in self.initials[e] for e in best):
                return best
        # Vowels left out and mistyped as well.
        if len(joined) >= 5 and without_vowels:
            return {e for e in self.bones.search(joined, 1) if joined[0] in self.initials[e]}
        return set()


#: A reference list with more entries or letters than this is refused, since each Python worker holds its trie.
MAX_ENTRIES, MAX_LETTERS = 100_000, 32_000_000


def reference_rows(reference: DataFrame, entry: str, aliases: str = "aliases", description: str = "description") -> tuple:
    """The reference list as (entry, aliases, description) rows on the driver: at most MAX_ENTRIES rows and MAX_LETTERS, else an error."""
    letters = reference.agg(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in (F.col(entry), F.array_join(aliases, ""), F.col(description))), F.lit(0)))).first()[0] or 0
    if letters > MAX_LETTERS:
        raise ValueError(f"the reference list has more than {MAX_LETTERS} letters")
    rows = reference.where(F.col(entry).isNotNull()).select(F.col(entry).alias("e"), F.col(aliases).alias("a"), F.col(description).alias("d")).limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the reference list has more than {MAX_ENTRIES} rows")
    merged: dict[str, tuple[list[str], list[str]]] = {}
    for r in rows:
        own = merged.setdefault(r.e, ([], []))
        own[0].extend(a for a in r.a or [] if a is not None and a not in own[0])
        if r.d and r.d not in own[1]:
            own[1].append(r.d)
    return tuple((e, tuple(a), " ".join(d)) for e, (a, d) in sorted(merged.items()))


def map_values(values: DataFrame, rows: tuple, verbs: bool) -> DataFrame:
    """(value, canonical_value) for each distinct ``value``; each is searched once."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = ReferenceList(rows, verbs)
        for pdf in batches:
            yield pd.DataFrame({"value": pdf["value"], "canonical_value": [known.lookup(v) for v in pdf["value"]]})

    return values.mapInPandas(search, "value string, canonical_value string")


def canonical_values(records: DataFrame, id_column: str, value_column: str, reference: DataFrame, entry: str, verbs: bool = False) -> DataFrame:
    """(record_id, canonical_value) of each record whose value is neither blank nor exactly an entry.

    ``verbs`` tells relationship names, whose first word is inflected, from type names, which take a plural. A value
    that means no entry, or more than one, is UNMATCHED. Rows with a NULL id, NULL or blank values give nothing; repeated
    rows count once; an empty reference list leaves all values UNMATCHED. Distinct values are searched once each
    and joined back with hot values salted.
    """
    rows = reference_rows(reference, entry)
    value = F.col("value")
    cases = records.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("record_id"), F.col(value_column).alias("value"))
    cases = _inexact(cases.where(value.isNotNull() & (F.trim(value) != "")), rows)
    mapped = map_values(cases.select("value").distinct(), rows, verbs)
    return salted_join(cases, mapped, ["value"], "inner", F.col("record_id")).select("record_id", "canonical_value").distinct()


def _inexact(values: DataFrame, rows: tuple) -> DataFrame:
    """The rows whose value is not exactly an entry. The entries are broadcast: reference_rows has checked their number and size."""
    exact = values.sparkSession.createDataFrame([(r[0],) for r in rows], "value string")
    return values.join(F.broadcast(exact), "value", "left_anti")


def candidates(records: DataFrame, value_column: str, reference: DataFrame, entry: str, kind: str) -> DataFrame:
    """(record_kind, value, entry, distance): all entries with a name or alias within the length-dependent distance of each
    distinct value, letters and digits alone compared, in lower case, a swap of neighbours as two edits; the distance is the least over the entry's names.

    Values without letters or digits, and NULL, give nothing; an empty list gives no rows.
    """
    rows = reference_rows(reference, entry)
    plain = F.lower(F.regexp_replace(value_column, "[^A-Za-z0-9]", ""))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie()
        for name, aliases, _ in rows:
            for path in (name, *aliases):
                if path := re.sub("[^A-Za-z0-9]", "", path).lower():
                    trie.add(path, name)
        for pdf in batches:
            found = [(v, e, d) for v in pdf["value"] for e, d in trie.search(v, distance_limit(len(v)), swaps=False).items()]
            yield pd.DataFrame(found, columns=["value", "entry", "distance"]).astype({"distance": "int64"})

    values = records.select(plain.alias("value")).where("value <> ''").distinct()
    return values.mapInPandas(search, "value string, entry string, distance long").select(F.lit(kind).alias("record_kind"), "value", "entry", "distance")


def graph_canonical_values(nodes: DataFrame, edges: DataFrame, entity_types: DataFrame, rel_types: DataFrame) -> DataFrame:
    """(record_kind, record_id, canonical_value) of graph_nodes.type_ and graph_edges.relationship."""
    of_nodes = canonical_values(nodes, "id", "type_", entity_types, "entity_type")
    of_edges = canonical_values(edges, "id", "relationship", rel_types, "rel_type", verbs=True)
    kind = lambda df, k: df.select(F.lit(k).alias("record_kind"), "record_id", "canonical_value")
    return kind(of_nodes, "node").unionByName(kind(of_edges, "edge"))


def unmatched_report(records: DataFrame, value_column: str, reference: DataFrame, entry: str, kind: str, verbs: bool = False) -> DataFrame:
    """(record_kind, value, n_rows) of the values that fit no entry."""
    rows = reference_rows(reference, entry)
    value: Column = F.col("value")
    filled = records.select(F.col(value_column).alias("value")).where(value.isNotNull() & (F.trim(value) != ""))
    counts = _inexact(filled.groupBy("value").agg(F.count(F.lit(1)).alias("n_rows")), rows)
    mapped = map_values(counts.select("value"), rows, verbs).where(F.col("canonical_value") == UNMATCHED)
    return counts.join(mapped, "value").select(F.lit(kind).alias("record_kind"), "value", "n_rows")
