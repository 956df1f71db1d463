"""Linking the spellings under which people and organisations were typed.

1. Each typed name becomes a canonical form; forms with their context are the nodes, so that repeated spellings count once.
2. MinHash banding over padded q-grams of a form's rare words gives candidate pairs. Rows and bands are chosen from
   the collision curve for the similarity that two typing errors leave.
3. Candidates are verified by Monge-Elkan similarity and context.
4. Star clustering: the fullest and most frequent spellings become centres, the others join the nearest centre.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import names
from weftgraph.llm.names import THRESHOLD, Form, canonical_form, context_score, parse_organisation, parse_person, similarity
from weftgraph.plans.lineage import cut, drop_cut
from weftgraph.plans.workers import by_value

by_value(__name__)
by_value(names.__name__)

QGRAM = 2
#: Jaccard similarity of the padded q-grams of two spellings that a candidate pair should have, and the recall wanted there.
TARGET_SIMILARITY, TARGET_RECALL = 0.45, 0.92
ROWS = 2
PRIME = (1 << 61) - 1


def collision(similarity: float, rows: int, bands: int) -> float:
    """Chance that two sets share at least one band."""
    return 1 - (1 - similarity**rows) ** bands


def bands_for(similarity: float = TARGET_SIMILARITY, recall: float = TARGET_RECALL, rows: int = ROWS) -> int:
    """The fewest bands that reach the recall at the similarity."""
    bands = 1
    while collision(similarity, rows, bands) < recall:
        bands += 1
    return bands


def padded_grams(word: str, q: int = QGRAM) -> set[str]:
    padded = "^" * (q - 1) + word + "$" * (q - 1)
    return {padded[i : i + q] for i in range(len(padded) - q + 1)}


def _stable(text: str) -> int:
    h = 1469598103934665603
    for byte in text.encode():
        h = ((h ^ byte) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h


class MinHash:
    """Band hashes of a word: the same on every machine."""

    def __init__(self, bands: int, rows: int = ROWS) -> None:
        r = np.random.RandomState(11)
        self.a = r.randint(1, 1 << 31, bands * rows).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.randint(1, 1 << 31, bands * rows).astype(np.uint64) << np.uint64(13)
        self.bands, self.rows = bands, rows
        self.known: dict[str, np.ndarray] = {}

    def of(self, word: str) -> np.ndarray:
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            h = np.array([_stable(g) for g in padded_grams(word)], np.uint64)
            mixed = h[:, None] * self.a + self.b
            mixed ^= mixed >> np.uint64(29)
            least = (mixed * np.uint64(0xBF58476D1CE4E5B9)).min(0).reshape(self.bands, self.rows)
            out = least[:, 0]
            for k in range(1, self.rows):
                out = out * np.uint64(0x9E3779B97F4A7C15) ^ least[:, k]
            self.known[word] = out
        return self.known[word]


#: Words in this part of all typed names of a type, beside LEAST_PARTNERS others at least, are no names of their own. The
#: part stays as data grow; how many others there are would not.
NAME_SHARE, LEAST_PARTNERS = 0.0035, 8
TYPES = ("Person", "Organization")


def typed_names(records: DataFrame) -> DataFrame:
    """(user_id, type, id, raw): each record's typed names, blank ones left out."""
    p = F.col("properties")
    raw = F.explode(F.array_distinct(F.array_compact(F.array(p["name"], F.col("label")))))
    kept = records.where(F.col("type").isin(*TYPES) & F.col("id").isNotNull() & F.col("user_id").isNotNull())
    return kept.select("user_id", "type", "id", raw.alias("raw")).where(F.trim("raw") != "").distinct()


def contexts(records: DataFrame) -> DataFrame:
    """(id, type, user_id, city, year, third): one context a record; of several values the greatest."""
    p = F.col("properties")
    own = records.where(F.col("type").isin(*TYPES) & F.col("id").isNotNull() & F.col("user_id").isNotNull())
    return own.groupBy("user_id", "type", "id").agg(F.max(p["city"]).alias("city"), F.max(F.coalesce(p["birth_year"], p["founded"])).alias("year"), F.max(F.coalesce(p["affiliation"], p["industry"])).alias("third"))


def common_words(typed: DataFrame) -> dict[str, frozenset[str]]:
    """Given names, and words of organisations: those that stand beside many different words.

    A word needs to be in NAME_SHARE of all names, so at most words-a-name / NAME_SHARE words come to the driver.
    """

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds, word, partner = [], [], []
            for kind, raw in zip(pdf["type"], pdf["raw"]):
                own = sorted({w for part in (parse_person(raw) if kind == "Person" else parse_organisation(raw)[:1]) for w in part if len(w) > 1})
                for x in own:  # beside None once in each name
                    for y in (None, *own):
                        if x != y:
                            kinds.append(kind)
                            word.append(x)
                            partner.append(y)
            yield pd.DataFrame({"type": kinds, "word": word, "partner": partner})

    pairs = typed.select("type", "raw").mapInPandas(tokens, "type string, word string, partner string")
    partners = pairs.groupBy("type", "word").agg(F.approx_count_distinct("partner", 0.02).alias("partners"), F.count_if(F.col("partner").isNull()).alias("n"))
    total = typed.groupBy("type").agg(F.count(F.lit(1)).alias("total"))
    found = partners.join(F.broadcast(total), "type").where((F.col("partners") >= LEAST_PARTNERS) & (F.col("n") >= F.col("total") * NAME_SHARE)).select("type", "word").collect()
    return {kind: frozenset(r.word for r in found if r.type == kind) for kind in TYPES}


def name_nodes(typed: DataFrame, context: DataFrame, common: dict[str, frozenset[str]]) -> DataFrame:
    """(user_id, type, id, form, acronym, full, city, year, third) of each typed name.

    A complete form is one node whatever its context; an incomplete one (initials, an acronym) is one node a context.
    """

    def canonical(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            forms = [canonical_form(k, r, common[k]) for k, r in zip(pdf["type"], pdf["raw"])]
            acronyms = ["".join(w[0] for w in parse_organisation(r)[0]) if k == "Organization" and f is not None and not f.acronym else "" for k, r, f in zip(pdf["type"], pdf["raw"], forms)]
            out = pdf[["user_id", "type", "id"]].assign(form=[f.text if f else None for f in forms], acronym=acronyms, full=[bool(f and f.full) for f in forms])
            yield out[out["form"].notna()]

    formed = typed.mapInPandas(canonical, "user_id string, type string, id string, form string, acronym string, full boolean")
    return formed.join(context, ["user_id", "type", "id"])


def _with_node(formed: DataFrame) -> DataFrame:
    own = [F.when(F.col("full"), "").otherwise(F.coalesce(F.col(c), F.lit(""))) for c in ("city", "year", "third")]
    return formed.withColumn("node", F.xxhash64("user_id", "type", "form", *own))


def _summary(members: DataFrame) -> DataFrame:
    """One row a node: its form, size and most frequent context."""
    return members.groupBy("node").agg(
        F.first("type").alias("type"), F.first("form").alias("form"), F.first("full").alias("full"), F.count(F.lit(1)).alias("size"), *(F.mode(c, True).alias(c) for c in ("city", "year", "third"))
    )


#: A bucket with more nodes is joined in blocks of about so many, each block with each.
BUCKET_NODES = 400


def candidate_pairs(members: DataFrame, bands: int, bucket_nodes: int = BUCKET_NODES) -> DataFrame:
    """(a, b) with a < b: nodes of one user and type that share a band of some rare word and an initial beside it.

    An acronym meets the forms that it abbreviates.
    """
    nodes = members.select("user_id", "type", "node", "form", "acronym").distinct()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = MinHash(bands)
        for pdf in batches:
            key, at, scopes = [], [], {}
            for n, (user, kind, text, acronym) in enumerate(zip(pdf["user_id"], pdf["type"], pdf["form"], pdf["acronym"])):
                form = Form.read(text)
                if (user, kind) not in scopes:
                    scopes[user, kind] = _stable(f"{user}|{kind}")
                own = _bucket_keys(scopes[user, kind], form, acronym, hashed)
                key += own
                at += [n] * len(own)
            at = np.array(at, int)
            yield pd.DataFrame({"key": np.array(key, np.int64), "node": pdf["node"].to_numpy()[at]})

    keyed = cut(nodes.mapInPandas(keys, "key long, node long"))
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_nodes)
    left = right = keyed
    if crowded.take(1):
        left, right = _in_blocks(keyed, cut(crowded), bucket_nodes)
    met = left.join(right.select("key", F.col("node").alias("b")), "key").where(F.col("node") < F.col("b"))
    return met.select(F.col("node").alias("a"), "b").distinct()


def _in_blocks(keyed: DataFrame, crowded: DataFrame, bucket_nodes: int) -> tuple[DataFrame, DataFrame]:
    """The smaller and the larger nodes of pairs, by key. A crowded key becomes one for each two of its blocks.

    Blocks are ranges of the node's hash: the smaller node of a pair is in the same block as the larger or in one before.
    """
    blocks = F.ceil(F.col("n") / bucket_nodes)
    place = F.floor((F.col("node") / 2.0**64 + 0.5) * F.col("blocks"))
    large = keyed.join(crowded, "key").withColumn("blocks", blocks).withColumn("block", F.least(place, F.col("blocks") - 1))
    rest = keyed.join(crowded, "key", "left_anti")
    ahead = large.withColumn("other", F.explode(F.sequence("block", F.col("blocks") - 1)))
    behind = large.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "block")))
    sides = ((ahead, ("block", "other")), (behind, ("other", "block")))
    left, right = (rest.unionByName(rows.withColumn("key", F.xxhash64("key", *cell)).select(rest.columns)) for rows, cell in sides)
    return left, right


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), 0x94D049BB133111EB


def _bucket_keys(scope: int, form: Form, acronym: str, hashed: MinHash) -> list[int]:
    """The buckets of a form: each band of each rare word with each initial beside it, short names' formal ones too."""
    if form.acronym:
        return [_signed(_stable(f"{scope}=|{form.rare[0]}"))]
    out = {_signed(_stable(f"{scope}=|{acronym}"))} if 2 <= len(acronym) <= 4 else set()
    place = np.arange(hashed.bands, dtype=np.uint64) * _A
    for i, word in enumerate(form.rare):
        beside = (*form.rare[:i], *form.rare[i + 1 :], *form.known)
        initials = {x[0] for w in beside for x in (w, *names.NICKNAMES.get(w, "").split())} or {"-"}
        of_word = (hashed.of(word) ^ place ^ np.uint64(scope)) * _B
        for letter in initials:
            key = of_word + np.uint64(ord(letter) * _C & 0xFFFFFFFFFFFFFFFF)
            out.update(((key ^ (key >> np.uint64(31))) * _A).view(np.int64).tolist())
    return list(out)


def verified_links(pairs: DataFrame, nodes: DataFrame, common: dict[str, frozenset[str]]) -> DataFrame:
    """(a, b, score) of the candidate pairs whose similarity reaches the threshold.

    The context of two incomplete spellings that differ must not speak against them.
    """
    side = lambda x: nodes.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("type", "form", "city", "year", "third")))
    both = pairs.join(side("a"), "a").join(side("b").drop("type_b"), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # Missing context comes as None or NaN; either counts as missing.
            side = lambda x: [tuple(v if isinstance(v, str) else None for v in row) for row in zip(pdf[f"city_{x}"], pdf[f"year_{x}"], pdf[f"third_{x}"])]  # noqa: B023, E731
            forms = {t: Form.read(t) for t in {*pdf["form_a"], *pdf["form_b"]}}
            scores = [similarity(k, forms[a], forms[b], x, y, common[k]) if _may_link(forms[a], forms[b], x, y) else 0.0 for k, a, b, x, y in zip(pdf["type_a"], pdf["form_a"], pdf["form_b"], side("a"), side("b"))]
            out = pd.DataFrame({"a": pdf["a"].astype("int64"), "b": pdf["b"].astype("int64"), "score": np.array(scores, float)})
            yield out[out["score"] >= THRESHOLD]

    return both.mapInPandas(verify, "a long, b long, score double")


def _may_link(a: Form, b: Form, context_a: tuple, context_b: tuple) -> bool:
    return a.full or b.full or a.acronym or b.acronym or a.text == b.text or context_score(context_a, context_b) >= 0


#: Each round settles the best-ranked free node of every connected part at least; more rounds than this mean an error.
MOST_ROUNDS = 1000


def star_clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, center) of each node that has a link.

    Nodes are ranked by completeness, size, and number. In each round the free nodes that outrank all free neighbours become
    centres, and every free neighbour of a centre joins the centre most similar to it. Rounds end when no link
    joins two free nodes; what is then free stands alone. Each round's table of free links replaces the one before it.
    """
    spark = nodes.sparkSession
    rank = F.struct(F.col("full"), F.col("size"), F.col("node"))
    ranked = nodes.select("node", rank.alias("rank"))
    two_way = links.select("a", "b", "score").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).groupBy("a", "b").agg(F.max("score").alias("score"))
    free = cut(two_way.join(ranked.select(F.col("node").alias("a"), F.col("rank").alias("rank_a")), "a").join(ranked.select(F.col("node").alias("b"), F.col("rank").alias("rank_b")), "b"))
    parts = []
    while free.take(1):
        if len(parts) == MOST_ROUNDS:
            raise RuntimeError(f"star clustering did not settle within {MOST_ROUNDS} rounds")
        tops = free.groupBy("a").agg(F.max("rank_b").alias("most"), F.first("rank_a").alias("rank")).where(F.col("rank") > F.col("most")).select("a")
        stars = free.join(tops.withColumnRenamed("a", "b"), "b", "left_semi").groupBy("a").agg(F.max_by("b", F.struct("score", "rank_b")).alias("center"))
        placed = cut(stars.select(F.col("a").alias("node"), "center").unionByName(tops.select(F.col("a").alias("node"), F.col("a").alias("center"))))
        parts.append(placed)
        gone = placed.select("node")
        left = cut(free.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti"))
        drop_cut(free)
        free = left
    out = spark.createDataFrame([], "node long, center long")
    for p in parts:
        out = out.unionByName(p)
    return out


def spellings_of_one_record(members: DataFrame) -> DataFrame:
    """(a, b, score): each further spelling of a record with its first one, however many there are."""
    own = members.select("user_id", "type", "id", "node").distinct()
    first = F.min("node").over(Window.partitionBy("user_id", "type", "id"))
    return own.select(first.alias("a"), F.col("node").alias("b")).where("a <> b").distinct().select("a", "b", F.lit(1.0).alias("score"))


def linked_records(records: DataFrame) -> DataFrame:
    """(center, id): the records of each entity. A record whose typed names fell to different entities is in each of them."""
    typed = cut(typed_names(records))
    common = common_words(typed)
    members = cut(_with_node(name_nodes(typed, contexts(records), common)))
    nodes = cut(_summary(members))
    links = verified_links(candidate_pairs(members, bands_for()), nodes, common)
    stars = star_clusters(nodes, cut(links.unionByName(spellings_of_one_record(members))))
    return members.select("node", "id").distinct().join(stars, "node", "left").select(F.coalesce("center", "node").alias("center"), "id").distinct()


def same_entity_pairs(records: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of different ids of one user and type that denote the same entity.

    Needs user_id, type, id, label and properties; others are ignored. Rows with NULL user_id or id, other types, and records
    without any name give nothing; repeated rows count once; an empty table gives no rows.
    """
    clusters = cut(linked_records(records))
    a, b = clusters.select("center", F.col("id").alias("id_a")), clusters.select("center", F.col("id").alias("id_b"))
    return a.join(b, "center").where("id_a < id_b").select("id_a", "id_b").distinct()


def entity_sizes(records: DataFrame) -> DataFrame:
    """(entity, n_records): the smallest id of each entity and the number of its records."""
    return linked_records(records).groupBy("center").agg(F.min("id").alias("entity"), F.count(F.lit(1)).alias("n_records")).drop("center")


def entity_members(records: DataFrame) -> DataFrame:
    """(id, entity): each record that has a name, with the smallest id of its entity; copies and variants are not paired up."""
    clusters = cut(linked_records(records))
    named = clusters.groupBy("center").agg(F.min("id").alias("entity"))
    return clusters.join(named, "center").select("id", "entity").distinct()
