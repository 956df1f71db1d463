"""Blocking, similarity and clustering for entity resolution."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import filled, ngrams, strip
from weftgraph.plans.lineage import cut, drop_cut
from weftgraph.plans.skew import hot_keys, salted_join
from weftgraph.plans.workers import by_value

by_value(__name__)


def block_keys(entity_type: Column, canonical_key: Column, name: Column) -> Column:
    """Blocking keys of a node, strongest first: canonical key, first three letters of the name, else the type as a whole."""
    t = F.coalesce(filled(entity_type), F.lit("_"))
    canon = F.when(canonical_key != "", F.concat(t, F.lit("|canon:"), canonical_key))
    short = F.substring(F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", "")), 1, 3)
    named = F.when(short != "", F.concat(t, F.lit("|name3:"), short))
    keys = F.array_compact(F.array(canon, named))
    return F.when(F.size(keys) > 0, keys).otherwise(F.array(F.concat(t, F.lit("|_all"))))


def blocks(nodes: DataFrame) -> DataFrame:
    """(block_key, id) of each node, and block sizes by pre-aggregated counts."""
    name = F.coalesce(filled(F.col("properties")["name"]), F.col("properties")["title"])
    return nodes.select("id", F.explode(block_keys(F.col("type_"), F.col("canonical_key"), name)).alias("block_key")).distinct()


def candidate_groups(keyed: DataFrame) -> DataFrame:
    """(block_key, id): each node in its largest block, singletons left out.

    Taken block by block the result would depend on the order; here a node's block is the largest it is in, of equals the
    smallest key, whatever the others do.
    """
    sizes = keyed.groupBy("block_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    best = keyed.join(sizes, "block_key").groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("m"), "block_key")).alias("b"))
    return best.select("b.block_key", "id")


def method_keys(value: Column, method: str, **options: float) -> Column:
    """Blocking value by data type: exact, prefix, suffix, numeric or date bucket."""
    v = strip(value)
    if method == "exact":
        return F.lower(v)
    if method == "first_n_chars":
        return F.lower(F.substring(v, 1, int(options.get("n", 4))))
    if method == "suffix":
        return F.lower(F.right(v, F.lit(int(options.get("n", 4)))))
    if method == "numeric_bucket":
        return F.floor(v.try_cast("double") / options.get("width", 10)).cast("string")
    if method == "date_bucket":
        return F.floor(F.datediff(v.try_cast("date"), F.lit("1970-01-01").cast("date")) / options.get("days", 30)).cast("string")
    raise ValueError(f"no blocking method {method!r}")


def rule_pairs(records: DataFrame, rules: Sequence[Column], queries: Column) -> DataFrame:
    """(a, b, rule): rows of a stated query set with all rows that agree with them on a rule's value, each at its first rule.

    records need id; ``queries`` tells the query set. One equi-join for all rules; hot values are spread.
    """
    keyed = records.select("id", queries.alias("_q"), F.posexplode(F.array(*rules)).alias("rule", "value")).where("value is not null and value <> ''").distinct()
    asked = keyed.where("_q").select("rule", "value", F.col("id").alias("a"))
    met = salted_join(keyed.select("rule", "value", F.col("id").alias("b")), asked, ["rule", "value"], "inner", F.col("b"))
    return met.where("a <> b").groupBy("a", "b").agg(F.min("rule").alias("rule"))


def query_pairs(records: DataFrame, keys: Sequence[str], queries: Column) -> DataFrame:
    """Rows of a stated query set, their columns ending in _a, beside all rows that agree with them on the keys, ending in _b."""
    rest = [c for c in records.columns if c not in keys]
    side = lambda df, end: df.select(*keys, *(F.col(c).alias(f"{c}_{end}") for c in rest))
    return salted_join(side(records, "b"), side(records.where(queries), "a"), list(keys), "inner", F.struct(*(f"{c}_b" for c in rest)))


MERSENNE = (1 << 31) - 1


def _coefficients(n: int) -> tuple[list[int], list[int]]:
    """Fixed multipliers and offsets of the n hash functions."""
    return [(k * 2 + 1) * 7919 % 65521 + 1 for k in range(n)], [(k + 1) * 104729 for k in range(n)]


def band_keys(grams: Sequence[str], n: int, rows: int, known: dict[str, int]) -> list[str]:
    """One key for each band of ``rows`` minima of (a h + b) mod (2^31 - 1).

    h is the first seven hex digits of a gram's md5, so that any engine can repeat the keys. known caches h.
    """
    import hashlib

    import numpy as np

    a, b = (np.array(x, np.int64) for x in _coefficients(n))
    for g in grams:
        if g not in known:
            known[g] = int(hashlib.md5(g.encode()).hexdigest()[:7], 16)
    h = np.array([known[g] for g in grams], np.int64)
    least = ((h[:, None] * a + b) % MERSENNE).min(0)
    return [hashlib.md5("|".join([str(i), *map(str, least[i * rows : (i + 1) * rows])]).encode()).hexdigest()[:12] for i in range(n // rows)]


def banded(records: DataFrame, text: str, n: int = 100, rows: int = 5, gram: int = 3) -> DataFrame:
    """(id, band): the LSH buckets of each record's text. Grams are cut in the JVM, hashed in Arrow batches."""

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for pdf in batches:
            if len(known) > 1_000_000:
                known.clear()
            keys = [band_keys(list(g), n, rows, known) for g in pdf["grams"]]
            yield pd.DataFrame({"id": pdf["id"].repeat(n // rows), "band": [k for own in keys for k in own]})

    kind = dict(records.dtypes)["id"]
    cut_up = records.where(F.length(F.trim(F.col(text))) > 0).select("id", ngrams(F.col(text), gram).alias("grams"))
    return cut_up.mapInPandas(bands, f"id {kind}, band string").distinct()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-10))))


def similarity_level(score: Column, thresholds: Sequence[float] = (0.95, 0.85, 0.70)) -> Column:
    """0 for the highest level, counted up; len(thresholds) below all."""
    out = F.when(score >= thresholds[0], 0)
    for i, t in enumerate(thresholds[1:], 1):
        out = out.when(score >= t, i)
    return out.otherwise(len(thresholds))


def hyperplane_key(vector: Column, planes: Sequence[Sequence[float]]) -> Column:
    """Signs of the vector against fixed planes, as a string of 0 and 1."""
    return F.concat(*(F.when(dot(vector, F.array(*(F.lit(float(x)) for x in p))) >= 0, "1").otherwise("0") for p in planes))


#: Queries that travel to every task at a time, and the bytes that a block of them may have.
QUERY_BLOCK, BLOCK_BYTES = 4096, 64 << 20


def nearest(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, place): the k most similar base vectors of each query, by cosine between 0 and 1.

    A stated query set against all rows: the queries are sent out in blocks of at most QUERY_BLOCK rows and BLOCK_BYTES, each base
    partition keeps the k best of its own for each query, and only those are ranked. Base rows never move. queries: (query_id,
    embedding); base: (vec_id, embedding). NULL vectors are left out; ties go to the smaller vec_id.
    """
    import numpy as np

    rows = queries.where("embedding is not null").select("query_id", "embedding").orderBy("query_id").toLocalIterator()
    blocks: list[tuple[list, np.ndarray]] = []
    ids: list = []
    vectors: list[np.ndarray] = []

    def close() -> None:
        if ids:
            x = np.stack(vectors)
            blocks.append((list(ids), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)))
            ids.clear()
            vectors.clear()

    for r in rows:
        ids.append(r.query_id)
        vectors.append(np.asarray(r.embedding, np.float64))
        if len(ids) == QUERY_BLOCK or len(ids) * vectors[0].nbytes >= BLOCK_BYTES:
            close()
    close()

    def search(block: tuple) -> DataFrame:
        sent = base.sparkSession.sparkContext.broadcast(block)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, x = sent.value
            best = np.zeros((len(own), 0))
            held = np.zeros((len(own), 0), np.int64)
            for pdf in batches:
                if not len(pdf):
                    continue
                y = np.stack([np.asarray(e, np.float64) for e in pdf["embedding"]])
                y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-10)
                s = np.concatenate([best, np.clip(x @ y.T, 0, 1)], axis=1)
                at = np.concatenate([held, np.broadcast_to(pdf["vec_id"].to_numpy(np.int64), (len(own), len(pdf)))], axis=1)
                top = np.lexsort((at, -np.round(s, 9)), axis=1)[:, :k]
                best, held = np.take_along_axis(s, top, 1), np.take_along_axis(at, top, 1)
            yield pd.DataFrame({"query_id": np.repeat(np.array(own, np.int64), best.shape[1]), "vec_id": held.ravel(), "score": best.ravel()})

        return base.where("embedding is not null").select("vec_id", "embedding").mapInPandas(score, "query_id long, vec_id long, score double")

    few = base.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for block in blocks:
        few = few.unionByName(search(block))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "vec_id")
    return few.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity in Arrow batches; NULL where a side is NULL."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _jaro_winkler(p, q) for p, q in zip(x, y)], dtype="float64")

    return score(a, b)


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    hit = [False] * len(b)
    mine = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not hit[j] and b[j] == x:
                hit[j] = True
                mine.append(x)
                break
    m = len(mine)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(mine, (b[j] for j in range(len(b)) if hit[j]))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def match_weight(levels: Mapping[str, tuple[Sequence[float], Sequence[float]]]) -> Column:
    """Fellegi-Sunter weight of a pair: sum of log2(m / u) over comparison columns.

    levels: column with the agreement level (0 best) -> (m, u) by level; NULL levels add nothing.
    """
    total = F.lit(0.0)
    for column, (m, u) in levels.items():
        weight = F.lit(0.0)
        for level, (x, y) in enumerate(zip(m, u)):
            weight = F.when(F.col(column) == level, math.log2(x / y)).otherwise(weight)
        total = total + weight
    return total


def match_probability(weight: Column, prior: float) -> Column:
    odds = F.pow(F.lit(2.0), weight) * F.lit(prior / (1 - prior))
    return odds / (odds + 1)


def estimate_m(gammas: DataFrame, columns: Sequence[str], levels: int, u: Mapping[str, Sequence[float]], m: Mapping[str, Sequence[float]], prior: float, rounds: int = 3) -> dict[str, list[float]]:
    """m by expectation maximisation over counts of agreement patterns: (levels + 1)^columns rows at most reach the driver."""
    rows = gammas.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).collect()
    m = {c: list(v) for c, v in m.items()}
    for _ in range(rounds):
        total = {c: [1e-9] * levels for c in columns}
        for r in rows:
            odds = prior / (1 - prior)
            for c in columns:
                if r[c] is not None:
                    odds *= m[c][r[c]] / u[c][r[c]]
            p = odds / (1 + odds)
            for c in columns:
                if r[c] is not None:
                    total[c][r[c]] += p * r["n"]
        m = {c: [x / sum(t) for x in t] for c, t in total.items()}
    return m


def closure(pairs: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, representative): the smallest id reachable, by handing minima on and jumping over them until nothing changes.

    Pairs of a hub are spread over tasks. Each round's table replaces the one before it.
    """
    both = pairs.where(F.col(a) != F.col(b)).select(F.explode(F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(b).alias("x"), F.col(a).alias("y")))).alias("e")).select("e.*").distinct()
    edges = cut(both)
    hubs = bool(hot_keys(edges, ["y"]).take(1))
    label = cut(edges.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("id"), F.least("x", "y").alias("rep")))
    for _ in range(max_rounds):
        named = label.withColumnRenamed("id", "y")
        met = salted_join(edges, named, ["y"], "inner", F.col("x")) if hubs else edges.join(named, "y")
        near = met.groupBy(F.col("x").alias("id")).agg(F.min("rep").alias("near"))
        lower = label.join(near, "id").select("id", F.least("rep", "near").alias("rep"))
        jumped = lower.join(lower.select(F.col("id").alias("rep"), F.col("rep").alias("far")), "rep", "left").select("id", F.least("rep", F.coalesce("far", "rep")).alias("rep"))
        new = cut(jumped)
        moved = new.join(label.withColumnRenamed("rep", "old"), "id").where("rep <> old").take(1)
        drop_cut(label)
        label = new
        if not moved:
            drop_cut(edges)
            return label.select("id", F.col("rep").alias("representative"))
    raise RuntimeError("the closure did not settle")


def edit_and_sound(pairs: DataFrame, a: str, b: str, most: int = 4) -> DataFrame:
    """Adds distance, edits up to ``most`` or NULL beyond, and sounds, whether both sound alike."""
    d = F.levenshtein(a, b, most)
    return pairs.withColumn("distance", F.when(d >= 0, d)).withColumn("sounds", (F.soundex(a) == F.soundex(b)) & F.col(a).rlike("^[a-z]"))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Gestalt similarity of two lower-cased strings, in Arrow batches."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p.lower(), q.lower()).ratio() for p, q in zip(x, y)], dtype="float64")

    return score(a, b)


def property_overlap(queries: DataFrame, store: DataFrame, least: float) -> DataFrame:
    """(query_id, id, m, n, score): store rows that share at least this part of a query's properties, compared trimmed and lower-case.

    queries and store: (id, type_, properties). A row that shares m of n properties, m >= least * n, shares one of any
    n - m + 1 of them: candidates meet on a query's rarest ones only, so that a value which many rows have, such as a
    status, makes no pairs; then all properties of the candidates are compared.
    """
    entry = lambda e: F.struct(e["key"].alias("key"), F.lower(F.trim(e["value"])).alias("value"))
    entries = F.filter(F.transform(F.coalesce(F.map_entries("properties"), F.array().cast("array<struct<key:string,value:string>>")), entry), lambda e: e["value"] != "")
    # Rows of one id and type are one set of entries; versions of a node are few.
    sets = lambda df, name: df.select(F.col("id").alias(name), "type_", F.explode(entries).alias("e")).where("type_ is not null").groupBy(name, "type_").agg(F.collect_set("e").alias(f"e_{name}"))
    q, s = cut(sets(queries, "query_id")), cut(sets(store, "id"))
    often = s.select("type_", F.explode("e_id").alias("e")).groupBy("type_", "e").agg(F.count(F.lit(1)).alias("often"))
    asked = salted_join(q.select("query_id", "type_", F.size("e_query_id").alias("n"), F.explode("e_query_id").alias("e")), often, ["type_", "e"], "left", F.col("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id", "type_").orderBy(F.coalesce("often", F.lit(0)), "e"))
    rare = asked.withColumn("place", place).where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1) & F.col("often").isNotNull())
    met = salted_join(s.select("id", "type_", F.explode("e_id").alias("e")), rare.select("query_id", "type_", "e"), ["type_", "e"], "inner", F.col("id")).select("query_id", "id", "type_").distinct()
    both = met.join(q, ["query_id", "type_"]).join(s, ["id", "type_"])
    m = F.size(F.array_intersect("e_query_id", "e_id")).cast("bigint")
    return both.select("query_id", "id", m.alias("m"), F.size("e_query_id").cast("bigint").alias("n")).withColumn("score", F.col("m") / F.col("n")).where(F.col("score") >= least)


def map_in_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """A model call or other table function over Arrow batches; fn takes and gives DataFrames of pandas."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)
