"""Mixing sources to target weights by Pareto order sampling.

Every document of a source is due a number of copies; the whole ones are certain. For the fraction left over, each
document draws a ranking number, its random odds divided by its inclusion odds, and the smallest numbers are taken until
the source's tokens are reached: a sample of fixed size with unequal probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.workers import by_value

by_value(__name__)

# Fixed value: the WordPunct tokenizer's pattern.
WORDPUNCT = r"\w+|[^\w\s]+"
#: Sums come by classes of length, a quarter octave each; their number bounds what the driver sees.
CLASSES_AN_OCTAVE = 4
#: How inclusion grows with a document's length: 0 gives each document of a source the same chance.
SIZE_POWER = 0.5
#: Ranking numbers are cut into so many ranges, and each of them into so many parts: only the part in which the sample ends is ordered.
RANGES = 4096


def source_name(c: Column) -> Column:
    """Sources compare in lower case, without outer spaces, and with _ for -."""
    name = F.translate(F.lower(F.trim(c)), "-", "_")
    return F.when(name != "", name)


def with_tokens(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, tokens) with tokens counted over the whole text by the public WordPunct tokenizer."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        find = re.compile(WORDPUNCT).findall
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [len(find(t)) if t else 0 for t in pdf["text"]]})

    rows = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), source_name(F.col(source)).alias("source"), F.col(text).alias("text"))
    return rows.mapInPandas(count, "doc_id bigint, source string, tokens bigint")


def _class(tokens: Column) -> Column:
    """Length class of a document; documents without tokens have none and are never drawn."""
    return F.when(tokens > 0, F.floor(F.log2(tokens) * CLASSES_AN_OCTAVE + 1e-9).cast("int"))


def allocate(size: float, weights: dict[str, float], supply: dict[str, float]) -> dict[str, float]:
    """Tokens of each source: its part of the size by weight, or all its supply where that is less.

    What a source lacks is not given to the others: that would take their shares further from their weights.
    """
    total = sum(w for w in weights.values() if w > 0)
    return {s: min(size * w / total, supply.get(s, 0.0)) if w > 0 else 0.0 for s, w in weights.items()}


def copies_a_size(target: float, cap: int, classes: dict[int, tuple[int, float, int]], power: float = SIZE_POWER) -> float:
    """The c for which min(cap, c * tokens^power) copies of each document make up target.

    classes: class -> (tokens, sum of tokens^(1 + power), most tokens of a document). Documents reach the cap in order of size, so
    that whole classes leave, largest first. In the one class that the cap cuts through, some documents get a little
    less than they would: the sample, which goes on until its tokens are reached, makes up for it.
    """
    order = sorted(classes, reverse=power > 0)
    capped = 0.0
    for i, k in enumerate(order):
        mass = sum(classes[x][1] for x in order[i:])
        c = max(0.0, target - capped) / mass if mass else 0.0
        if c * classes[k][2] ** power <= cap:
            return c
        capped += cap * classes[k][0]
    return float("inf")


def plan(tokens: DataFrame, targets: DataFrame, power: float = SIZE_POWER) -> list[tuple]:
    """Rows (mix_id, source, target_share, cap, c, due, supply): the tokens due to each source of each mix, what it has with all
    repeats, and c, which gives each document's copies. Built on the driver from sums by source and length class and from
    the targets, both of a size that does not grow with the documents."""
    named = targets.select("mix_id", source_name(F.col("source")).alias("source"), "weight", "max_repeats", "size_ratio").where("mix_id is not null").collect()
    sources = sorted({r.source for r in named if r.source})
    t = F.col("tokens")
    sums = tokens.groupBy(F.when(F.col("source").isin(sources), F.col("source")).alias("source"), _class(t).alias("class")).agg(F.sum(t).alias("t"), F.sum(F.pow(t.cast("double"), F.lit(1.0 + power))).alias("m"), F.max(t).alias("most")).collect()
    total = sum(r.t for r in sums)
    by_source: dict[str, dict[int, tuple[int, float, int]]] = {}
    for r in sums:
        if r.source is not None and r["class"] is not None:
            by_source.setdefault(r.source, {})[r["class"]] = (r.t, r.m, r.most)
    rows = []
    for mix in sorted({r.mix_id for r in named}):
        own = {r.source: r for r in named if r.mix_id == mix and r.source}
        if not own:
            continue
        size = total * max(r.size_ratio or 0.0 for r in own.values())
        weights = {s: max(0.0, r.weight or 0.0) for s, r in own.items()}
        supply = {s: float((r.max_repeats or 0) * sum(x for x, _, _ in by_source.get(s, {}).values())) for s, r in own.items()}
        due = allocate(size, weights, supply)
        whole = sum(weights.values())
        rows += [(mix, s, weights[s] / whole if whole else 0.0, r.max_repeats or 0, copies_a_size(due[s], r.max_repeats or 0, by_source.get(s, {}), power), float(due[s]), supply[s]) for s, r in own.items()]
    return rows


PLAN_SCHEMA = "mix_id string, source string, target_share double, cap int, c double, due double, supply double"


def allocation(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, due, supply): the tokens due to each source, and what all its repeats come to."""
    return tokens.sparkSession.createDataFrame(plan(tokens, targets), PLAN_SCHEMA).select("mix_id", "source", "target_share", "due", "supply")


def _sample_end(sums: DataFrame, own: list[str], part: str) -> DataFrame:
    """(own, part, before): the part in which a sample's tokens reach ``short``, and the tokens before it. sums: (own, part, t, short)."""
    before = F.sum("t").over(Window.partitionBy(*own).orderBy(part)) - F.col("t")
    return sums.withColumn("before", before).where((F.col("before") < F.col("short")) & (F.col("before") + F.col("t") >= F.col("short"))).select(*own, part, "before")


def draw(tokens: DataFrame, targets: DataFrame, seed: int = 1, power: float = SIZE_POWER) -> DataFrame:
    """(mix_id, source, doc_id, copies, tokens): the documents of each mix; tokens are those of one copy.

    A source without documents gives nothing; NULL weights, caps and ratios count as 0. Documents without tokens
    are never drawn. Ties of the ranking number fall to the smaller doc_id. No source is ever sorted as a whole: the range
    of ranking numbers in which its sample ends is found from sums, then the part of that range, and only that part, one
    of RANGES x RANGES, is put in order.
    """
    spark = tokens.sparkSession
    own = ["mix_id", "source"]
    # One row a mix and source: what is broadcast here and below is as bounded as the targets are.
    planned = spark.createDataFrame(plan(tokens, targets, power), PLAN_SCHEMA).where("c > 0").drop("target_share", "supply")
    due = tokens.where("tokens > 0").join(F.broadcast(planned), "source")
    due = due.withColumn("share", F.least(F.col("cap").cast("double"), F.col("c") * F.pow(F.col("tokens").cast("double"), F.lit(power))))
    due = due.withColumn("whole", F.floor(F.col("share") + 1e-9).cast("int")).withColumn("chance", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("share") - F.col("whole"))))
    u = (F.pmod(F.xxhash64("mix_id", "doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    rank = F.when(F.col("chance") > 0, F.log(u / (1 - u)) - F.log(F.col("chance") / F.greatest(1 - F.col("chance"), F.lit(1e-9))))
    # exp(rank) is the Pareto ranking number; its logarithm is cut into ranges, and each range into as many parts.
    place = (F.col("rank") + 40) * (RANGES / 80.0)
    within = lambda x: F.least(F.lit(RANGES - 1), F.greatest(F.lit(0), F.floor(x))).cast("int")
    due = due.withColumn("rank", rank).withColumn("range", F.when(F.col("rank").isNotNull(), within(place))).withColumn("part", within((place - F.col("range")) * RANGES))
    # What the certain copies leave to be drawn.
    sums = due.groupBy(*own, "range").agg(F.sum("tokens").alias("t"), F.sum(F.col("whole") * F.col("tokens")).alias("certain"), F.first("due").alias("due"))
    sums = sums.withColumn("short", F.col("due") - F.sum("certain").over(Window.partitionBy(*own)))
    short = sums.groupBy(*own).agg(F.first("short").alias("short"))
    last = _sample_end(sums.where("range is not null"), own, "range").withColumnsRenamed({"range": "last", "before": "before_last"})
    placed = due.join(F.broadcast(short.join(last, own, "left")), own)
    left = F.col("short") - F.col("before_last")
    parts = placed.where(F.col("range") == F.col("last")).groupBy(*own, "part").agg(F.sum("tokens").alias("t"), F.first(left).alias("short"))
    last_part = _sample_end(parts, own, "part").withColumnsRenamed({"part": "last_part", "before": "before_part"})
    placed = placed.join(F.broadcast(last_part), own, "left")
    r, part = F.col("range"), F.col("part")
    drawn = r.isNotNull() & (F.col("short") > 0) & (F.col("last").isNull() | (r < F.col("last")) | ((r == F.col("last")) & (part < F.col("last_part"))))
    at_end = F.coalesce((r == F.col("last")) & (part == F.col("last_part")), F.lit(False))
    order = Window.partitionBy(*own).orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.col("before_part") + F.sum("tokens").over(order)
    # The document that crosses the line is taken if that comes nearer to it.
    ended = placed.where(at_end).withColumn("copies", F.col("whole") + F.when(reached - F.col("tokens") / 2 <= left, 1).otherwise(0))
    others = placed.where(~at_end).withColumn("copies", F.col("whole") + F.when(drawn, 1).otherwise(0))
    return ended.unionByName(others).where("copies > 0").select(*own, "doc_id", "copies", "tokens")


def report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a mix and source: target and reached share of the tokens, tokens, documents and the most copies."""
    own = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("copies").alias("most_copies"))
    wanted = targets.where("mix_id is not null").select("mix_id", source_name(F.col("source")).alias("source"), "weight", "max_repeats")
    w = Window.partitionBy("mix_id")
    joined = wanted.join(own, ["mix_id", "source"], "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("tokens", "n_documents", "most_copies")})
    return joined.select("mix_id", "source", (F.col("weight") / F.sum("weight").over(w)).alias("target_share"), (F.col("tokens") / F.greatest(F.sum("tokens").over(w), F.lit(1))).alias("actual_share"), "tokens", "n_documents", "most_copies", "max_repeats")
