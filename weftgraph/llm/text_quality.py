"""Per-document text statistics, and how far a document lies from its language's prose.

Texts are read once. Location and scatter of prose are then fitted for each language over all documents, robustly: from quartiles
first, then from the documents near enough, again and again. The squared Mahalanobis distance splits exactly into one
contribution a statistic. It decides which documents are prose; of the outliers, the form of the lines tells lists and
tables, and the contributions tell sentences from words strung together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import prose
from weftgraph.llm.prose import KINDS, STATISTICS, Neighbours, text_statistics
from weftgraph.plans.lineage import cut, drop_cut
from weftgraph.plans.workers import by_value

by_value(__name__)
by_value(prose.__name__)

P = len(STATISTICS)
#: A statistic's scale in prose counts as this part of its scale over all documents at least: one that never varies in
#: prose would rule the distance otherwise.
LEAST_PART = 0.05
#: A language's fit is drawn towards the fit over all languages as if by so many documents more.
PRIOR_DOCUMENTS = 100
ROUNDS = 4
POOLED = "*"


def chi_square_quantile(p: int, z: float) -> float:
    """Of the chi-square distribution with p degrees, the quantile at z standard normal deviations (Wilson-Hilferty)."""
    return p * (1 - 2 / (9 * p) + z * (2 / (9 * p)) ** 0.5) ** 3


#: Documents within this distance (97.5 %) take part in the next fit; beyond OUTLYING (99.9 %) one is no plain prose; beyond
#: SENSELESS (all but one in a million) by the statistics in BROKEN alone, one makes no sense as sentences.
NEAR, OUTLYING, SENSELESS = chi_square_quantile(P, 1.96), chi_square_quantile(P, 3.09), chi_square_quantile(P, 4.75)
#: Statistics that words without order, repetition and broken characters move, and to which side.
BROKEN = {"neighbour_fit": -1, "packed_size": -1, "odd_characters": 1}

RAW_SCHEMA = "doc_id bigint, lang string, n_words int, stats array<double>, " + ", ".join(f"{k}_chars bigint" for k in KINDS) + ", broken boolean"


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One Arrow list a part."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def _counted(parts: list[np.ndarray]) -> tuple[pa.ListArray, pa.ListArray]:
    """The different cells of each part and how often each occurs, all parts counted at once."""
    sizes = np.array([len(p) for p in parts])
    flat = np.concatenate(parts).astype(np.int64) if len(parts) else np.zeros(0, np.int64)
    keyed, counts = np.unique(np.repeat(np.arange(len(parts)), sizes) * (1 << 32) + flat, return_counts=True)
    offsets = pa.array(np.searchsorted(keyed, np.arange(len(parts) + 1) * (1 << 32)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array((keyed & 0xFFFFFFFF).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32)))


def measured_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: RAW_SCHEMA and the neighbours of its common words (cells, counts). The only pass over the texts."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Neighbours()
        for batch in batches:
            rows = [text_statistics(t, known) for t in batch.column("text").to_pylist()]
            cells, counts = _counted([r[5] for r in rows])
            columns = {
                "doc_id": batch.column("doc_id"),
                "lang": pa.array([r[0] for r in rows], pa.string()),
                "n_words": pa.array([r[1] for r in rows], pa.int32()),
                "stats": _lists([np.array(r[2]) for r in rows], pa.float64()),
                **{f"{k}_chars": pa.array([r[3][k] for r in rows], pa.int64()) for k in KINDS},
                "broken": pa.array([r[4] for r in rows], pa.bool_()),
                "cells": cells,
                "counts": counts,
            }
            yield pa.RecordBatch.from_pydict(columns)

    own = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(measure, RAW_SCHEMA + ", cells array<int>, counts array<int>")


def fit_neighbours(measured: DataFrame) -> Neighbours:
    """Neighbours counted over all texts. The table on the driver has a fixed size: languages x (common words)^2."""
    pairs = measured.where("lang <> 'und'").select("lang", F.explode(F.arrays_zip("cells", "counts")).alias("e"))
    counted = pairs.groupBy("lang", F.col("e.cells").alias("cell")).agg(F.sum("e.counts").alias("n")).toPandas()
    known = Neighbours()
    tables = {}
    for lang, own in counted.groupby("lang"):
        flat = np.zeros((len(known.place[lang]) + 1) ** 2)
        flat[own["cell"].to_numpy()] = own["n"].to_numpy()
        tables[lang] = flat
    return known.fit(tables)


def with_neighbour_fit(measured: DataFrame, neighbours: Neighbours) -> DataFrame:
    """RAW_SCHEMA with neighbour_fit filled in; the neighbours are no longer needed."""
    at = STATISTICS.index("neighbour_fit")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, langs = batch.num_rows, np.array(batch.column("lang").to_pylist(), object)
            stats = np.array(batch.column("stats").flatten()).reshape(n, P).copy()
            cells, counts = np.array(batch.column("cells").flatten()), np.array(batch.column("counts").flatten())
            starts = np.array(batch.column("cells").offsets)[:n] - batch.column("cells").offsets[0].as_py()
            sizes = np.diff(np.append(starts, len(cells)))
            words = np.array(batch.column("n_words"))
            for lang in set(langs) - {"und"}:
                rows = np.flatnonzero(langs == lang)
                take = np.concatenate([np.arange(starts[r], starts[r] + sizes[r]) for r in rows]).astype(int)
                own = np.concatenate([[0], np.cumsum(sizes[rows])])[:-1]
                stats[rows, at] = neighbours.means(lang, cells[take], counts[take], own, words[rows])
            columns = {name: batch.column(name) for name in batch.schema.names if name not in ("stats", "cells", "counts")}
            columns["stats"] = pa.ListArray.from_arrays(pa.array(np.arange(0, n * P + 1, P), pa.int32()), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_pydict({f.split()[0]: columns[f.split()[0]] for f in RAW_SCHEMA.split(", ")})

    return measured.mapInArrow(fill, RAW_SCHEMA)


class ProseFit:
    """Mean and inverse covariance of prose by language; POOLED, over all languages, serves texts whose language is unknown."""

    def __init__(self, least: np.ndarray) -> None:
        self.least = least
        self.mean: dict[str, np.ndarray] = {}
        self.inverse: dict[str, np.ndarray] = {}

    def set(self, sizes: dict[str, float], means: dict[str, np.ndarray], covariances: dict[str, np.ndarray]) -> None:
        """Each language drawn towards POOLED by PRIOR_DOCUMENTS, alike at every size."""
        for lang, n in sizes.items():
            w = 1.0 if lang == POOLED else n / (n + PRIOR_DOCUMENTS)
            self.mean[lang] = w * means[lang] + (1 - w) * means[POOLED]
            self.inverse[lang] = np.linalg.inv(w * covariances[lang] + (1 - w) * covariances[POOLED] + np.diag(self.least**2))

    def contributions(self, lang: str, stats: np.ndarray) -> np.ndarray:
        """For rows of statistics of one language, the parts of the squared distance: they add up to it."""
        own = lang if lang in self.mean else POOLED
        off = stats - self.mean[own]
        return off * (off @ self.inverse[own])

    def senseless(self, lang: str, stats: np.ndarray, contributions: np.ndarray) -> np.ndarray:
        """Of the distance, what the statistics in BROKEN contribute to their side."""
        off = stats - self.mean[lang if lang in self.mean else POOLED]
        at, side = [STATISTICS.index(s) for s in BROKEN], np.array(list(BROKEN.values()))
        return np.where(off[:, at] * side > 0, contributions[:, at], 0.0).sum(1)


def fit_prose(stats: DataFrame) -> ProseFit:
    """Robust fit over all documents whose language can be told. Only sums of fixed size reach the driver."""
    columns = [F.col("stats")[i].alias(f"s{i}") for i in range(P)]
    spread = stats.where("n_words > 0").select(*columns).agg(*(F.stddev_pop(f"s{i}").alias(f"d{i}") for i in range(P))).first()
    least = np.array([max(LEAST_PART * (spread[i] or 0.0), 1e-6) for i in range(P)])
    told = stats.where("lang <> 'und'")
    groups = F.explode(F.array(F.col("lang"), F.lit(POOLED)))
    quartiles = told.select(groups.alias("g"), *columns).groupBy("g").agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(f"s{i}", [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i in range(P))).collect()
    fit = ProseFit(least)
    if not quartiles:
        fit.set({POOLED: 1}, {POOLED: np.zeros(P)}, {POOLED: np.eye(P)})
        return fit
    q = {r.g: np.array([r[f"q{i}"] for i in range(P)]) for r in quartiles}
    fit.set({r.g: r.n for r in quartiles}, {g: x[:, 1] for g, x in q.items()}, {g: np.diag(((x[:, 2] - x[:, 0]) / 1.349) ** 2) for g, x in q.items()})
    for _ in range(ROUNDS):
        sums = _near_sums(told, fit)
        sums[POOLED] = sum(sums.values()) if sums else np.zeros(1)
        if sums[POOLED][0] <= 2 * P:  # too few to tell a scatter from
            break
        sizes = {g: v[0] for g, v in sums.items() if v[0]}
        means = {g: sums[g][1 : P + 1] / n for g, n in sizes.items()}
        fit.set(sizes, means, {g: sums[g][P + 1 :].reshape(P, P) / n - np.outer(means[g], means[g]) for g, n in sizes.items()})
    return fit


def _near_sums(stats: DataFrame, fit: ProseFit) -> dict[str, np.ndarray]:
    """By language, count, sums and sums of products of the documents near the fit."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, own in pdf.groupby("lang"):
                x = np.stack(own["stats"].to_numpy())
                near = x[fit.contributions(lang, x).sum(1) <= NEAR]
                total[lang] = total.get(lang, 0) + np.concatenate([[len(near)], near.sum(0), (near.T @ near).ravel()])
        for g, v in total.items():
            yield pd.DataFrame({"g": g, "i": np.arange(len(v), dtype=np.int32), "v": v})

    sums = stats.select("lang", "stats").mapInPandas(add, "g string, i int, v double").groupBy("g", "i").agg(F.sum("v").alias("v")).toPandas()
    return {g: own.sort_values("i")["v"].to_numpy() for g, own in sums.groupby("g")}


def outlierness(stats: DataFrame, fit: ProseFit) -> DataFrame:
    """Adds distance2, the squared robust distance, contributions, its parts in the order of STATISTICS, and senseless, the
    part of BROKEN in it."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts, broken = np.zeros((len(pdf), P)), np.zeros(len(pdf))
            for lang, at in pdf.groupby("lang").indices.items():
                x = np.stack(pdf["stats"].to_numpy()[at])
                parts[at] = fit.contributions(lang, x)
                broken[at] = fit.senseless(lang, x, parts[at])
            yield pdf.assign(distance2=parts.sum(1), contributions=list(parts), senseless=broken)

    return stats.mapInPandas(measure, RAW_SCHEMA + ", distance2 double, contributions array<double>, senseless double")


def fitted_statistics(documents: DataFrame) -> DataFrame:
    """Statistics, distance and contributions of every document, from one pass over the texts: what it measures is cut into
    the shared folder."""
    measured = cut(measured_texts(documents))
    stats = cut(with_neighbour_fit(measured, fit_neighbours(measured)))
    drop_cut(measured)
    return outlierness(stats, fit_prose(stats))


def told_kind() -> Column:
    """The kind of an outlier; NULL if it is prose after all: a heading, an odd sentence, prose with a short list."""
    most = F.greatest("list_chars", "table_chars", "junk_chars")
    prose_wins = F.col("prose_chars") > F.col("list_chars") + F.col("table_chars") + F.col("junk_chars")
    return (
        F.when(F.col("broken") | (F.col("prose_chars") + most == 0), "junk")
        .when(prose_wins & (F.col("senseless") > SENSELESS), "junk")
        .when(prose_wins, None)
        .when(F.col("list_chars") == most, "list")
        .when(F.col("table_chars") == most, "table")
        .otherwise("junk")
    )


def not_prose(documents: DataFrame, outlying: float = OUTLYING) -> DataFrame:
    """(doc_id, kind) of the documents that are, by the greater part of their characters, list, table or junk.

    A document within ``outlying`` of its language's prose is prose. Of the outliers, the kind of line that holds the most
    characters decides; where that is prose, the distance decides again: sentences are prose, but a text whose
    words have no order, that repeats itself or is broken is junk. NULL and empty text is junk. Rows with NULL doc_id
    give nothing; repeated rows count once.
    """
    s = fitted_statistics(documents)
    return s.where(F.col("distance2") > outlying).select("doc_id", told_kind().alias("kind")).where("kind is not null").distinct()


def statistics_report(documents: DataFrame) -> DataFrame:
    """One row a document: its language, each statistic, the squared distance and each statistic's contribution."""
    s = fitted_statistics(documents)
    return s.select("doc_id", "lang", "n_words", "distance2", *(F.col("stats")[i].alias(n) for i, n in enumerate(STATISTICS)), *(F.col("contributions")[i].alias(f"{n}_contribution") for i, n in enumerate(STATISTICS)))
