"""Model calls as table functions over Arrow batches, and the texts that models are given. The model is the caller's function."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.review import first_rows
from weftgraph.plans.workers import by_value

by_value(__name__)

NODE_SCHEMA = "doc_id bigint, chunk_index int, id string, type_ string, name string, model string, prompt_version string"
EDGE_SCHEMA = "doc_id bigint, chunk_index int, from_ string, to_ string, relationship string, model string, prompt_version string"
#: Members of a candidate group that one call judges; larger groups are judged in parts.
GROUP_MEMBERS = 50


def named_things(text: str) -> list[dict[str, Any]]:
    """A stand-in for an extraction model, the same everywhere: capitalised words in a row are names, those with a legal form
    of organisations."""
    out: dict[str, dict[str, Any]] = {}
    for m in re.finditer(r"(?<![.!?]\s)(?<!^)\b[A-Z][a-z]+(?: [A-Z][A-Za-z]+)+", text, re.M):
        kind = "Organization" if re.search(r"\b(?:Inc|Ltd|LLC|PLC|GmbH|AG|SA|BV|Corp|Group|University)\b", m[0]) else "Person"
        out.setdefault(m[0], {"type_": kind, "name": m[0]})
    return list(out.values())


def extracted_nodes(chunks: DataFrame, extract: Callable[[str], Sequence[Mapping[str, Any]]] = named_things, model: str = "stub", prompt_version: str = "1.0") -> DataFrame:
    """NODE_SCHEMA: what a model finds in each chunk. chunks: (doc_id, chunk_index, chunk). A chunk on which the model fails
    gives nothing; the others are not lost."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, n, text in zip(pdf["doc_id"], pdf["chunk_index"], pdf["chunk"]):
                try:
                    found = extract(text or "")
                except Exception:  # noqa: BLE001 (one bad answer must not end the job)
                    continue
                rows += [(doc_id, n, f"{doc_id}:{n}:{i}", f["type_"], f["name"], model, prompt_version) for i, f in enumerate(found)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")]).astype({"chunk_index": "int32"})

    return chunks.select("doc_id", "chunk_index", "chunk").mapInPandas(run, NODE_SCHEMA)


def extracted_edges(nodes: DataFrame, infer: Callable[[str, str], str | None]) -> DataFrame:
    """EDGE_SCHEMA: relationships that a model infers between nodes that follow each other in a chunk."""
    keyed = nodes.select("doc_id", "chunk_index", "id", "type_", "model", "prompt_version", F.substring_index("id", ":", -1).cast("int").alias("n"))
    after = keyed.select("doc_id", "chunk_index", (F.col("n") - 1).alias("n"), F.col("id").alias("to_"), F.col("type_").alias("other"))
    pairs = keyed.join(after, ["doc_id", "chunk_index", "n"])

    @F.pandas_udf("string")
    def verdict(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([infer(x, y) for x, y in zip(a, b)], dtype=object)

    return pairs.withColumn("relationship", verdict("type_", "other")).where("relationship is not null").select("doc_id", "chunk_index", F.col("id").alias("from_"), "to_", "relationship", "model", "prompt_version")


def answered_once(prompts: DataFrame, answer: Callable[[str], str]) -> DataFrame:
    """(id, answer): each different prompt is put to the model once, by its digest, and the answer joined back."""
    keyed = prompts.select("id", "prompt", F.md5("prompt").alias("key"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "answer": [answer(p) for p in pdf["prompt"]]})

    once = keyed.groupBy("key").agg(F.first("prompt").alias("prompt")).mapInPandas(ask, "key string, answer string")
    return keyed.join(once, "key").select("id", "answer")


def judged_groups(members: DataFrame, judge: Callable[[list[str]], list[list[str]]], most: int = GROUP_MEMBERS) -> DataFrame:
    """(group, id, representative): groups as a model splits them. members: (group, id, text), judged ``most`` at a time, so that no
    call and no task sees more of a group; the smallest id of each part the model leaves together represents it."""
    sized = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    parts = members.join(sized, "group").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / (most / 2))))

    def split(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id")
        by_text: dict[str, list[str]] = {}
        for i, t in zip(own["id"], own["text"]):
            by_text.setdefault(t, []).append(i)
        rows = []
        for together in judge(sorted(by_text)):
            ids = [i for t in together for i in by_text.get(t, ())]
            rows += [(key[0], i, min(ids)) for i in ids]
        return pd.DataFrame(rows, columns=["group", "id", "representative"])

    return parts.groupBy("group", "part").applyInPandas(split, "group string, id string, representative string")


def context_line(kind: Column, label: Column, properties: Column, keys: Sequence[str]) -> Column:
    """[type] label: key=value; ... of the keys that are filled."""
    told = F.array_compact(F.array(*(F.when(F.trim(properties[k]) != "", F.concat(F.lit(f"{k}="), F.trim(properties[k]))) for k in keys)))
    return F.concat(F.lit("["), F.coalesce(kind, F.lit("_")), F.lit("] "), label, F.when(F.size(told) > 0, F.concat(F.lit(": "), F.array_join(told, "; "))).otherwise(F.lit("")))


def context_texts(lines: DataFrame, by: str, most_lines: int) -> DataFrame:
    """(by, n_lines, text): the first lines of each group as one text. lines: (by, line). A group's lines are cut down before
    they are put together, so that no text holds more than ``most_lines`` of them."""
    few = first_rows(lines.distinct(), [by], [F.asc("line")], most_lines, F.col("line"))
    ordered = F.array_sort(F.collect_list("line"))
    return few.groupBy(by).agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(ordered, "\n").alias("text"))


def type_summary(nodes: DataFrame, keys: int = 6, samples: int = 5) -> DataFrame:
    """(type_, n, keys, samples): how many nodes a type has, its most frequent property keys, and the first of its names."""
    sizes = nodes.where("type_ is not null").groupBy("type_").agg(F.count(F.lit(1)).alias("n"))
    counted = nodes.where("type_ is not null").select("type_", F.explode(F.map_keys("properties")).alias("key")).groupBy("type_", "key").agg(F.count(F.lit(1)).alias("c"))
    top = first_rows(counted, ["type_"], [F.desc("c"), F.asc("key")], keys, F.col("key")).groupBy("type_").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda x: x["key"]), ",").alias("keys"))
    names = nodes.where("type_ is not null").select("type_", F.col("properties")["name"].alias("name")).where("name is not null").distinct()
    few = first_rows(names, ["type_"], [F.asc("name")], samples, F.col("name")).groupBy("type_").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("samples"))
    return sizes.join(top, "type_", "left").join(few, "type_", "left")
