"""Classifying documents, cutting them into chunks, and measuring chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import words
from weftgraph.plans.workers import by_value

by_value(__name__)

# How headings, list items and structure of any kind begin, and the words of technical texts.
HEADING, LISTED = r"^(#+\s+|[#*-]\s+)", r"^(\d+\.\s+|[-*+]\s+)"
STRUCTURE = r"(?m)^(\d+\.\s+|#+\s+|[-*+]\s+)"
TECHNICAL = ("function", "class", "api")


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in characters. Chunks of a structured text keep headings and lists whole; a narrative one from ``semantic_from``
    characters on is cut where its sentences change the subject."""

    least: int = 500
    most: int = 3000
    overlap: int = 0
    semantic_from: int = 5000
    most_chunks: int = 20

    def __post_init__(self) -> None:
        if not 0 < self.least <= self.most or not 0 <= self.overlap < self.most or self.most_chunks < 1:
            raise ValueError("sizes must be positive, the least not above the most, the overlap below it")


# The presets by class of document.
PRESETS = {"structured": ChunkConfig(500, 3000), "narrative": ChunkConfig(800, 4000, 200), "technical": ChunkConfig(400, 2000, 100), "mixed": ChunkConfig(533, 1600)}


def line_counts(text: Column) -> tuple[Column, Column, Column]:
    """Headings, list items and paragraphs among a text's lines. A bullet counts as both of the first two."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    count = lambda f: F.size(F.filter(lines, f))
    return count(lambda x: x.rlike(HEADING)), count(lambda x: x.rlike(LISTED)), count(lambda x: F.length(x) > 50)


def document_class(text: Column) -> Column:
    headings, items, paragraphs = line_counts(text)
    low = F.lower(text)
    technical = low.contains(TECHNICAL[0]) | low.contains(TECHNICAL[1]) | low.contains(TECHNICAL[2])
    return F.when((headings > 3) | (items > 3), "structured").when((F.length(text) > 5000) & (paragraphs > 10), "narrative").when(technical, "technical").otherwise("mixed")


def fixed_slices(text: Column, size: int) -> Column:
    """The text cut every ``size`` characters."""
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n, F.lit(size)), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def chunk_measures(chunk: Column, kind: Column | None = None) -> dict[str, Column]:
    """Words, sentences (pieces between full stops), and a score that grows with length up to 100 words; structure in a chunk
    of a structured document adds 0.2."""
    bonus = F.lit(0.0) if kind is None else F.when((kind == "structured") & chunk.rlike(STRUCTURE), 0.2).otherwise(0.0)
    n_words = F.size(words(chunk))
    sentences = F.size(F.filter(F.split(chunk, r"\."), lambda s: F.regexp_replace(s, r"\s+", "") != ""))
    return {"n_words": n_words, "n_sentences": sentences, "mean_sentence": n_words / F.greatest(sentences, F.lit(1)), "score": F.least(F.lit(1.0), n_words / 100) + bonus}


def positions(text: Column, chunk: Column) -> Column:
    """Where a chunk begins in its text, by its first 50 characters; -1 if it isn't there."""
    return F.call_function("position", F.substring(chunk, 1, 50), text) - 1


def truncated(text: Column, limit: int, sentinel: str = "\n[...truncated...]\n") -> Column:
    """Head and tail of a text that is too long, with a mark between them, never longer than the limit."""
    mark = sentinel.strip()
    head = (limit - len(sentinel)) // 2
    tail = limit - len(sentinel) - head
    cut = F.concat(F.regexp_replace(F.substring(text, 1, head), "\n+$", ""), F.lit(f"\n{mark}\n"), F.regexp_replace(F.right(text, F.lit(tail)), "^\n+", ""))
    ended = F.concat(F.regexp_replace(F.substring(cut, 1, limit), r"\s+$", ""), F.lit("\n"))
    return F.when(F.length(text) <= limit, text).otherwise(F.substring(ended, 1, limit))


def recursive_pieces(text: str, size: int, overlap: int = 0, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that serves; neighbours share up to ``overlap``."""
    if len(text) <= size:
        return [text] if text.strip() else []
    if not separators:
        step = max(1, size - overlap)
        return [text[i : i + size] for i in range(0, len(text), step) if text[i : i + size].strip()]
    parts = text.split(separators[0])
    out: list[str] = []
    held = ""
    for part in parts:
        joined = f"{held}{separators[0]}{part}" if held else part
        if len(joined) <= size:
            held = joined
            continue
        if held.strip():
            out.append(held)
        tail = held[-overlap:] if overlap and held else ""
        if len(part) > size:
            out += recursive_pieces(part, size, overlap, separators[1:])
            held = ""
        else:
            held = f"{tail}{separators[0]}{part}" if tail and len(tail) + len(part) + len(separators[0]) <= size else part
    if held.strip():
        out.append(held)
    return out


def structural_pieces(text: str, least: int = 500, most: int = 3000) -> list[str]:
    """Pieces that keep headings with what follows them and lists and quotes whole."""
    heading = lambda x: len(x) < 100 and re.match(r"#+\s|[A-Z][^.!?]*$", x)
    kind = lambda x: "heading" if heading(x) else "list" if re.match(r"\s*(?:\d+\.|[-*+])\s", x) else "quote" if x.lstrip()[:1] in (">", '"') or "***" in x else "plain"
    blocks: list[tuple[str, list[str]]] = []
    for line in text.split("\n"):
        k = kind(line.strip()) if line.strip() else "blank"
        if blocks and (k == "blank" or (k == blocks[-1][0] and k in ("list", "quote"))):
            blocks[-1][1].append(line)
        elif blocks and k == "plain" and blocks[-1][0] == "heading":
            blocks[-1][1].append(line)
        else:
            blocks.append((k, [line]))
    out, held = [], ""
    for k, lines in blocks:
        block = "\n".join(lines) + "\n"
        if held and (k == "heading" and len(held) > least or len(held) + len(block) > most):
            out.append(held.strip())
            held = ""
        held += block
    if held.strip():
        out.append(held.strip())
    return [p for x in out for p in (recursive_pieces(x, most) if len(x) > most else [x])]


def chunk_gate(chunks: DataFrame, coherence: float = 0.6, relevance: float = 0.6, size: float = 0.5) -> DataFrame:
    """(doc_id, passes): whether all chunks of a document reach the scores. chunks: (doc_id, coherence, relevance, size_score);
    a missing score counts as 0."""
    have = lambda c, least: F.coalesce(c, F.lit(0.0)) >= least
    return chunks.groupBy("doc_id").agg(F.bool_and(have("coherence", coherence) & have("relevance", relevance) & have("size_score", size)).alias("passes"))


def structural_flags(line: Column) -> dict[str, Column]:
    """Whether a line is a heading, a list item, or a quote."""
    t = F.regexp_replace(line, r"^\s+|\s+$", "")
    heading = t.rlike(r"^#+\s+") | (t.rlike(r"^[A-Z][^.!?]*$") & (F.length(t) < 100))
    return {"heading": heading, "item": t.rlike(LISTED), "quote": t.startswith(">") | t.startswith('"') | t.startswith("***")}


def coalesced(pieces: list[str], most_chunks: int) -> list[str]:
    """Neighbouring pieces joined by a blank line until there are at most so many, each of about equally many pieces."""
    if len(pieces) <= most_chunks:
        return pieces
    group = -(-len(pieces) // most_chunks)
    return ["\n\n".join(pieces[i : i + group]) for i in range(0, len(pieces), group)]


def packed_paragraphs(text: str, most: int) -> list[str]:
    """Paragraphs packed into pieces of at most ``most`` characters; a longer paragraph is cut into slices."""
    out: list[str] = []
    held = ""
    for paragraph in (p for p in text.split("\n\n") if p.strip()):
        joined = f"{held}\n\n{paragraph}" if held else paragraph
        if len(joined) <= most:
            held = joined
            continue
        if held:
            out.append(held)
        slices = [paragraph[i : i + most] for i in range(0, len(paragraph), most)]
        out += slices[:-1]
        held = slices[-1]
    return [*out, held] if held else out


def hashed_vector(text: str, size: int = 256) -> dict[int, int]:
    """A sparse count of hashed words: a stand-in for an embedding that is the same on every machine."""
    import zlib

    out: dict[int, int] = {}
    for w in re.findall(r"\w+", text.lower()):
        at = zlib.crc32(w.encode()) % size
        out[at] = out.get(at, 0) + 1
    return out


def similarity(a: dict[int, int], b: dict[int, int]) -> float:
    dot = sum(n * b.get(k, 0) for k, n in a.items())
    size = sum(n * n for n in a.values()) * sum(n * n for n in b.values())
    return dot / size**0.5 if size else 0.0


def semantic_pieces(text: str, most: int, embed: Callable[[str], dict[int, int]] = hashed_vector, break_share: float = 0.05) -> list[str]:
    """Sentences kept together until the subject changes: breaks are the ``break_share`` of neighbours least like each other."""
    sentences = [x for x in re.split(r"(?<=[.!?])\s+", text) if x.strip()]
    if len(sentences) < 3:
        return recursive_pieces(text, most)
    vectors = [embed(x) for x in sentences]
    alike = [similarity(a, b) for a, b in zip(vectors, vectors[1:])]
    bound = sorted(alike)[max(0, int(len(alike) * break_share) - 1)] if alike else 0.0
    out, held = [], sentences[0]
    for s, value in zip(sentences[1:], alike):
        if value <= bound or len(held) + 1 + len(s) > most:
            out.append(held)
            held = s
        else:
            held = f"{held} {s}"
    out.append(held)
    return [p for x in out for p in (packed_paragraphs(x, most) if len(x) > most else [x])]


def chunks(documents: DataFrame, config: ChunkConfig | None = None, embed: Callable[[str], dict[int, int]] = hashed_vector) -> DataFrame:
    """(doc_id, chunk_index, chunk_id, method, chunk) of each document: structural where it has structure, semantic where it is
    long and narrative, else recursive; no piece longer than allowed, neighbours joined where there are too many.

    config: one for all documents, by default the preset of each one's class. NULL and blank texts give nothing.
    """

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, kind, text in zip(pdf["doc_id"], pdf["kind"], pdf["text"]):
                c = config or PRESETS[kind]
                if kind == "structured":
                    method, pieces = "structural", structural_pieces(text, c.least, c.most)
                elif kind == "narrative" and len(text) >= c.semantic_from:
                    method, pieces = "semantic", semantic_pieces(text, c.most, embed)
                else:
                    method, pieces = "recursive", recursive_pieces(text, c.most, c.overlap)
                pieces = [q for p in pieces for q in (packed_paragraphs(p, c.most) if len(p) > c.most else [p])]
                rows += [(doc_id, i, f"{doc_id}_chunk_{i}", method, p) for i, p in enumerate(coalesced(pieces, c.most_chunks))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "chunk_id", "method", "chunk"]).astype({"chunk_index": "int32"})

    own = documents.where("text is not null").select("doc_id", document_class(F.col("text")).alias("kind"), "text")
    return own.mapInPandas(cut_up, "doc_id bigint, chunk_index int, chunk_id string, method string, chunk string")
