"""Text of office documents and simple PDFs, from their bytes and the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.workers import by_value
from weftgraph.sources.files import PARSERS, TEXT_SUFFIXES, suffix

by_value(__name__)

#: What a part of an archive may hold once unpacked; larger ones are no document.
MOST_BYTES = 256 << 20


def _parts(content: bytes, pattern: str) -> Iterator[ElementTree.Element]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        named = [i for i in archive.infolist() if re.fullmatch(pattern, i.filename) and i.file_size <= MOST_BYTES]
        for info in sorted(named, key=lambda i: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", i.filename)]):
            yield ElementTree.fromstring(archive.read(info))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _paragraphs(root: ElementTree.Element) -> Iterator[str]:
    for element in root.iter():
        if _local(element.tag) == "p":
            yield "".join(x.text or "" for x in element.iter() if _local(x.tag) == "t")


def docx_text(content: bytes) -> str:
    """Paragraphs of a word processor's document, one a line."""
    return "\n".join(p for root in _parts(content, r"word/document\.xml") for p in _paragraphs(root))


def pptx_text(content: bytes) -> str:
    """Paragraphs of a presentation, slide by slide."""
    return "\n\n".join("\n".join(p for p in _paragraphs(root) if p) for root in _parts(content, r"ppt/slides/slide\d+\.xml"))


def xlsx_text(content: bytes) -> str:
    """Rows of a workbook, cells set apart by tabs, sheets by blank lines."""
    shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for root in _parts(content, r"xl/sharedStrings\.xml") for si in root]
    sheets = []
    for root in _parts(content, r"xl/worksheets/sheet\d+\.xml"):
        lines = []
        for row in (e for e in root.iter() if _local(e.tag) == "row"):
            cells = []
            for c in row:
                value = next((v.text or "" for v in c.iter() if _local(v.tag) in ("v", "t")), "")
                cells.append(shared[int(value)] if c.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value)
            lines.append("\t".join(cells))
        sheets.append("\n".join(lines))
    return "\n\n".join(sheets)


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}
_SHOWN = re.compile(rb"\((?P<s>(?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|\[(?P<a>(?:\\.|[^\]])*)\]\s*TJ|(?P<n>T\*|\bTD\b|\bTd\b|\bET\b)", re.S)


def _literal(raw: bytes) -> str:
    out = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), raw, flags=re.S)
    return out.decode("cp1252", "replace")


def pdf_pages(content: bytes) -> list[str]:
    """Text of the content streams of a PDF, in order, as far as it is written in plain single-byte fonts; encrypted files give none."""
    if not content.startswith(b"%PDF") or b"/Encrypt" in content:
        return []
    pages = []
    for m in re.finditer(rb"<<(?P<d>.*?)>>\s*stream\r?\n(?P<b>.*?)\r?\nendstream", content, re.S):
        body = m["b"]
        if b"/FlateDecode" in m["d"]:
            try:
                body = zlib.decompressobj().decompress(body, MOST_BYTES)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        shown = []
        for t in _SHOWN.finditer(body):
            if t["s"] is not None:
                shown.append(_literal(t["s"]))
            elif t["a"] is not None:
                shown.append("".join(_literal(x) for x in re.findall(rb"\(((?:\\.|[^\\()])*)\)", t["a"], re.S)))
            else:
                shown.append("\n")
        text = re.sub(r"\n{2,}", "\n", "".join(shown)).strip()
        if text:
            pages.append(text)
    return pages


def pdf_text(content: bytes) -> str | None:
    pages = pdf_pages(content)
    return "\n\n".join(pages) if pages else None


# The parser of each suffix; register_parser adds others or replaces these.
BUILT_IN: dict[str, Callable[[bytes], str | None]] = {".docx": docx_text, ".pptx": pptx_text, ".xlsx": xlsx_text, ".pdf": pdf_text}


def parsed_files(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES, strict: bool = False) -> DataFrame:
    """(path, suffix, text, problem): documents of any format that a parser is known for, by suffix.

    Plain text is read as UTF-8, else Latin-1. A file without parser, too large or broken has NULL text and says so in
    ``problem``; strict drops it. One bad file never ends the job.
    """
    parsers = BUILT_IN | PARSERS

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text, problem = [], []
            for kind, content in zip(pdf["suffix"], pdf["content"]):
                t, p = None, None
                try:
                    if kind in TEXT_SUFFIXES:
                        try:
                            t = bytes(content).decode("utf-8")
                        except UnicodeDecodeError:
                            t = bytes(content).decode("latin-1")
                    elif kind in parsers:
                        t = parsers[kind](bytes(content))
                        p = None if t is not None else "no text"
                    else:
                        p = "no parser"
                except Exception as e:  # noqa: BLE001 (a broken file is a row, not a failed task)
                    p = f"broken: {type(e).__name__}"
                text.append(t)
                problem.append(p)
            yield pd.DataFrame({"path": pdf["path"], "suffix": pdf["suffix"], "text": text, "problem": problem})

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fits = raw.where(F.col("length") <= most_bytes).select("path", suffix(F.col("path")).alias("suffix"), "content").mapInPandas(parse, "path string, suffix string, text string, problem string")
    large = raw.where(F.col("length") > most_bytes).select("path", suffix(F.col("path")).alias("suffix"), F.lit(None).cast("string").alias("text"), F.lit("too large").alias("problem"))
    out = fits.unionByName(large)
    return out.where("text is not null") if strict else out


def pdf_page_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text): PDFs cut into their pages."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, i, t) for p, content in zip(pdf["path"], pdf["content"]) for i, t in enumerate(pdf_pages(bytes(content)))]
            yield pd.DataFrame(rows, columns=["path", "page", "text"]).astype({"page": "int32"})

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(suffix(F.col("path")) == ".pdf")
    return raw.select("path", "content").mapInPandas(split, "path string, page int, text string")
