"""Documents and golden corpora from files, and text sinks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes that are read as plain text, and the first bytes of common formats.
TEXT_SUFFIXES = (".txt", ".md", ".csv", ".json", ".xml", ".html")
MAGIC = {"25504446": "application/pdf", "504B0304": "application/zip", "89504E47": "image/png", "FFD8FF": "image/jpeg"}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def text_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, suffix, text): whole files, as UTF-8 where the bytes are, else as Latin-1; text is NULL for other formats."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    s = suffix(F.col("path"))
    return raw.select("path", s.alias("suffix"), F.when(s.isin(*TEXT_SUFFIXES), text).alias("text"))


def upload_checks(spark: SparkSession, path: str, most_bytes: int) -> DataFrame:
    """(path, length, format, ok): size and agreement of suffix and first bytes."""
    raw = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 4))
    kind = F.lit("text/plain")
    for magic, name in MAGIC.items():
        kind = F.when(head.startswith(magic), name).otherwise(kind)
    plain = suffix(F.col("path")).isin(*TEXT_SUFFIXES) == (kind == "text/plain")
    return raw.select("path", "length", kind.alias("format"), ((F.col("length") <= most_bytes) & (F.col("length") > 0) & plain).alias("ok"))


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags gone, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " "), r"\s+", " "))


def safe_filename(name: Column, most: int = 120) -> Column:
    """The last part of a path with unsafe characters replaced and its length bounded."""
    last = F.regexp_replace(name, r"^.*[/\\]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(last, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+", ""), 1, most)


def page_number(name: Column) -> Column:
    """Page index from the suffix that a splitter puts before the extension."""
    return F.regexp_extract(name, r"_(\d+)\.", 1).try_cast("int")


def golden_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(slug, nodes, edges) of expected.json files in folders named by slug."""
    schema = "nodes array<struct<id:string,type:string,label:string,properties:map<string,string>>>, edges array<struct<id:string,type:string,source:string,target:string,properties:map<string,string>>>"
    own = spark.read.schema(schema).json(f"{path}/*/expected.json", multiLine=True)
    return own.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/expected\.json$", 1).alias("slug"), "nodes", "edges")


def markdown_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """(cells): the body rows of Markdown tables among lines of text."""
    bar = F.trim(column).startswith("|")
    rule = F.trim(column).rlike(r"^\|[\s:|-]+$")
    cells = F.transform(F.split(F.regexp_replace(F.trim(column), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return lines.where(bar & ~rule).select(cells.alias("cells"))


def write_csv(df: DataFrame, path: str, decimals: dict[str, int] | None = None) -> None:
    """CSV with a header; NULL as empty, given columns with fixed decimals."""
    for c, n in (decimals or {}).items():
        df = df.withColumn(c, F.format_string(f"%.{n}f", F.col(c)))
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that df holds, so that a load can be repeated from any point."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def within(base: str, path: str) -> bool:
    """Whether a path stays below a folder, whatever dots it has."""
    import posixpath

    full = posixpath.normpath(posixpath.join(base, path))
    return full == posixpath.normpath(base) or full.startswith(posixpath.normpath(base) + "/")


PARSERS: dict[str, Callable[[bytes], str | None]] = {}


def register_parser(ending: str, parser: Callable[[bytes], str | None]) -> None:
    """Adds a parser of a binary format (PDF, office documents) by suffix; an optional dependency of the caller."""
    PARSERS[ending.lower()] = parser


def strip_fences(text: Column) -> Column:
    """Model output without the code fence around it."""
    inner = F.regexp_extract(text, r"(?s)```[a-zA-Z]*\n(.*?)```", 1)
    return F.trim(F.when(inner != "", inner).otherwise(text))


IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def safe_identifier(name: str) -> str:
    """The name if it can stand in a statement as it is, else an error."""
    if not IDENTIFIER.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def evidence_text(text: Column, most: int) -> Column:
    """The text as evidence, or NULL where it is longer than allowed: never a part of it."""
    return F.when(F.length(text) <= most, text)


# What each kind of store can do, and which of it is only known once it runs.
CAPABILITIES = (
    ("memory", False, False, True, False, False, ""),
    ("neo4j", True, True, True, False, True, ""),
    ("postgres_age", True, False, True, False, False, "full_text_indexes"),
)


def backend_capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CAPABILITIES), "backend string, persistent boolean, full_text_indexes boolean, similarity_search boolean, embedding_similarity boolean, per_user_routing boolean, told_at_run_time string")
