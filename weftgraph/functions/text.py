"""Column expressions on strings. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of company names that don't count.
COMPANY_SUFFIXES = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "plc", "gmbh")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Stripped, inner white space as single blanks."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def filled(c: Column) -> Column:
    """c, or NULL where it is blank."""
    return F.when(strip(c) != "", c)


def drop_endings(c: Column, endings: Sequence[str]) -> Column:
    """Without the last words as long as they are among endings; a value of endings alone becomes empty."""
    return F.regexp_replace(c, "((^| )(" + "|".join(endings) + "))+$", "")


def company_key(c: Column) -> Column:
    """Lower case, only letters and digits, without company endings."""
    return drop_endings(F.trim(F.regexp_replace(F.lower(c), "[^0-9a-z]+", " ")), COMPANY_SUFFIXES)


def canonical_value(
    c: Column, preserve_case: bool = False, strip_punctuation: bool = False, remove_non_alnum: bool = False, strip_suffixes: Sequence[str] = (), strip_company_suffixes: bool = False
) -> Column:
    """The canonical form of a display value as an ontology property asks for it."""
    v = collapse(c)
    if not preserve_case:
        v = F.lower(v)
    if strip_punctuation:
        v = F.trim(F.regexp_replace(F.regexp_replace(v, r"(?U)[^\w\s]", " "), r"\s+", " "))
    if remove_non_alnum:
        v = F.trim(F.regexp_replace(v, "[^0-9a-zA-Z]+", " "))
    endings = [s.lower() for s in strip_suffixes] or (list(COMPANY_SUFFIXES) if strip_company_suffixes else [])
    return F.trim(drop_endings(v, endings)) if endings else v


def title_case(c: Column) -> Column:
    """Each run of letters with its first letter in upper case and the others in lower case, whatever stands between runs."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def case_format(c: Column, style: str) -> Column:
    """lowercase, uppercase or titlecase; any other style leaves the value as it is."""
    return {"lowercase": F.lower, "uppercase": F.upper, "titlecase": title_case}.get(style.lower(), lambda x: x)(c)


def words(c: Column) -> Column:
    """Words as Python's split() gives them: no empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def ngrams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the lower-cased value; a shorter value is its own only one."""
    v = F.lower(F.trim(c))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(v) - (n - 1), F.lit(1))), lambda i: F.substring(v, i, F.lit(n)))
    return F.array_distinct(F.when(F.length(v) >= n, grams).otherwise(F.array(v)))
