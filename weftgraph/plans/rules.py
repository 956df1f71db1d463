"""Compiling scalar quality rules: all rules of all types become one projection and one explode over one scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import strip, title_case

VIOLATION = ("rule_id", "rule_type", "severity", "entity_type", "entity_id", "property_name", "message", "expected", "actual")


@dataclass(frozen=True)
class Rule:
    """One rule on one property of one entity type. kind names a check in CHECKS; options are the check's arguments."""

    rule_id: str
    kind: str
    entity_type: str
    property_name: str
    severity: str = "warning"
    options: dict[str, Any] = field(default_factory=dict)


def _pattern(v: Column, present: Column, pattern: str, flags: int = 0) -> list[tuple[Column, str, str]]:
    """flags: 2 ignores case, 8 lets ^ and $ match at lines, 16 lets the dot match line ends."""
    t = strip(v)
    inline = "".join(c for bit, c in ((2, "i"), (8, "m"), (16, "s")) if flags & bit)
    return [((t != "") & ~t.rlike(f"^(?{inline}:{pattern})" if inline else f"^(?:{pattern})"), "does not match the pattern", pattern)]


def _words(v: Column, present: Column, words: Sequence[str]) -> list[tuple[Column, str, str]]:
    """One of the words, as patterns and whatever their case, on the value's first line."""
    t = strip(v)
    return [((t != "") & ~t.rlike(r"(?i)\A[^\n]*(" + "|".join(words) + ")"), "has none of the words", ", ".join(words))]


def _forbidden_pattern(v: Column, present: Column, pattern: str) -> list[tuple[Column, str, str]]:
    """A value of several lines counts as matching, as a pattern that must not occur cannot be ruled out beyond the first."""
    t = strip(v)
    return [((t != "") & (t.rlike(pattern) | t.contains("\n")), "matches a forbidden pattern", pattern)]


def _iso_window(v: Column, present: Column, earliest: str | None = None, latest: str | None = None, allow_future: bool = True, now: str | None = None) -> list[tuple[Column, str, str]]:
    """An ISO date within bounds; missing and unreadable values count where the key is there. now: what the future begins after."""
    from weftgraph.plans.ontology_rules import iso_time

    at = iso_time(v)
    bound = lambda x: F.lit(x).cast("timestamp_ntz")
    out = [(present & at.isNull(), "is no date", "an ISO date")]
    if earliest:
        out.append((at < bound(earliest), "is too early", f">= {earliest}"))
    if latest:
        out.append((at > bound(latest), "is too late", f"<= {latest}"))
    if not allow_future:
        out.append((at > (bound(now) if now else F.localtimestamp()), "is in the future", "a date that has passed"))
    return out


def _length(v: Column, present: Column, least: int | None = None, most: int | None = None) -> list[tuple[Column, str, str]]:
    n = F.length(strip(v))
    out = []
    if least is not None:
        out.append((v.isNotNull() & (n < least), "is too short", f">= {least}"))
    if most is not None:
        out.append((v.isNotNull() & (n > most), "is too long", f"<= {most}"))
    return out


def _case(v: Column, present: Column, style: str) -> list[tuple[Column, str, str]]:
    t = strip(v)
    form = {"upper": F.upper(t), "lower": F.lower(t), "titleCase": title_case(t)}[style]
    return [((t != "") & (t != form), "has the wrong case", style)]


def _allowed(v: Column, present: Column, values: Sequence[str]) -> list[tuple[Column, str, str]]:
    return [(v.isNotNull() & ~strip(v).isin(list(values)), "is not allowed", ", ".join(values))]


def _forbidden(v: Column, present: Column, values: Sequence[str]) -> list[tuple[Column, str, str]]:
    return [(v.isNotNull() & F.lower(strip(v)).isin([x.lower() for x in values]), "is forbidden", "not " + ", ".join(values))]


def _range(v: Column, present: Column, least: float | None = None, most: float | None = None, inclusive: bool = True) -> list[tuple[Column, str, str]]:
    n = strip(v).try_cast("double")
    out = [(v.isNotNull() & n.isNull(), "is no number", "a number")]
    if least is not None:
        out.append(((n < least) if inclusive else (n <= least), "is too low", f">= {least:g}"))
    if most is not None:
        out.append(((n > most) if inclusive else (n >= most), "is too high", f"<= {most:g}"))
    return out


def _required(v: Column, present: Column) -> list[tuple[Column, str, str]]:
    """Only keys that are present can be reported as empty; absent keys are a matter of completeness."""
    return [(present & (v.isNull() | (strip(v) == "")), "is empty", "a value")]


def _year_window(v: Column, present: Column, earliest: int | None = None, latest: int | None = None) -> list[tuple[Column, str, str]]:
    y = strip(v).try_cast("int")
    out = [(v.isNotNull() & y.isNull(), "is no year", "a year")]
    if earliest is not None:
        out.append((y < earliest, "is too early", f">= {earliest}"))
    if latest is not None:
        out.append((y > latest, "is too late", f"<= {latest}"))
    return out


CHECKS: dict[str, Callable[..., list[tuple[Column, str, str]]]] = {
    "pattern": _pattern, "length": _length, "case_format": _case, "allowed_values": _allowed, "forbidden_values": _forbidden, "range": _range, "required": _required, "date_window": _year_window,
    "words": _words, "forbidden_pattern": _forbidden_pattern, "iso_window": _iso_window,
}


def register_check(kind: str, check: Callable[..., list[tuple[Column, str, str]]]) -> None:
    """Adds a kind of rule: check(value, present, **options) gives (violated, message, expected) triples."""
    CHECKS[kind] = check


def property_violations(nodes: DataFrame, rules: Sequence[Rule], entity_type: str = "type_", entity_id: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """Violations of all rules in one pass. A rule may give several rows for one value; NULL results count as no violation.

    keep: further columns of the nodes that each violation carries, such as the transform it was found in.
    """
    found = []
    for r in rules:
        value = F.col("properties")[r.property_name]
        present = F.coalesce(F.map_contains_key("properties", F.lit(r.property_name)), F.lit(False))
        for violated, message, expected in CHECKS[r.kind](value, present, **r.options):
            row = F.struct(
                F.lit(r.rule_id).alias("rule_id"), F.lit(r.kind).alias("rule_type"), F.lit(r.severity).alias("severity"), F.lit(r.property_name).alias("property_name"),
                F.lit(f"{r.entity_type}.{r.property_name} {message}").alias("message"), F.lit(expected).alias("expected"), value.alias("actual"),
            )
            found.append(F.when((F.col(entity_type) == r.entity_type) & violated, row))
    typed = nodes.where(F.col(entity_type).isin(sorted({r.entity_type for r in rules})))
    rows = typed.select(*keep, F.col(entity_type).alias("entity_type"), F.col(entity_id).alias("entity_id"), F.explode(F.array_compact(F.array(*found))).alias("v"))
    return rows.select(*keep, "v.rule_id", "v.rule_type", "v.severity", "entity_type", "entity_id", "v.property_name", "v.message", "v.expected", "v.actual")
