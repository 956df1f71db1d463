"""Ontologies as small DataFrames, and what follows from them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Property types and what holds them; any other name is a string.
TYPES: dict[str, T.DataType] = {
    "string": T.StringType(), "str": T.StringType(), "integer": T.LongType(), "int": T.LongType(), "float": T.DoubleType(), "number": T.DoubleType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "bool": T.BooleanType(), "datetime": T.TimestampNTZType(), "list": T.ArrayType(T.StringType()), "array": T.ArrayType(T.StringType()),
}


def normalised(ontology: Mapping[str, Any]) -> dict[str, list[dict[str, Any]]]:
    """entity_types, prop_defs and rel_types rows of an ontology; relationships may be nested under entities or stand at the top."""
    entities = ontology.get("entities") or {}
    if not isinstance(entities, Mapping):
        raise ValueError("entities must be a mapping")
    out: dict[str, list[dict[str, Any]]] = {"entity_types": [], "prop_defs": [], "rel_types": []}
    for n, (name, body) in enumerate(entities.items()):
        body = body or {}
        out["entity_types"].append({"entity_type": name, "ordinal": n})
        for k, (prop, d) in enumerate((body.get("properties") or {}).items()):
            d = d or {}
            out["prop_defs"].append({"entity_type": name, "prop": prop, "ordinal": k, "type": d.get("type", "string"), "required": bool(d.get("required")), "is_unique": bool(d.get("unique")), "enum": list(d.get("enum") or [])})
        for rel, d in (body.get("relationships") or {}).items():
            out["rel_types"].append({"source_type": name, "rel_type": rel, "target_type": (d or {}).get("target"), "cardinality": (d or {}).get("cardinality")})
    for rel, d in (ontology.get("relationships") or {}).items():
        d = d or {}
        out["rel_types"].append({"source_type": d.get("source"), "rel_type": rel, "target_type": d.get("target"), "cardinality": d.get("cardinality")})
    return out


def row_type(prop_defs: Iterable[Mapping[str, Any]]) -> T.StructType:
    """The struct that holds an entity's properties with their declared types."""
    return T.StructType([T.StructField(p["prop"], TYPES.get(p["type"], T.StringType())) for p in sorted(prop_defs, key=lambda p: p["ordinal"])])


def coerced(value: Column, kind: str) -> Column:
    """A string as its declared type; NULL where it can't be."""
    v = F.trim(value)
    if kind in ("boolean", "bool"):
        low = F.lower(v)
        return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)
    if kind in ("list", "array"):
        return F.filter(F.transform(F.split(v, ","), lambda x: F.trim(x)), lambda x: x != "")
    target = TYPES.get(kind, T.StringType())
    return v if isinstance(target, T.StringType) else v.try_cast(target)


def snapped(value: Column, enum: Iterable[str]) -> Column:
    """The declared spelling of a value whatever its case; NULL if it is none of them."""
    out = F.lit(None).cast("string")
    for e in enum:
        out = F.when(F.lower(F.trim(value)) == e.lower(), e).otherwise(out)
    return out


def typed_view(nodes: DataFrame, entity_type: str, prop_defs: Iterable[Mapping[str, Any]], type_column: str = "type_") -> DataFrame:
    """Nodes of a type with real columns for their properties: only rows whose required properties are there, whose values fit
    their types and whose enumerated values are declared."""
    defs = [p for p in prop_defs if p["entity_type"] == entity_type]
    out = nodes.where(F.col(type_column) == entity_type)
    columns = []
    for p in defs:
        raw = F.col("properties")[p["prop"]]
        value = snapped(raw, p["enum"]) if p["enum"] else coerced(raw, p["type"])
        out = out.where((raw.isNull() | (F.trim(raw) == "") | value.isNotNull()) if not p["required"] else value.isNotNull() & (F.trim(raw) != ""))
        columns.append(value.alias(p["prop"]))
    return out.select("id", *columns)


_CANONICALIZERS: dict[str, Callable[[Column], Column]] = {}


def register_canonicalizer(key: str, f: Callable[[Column], Column]) -> None:
    """Adds a canonical form for 'property' or 'Entity.property'; f works on columns."""
    _CANONICALIZERS[key.lower()] = f


def canonicalizer(entity_type: str, prop: str, default: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return _CANONICALIZERS.get(f"{entity_type}.{prop}".lower()) or _CANONICALIZERS.get(prop.lower()) or default


def tables(spark: SparkSession, ontology: Mapping[str, Any]) -> dict[str, DataFrame]:
    """The ontology as small DataFrames to join with."""
    schema = {
        "entity_types": "entity_type string, ordinal int", "prop_defs": "entity_type string, prop string, ordinal int, type string, required boolean, is_unique boolean, enum array<string>",
        "rel_types": "source_type string, rel_type string, target_type string, cardinality string",
    }
    return {k: spark.createDataFrame(rows, schema[k]) for k, rows in normalised(ontology).items()}
