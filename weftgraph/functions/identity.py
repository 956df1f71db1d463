"""Keys and identifiers that follow from content."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces of name-based identifiers (RFC 9562, version 5): URLs, and canonical nodes.
URL_NAMESPACE = uuid.NAMESPACE_URL
CANONICAL_NAMESPACE = uuid.UUID("f791eccc-e49c-59ea-9b9c-a0bdb94533ad")


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """The version 5 identifier of a name, from built-in functions."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def canonical_key(entity_type: Column, properties: Column, unique: Sequence[str]) -> Column:
    """Type and its unique properties in order of name, or all its properties, as Type:k=v:k=v."""
    keys = F.array(*(F.lit(k) for k in unique))
    entries = F.filter(F.map_entries(properties), lambda e: e["value"].isNotNull())
    own = F.filter(entries, lambda e: F.array_contains(keys, e["key"]))
    used = F.when(F.size(own) > 0, own).otherwise(entries)
    pairs = F.transform(F.array_sort(used), lambda e: F.concat(e["key"], F.lit("="), F.lower(F.trim(e["value"]))))
    return F.concat(entity_type, F.lit(":"), F.array_join(pairs, ":"))


def canonical_id(key: Column) -> Column:
    return uuid5(CANONICAL_NAMESPACE, key)


def node_id(transform_id: Column, entity_type: Column, key: Column) -> Column:
    """Identifier of a node within a transform: the same input gives the same id."""
    return uuid5(URL_NAMESPACE, F.concat_ws(":", transform_id, entity_type, key))


def sorted_json(properties: Column) -> Column:
    """A property map as text that is equal for equal maps."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(properties))))


def diff_key(entity_type: Column, cid: Column, ckey: Column, local: Column) -> Column:
    """Identity across graphs: type and canonical id, else type and canonical key, else the local id."""
    blank = lambda c: F.when(c != "", c)
    return F.coalesce(F.concat(entity_type, F.lit(":"), blank(cid)), F.concat(entity_type, F.lit(":"), blank(ckey)), F.concat(F.lit("__local__:"), local))
