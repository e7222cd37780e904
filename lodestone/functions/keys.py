"""Deterministic keys: name-based UUIDs (RFC 4122, version 5) as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the RFC 4122 namespace for DNS names.
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def _name_hash(name: Column) -> Column:
    return F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_DNS)), F.encode(name, "UTF-8")))


def uuid5(name: Column) -> Column:
    """The version-5 UUID of `name` in its usual 8-4-4-4-12 form."""
    digits = _name_hash(name)
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digits, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(digits, 1, 8),
        F.substring(digits, 9, 4),
        F.concat(F.lit("5"), F.substring(digits, 14, 3)),
        F.concat(variant, F.substring(digits, 18, 3)),
        F.substring(digits, 21, 12),
    )


def int_id(doc_id: Column) -> Column:
    """63-bit label of a document id: upper half of its UUID, sign bit cleared."""
    digits = _name_hash(doc_id)
    first = F.conv(F.conv(F.substring(digits, 1, 1), 16, 10).cast("int").bitwiseAND(F.lit(7)).cast("string"), 10, 16)
    label = F.concat(first, F.substring(digits, 2, 11), F.lit("5"), F.substring(digits, 14, 3))
    return F.conv(label, 16, 10).cast("long")


def triple_id(collection_id: Column, subject: Column, predicate: Column, obj: Column) -> Column:
    """Identity of an edge: one id per collection, subject, predicate, object."""
    return uuid5(F.concat_ws(":", collection_id, subject, predicate, obj))
