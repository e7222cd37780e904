"""Metadata: JSON text at rest, VARIANT while filtering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_metadata(value: Column) -> Column:
    """A struct, map or VARIANT as JSON text; missing metadata is `{}`."""
    return F.coalesce(F.to_json(value), F.lit("{}"))


def default_metadata(json_text: Column) -> Column:
    """Metadata that is already JSON text; missing or blank is `{}`."""
    return F.when(F.trim(json_text) == "", F.lit("{}")).otherwise(F.coalesce(json_text, F.lit("{}")))


def decode_metadata(json_text: Column) -> Column:
    """JSON text as VARIANT; missing or malformed text is the empty object."""
    return F.coalesce(F.try_parse_json(json_text), F.parse_json(F.lit("{}")))
