"""Batches given as parallel arrays."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.metadata import default_metadata, encode_metadata

_ARRAYS = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.StringType())),
        T.StructField("documents", T.ArrayType(T.StringType())),
        T.StructField("metadatas", T.ArrayType(T.StringType())),
    ]
)


def unnest_batches(batches: DataFrame, *keep: str) -> DataFrame:
    """(keep..., pos, id, text, metadata) from rows of ids, documents and metadatas.

    Arrays of one row must have the same length; missing metadatas are `{}`.
    Metadata elements are JSON text, or structs and maps that are encoded.
    """
    columns = [F.col("ids"), F.col("documents")]
    if "metadatas" in batches.columns:
        element = batches.schema["metadatas"].dataType.elementType
        blank = F.transform("ids", lambda _: F.lit("{}"))
        given = (
            F.col("metadatas")
            if isinstance(element, T.StringType)
            else F.transform("metadatas", lambda m: encode_metadata(m))
        )
        columns.append(F.coalesce(given, blank))
    else:
        columns.append(F.transform("ids", lambda _: F.lit("{}")))
    same = (F.size(columns[0]) == F.size(columns[1])) & (F.size(columns[0]) == F.size(columns[2]))
    checked: Column = F.when(
        same,
        F.arrays_zip(*[c.alias(n) for c, n in zip(columns, ("id", "text", "metadata"))]),
    ).otherwise(F.raise_error(F.lit("ids, documents and metadatas must have the same length")))
    rows = batches.select(*keep, F.posexplode(checked).alias("pos", "row"))
    return rows.select(
        *keep, "pos", "row.id", "row.text", default_metadata(F.col("row.metadata")).alias("metadata")
    )


def batch_of(
    spark: SparkSession,
    collection_id: str,
    ids: list[str],
    documents: list[str],
    metadatas: list[dict[str, Any]] | None = None,
) -> DataFrame:
    """A batch from Python lists: (collection_id, pos, id, text, metadata)."""
    import json

    if len(ids) != len(documents) or (metadatas is not None and len(ids) != len(metadatas)):
        raise ValueError("ids, documents and metadatas must have the same length")
    texts = ["{}"] * len(ids) if metadatas is None else [json.dumps(m or {}) for m in metadatas]
    rows = [(collection_id, pos, *row) for pos, row in enumerate(zip(ids, documents, texts))]
    return spark.createDataFrame(rows, "collection_id string, pos int, id string, text string, metadata string")
