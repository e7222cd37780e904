"""Vector, keyword and hybrid search over many queries at once.

`docs` holds collection_id, id, text, metadata and embedding, `queries` holds
q_id, collection_id, query_text and embedding. A query only sees the documents
of its own collection.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.metadata import decode_metadata
from lodestone.functions.where import Fields, VariantFields, compile_equality, compile_where
from lodestone.operators.fusion import fuse, fused_topk
from lodestone.operators.keyword import KeywordIndex, keyword_topk
from lodestone.operators.lookup import hydrate
from lodestone.operators.vector import vector_topk
from lodestone.session import BROADCAST_ROWS, fits

Where = dict[str, Any] | None
VectorLeg = Callable[[DataFrame, DataFrame, int], DataFrame]

_KEY = ["q_id", "collection_id", "id"]


def metadata_fields() -> Fields:
    """Keys of the JSON column `metadata`."""
    return VariantFields(decode_metadata(F.col("metadata")))


def _renumber(hits: DataFrame, k: int) -> DataFrame:
    """Close the gaps a filter left in the ranks and keep the first k."""
    order = Window.partitionBy("q_id").orderBy("_rank")
    numbered = hits.withColumnRenamed("rank", "_rank").withColumn("rank", F.row_number().over(order))
    return numbered.where(F.col("rank") <= k).drop("_rank")


def vector_search(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    where: Where = None,
    fields: Fields | None = None,
    columns: tuple[str, ...] = ("text", "metadata"),
    operators: bool = False,
    vector_leg: VectorLeg = vector_topk,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(q_id, collection_id, rank, id, score, ...): nearest documents, then the filter.

    With a filter 2k candidates are ranked and the first k that pass remain,
    so fewer than k may be left. The score is the squared distance. The filter
    compares each key for equality; `operators` allows the whole language.
    """
    hits = vector_leg(docs, queries, 2 * k if where else k)
    bounded = fits(queries, max_rows // (2 * k))
    rows = hydrate(hits.select(*_KEY, "rank", F.col("distance").alias("score")), docs, list(columns), bounded)
    if where:
        compiler = compile_where if operators else compile_equality
        rows = rows.where(compiler(where, fields or metadata_fields()))
    return _renumber(rows, k).select(*_KEY[:2], "rank", "id", "score", *columns)


def hybrid_search(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    where: Where = None,
    fields: Fields | None = None,
    columns: tuple[str, ...] = ("text", "metadata"),
    index: KeywordIndex | None = None,
    filter_mode: str = "post",
    vector_leg: VectorLeg = vector_topk,
    max_rows: int = BROADCAST_ROWS,
    **keyword_options,
) -> DataFrame:
    """(q_id, collection_id, rank, id, score, source, ...): both legs fused by rank.

    The vector leg gives k candidates, or 2k with a filter, the keyword leg
    2k. The fused list is cut to k and then filtered (`filter_mode="post"`),
    so fewer than k may be left; "pre" filters the documents first.
    """
    if filter_mode not in ("post", "pre"):
        raise ValueError(f"unknown filter mode {filter_mode!r}")
    index = index or KeywordIndex.of(docs)
    passing = compile_where(where, fields or metadata_fields()) if where else None
    if passing is not None and filter_mode == "pre":
        allowed = docs.where(passing)
        vector_hits = vector_leg(allowed, queries, k)
        keyword_options["only"] = allowed.select("collection_id", "id")
    else:
        vector_hits = vector_leg(docs, queries, 2 * k if where else k)
    keyword_hits = keyword_topk(index, queries, limit=2 * k, max_rows=max_rows, **keyword_options)
    best = fused_topk(fuse(vector_hits, keyword_hits), k)
    bounded = fits(queries, max_rows // (2 * k))
    rows = hydrate(best.select(*_KEY, "rank", "score", "source"), docs, list(columns), bounded)
    if passing is not None and filter_mode == "post":
        rows = rows.where(passing)
    return _renumber(rows, k).select(*_KEY[:2], "rank", "id", "score", "source", *columns)
