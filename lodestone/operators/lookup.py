"""Lookups: many keys against the stored documents in one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.where import Fields, VariantFields, compile_equality
from lodestone.functions.metadata import decode_metadata
from lodestone.session import BROADCAST_ROWS, cut_lineage, equi_join, local

#: Up to this many documents are looked up by a filter on their ids.
PUSHED_IDS = 1_000


def lookup_documents(docs: DataFrame, keys: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Documents with the given (collection_id, id)."""
    wanted = keys.select("collection_id", "id").distinct()
    return equi_join(docs, wanted, ["collection_id", "id"], "left_semi", max_rows=max_rows)


def lookup_int_ids(docs: DataFrame, labels: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Documents with the given (collection_id, int_id); no labels, no rows."""
    wanted = labels.select("collection_id", "int_id").distinct()
    return equi_join(docs, wanted, ["collection_id", "int_id"], "left_semi", max_rows=max_rows)


def hydrate(hits: DataFrame, docs: DataFrame, columns: list[str], bounded: bool = False) -> DataFrame:
    """Add document columns to ranked hits; hits without a document drop out.

    The hits are the small side: wide columns are read only here, after the
    top-k cut. `bounded` tells that the hits are known to fit a broadcast; they
    are found first, and up to `PUSHED_IDS` ids become a filter of the scan.
    Otherwise each wanted document is fetched once, and the hits are spread by
    query, so that a document wanted by many queries is no hot key.
    """
    key = ["collection_id", "id"]
    wide = docs.select(*key, *columns)
    if bounded:
        hits = local(hits)
        ids = sorted({r["id"] for r in hits.select("id").collect()})
        if len(ids) <= PUSHED_IDS:
            wide = wide.where(F.col("id").isin(ids))
        return wide.join(F.broadcast(hits), key)
    hits = cut_lineage(hits)
    fetched = equi_join(wide, hits.select(*key).distinct(), key, "left_semi")
    return equi_join(hits, fetched, key, spread=["q_id"], small_fits=False)


def matching_ids(docs: DataFrame, where: dict | None, fields: Fields | None = None) -> DataFrame | None:
    """Ids of documents whose metadata equals every given value; None without a filter.

    Without `fields` the keys are read from the JSON column `metadata`.
    """
    if not where:
        return None
    fields = fields or VariantFields(decode_metadata(F.col("metadata")))
    return docs.where(compile_equality(where, fields)).select("collection_id", "id")


def collection_sizes(docs: DataFrame) -> DataFrame:
    """(collection_id, n_docs)."""
    return docs.groupBy("collection_id").agg(F.count(F.lit(1)).alias("n_docs"))
