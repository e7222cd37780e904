"""Upserts and deletes: an append-only log and its latest view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.keys import int_id
from lodestone.functions.metadata import default_metadata
from lodestone.session import cut_lineage, equi_join

_KEY = ["collection_id", "id"]
#: Rows of one batch are numbered below this; batches count in steps of it.
BATCH_STEP = 2**40


def upsert_rows(batch: DataFrame, batch_no: int) -> DataFrame:
    """Log rows for (collection_id, id, text, metadata, embedding, pos).

    A later batch wins over an earlier one, and within a batch the higher `pos`.
    """
    pos = F.col("pos").cast("long") if "pos" in batch.columns else F.lit(0).cast("long")
    pos = F.when(pos.between(0, BATCH_STEP - 1), pos).otherwise(F.raise_error(F.lit("pos is not in 0 .. 2^40 - 1")))
    return batch.select(
        *_KEY,
        int_id(F.col("id")).alias("int_id"),
        "text",
        default_metadata(F.col("metadata")).alias("metadata"),
        "embedding",
        (F.lit(batch_no * BATCH_STEP) + pos).alias("seq"),
        F.lit("upsert").alias("op"),
    )


def delete_rows(keys: DataFrame, batch_no: int) -> DataFrame:
    """Log rows that remove the given (collection_id, id)."""
    return keys.select(
        *_KEY,
        int_id(F.col("id")).alias("int_id"),
        F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("string").alias("metadata"),
        F.lit(None).cast("array<float>").alias("embedding"),
        F.lit(batch_no * BATCH_STEP).alias("seq"),
        F.lit("delete").alias("op"),
    )


def latest_rows(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key by the `order` columns.

    A running maximum, so the versions of a hot key collapse before the
    shuffle. Ties are decided by the remaining columns.
    """
    rest = [c for c in log.columns if c not in keys and c not in order]
    last = log.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("last"))
    return last.select(*keys, "last.*").select(*log.columns)


def collapse_batch(batch: DataFrame) -> DataFrame:
    """One row per id of a batch: the one with the highest `pos`.

    The batch is read twice: repeated ids are found from the keys alone, and only their rows are shuffled.
    """
    order = ["pos"] if "pos" in batch.columns else []
    repeated = batch.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*_KEY)
    repeated = cut_lineage(repeated)
    if repeated.isEmpty():
        return batch
    nameless = F.col("collection_id").isNull() | F.col("id").isNull()
    once = equi_join(batch.where(~nameless), repeated, _KEY, "left_anti").select(*batch.columns)
    several = equi_join(batch, repeated, _KEY, "left_semi").select(*batch.columns).unionByName(batch.where(nameless))
    return once.unionByName(latest_rows(several, _KEY, order))


def latest_documents(log: DataFrame) -> DataFrame:
    """Documents as of now: last write per id, deleted ids left out."""
    return latest_rows(log, _KEY, ["seq"]).where(F.col("op") == "upsert")


def stale_versions(log: DataFrame) -> DataFrame:
    """(collection_id, id, seq) of rows a later row replaced or removed.

    Reads keys only. Versions of one id need distinct `seq`, which batches
    written through `collapse_batch` have.
    """
    versions = log.select(*_KEY, "seq", "op")
    newest = versions.groupBy(*_KEY).agg(F.max("seq").alias("last_seq"), F.max_by("op", "seq").alias("last_op"), F.count(F.lit(1)).alias("n"))
    changed = newest.where((F.col("n") > 1) | (F.col("last_op") == "delete")).drop("n")
    # The small side is unique per id; a much rewritten id is spread by its versions.
    return (
        equi_join(versions, changed, _KEY, spread=["seq"])
        .where((F.col("seq") < F.col("last_seq")) | (F.col("last_op") == "delete"))
        .select(*_KEY, "seq")
    )
