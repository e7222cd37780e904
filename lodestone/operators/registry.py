"""The collection registry: a log of create and delete rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.keys import uuid5
from lodestone.functions.metadata import default_metadata
from lodestone.session import equi_join

_NAME = ["tenant_id", "name"]
_COLUMNS = ["collection_id", "tenant_id", "name", "metadata", "seq", "op"]


def current_collections(registry: DataFrame) -> DataFrame:
    """(collection_id, tenant_id, name, metadata) of collections that exist now."""
    last = registry.groupBy(*_NAME).agg(F.max(F.struct("seq", "collection_id", "metadata", "op")).alias("last"))
    return last.where(F.col("last.op") == "create").select("last.collection_id", *_NAME, "last.metadata")


def create_collections(registry: DataFrame, wanted: DataFrame, seq: int, if_exists: str = "keep") -> DataFrame:
    """Registry rows for the wanted (tenant_id, name, metadata) that do not exist.

    A name that exists keeps its row and its metadata; `if_exists="error"`
    raises instead; of several metadata for one new name the least is kept.
    Ids are derived from a list of tenant, name and sequence number, so a
    retried task writes the same id and a collection made anew gets another.
    """
    names = wanted.groupBy(*_NAME).agg(F.min("metadata").alias("metadata"))
    existing = current_collections(registry).select(*_NAME)
    if if_exists == "error":
        clash = names.join(existing, _NAME, "left_semi").select("name").head(1)
        if clash:
            raise ValueError(f"collection {clash[0]['name']!r} already exists")
    elif if_exists != "keep":
        raise ValueError(f"unknown if_exists {if_exists!r}")
    made = names.join(existing, _NAME, "left_anti")
    return made.select(
        uuid5(F.to_json(F.array("tenant_id", "name", F.lit(str(seq))))).alias("collection_id"),
        *_NAME,
        default_metadata(F.col("metadata")).alias("metadata"),
        F.lit(seq).cast("long").alias("seq"),
        F.lit("create").alias("op"),
    )


def get_collections(registry: DataFrame, names: DataFrame) -> DataFrame:
    """Existing collections among the given (tenant_id, name)."""
    return equi_join(current_collections(registry), names.select(*_NAME).distinct(), _NAME, "left_semi")


def delete_collections(registry: DataFrame, names: DataFrame, seq: int) -> DataFrame:
    """Registry rows that mark the named collections as deleted."""
    gone = get_collections(registry, names)
    return gone.withColumns({"seq": F.lit(seq).cast("long"), "op": F.lit("delete")}).select(*_COLUMNS)


def deleted_collections(registry: DataFrame) -> DataFrame:
    """(collection_id) of every collection that was deleted."""
    return registry.where(F.col("op") == "delete").select("collection_id").distinct()


def in_live_collections(rows: DataFrame, registry: DataFrame, spread: str) -> DataFrame:
    """Rows whose collection exists: documents, postings and edges of deleted ones disappear."""
    live = current_collections(registry).select("collection_id")
    return equi_join(rows, live, ["collection_id"], "left_semi", spread=[spread])


def tenant_collections(registry: DataFrame, tenant_id: str) -> DataFrame:
    """Collections of one tenant."""
    return current_collections(registry).where(F.col("tenant_id") == tenant_id)


def scoped_name(tenant_id: Column, name: Column) -> Column:
    """Name of a tenant's collection in a registry without a tenant column."""
    return F.concat(tenant_id, F.lit("_"), name)


def unscope_names(collections: DataFrame, tenant_id: str) -> DataFrame:
    """Collections whose name starts with the tenant's prefix, prefix removed."""
    prefix = f"{tenant_id}_"
    return collections.where(F.startswith(F.col("name"), F.lit(prefix))).withColumn(
        "name", F.expr(f"substring(name, {len(prefix) + 1})")
    )
