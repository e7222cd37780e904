"""The given tables in the shapes the operators take."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.embedding import embed
from lodestone.operators.graph import identify_triples
from lodestone.session import spread

#: Length of the hashed text vectors of the workload.
DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark, sf_dir, collection=None) -> DataFrame:
    """embeddings as documents: one collection, or one per `collection` column."""
    home = F.lit("all") if collection is None else F.col(collection).cast("string")
    return table(spark, sf_dir, "embeddings").select(
        home.alias("collection_id"), F.col("vec_id").cast("string").alias("id"), "embedding", "label"
    )


def as_queries(documents: DataFrame) -> DataFrame:
    return documents.select("collection_id", F.col("id").alias("q_id"), "embedding")


def labelled(spark, sf_dir) -> DataFrame:
    """documents with quality and toxic where labels have them."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def documents(spark, sf_dir, collection=None) -> DataFrame:
    """documents as (collection_id, id, text, metadata), metadata as JSON without missing keys."""
    home = F.lit("docs") if collection is None else F.col(collection)
    keys = F.struct("lang", "source", "n_chars", "quality", "toxic")
    rows = spread(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select(
        home.alias("collection_id"), F.col("doc_id").cast("string").alias("id"), "text", F.to_json(keys).alias("metadata")
    )


def embedded(spark, sf_dir, collection=None) -> DataFrame:
    return embed(documents(spark, sf_dir, collection), dim=DIM)


def questions(spark, sf_dir) -> DataFrame:
    """benchmark texts as queries against the one collection, with hashed vectors."""
    rows = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("q_id"), F.lit("docs").alias("collection_id"), F.col("text").alias("query_text")
    )
    return embed(rows, "query_text", dim=DIM)


def questions_per_language(spark, sf_dir) -> DataFrame:
    """Every benchmark text asked in the collection of every language."""
    rows = asked_of(spark, sf_dir, "lang")
    rows = rows.withColumn("q_id", F.concat_ws(":", "collection_id", "item_id"))
    return embed(rows.select("q_id", "collection_id", "query_text"), "query_text", dim=DIM)


def asked_of(spark, sf_dir, collection) -> DataFrame:
    """(collection_id, item_id, query_text): every benchmark text with every value of a documents column.

    The values go round as one array per item: a stated set of questions, not a join of tables.
    """
    values = table(spark, sf_dir, "documents").where(F.col(collection).isNotNull()).select(collection).distinct()
    names = [r[0] for r in values.orderBy(collection).collect()]
    homes = F.explode(F.array(*[F.lit(x) for x in names])).alias("collection_id")
    return table(spark, sf_dir, "benchmark").select(homes, "item_id", F.col("text").alias("query_text"))


def star_triples(spark, sf_dir) -> DataFrame:
    """The star schema as edges of one collection."""

    def node(kind: str, key: str):
        return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))

    def edges(name, subject, predicate, obj):
        rows = spread(table(spark, sf_dir, name))
        return rows.select(
            F.lit("star").alias("collection_id"), node(*subject).alias("subject"), F.lit(predicate).alias("predicate"), node(*obj).alias("object")
        )

    parts = [
        edges("customer", ("customer", "c_custkey"), "in_nation", ("nation", "c_nationkey")),
        edges("supplier", ("supplier", "s_suppkey"), "in_nation", ("nation", "s_nationkey")),
        edges("nation", ("nation", "n_nationkey"), "in_region", ("region", "n_regionkey")),
        edges("orders", ("customer", "o_custkey"), "placed", ("order", "o_orderkey")),
        edges("lineitem", ("order", "l_orderkey"), "contains", ("part", "l_partkey")).distinct(),
    ]
    return identify_triples(reduce(DataFrame.unionByName, parts))
