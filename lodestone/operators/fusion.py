"""Reciprocal rank fusion of a vector leg and a keyword leg."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value of the fusion formula.
RRF_K = 60

_HIT = ["q_id", "collection_id", "id"]


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """(q_id, collection_id, id, vec_rank, kw_rank, source, score) of all hits.

    Each leg holds (q_id, collection_id, id, rank). The score adds
    1 / (60 + rank) over the legs a document is in.
    """
    legs = vector_hits.select(*_HIT, F.col("rank").alias("vec_rank"), F.lit(None).cast("int").alias("kw_rank")).unionByName(
        keyword_hits.select(*_HIT, F.lit(None).cast("int").alias("vec_rank"), F.col("rank").alias("kw_rank"))
    )
    merged = legs.groupBy(*_HIT).agg(F.min("vec_rank").alias("vec_rank"), F.min("kw_rank").alias("kw_rank"))
    in_vector, in_keyword = F.col("vec_rank").isNotNull(), F.col("kw_rank").isNotNull()

    def part(rank: str):
        return F.coalesce(1.0 / (RRF_K + F.col(rank)), F.lit(0.0))

    return merged.withColumn("source", F.when(in_vector & in_keyword, "both").when(in_vector, "vector").otherwise("keyword")).withColumn(
        "score", part("vec_rank") + part("kw_rank")
    )


def fused_topk(fused: DataFrame, k: int) -> DataFrame:
    """The best k per query; equal scores keep vector order, then keyword order."""
    best = Window.partitionBy("q_id").orderBy(
        F.desc("score"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("kw_rank"), "id"
    )
    return fused.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def keyword_only(vector_hits: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """Keyword hits that are no vector hits of the same query."""
    return keyword_hits.join(vector_hits.select(*_HIT), _HIT, "left_anti")
