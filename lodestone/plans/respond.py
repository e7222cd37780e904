"""Responses: result lists, prompt context and readable text.

Everything that gathers rows gathers at most the k hits of one query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import equi_join


def _ranked(*columns: Column) -> Column:
    return F.sort_array(F.collect_list(F.struct("rank", *columns)))


def response_lists(queries: DataFrame, results: DataFrame) -> DataFrame:
    """One row per query with four aligned arrays in rank order.

    `distances` carries the score of the search: for hybrid results a higher
    value is better. Queries without hits keep empty arrays.
    """
    hits = results.groupBy("q_id").agg(
        _ranked(
            F.col("id").alias("id"), F.col("text").alias("text"), F.col("metadata").alias("metadata"), F.col("score").alias("score")
        ).alias("hits")
    )

    def column(field: str) -> Column:
        return F.coalesce(F.transform("hits", lambda h: h[field]), F.array())

    return (
        queries.select("q_id")
        .join(hits, "q_id", "left")
        .select(
            "q_id",
            column("id").alias("ids"),
            column("text").alias("documents"),
            column("metadata").alias("metadatas"),
            column("score").alias("distances"),
        )
    )


def assemble_context(results: DataFrame, source: Column | None = None) -> DataFrame:
    """(q_id, context): the hit texts in rank order, each under its source.

    The source is the `source` key of the metadata unless given as a column.
    """
    named = F.coalesce(F.get_json_object("metadata", "$.source") if source is None else source, F.lit("unknown"))
    piece = F.concat(F.lit("[Source: "), named, F.lit("]\n"), F.col("text"))
    return results.groupBy("q_id").agg(
        F.concat_ws("\n\n", F.transform(_ranked(piece.alias("piece")), lambda h: h["piece"])).alias("context")
    )


def render_results(results: DataFrame) -> DataFrame:
    """(q_id, rendered): numbered hits with score, text and metadata."""
    piece = F.format_string(
        "--- Result %d (Score: %.4f) ---\n%s\nMetadata: %s", F.col("rank"), F.col("score"), F.col("text"), F.col("metadata")
    )
    return results.groupBy("q_id").agg(
        F.concat_ws("\n\n", F.transform(_ranked(piece.alias("piece")), lambda h: h["piece"])).alias("rendered")
    )


def render_triples(entities: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(q_id, entity, part, line): one row per line of the answer about each entity.

    `entities` has q_id and entity, `neighbours` the result of a graph query
    with q_id and triple_id. The heading is part 0 and the edges are part 1; a hub entity
    may have any number of lines, so they are never joined into one string.
    """
    found = neighbours.select("q_id").distinct().withColumn("found", F.lit(True))
    heads = entities.join(found, "q_id", "left").select(
        "q_id",
        "entity",
        F.lit(0).alias("part"),
        F.when(F.col("found"), F.format_string("Knowledge about '%s':", F.col("entity")))
        .otherwise(F.format_string("No knowledge found for '%s'", F.col("entity")))
        .alias("line"),
    )
    lines = equi_join(neighbours, entities.select("q_id", "entity"), ["q_id"], spread=["triple_id"]).select(
        "q_id",
        "entity",
        F.lit(1).alias("part"),
        F.format_string("- %s %s %s", F.col("subject"), F.col("predicate"), F.col("object")).alias("line"),
    )
    return heads.unionByName(lines)
