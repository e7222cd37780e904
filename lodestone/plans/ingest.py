"""Ingest: one batch of documents through vectors, duplicate check, graph and text index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.embedding import DEFAULT_DIM, embed
from lodestone.functions.keys import uuid5
from lodestone.functions.text import chunk_text
from lodestone.operators import mutate
from lodestone.operators.dedup import DEFAULT_THRESHOLD, drop_near_duplicates, ingest_summary
from lodestone.operators.graph import cooccurrence_triples, extract_entities, gazetteer_entities, identify_triples
from lodestone.session import cut_lineage, discard, small_batches
from lodestone.sources.store import Store, versioned_postings


def ingest_batch(
    store: Store,
    batch: DataFrame,
    deduplicate: bool = False,
    similarity_threshold: float = DEFAULT_THRESHOLD,
    extract_graph: bool = False,
    embed_fn: Callable[[Column], Column] | None = None,
    entity_fn: Callable[[Column], Column] | None = None,
    dim: int = DEFAULT_DIM,
    gazetteer: DataFrame | None = None,
) -> DataFrame:
    """Add (collection_id, id, text, metadata, pos) rows; returns the summary per collection.

    Edges join the entities that `entity_fn` finds, or the names of `gazetteer` (text, label), or else runs of
    capitalised words.

    The summary has count, skipped and triples_extracted. Vectors, documents,
    postings and edges become visible together when the batch is committed.
    """
    with small_batches(store.spark):
        number = store.next_batch()
        # Written once: a model runs over every text only once.
        incoming = cut_lineage(embed(batch, fn=embed_fn, dim=dim))
        kept = incoming
        if deduplicate:
            # The found duplicates are written, not a second copy of all others.
            kept = drop_near_duplicates(incoming, store.documents(), similarity_threshold)
        store.write("documents", number, mutate.upsert_rows(mutate.collapse_batch(kept), number))
        summary = cut_lineage(ingest_summary(incoming, kept))
        # Everything else starts from the documents that were written.
        discard(incoming)
        written = store.read_batch("documents", number)
        tables = ["documents", "postings"]
        store.write("postings", number, versioned_postings(written))
        if extract_graph:
            # Edges carry the number of their document: of equal edges the last document's stays.
            if gazetteer is not None and entity_fn is None:
                mentions = gazetteer_entities(written, gazetteer, keep=("seq",))
            else:
                mentions = extract_entities(written, entity_fn, ("seq",))
            edges = cooccurrence_triples(mentions, ("seq",))
            store.write("triples", number, identify_triples(edges))
            tables.append("triples")
            extracted = store.read_batch("triples", number).groupBy("collection_id").agg(
                F.count(F.lit(1)).alias("triples_extracted")
            )
            summary = summary.join(extracted, "collection_id", "left")
        else:
            summary = summary.withColumn("triples_extracted", F.lit(0).cast("long"))
    store.commit(number, tables)
    return summary.withColumn("triples_extracted", F.coalesce("triples_extracted", F.lit(0)))


def chunk_rows(files: DataFrame) -> DataFrame:
    """(id, pos, text, metadata) for every chunk of (source, text) rows.

    The metadata names the source and the number of the chunk. The id derives from
    the number and the file's whole path (the source where there is no `path`), so a
    retried task writes the same id and files of one name do not meet.
    """
    path = F.col("path") if "path" in files.columns else F.col("source")
    pieces = files.select("source", path.alias("path"), F.posexplode(chunk_text(F.col("text"))).alias("pos", "text"))
    metadata = F.to_json(F.struct(F.col("source"), F.col("pos").alias("chunk")))
    return pieces.select(
        uuid5(F.concat_ws("#", F.col("path"), F.col("pos"))).alias("id"), "pos", "text", metadata.alias("metadata")
    )


def ingest_files(store: Store, files: DataFrame, collection_id: str, **options) -> DataFrame:
    """Chunk (source, text) rows and add the chunks, with duplicate check and graph."""
    batch = chunk_rows(files).withColumn("collection_id", F.lit(collection_id))
    return ingest_batch(store, batch, **{"deduplicate": True, "extract_graph": True, **options})
