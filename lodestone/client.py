"""A collection-oriented front: create, add, query, delete, graph."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.embedding import DEFAULT_DIM, embed
from lodestone.operators.cells import RECALL
from lodestone.operators.dedup import DEFAULT_THRESHOLD
from lodestone.operators.graph import expand, identify_triples, latest_triples, neighbours
from lodestone.plans.ingest import ingest_batch
from lodestone.plans.respond import assemble_context, render_results
from lodestone.plans.search import hybrid_search
from lodestone.schema import QUERIES
from lodestone.session import equi_join, local
from lodestone.sources.batches import batch_of
from lodestone.sources.store import Store


class Client:
    """Collections below one folder, optionally of one tenant."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        tenant_id: str = "",
        dim: int = DEFAULT_DIM,
        embed_fn=None,
        entity_fn=None,
        gazetteer: DataFrame | None = None,
    ):
        self.spark = spark
        self.store = Store(spark, root)
        self.tenant_id = tenant_id
        self.dim = dim
        self.embed_fn = embed_fn
        self.entity_fn = entity_fn
        self.gazetteer = gazetteer

    def _names(self, name: str, metadata: dict[str, Any] | None = None) -> DataFrame:
        row = (self.tenant_id, name, json.dumps(metadata or {}))
        return self.spark.createDataFrame([row], "tenant_id string, name string, metadata string")

    def create_collection(self, name: str, metadata: dict[str, Any] | None = None) -> "Collection":
        """Create a collection. An existing name is returned unchanged; within a tenant it is an error."""
        if_exists = "error" if self.tenant_id else "keep"
        row = self.store.create_collections(self._names(name, metadata), if_exists).first()
        return Collection(self, name, row["collection_id"])

    def get_collection(self, name: str) -> "Collection":
        found = (
            self.store.collections()
            .where((F.col("tenant_id") == self.tenant_id) & (F.col("name") == name))
            .select("collection_id")
            .head(1)
        )
        if not found:
            raise ValueError(f"collection {name!r} does not exist")
        return Collection(self, name, found[0]["collection_id"])

    def get_or_create_collection(self, name: str, metadata: dict[str, Any] | None = None) -> "Collection":
        try:
            return self.get_collection(name)
        except ValueError:
            return self.create_collection(name, metadata)

    def list_collections(self) -> DataFrame:
        """(collection_id, name, metadata) of this tenant."""
        mine = self.store.collections().where(F.col("tenant_id") == self.tenant_id)
        return mine.select("collection_id", "name", "metadata")

    def delete_collection(self, name: str) -> None:
        self.get_collection(name)
        self.store.delete_collections(self._names(name))


class Collection:
    """One collection of a client."""

    def __init__(self, client: Client, name: str, collection_id: str):
        self.client = client
        self.spark = client.spark
        self.store = client.store
        self.name = name
        self.collection_id = collection_id

    def add(
        self,
        ids: list[str],
        documents: list[str],
        metadatas: list[dict[str, Any]] | None = None,
        deduplicate: bool = False,
        similarity_threshold: float = DEFAULT_THRESHOLD,
        extract_graph: bool = False,
    ) -> dict[str, int]:
        """Add or replace documents; returns count, skipped and triples_extracted."""
        batch = batch_of(self.spark, self.collection_id, ids, documents, metadatas)
        return self.add_rows(batch, deduplicate, similarity_threshold, extract_graph)

    def add_rows(
        self,
        rows: DataFrame,
        deduplicate: bool = False,
        similarity_threshold: float = DEFAULT_THRESHOLD,
        extract_graph: bool = False,
    ) -> dict[str, int]:
        """Add (id, text, metadata[, pos]) rows of any number."""
        summary = ingest_batch(
            self.store,
            rows.withColumn("collection_id", F.lit(self.collection_id)),
            deduplicate,
            similarity_threshold,
            extract_graph,
            self.client.embed_fn,
            self.client.entity_fn,
            self.client.dim,
            self.client.gazetteer,
        ).first()
        counts = ("count", "skipped", "triples_extracted")
        return {c: summary[c] for c in counts} if summary else dict.fromkeys(counts, 0)

    def documents(self) -> DataFrame:
        return self.store.documents(self.collection_id)

    def queries(self, texts: list[str]) -> DataFrame:
        """Query rows with vectors for a list of texts."""
        rows = [(f"{i:08d}", self.collection_id, text) for i, text in enumerate(texts)]
        return embed(self.spark.createDataFrame(rows, QUERIES), "query_text", fn=self.client.embed_fn, dim=self.client.dim)

    def build_index(self, n_cells: int | None = None, recall: float = RECALL, asked: list[str] | None = None) -> int:
        """Write the vectors by cell for approximate search; returns the number of cells.

        `asked` are typical questions, on which the number of opened cells is calibrated.
        """
        typical = self.queries(asked) if asked else None
        return len(self.store.build_cells(self.collection_id, n_cells, recall, typical).centres)

    def search(
        self,
        queries: DataFrame,
        n_results: int = 10,
        where: dict[str, Any] | None = None,
        approximate: bool = False,
        n_probe: int | None = None,
        **options,
    ) -> DataFrame:
        """Hybrid search for a frame of queries (q_id, collection_id, query_text, embedding).

        `approximate` looks for vectors in the nearest cells of the stored index. A filter that applies first
        (`filter_mode="pre"`) leaves few documents in a cell, so its vector leg stays exact.
        """
        store = self.store.snapshot()
        if approximate and options.get("filter_mode", "post") == "post":
            options["vector_leg"] = lambda _, asked, k: store.nearest_stored(self.collection_id, asked, k, n_probe)
        return hybrid_search(
            store.documents(self.collection_id), queries, n_results, where, index=store.keyword_index(), **options
        )

    def query(
        self, query_texts: list[str], n_results: int = 10, where: dict[str, Any] | None = None, **options
    ) -> dict[str, list[list[Any]]]:
        """Four lists with one inner list per text; `distances` holds fused scores, higher is better."""
        queries = local(self.queries(query_texts))
        found: list[list[Any]] = [[] for _ in query_texts]
        for row in self.search(queries, n_results, where, **options).collect():
            found[int(row["q_id"])].append(row)
        ranked = [sorted(rows, key=lambda r: r["rank"]) for rows in found]
        return {
            "ids": [[r["id"] for r in rows] for rows in ranked],
            "documents": [[r["text"] for r in rows] for rows in ranked],
            "metadatas": [[json.loads(r["metadata"]) for r in rows] for rows in ranked],
            "distances": [[r["score"] for r in rows] for rows in ranked],
        }

    def context(self, query_texts: list[str], n_results: int = 5, where: dict[str, Any] | None = None) -> DataFrame:
        """(q_id, context): hits as one prompt text per query."""
        return assemble_context(self.search(self.queries(query_texts), n_results, where))

    def render(self, query_texts: list[str], n_results: int = 5, where: dict[str, Any] | None = None) -> DataFrame:
        """(q_id, rendered): hits as readable text per query."""
        return render_results(self.search(self.queries(query_texts), n_results, where))

    def delete(self, ids: list[str]) -> None:
        keys = self.spark.createDataFrame([(self.collection_id, i) for i in ids], "collection_id string, id string")
        self.store.delete_documents(keys)

    def add_triples(self, triples: list[dict[str, Any]]) -> int:
        """Add or replace edges given as subject, predicate, object, doc_id and weight."""
        rows = [
            (self.collection_id, pos, t["subject"], t["predicate"], t["object"], t.get("doc_id"), t.get("weight"))
            for pos, t in enumerate(triples)
        ]
        layout = (
            "collection_id string, pos int, subject string, predicate string, object string, "
            "document_id string, weight double"
        )
        self.store.add_triples(identify_triples(self.spark.createDataFrame(rows, layout)))
        return len(rows)

    def _entities(self, entities: list[str]) -> DataFrame:
        rows = [("0", self.collection_id, e) for e in entities]
        return self.spark.createDataFrame(rows, "q_id string, collection_id string, entity string")

    def query_graph(self, entities: list[str], hops: int = 1) -> DataFrame:
        """(subject, predicate, object, weight) of edges at the entities, or within several hops."""
        log = self.store.edge_log(self.collection_id)
        wanted = self._entities(entities)
        # Every write of an edge has its ends, so edges are found first and only their last writes looked for.
        if hops == 1:
            near = log.where(F.col("subject").isin(entities) | F.col("object").isin(entities))
            found = neighbours(latest_triples(near), wanted)
        else:
            reached = expand(log, wanted, hops).select("triple_id").distinct()
            found = latest_triples(equi_join(log, reached, ["triple_id"], "left_semi", spread=["seq"]))
        return found.select("subject", "predicate", "object", "weight")
