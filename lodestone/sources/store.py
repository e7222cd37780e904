"""The durable store: Parquet batches made visible by a commit row.

Every change writes its rows to `<table>/batch=<n>/attempt=<id>` and then one row
to `commits/batch=<n>`, which names the attempt. Readers only open committed
attempts, so documents, postings and edges of a batch appear together or not at
all, and no attempt writes over the files of another. `compact` writes everything
that is live as one batch and drops the earlier ones from view. One writer at
a time.

An index of vectors is a batch of its own: `cells` holds the vectors by cell,
`cell_maps` one row with the centres. Documents of later batches are its tail.
"""

from __future__ import annotations

import uuid
from copy import copy

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import schema
from lodestone.operators import cells, mutate, registry
from lodestone.operators.graph import latest_triples
from lodestone.operators.keyword import KeywordIndex, build_postings, corpus_stats
from lodestone.operators.vector import vector_topk
from lodestone.session import cut_lineage, equi_join, local, shuffles_dropped, spread

_COMMITS = T.StructType(
    [
        T.StructField("batch", T.LongType()),
        T.StructField("snapshot", T.BooleanType()),
        T.StructField("attempt", T.StringType()),
        T.StructField("tables", T.ArrayType(T.StringType())),
    ]
)

TABLES = {
    "collections": schema.COLLECTIONS,
    "documents": schema.DOCUMENTS,
    "postings": T.StructType([*schema.POSTINGS.fields, T.StructField("seq", T.LongType())]),
    "triples": schema.TRIPLES,
}
INDEX_TABLES = {"cells": schema.CELLS, "cell_maps": schema.CELL_MAPS}


class Store:
    """Collections, documents, postings and edges below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._attempts: dict[int, str] = {}
        self._pinned: list | None = None
        # What was found out for the newest commit; snapshots share it.
        self._known: dict = {}

    # Batches ---------------------------------------------------------------

    def _commits(self) -> list:
        """Visible commits; their number is bounded by compaction."""
        if self._pinned is not None:
            return self._pinned
        try:
            rows = self.spark.read.schema(_COMMITS).parquet(f"{self.root}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        # Commits before the last snapshot are never collected.
        start = rows.agg(F.max(F.when(F.col("snapshot"), F.col("batch")))).first()[0]
        if start is not None:
            rows = rows.where(F.col("batch") >= start)
        return sorted(rows.collect(), key=lambda r: r["batch"])

    def snapshot(self) -> "Store":
        """This store as of now, to read from: later commits stay out, and the commits are read once."""
        view = copy(self)
        view._pinned = self._commits()
        return view

    def _remember(self, key, make):
        """What `make` returns, kept until the next commit."""
        last = self._last_batch()
        if (last, key) not in self._known:
            for old in [k for k in self._known if k[0] != last]:
                del self._known[old]
            self._known[last, key] = make()
        return self._known[last, key]

    def _last_batch(self) -> int:
        commits = self._commits()
        return commits[-1]["batch"] if commits else 0

    def next_batch(self) -> int:
        """The number of a new batch; what an earlier attempt has written under it is left behind."""
        batch = self._last_batch() + 1
        self._attempts.pop(batch, None)
        return batch

    def path(self, table: str, batch: int, attempt: str | None = None) -> str:
        """The folder of one attempt to write a batch; no other attempt writes there."""
        attempt = attempt or self._attempts.setdefault(batch, uuid.uuid4().hex)
        return f"{self.root}/{table}/batch={batch}/attempt={attempt}"

    def write(self, table: str, batch: int, rows: DataFrame) -> None:
        """Write the rows of one table; invisible until the batch is committed.

        Shuffle files go when it is written. Rebalancing splits a hot collection or term over several files, and
        sorted postings let a search skip the row groups of other terms.
        """
        rows = rows.select(*_layout(table).fieldNames())
        folders = ["collection_id"] if table != "collections" else []
        if table == "cell_maps":
            rows, folders = rows.coalesce(1), []
        elif table == "cells":
            # A large cell becomes several files, small ones share a task.
            folders = ["collection_id", "cell"]
            rows = rows.hint("rebalance", *folders)
        elif table == "postings":
            rows = rows.hint("rebalance", "collection_id", "term").sortWithinPartitions("collection_id", "term", "id")
        else:
            rows = rows.hint("rebalance", "collection_id")
        if table == "documents":
            # Sorted by id, so that reading a few documents skips the row groups of the others.
            rows = rows.sortWithinPartitions("collection_id", "id")
        writer = rows.write.option("compression", "zstd")
        with shuffles_dropped(self.spark):
            (writer.partitionBy(*folders) if folders else writer).parquet(self.path(table, batch))

    def commit(self, batch: int, tables: list[str], snapshot: bool = False) -> None:
        """Make a batch visible; fails where another writer has committed the same number."""
        attempt = self._attempts.pop(batch, None)
        row = self.spark.createDataFrame([(batch, snapshot, attempt, tables)], _COMMITS).coalesce(1)
        row.drop("batch").write.mode("errorifexists").parquet(f"{self.root}/commits/batch={batch}")

    def read_batch(self, table: str, batch: int) -> DataFrame:
        return self.spark.read.schema(_layout(table)).parquet(self.path(table, batch))

    def log(self, table: str, after: int = 0, only: int | None = None) -> DataFrame:
        """All committed rows of a table: those of all batches, of batches after one, or of one."""
        commits = self._commits()
        paths = [
            self.path(table, c["batch"], c["attempt"])
            for c in commits
            if table in c["tables"] and c["batch"] > after and only in (None, c["batch"])
        ]
        if not paths:
            return self.spark.createDataFrame([], _layout(table))

        def read():
            rows = self.spark.read.schema(_layout(table)).option("basePath", f"{self.root}/{table}").parquet(*paths)
            return rows.select(*_layout(table).fieldNames())

        # The files are listed once per commit.
        return self._remember(("log", table, after, only), read)

    # Views -----------------------------------------------------------------

    def collections(self) -> DataFrame:
        return registry.current_collections(self.log("collections"))

    def _missing(self) -> tuple[DataFrame | None, DataFrame | None]:
        """Replaced or deleted versions, and deleted collections; None where there are none.

        Found from the keys alone and kept until the next commit, so that
        texts and vectors are never shuffled to find the latest ones.
        """

        def find():
            view = self.snapshot()
            found = [
                cut_lineage(mutate.stale_versions(view.log("documents"))),
                cut_lineage(registry.deleted_collections(view.log("collections"))),
            ]
            return tuple(None if rows.isEmpty() else rows for rows in found)

        return self._remember("missing", find)

    def _current(self, rows: DataFrame, spread_by: str) -> DataFrame:
        stale, _ = self._missing()
        if stale is None:
            return rows
        return equi_join(rows, stale, ["collection_id", "id", "seq"], "left_anti", spread=["id", spread_by])

    def _live(self, rows: DataFrame, spread_by: str) -> DataFrame:
        _, dead = self._missing()
        return rows if dead is None else equi_join(rows, dead, ["collection_id"], "left_anti", spread=[spread_by])

    def documents(self, collection_id: str | None = None) -> DataFrame:
        """Latest documents; one collection reads only its own folders."""
        rows = self.log("documents").where(F.col("op") == "upsert")
        if collection_id is not None:
            rows = rows.where(F.col("collection_id") == collection_id)
        return self._live(self._current(rows, "seq"), "id")

    def keyword_index(self) -> KeywordIndex:
        """Postings and lengths of the latest documents of all live collections."""
        rows = self._live(self._current(self.log("postings"), "term"), "id").drop("seq")
        # The empty term carries the length, so a document without words counts as well.
        words = rows.where(F.col("term") != "")
        lengths = rows.where(F.col("term") == "").select("collection_id", "id", "dl")
        # One row, counted once per commit.
        corpus = self._remember("corpus", lambda: local(corpus_stats(lengths)))
        return KeywordIndex(words, lengths, corpus)

    # Index of vectors ------------------------------------------------------

    def cell_map(self, collection_id: str) -> tuple[int, cells.CellMap] | None:
        """Batch and cells of the newest index of a collection; None where there is none."""

        def find():
            maps = self.log("cell_maps").where(F.col("collection_id") == collection_id)
            found = maps.orderBy(F.desc("batch_no")).limit(1).toArrow().to_pylist()
            if not found:
                return None
            row = found[0]
            centres = np.array(row["centres"], dtype=np.float64).reshape(-1, max(1, row["dim"]))
            return row["batch_no"], cells.CellMap(centres, row["n_probe"], row["n_docs"])

        return self._remember(("cells", collection_id), find)

    def build_cells(
        self,
        collection_id: str,
        n_cells: int | None = None,
        recall: float = cells.RECALL,
        asked: DataFrame | None = None,
    ) -> cells.CellMap:
        """Train cells on a bounded sample of a collection and write all its vectors by cell.

        `asked` (q_id, embedding) are questions like those to come: the number of opened cells is calibrated on
        them, which matters where questions do not resemble the documents.
        """
        batch = self.next_batch()
        docs = self.documents(collection_id).where(F.col("embedding").isNotNull())
        n_docs = docs.count()
        wanted = n_cells or cells.cells_for(n_docs)
        sample = cells.sample_vectors(docs, n_docs, min(cells.SAMPLE_ROWS, cells.ROWS_PER_CELL * wanted))
        typical = None if asked is None else cells.sample_vectors(asked, asked.count(), cells.ASKED, "q_id")
        made = cells.train(sample, wanted, recall, typical)
        made.n_docs = n_docs
        if n_docs:
            self.write("cells", batch, cells.with_cell(docs, made))
        flat = [float(x) for x in made.centres.ravel()]
        row = (collection_id, batch, made.n_probe, n_docs, made.centres.shape[1], flat)
        self.write("cell_maps", batch, self.spark.createDataFrame([row], schema.CELL_MAPS))
        self.commit(batch, ["cells", "cell_maps"] if n_docs else ["cell_maps"])
        return made

    def indexed_vectors(self, collection_id: str, batch: int) -> tuple[DataFrame, DataFrame | None]:
        """Latest vectors by cell, and those written after the index."""
        held = self.log("cells", only=batch).where(F.col("collection_id") == collection_id)
        late = None
        if any("documents" in c["tables"] and c["batch"] > batch for c in self._commits()):
            late = self.log("documents", after=batch).where((F.col("op") == "upsert") & (F.col("collection_id") == collection_id))
            late = self._live(self._current(late, "seq"), "id")
        return self._live(self._current(held, "seq"), "id"), late

    def nearest_stored(
        self, collection_id: str, queries: DataFrame, k: int, n_probe: int | None = None, **limits
    ) -> DataFrame:
        """The k nearest documents in the index of one collection; exact where it has no index."""
        queries = queries.where(F.col("collection_id") == collection_id)
        view = self.snapshot()
        found = view.cell_map(collection_id)
        if found is None:
            return vector_topk(view.documents(collection_id), queries, k, **limits)
        held, late = view.indexed_vectors(collection_id, found[0])
        return cells.search_cells(held, late, found[1], queries, k, n_probe, **limits)

    def triples(self, collection_id: str | None = None) -> DataFrame:
        return latest_triples(self.edge_log(collection_id))

    def edge_log(self, collection_id: str | None = None) -> DataFrame:
        """All writes of edges; whoever asks for some edges filters here, before `latest_triples`."""
        log = self.log("triples")
        if collection_id is not None:
            log = log.where(F.col("collection_id") == collection_id)
        return self._live(log, "triple_id")

    # Changes ---------------------------------------------------------------

    def create_collections(self, wanted: DataFrame, if_exists: str = "keep") -> DataFrame:
        """Create what is missing of (tenant_id, name, metadata); returns the current rows."""
        batch = self.next_batch()
        made = registry.create_collections(self.log("collections"), wanted, batch, if_exists)
        self.write("collections", batch, made)
        self.commit(batch, ["collections"])
        return registry.get_collections(self.log("collections"), wanted)

    def delete_collections(self, names: DataFrame) -> None:
        batch = self.next_batch()
        self.write("collections", batch, registry.delete_collections(self.log("collections"), names, batch))
        self.commit(batch, ["collections"])

    def delete_documents(self, keys: DataFrame) -> None:
        batch = self.next_batch()
        self.write("documents", batch, mutate.delete_rows(keys, batch))
        self.commit(batch, ["documents"])

    def add_triples(self, triples: DataFrame) -> None:
        """Append identified triples with a `pos`; the last write of an edge wins."""
        batch = self.next_batch()
        self.write("triples", batch, numbered_triples(triples, batch))
        self.commit(batch, ["triples"])

    def compact(self) -> None:
        """Write all live rows as one snapshot batch; indexes are built anew after it."""
        maps = self.log("cell_maps").select("collection_id").distinct()
        indexed = [r[0] for r in self._live(maps, "collection_id").orderBy("collection_id").toLocalIterator()]
        batch = self.next_batch()
        names = self.log("collections")
        live = self.collections().join(
            names.where(F.col("op") == "create").select("collection_id", "seq", "op"), "collection_id"
        )
        self.write("collections", batch, live)
        documents = self.documents()
        self.write("documents", batch, documents)
        self.write("triples", batch, self.triples())
        self.write("postings", batch, versioned_postings(self.read_batch("documents", batch)))
        self.commit(batch, list(TABLES), snapshot=True)
        for collection_id in indexed:
            self.build_cells(collection_id)


def _layout(table: str) -> T.StructType:
    return (TABLES | INDEX_TABLES)[table]


def numbered_triples(triples: DataFrame, batch: int) -> DataFrame:
    pos = F.col("pos").cast("long") if "pos" in triples.columns else F.lit(0).cast("long")
    return triples.withColumn("seq", F.lit(batch * mutate.BATCH_STEP) + pos)


def versioned_postings(documents: DataFrame) -> DataFrame:
    """Postings and lengths that carry the version of their document."""
    return build_postings(spread(documents), ("seq",), with_lengths=True)
