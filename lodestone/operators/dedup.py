"""Near-duplicate skipping: new vectors against the stored ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.vector import (
    BROADCAST_QUERIES,
    _matrix,
    _positions,
    _rows,
    _stack,
    cell_index,
    choose_pivots,
    exact_distances,
    into_blocks,
    rough_distances,
    slack,
)
from lodestone.session import cut_lineage, discard, equi_join, fits

DEFAULT_THRESHOLD = 0.1
#: Pivots of the partitioned plan, and the groups of their cells at least.
CELLS, GROUPS = 256, 16
#: Numbers in the vectors of one block, but for chance; a task holds a block of either side.
BLOCK_VALUES = 2_097_152
#: New and stored vectors that are compared at once.
TILE = (512, 4096)
#: Squared norms above this are compared in doubles only.
_LARGE = 1e30


def _close_to_any(new: np.ndarray, stored: np.ndarray, threshold: float) -> np.ndarray:
    """For each new vector: is some stored vector within the threshold?"""
    hit = np.zeros(len(new), dtype=bool)
    if not len(new) or not len(stored):
        return hit
    # Single floats screen a tile with one product, as -distance / 2; doubles decide on the rows that pass.
    halves = [(x * x).sum(axis=1) / 2.0 for x in (new, stored)]
    largest = halves[1].max()
    screens = largest < _LARGE and new.shape[1] == stored.shape[1]
    if screens:
        held = np.column_stack((stored, -halves[1], np.full(len(stored), -1.0))).astype(np.float32)
    for at in range(0, len(new), TILE[0]):
        rows = np.arange(at, min(at + TILE[0], len(new)))
        half = halves[0][rows]
        if screens and (half < _LARGE).all():
            asked = np.column_stack((new[rows], np.ones(len(rows)), half)).astype(np.float32)
            off = 4.0 * np.finfo(np.float32).eps * (new.shape[1] + 8) * (half + largest) + 1e-30
            least = np.nextafter((-threshold / 2.0 - off).astype(np.float32), np.float32(-np.inf))[:, None]
        else:
            asked = None
        for start in range(0, len(stored), TILE[1]):
            near = np.flatnonzero(~hit[rows])
            if asked is not None:
                near = near[(asked[near] @ held[start : start + TILE[1]].T >= least[near]).any(axis=1)]
            if len(near):
                hit[rows[near]] = _close(new[rows[near]], stored[start : start + TILE[1]], threshold)
    return hit


def _close(new: np.ndarray, stored: np.ndarray, threshold: float) -> np.ndarray:
    rough, off = rough_distances(new, stored), slack(new, stored)
    sure = (rough < threshold - off).any(axis=1)
    qi, di = np.nonzero((rough <= threshold + off) & ~sure[:, None])
    edge = np.zeros(len(new), dtype=bool)
    if len(qi):
        edge[qi[exact_distances(new[qi], stored[di]) <= threshold]] = True
    return sure | edge


def near_duplicates(new: DataFrame, store: DataFrame, threshold: float = DEFAULT_THRESHOLD, **limits) -> DataFrame:
    """Rows of `new` that have a stored vector of their collection within the threshold."""
    return _split(new, store, threshold, "left_semi", **limits)


def drop_near_duplicates(new: DataFrame, store: DataFrame, threshold: float = DEFAULT_THRESHOLD, **limits) -> DataFrame:
    """Rows of `new` to keep. New rows are compared with the store, not with each other."""
    return _split(new, store, threshold, "left_anti", **limits)


def _split(
    new: DataFrame,
    store: DataFrame,
    threshold: float,
    how: str,
    max_new: int = BROADCAST_QUERIES,
    n_cells: int = CELLS,
) -> DataFrame:
    store = store.select("collection_id", "id", "embedding").where(F.col("embedding").isNotNull())
    # Copies of a vector share their fate, whatever their ids: each distinct vector is compared once, under a key
    # made from two hashes of its values.
    key = F.concat_ws(":", F.xxhash64("embedding").cast("string"), F.hash("embedding").cast("string"))
    keyed = new.withColumn("_vector", F.when(F.col("embedding").isNotNull(), key))
    vectors = keyed.where(F.col("_vector").isNotNull()).select("collection_id", F.col("_vector").alias("id"), "embedding")
    vectors = vectors.dropDuplicates(["collection_id", "id"])
    if fits(new, max_new):
        # Written, so that whoever reads the kept rows twice searches once.
        hits = cut_lineage(_scan_hits(vectors, store, threshold)).withColumnRenamed("id", "_vector")
        # At most one hit per new row, so the hits are within the bound as well.
        return keyed.join(F.broadcast(hits), ["collection_id", "_vector"], how).select(*new.columns)
    vectors = cut_lineage(vectors)
    hits = _cell_hits(vectors, store, threshold, n_cells).withColumnRenamed("id", "_vector")
    discard(vectors)
    return equi_join(keyed, hits, ["collection_id", "_vector"], how, spread=["id"]).select(*new.columns)


def _hit_schema(new: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(c, new.schema[c].dataType) for c in ("collection_id", "id")])


def _scan_hits(new: DataFrame, store: DataFrame, threshold: float) -> DataFrame:
    """A bounded batch is broadcast; each partition of the store reports which rows it matches."""
    schema = _hit_schema(new)
    table = new.select("collection_id", "id", "embedding").where(F.col("embedding").isNotNull()).toArrow()
    if table.num_rows == 0:
        return new.sparkSession.createDataFrame([], schema)
    keys = table.select(["collection_id", "id"]).to_pandas()
    asked = {group: (rows, _rows(table["embedding"], rows)) for group, rows in _positions(keys[["collection_id"]]).items()}
    shipped = new.sparkSession.sparkContext.broadcast((keys, asked))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, asked = shipped.value
        hit = np.zeros(len(keys), dtype=bool)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for group, rows in _positions(batch.select(["collection_id"]).to_pandas()).items():
                if group not in asked:
                    continue
                places, matrix = asked[group]
                is_open = ~hit[places]
                if is_open.any():
                    stored = _rows(batch.column("embedding"), rows)
                    hit[places[is_open]] = _close_to_any(matrix[is_open], stored, threshold)
        if hit.any():
            yield pa.RecordBatch.from_pandas(keys[hit], preserve_index=False)

    return store.mapInArrow(scan, schema).distinct()


def _cell_hits(new: DataFrame, store: DataFrame, threshold: float, n_cells: int) -> DataFrame:
    """A large batch meets the store cell by cell; the hits are written.

    Every stored vector lies in the cell of its nearest pivot. A vector within
    distance r of x can lie in cell c only if x is within r of the half-space
    of c, that is d(x,c)^2 - d(x,own)^2 <= 2 r d(c,own); all other cells are
    skipped without losing a match. Cells beside each other form groups, which
    grow in number with the store: a vector goes out once for each group it
    can reach, not once for each cell.
    """
    pivots = choose_pivots(store, n_cells)
    if len(pivots) == 0:
        return new.sparkSession.createDataFrame([], _hit_schema(new))
    block_rows = max(1, BLOCK_VALUES // max(1, pivots.shape[1]))
    leads = pivots[: max(GROUPS, -(-store.count() // block_rows))]
    home = rough_distances(pivots, leads).argmin(axis=1)
    shipped = new.sparkSession.sparkContext.broadcast(pivots)
    radius = float(np.sqrt(max(threshold, 0.0)))

    @F.pandas_udf("array<int>")
    def reachable(vectors: pd.Series) -> pd.Series:
        centres = shipped.value
        between = np.sqrt(np.maximum(rough_distances(centres, centres), 0.0))
        out = []
        for at in range(0, len(vectors), 1024):
            block = _stack(vectors.iloc[at : at + 1024])
            distance = rough_distances(block, centres)
            own = distance.argmin(axis=1)
            excess = distance - distance[np.arange(len(own)), own][:, None]
            # The distances of centres err as well, by a root of their slack at worst.
            far = 2.0 * radius * (between[own] + np.sqrt(slack(centres, centres).max()))
            inside = excess <= far + 2.0 * slack(block, centres)
            out.extend(np.unique(home[row]).astype(np.int32) for row in inside)
        return pd.Series(out)

    probes = new.withColumn("cell", F.explode(reachable("embedding"))).withColumnRenamed("id", "q_id")
    grouped = cell_index(store, pivots).withColumn("cell", F.get(F.lit(home.tolist()), F.col("cell")).cast("int"))
    grouped, probes = cut_lineage(grouped), cut_lineage(probes)
    left, right, keys = into_blocks(grouped, probes, ["collection_id", "cell"], block_rows)
    schema = _hit_schema(new)

    def meet(doc_block: pa.Table, new_block: pa.Table) -> pa.Table:
        hit = np.zeros(new_block.num_rows, dtype=bool)
        if doc_block.num_rows and new_block.num_rows:
            sides = [_matrix(x["embedding"], x.num_rows) for x in (new_block, doc_block)]
            hit = _close_to_any(*sides, threshold)
        found = new_block.filter(pa.array(hit))
        return pa.table([found["collection_id"], found["q_id"]], names=["collection_id", "id"])

    hits = cut_lineage(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema).distinct())
    discard(grouped, probes)
    return hits


def ingest_summary(incoming: DataFrame, kept: DataFrame) -> DataFrame:
    """(collection_id, count, skipped) of one batch, one row per collection."""
    flagged = incoming.select("collection_id", F.lit(0).alias("k")).unionByName(
        kept.select("collection_id", F.lit(1).alias("k"))
    )
    return flagged.groupBy("collection_id").agg(
        F.sum("k").alias("count"), (F.count_if(F.col("k") == 0) - F.sum("k")).alias("skipped")
    )
