"""Stored approximate search: vectors written by cell, searched by opening a few cells.

`train` finds the centres of the cells and the number of cells a query has to
open on a bounded sample; every row is then assigned to the cell of its nearest
centre. A search ranks exactly the rows of the opened cells, and all rows that
were written after the index ("the tail", cell -1).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.vector import (
    BROADCAST_QUERIES,
    CELLS_AT_ONCE,
    _blocked_topk,
    _matrix,
    _scan_table,
    _stack,
    rough_distances,
)

#: Cells of one index at most: beyond the square of half of it cells get more rows instead of more cells.
MAX_CELLS = 4_096
#: Rows of the sample: so many for each cell, and never more than the second number.
ROWS_PER_CELL, SAMPLE_ROWS = 64, 65_536
#: Rounds of the training.
ROUNDS = 8
#: Share of the true neighbours that the calibrated number of opened cells has to find.
RECALL = 0.95
#: Sampled vectors asked to calibrate, and neighbours looked for.
ASKED, NEIGHBOURS = 512, 10
#: The cell of rows that no index holds yet.
TAIL = -1


@dataclass
class CellMap:
    """Centres of the cells (one row each) and how many of them a query opens."""

    centres: np.ndarray
    n_probe: int
    n_docs: int = 0


def cells_for(n_rows: int) -> int:
    """Cells for a collection of this size: twice its root, so cells and the centres to compare grow alike."""
    return max(1, min(MAX_CELLS, 2 * math.ceil(math.sqrt(n_rows))))


def sample_vectors(docs: DataFrame, n_rows: int, wanted: int, key: str = "id") -> np.ndarray:
    """About `wanted` of `n_rows` vectors, chosen by a hash of their keys; never more than twice as many."""
    docs = docs.where(F.col("embedding").isNotNull())
    if wanted < n_rows:
        steps = 2**31
        docs = docs.where(F.pmod(F.xxhash64(key), F.lit(steps)) < int(wanted / n_rows * steps))
    picked = docs.select("embedding").limit(2 * wanted).toArrow()
    return _matrix(picked["embedding"], picked.num_rows)


def _nearest_centres(vectors: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    """Numbers of the `count` nearest centres of each vector, nearest first."""
    out = np.empty((len(vectors), count), dtype=np.int32)
    step = max(1, CELLS_AT_ONCE // max(1, len(centres)))
    for at in range(0, len(vectors), step):
        distance = rough_distances(vectors[at : at + step], centres)
        if count == 1:
            out[at : at + step, 0] = distance.argmin(axis=1)
            continue
        near = np.argpartition(distance, count - 1, axis=1)[:, :count]
        order = np.argsort(np.take_along_axis(distance, near, axis=1), axis=1, kind="stable")
        out[at : at + step] = np.take_along_axis(near, order, axis=1)
    return out


def train(
    sample: np.ndarray, n_cells: int, recall: float = RECALL, asked: np.ndarray | None = None, seed: int = 7
) -> CellMap:
    """Centres by Lloyd's rounds on the sample, and the calibrated number of cells to open.

    `asked` are vectors like those that will be asked; without them the sample asks for itself.
    """
    distinct = np.unique(sample, axis=0)
    if len(distinct) == 0:
        return CellMap(np.zeros((0, 0)), 1)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.choice(len(distinct), min(n_cells, len(distinct)), replace=False)]
    for _ in range(ROUNDS):
        own = _nearest_centres(sample, centres, 1)[:, 0]
        order = np.argsort(own, kind="stable")
        filled, starts = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(sample[order], starts, axis=0)
        centres = centres.copy()
        # A cell without rows keeps its centre.
        centres[filled] = sums / np.bincount(own, minlength=len(centres))[filled][:, None]
    return CellMap(centres, _calibrate(sample, centres, recall, asked, rng))


def _calibrate(
    sample: np.ndarray, centres: np.ndarray, recall: float, asked: np.ndarray | None, rng: np.random.Generator
) -> int:
    """Cells to open until the asked vectors find this share of their neighbours in the sample.

    The sample is at most as dense as the collection, so its neighbours are no nearer than the real ones.
    """
    own = _nearest_centres(sample, centres, 1)[:, 0]
    itself = asked is None or len(asked) == 0
    source = sample if itself else asked
    chosen = rng.choice(len(source), min(ASKED, len(source)), replace=False)
    count = min(NEIGHBOURS, len(sample) - itself)
    if count < 1:
        return 1
    found = np.zeros(len(centres) + 1)
    step = max(1, CELLS_AT_ONCE // len(sample))
    for at in range(0, len(chosen), step):
        rows = chosen[at : at + step]
        distance = rough_distances(source[rows], sample)
        if itself:
            distance[np.arange(len(rows)), rows] = np.inf
        near = np.argpartition(distance, count - 1, axis=1)[:, :count]
        place = np.argsort(_nearest_centres(source[rows], centres, len(centres)), axis=1)
        # The place of a neighbour's cell in the query's order is the number of cells opened before it.
        found += np.bincount(np.take_along_axis(place, own[near], axis=1).ravel() + 1, minlength=len(found))
    return int(np.searchsorted(np.cumsum(found) / found.sum(), recall))


def with_cell(docs: DataFrame, cells: CellMap) -> DataFrame:
    """Add `cell`, the number of the nearest centre; rows without a vector drop out."""
    return _probed(docs, cells, 1).withColumn("cell", F.col("cells")[0]).drop("cells")


def _probed(df: DataFrame, cells: CellMap, count: int) -> DataFrame:
    shipped = df.sparkSession.sparkContext.broadcast(cells.centres)

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list(_nearest_centres(_stack(vectors), shipped.value, count)))

    return df.where(F.col("embedding").isNotNull()).withColumn("cells", nearest("embedding"))


def search_cells(
    indexed: DataFrame,
    tail: DataFrame | None,
    cells: CellMap,
    queries: DataFrame,
    k: int,
    n_probe: int | None = None,
    max_queries: int = BROADCAST_QUERIES,
) -> DataFrame:
    """(q_id, collection_id, id, distance, rank): the k nearest of the opened cells and the tail.

    `indexed` has the partition column `cell`. Up to `max_queries` pairs of a
    query and an opened cell are chosen in the driver, so that the scan leaves
    out the folders of all other cells; more pairs open about all cells and
    meet their rows in blocks. Fewer than k rows come back where the opened
    cells hold fewer; equal distances rank by id.
    """
    n_probe = min(len(cells.centres), n_probe or cells.n_probe)
    max_queries //= n_probe + 1
    columns = ["collection_id", "cell", "id", "embedding"]
    groups = ["collection_id", "cell"]
    queries = queries.select("collection_id", "q_id", "embedding").where(F.col("embedding").isNotNull())

    def rows(opened: DataFrame) -> DataFrame:
        opened = opened.select(*columns)
        if tail is None:
            return opened
        late = tail.where(F.col("embedding").isNotNull()).withColumn("cell", F.lit(TAIL))
        return opened.unionByName(late.select(*columns))

    asked = queries.limit(max_queries + 1).toArrow()
    if asked.num_rows <= max_queries:
        vectors = _matrix(asked["embedding"], asked.num_rows)
        near = _nearest_centres(vectors, cells.centres, n_probe) if len(vectors) and n_probe else np.zeros((asked.num_rows, 0), dtype=np.int32)
        near = np.hstack([near, np.full((asked.num_rows, 1), TAIL, dtype=np.int32)])
        probes = asked.take(pa.array(np.repeat(np.arange(asked.num_rows), near.shape[1])))
        probes = probes.append_column("cell", pa.array(near.ravel(), pa.int32()))
        opened = [int(c) for c in np.unique(near) if c != TAIL]
        candidates = _scan_table(rows(indexed.where(F.col("cell").isin(opened))), queries, probes, k, groups)
    else:
        probes = _probed(queries, cells, n_probe) if n_probe else queries.withColumn("cells", F.array().cast("array<int>"))
        probes = probes.withColumn("cell", F.explode(F.array_append("cells", F.lit(TAIL)))).drop("cells")
        candidates = _blocked_topk(rows(indexed), probes, k, groups)
    best = Window.partitionBy("q_id").orderBy("distance", "id")
    return candidates.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
