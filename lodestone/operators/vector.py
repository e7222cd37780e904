"""Vector search: exact and approximate nearest neighbours by squared L2.

Both searches are one equi-grouped distance job. Documents and queries carry
group columns; a query sees exactly the documents of its groups. Exact search
groups by collection, approximate search by collection and cell.

A bounded set of queries is broadcast as one matrix, and every partition of
documents reports its own k best, so documents are never shuffled. More
queries are cut into blocks that meet blocks of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import cut_lineage, equi_join

#: Queries that may be broadcast together.
BROADCAST_QUERIES = 20_000
#: Rows per side of one block in the blocked plan.
BLOCK_ROWS = 16_384
#: Distances held in memory at once by a kernel.
CELLS_AT_ONCE = 4_000_000


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    """Vectors of one length as a matrix; mixed lengths are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64)
    width = len(flat) // rows if rows else 0
    if rows and not (column.value_lengths().to_numpy(zero_copy_only=False) == width).all():
        raise ValueError("vectors of one collection and search must have one length")
    return flat.reshape(rows, width)


def _rows(column: pa.Array | pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    """The vectors of some rows; rows of one collection have one length, those of others may differ."""
    return _matrix(column.take(pa.array(rows)), len(rows))


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def rough_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All distances through one matrix product; off by rounding only."""
    squares = (left * left).sum(axis=1)[:, None] + (right * right).sum(axis=1)[None, :]
    return squares - 2.0 * (left @ right.T)


def slack(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How far `rough_distances` may be off for each left row; it grows with the squared norms."""
    largest = (right * right).sum(axis=1).max() if len(right) else 0.0
    return 4.0 * np.finfo(float).eps * (left.shape[1] + 4) * ((left * left).sum(axis=1)[:, None] + largest)


def exact_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row-by-row distances, summed dimension by dimension so that the same vectors always give the same bits."""
    out = np.zeros(np.broadcast_shapes(left.shape[:-1], right.shape[:-1]))
    for i in range(left.shape[-1]):
        gap = left[..., i] - right[..., i]
        out += gap * gap
    return out


def _nearest(q_rows: np.ndarray, q_vecs: np.ndarray, ids: np.ndarray, vecs: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest documents of each query, as (q, distance, id) rows."""
    found = []
    step = max(1, CELLS_AT_ONCE // max(1, len(ids)))
    for at in range(0, len(q_rows), step):
        block = q_vecs[at : at + step]
        rough = rough_distances(block, vecs)
        if len(ids) > k:
            reach = np.partition(rough, k - 1, axis=1)[:, k - 1 : k] + 2.0 * slack(block, vecs)
            qi, di = np.nonzero(rough <= reach)
        else:
            qi, di = (x.ravel() for x in np.indices(rough.shape))
        distance = exact_distances(block[qi], vecs[di])
        found.append(pd.DataFrame({"q": q_rows[at + qi], "distance": distance, "id": ids[di]}))
        found[-1] = _keep_best(found[-1], k)
    return pd.concat(found, ignore_index=True)


def _keep_best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = rows.sort_values(["q", "distance", "id"], ignore_index=True)
    return ordered[ordered.groupby("q").cumcount() < k]


def _positions(groups: pd.DataFrame) -> dict[tuple, np.ndarray]:
    found = groups.groupby(list(groups.columns), sort=False, dropna=False).indices
    return {(key if isinstance(key, tuple) else (key,)): rows for key, rows in found.items()}


def grouped_topk(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    groups: list[str],
    max_queries: int = BROADCAST_QUERIES,
) -> DataFrame:
    """(q_id, collection_id, id, distance, rank): the k nearest documents within a query's groups.

    `docs` needs id, embedding and the group columns; `queries` needs q_id,
    embedding and the group columns, one row per group the query looks into.
    The collection is always one of the group columns.
    """
    docs = docs.select(*groups, "id", "embedding").where(F.col("embedding").isNotNull())
    queries = queries.select(*groups, "q_id", "embedding").where(F.col("embedding").isNotNull())
    asked = queries.limit(max_queries + 1).toArrow()
    if asked.num_rows <= max_queries:
        candidates = _scan_table(docs, queries, asked, k, groups)
    else:
        candidates = _blocked_topk(docs, queries, k, groups)
    best = Window.partitionBy("q_id").orderBy("distance", "id")
    return candidates.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _result_schema(docs: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("q_id", queries.schema["q_id"].dataType),
            T.StructField("collection_id", docs.schema["collection_id"].dataType),
            T.StructField("id", docs.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def _scan_table(docs: DataFrame, queries: DataFrame, table: pa.Table, k: int, groups: list[str]) -> DataFrame:
    """One scan of `docs` for a bounded table of queries; `queries` only gives the types."""
    schema = _result_schema(docs, queries)
    if table.num_rows == 0:
        return docs.sparkSession.createDataFrame([], schema)
    q_groups = _positions(table.select(groups).to_pandas())
    shipped = docs.sparkSession.sparkContext.broadcast(
        (
            table.select(["q_id", "collection_id"]).to_pandas(),
            {group: (rows, _rows(table["embedding"], rows)) for group, rows in q_groups.items()},
        )
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_keys, asked = shipped.value
        best = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            frame = batch.select(groups + ["id"]).to_pandas()
            ids = frame["id"].to_numpy()
            found = [best] if best is not None else []
            for group, rows in _positions(frame[groups]).items():
                if group in asked:
                    found.append(_nearest(*asked[group], ids[rows], _rows(batch.column("embedding"), rows), k))
            if found:
                # A query with several groups has several rows; they compete under one id.
                best = _keep_best(pd.concat(found, ignore_index=True), k)
        if best is not None:
            out = q_keys.iloc[best["q"].to_numpy()].reset_index(drop=True)
            out["id"], out["distance"] = best["id"].to_numpy(), best["distance"].to_numpy()
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return docs.mapInArrow(scan, schema)


def into_blocks(
    docs: DataFrame, queries: DataFrame, groups: list[str], block_rows: int
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Cut both sides of every group into blocks and pair the blocks.

    However large a group is, one (document block, query block) pair holds
    about `block_rows` rows of each side.
    """
    doc_blocks = docs.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_d_blocks"))
    query_blocks = queries.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_q_blocks"))
    sizes = cut_lineage(doc_blocks.join(query_blocks, groups))

    def numbers(count: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    left = (
        equi_join(docs, sizes, groups, spread=["id"])
        .withColumn("_d", F.pmod(F.xxhash64("id"), F.col("_d_blocks")))
        .withColumn("_q", numbers("_q_blocks"))
    )
    right = (
        equi_join(queries, sizes, groups, spread=["q_id"])
        .withColumn("_q", F.pmod(F.xxhash64("q_id"), F.col("_q_blocks")))
        .withColumn("_d", numbers("_d_blocks"))
    )
    keys = groups + ["_d", "_q"]
    # Both sides may come from one table: aliases keep their columns apart.
    return (
        left.select(*[F.col(c).alias(c) for c in [*keys, "id", "embedding"]]),
        right.select(*[F.col(c).alias(c) for c in [*keys, "q_id", "embedding"]]),
        keys,
    )


def _blocked_topk(
    docs: DataFrame, queries: DataFrame, k: int, groups: list[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    schema = _result_schema(docs, queries)
    left, right, keys = into_blocks(docs, queries, groups, block_rows)

    def meet(doc_block: pd.DataFrame, query_block: pd.DataFrame) -> pd.DataFrame:
        if doc_block.empty or query_block.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        best = _nearest(
            np.arange(len(query_block)),
            _stack(query_block["embedding"]),
            doc_block["id"].to_numpy(),
            _stack(doc_block["embedding"]),
            k,
        )
        out = query_block[["q_id", "collection_id"]].iloc[best["q"].to_numpy()].reset_index(drop=True)
        out["id"], out["distance"] = best["id"].to_numpy(), best["distance"].to_numpy()
        return out

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, schema)


def vector_topk(docs: DataFrame, queries: DataFrame, k: int, max_queries: int = BROADCAST_QUERIES) -> DataFrame:
    """Exact search: the k documents of the query's collection nearest to it.

    Fewer than k rows come back where the collection holds fewer documents,
    none where it is empty. Equal distances rank by id.
    """
    return grouped_topk(docs, queries, k, ["collection_id"], max_queries)


# Approximate search ---------------------------------------------------------


def choose_pivots(docs: DataFrame, n_cells: int) -> np.ndarray:
    """`n_cells` stored vectors picked by a hash of their ids; a bounded read."""
    picked = (
        docs.where(F.col("embedding").isNotNull())
        .select(F.md5(F.col("id").cast("string")).alias("h"), F.col("id"), "embedding")
        .orderBy("h", "id")
        .limit(n_cells)
        .select("embedding")
        .toArrow()
    )
    return _matrix(picked["embedding"], picked.num_rows)


def _near_cells(pivots: np.ndarray, vectors: np.ndarray, count: int) -> np.ndarray:
    distance = exact_distances(vectors[:, None, :], pivots[None, :, :])
    return np.argsort(distance, axis=1, kind="stable")[:, :count]


def assign_cells(df: DataFrame, pivots: np.ndarray, count: int = 1) -> DataFrame:
    """Add `cells`: the `count` nearest pivots of each vector, nearest first."""
    shipped = df.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype=object)
        parts = (_stack(vectors.iloc[at : at + 1024]) for at in range(0, len(vectors), 1024))
        return pd.Series([x for part in parts for x in _near_cells(shipped.value, part, count).astype(np.int32)])

    return df.where(F.col("embedding").isNotNull()).withColumn("cells", cells("embedding"))


def cell_index(docs: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Documents with the cell they belong to; write it to search it often."""
    return assign_cells(docs, pivots).withColumn("cell", F.col("cells")[0]).drop("cells")


def vector_topk_ann(
    indexed: DataFrame,
    pivots: np.ndarray,
    queries: DataFrame,
    k: int,
    n_probe: int,
    max_queries: int = BROADCAST_QUERIES,
) -> DataFrame:
    """Approximate search: exact ranking of the documents in the query's nearest cells."""
    probes = assign_cells(queries, pivots, n_probe).withColumn("cell", F.explode("cells")).drop("cells")
    return grouped_topk(indexed, probes, k, ["collection_id", "cell"], max_queries)
