"""Hard negatives from Hilbert-ordered Parquet blocks with zone maps.

Rows are ids, labels and vectors; components become floor(`scale` * x) and a score is the integer inner
product. An anchor's positives are its best rows of the same label. The negatives of an anchor and a
positive are the best rows of another label whose score lies in a window below the positive's
score: `low` % of it to all of it. Higher scores come first, ties by smaller id.

Rows are sorted along a Hilbert curve through the grid of their components and packed into blocks, one
Parquet row each: ids, labels, a matrix, and the zone map, the least and the largest value of every
dimension. Anchors are packed in the same way. For an anchor a and a block the interval
[sum of a_d * min_d or a_d * max_d, whichever is less; whichever is more] holds all scores of the block, so
an anchor reads only the blocks whose interval meets one of its windows:

1. the block with the highest bound of each group of zone maps gives a first k-th best score;
2. the blocks that reach this score give the positives;
3. the blocks that meet a window below a positive give the negatives.

The anchors are a stated query set that is searched in all rows, block by block: a pair of blocks is one matrix
product, and a task keeps only the k best of each window.

Defined results
* rows with a null id, label or vector, or with a null or not finite component take no part
* rows equal in id, label and vector count once; a row is never positive or negative of its own id
* vectors of different lengths are filled up with zeros
* anchors without rows of their label, or with only negative scores among them, give no rows
* an empty table gives an empty table; the columns of the input may have any names
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import cut_lineage

#: Rows of a block, and blocks whose zone maps are looked through together.
BLOCK_ROWS, ZONE_GROUP = 1024, 128
#: Bits of each dimension in the place on the curve.
BITS = 4
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1

_BLOCKS = (
    "block bigint, n bigint, ids binary, labels binary, matrix binary, zone_low binary, zone_high binary, label_low bigint, label_high bigint"
)
_FOUND = "chunk bigint, at bigint, slot bigint, id bigint, score bigint"


def quantize(vector: Column, scale: int) -> Column:
    """The components as whole numbers; null where one of them is null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


# Hilbert order ---------------------------------------------------------------


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of a grid of `bits`-bit numbers on the Hilbert curve, as rows of bytes.

    The axes are turned bit by bit from the top, so that each half cube begins where the one before ends;
    then they are Gray-coded and their bits interleaved.
    """
    x = grid.T.astype(np.uint64).copy()
    one, high = np.uint64(1), bits - 1
    for level in range(high, 0, -1):
        below = (one << np.uint64(level)) - one
        for axis in x:
            up = (axis >> np.uint64(level)) & one == one
            swapped = np.where(up, 0, (x[0] ^ axis) & below).astype(np.uint64)
            axis ^= swapped
            if axis is not x[0]:
                x[0] ^= swapped
            x[0] ^= np.where(up, below, 0).astype(np.uint64)
    x = np.bitwise_xor.accumulate(x, axis=0)
    turn = np.zeros(x.shape[1], np.uint64)
    for level in range(high, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(level)) & one == one, (one << np.uint64(level)) - one, 0).astype(np.uint64)
    x ^= turn
    planes = [((x >> np.uint64(level)) & one).astype(np.uint8) for level in range(high, -1, -1)]
    return np.packbits(np.concatenate(planes).T, axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of one width."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _place(batches: Iterator[pa.RecordBatch], width: int, low: int, high: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = _matrix(batch.column("vector"), width).astype(np.float64)
        grid = np.floor((rows - low) / max(1, high - low) * ((1 << bits) - 1)).clip(0, (1 << bits) - 1)
        keys = [x.tobytes() for x in hilbert_keys(grid, bits)] if width else [b""] * len(rows)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=["id", "label", "vector", "key"])


def _pack(batches: Iterator[pa.RecordBatch], width: int, kind: str, rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to blocks of `rows` rows; equal neighbours are one row."""
    number = (TaskContext.get().partitionId()) << 32
    held: list[tuple[np.ndarray, ...]] = []
    schema = pa.schema([(f.split()[0], pa.binary() if "binary" in f else pa.int64()) for f in _BLOCKS.split(", ")])

    def block(ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
        nonlocal number
        number += 1
        data = [matrix.astype(kind), matrix.min(axis=0).astype("<i8"), matrix.max(axis=0).astype("<i8")]
        row = [number - 1, len(ids), ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), *(x.tobytes() for x in data)]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([*row, int(labels.min()), int(labels.max())], schema)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column("id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("vector"), width)]
        if held:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        same = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1]) & (cols[2][1:] == cols[2][:-1]).all(axis=1)
        cols = [c[np.concatenate(([True], ~same))] for c in cols]
        full = (len(cols[0]) - 1) // rows * rows  # the last row stays, as the next one may equal it
        for i in range(0, full, rows):
            yield block(*(c[i : i + rows] for c in cols))
        held = [c[full:] for c in cols]
    if held:
        yield block(*held)


class Blocks:
    """All rows and the anchors among them, packed in Hilbert order and written once."""

    def __init__(self, rows: DataFrame, anchors: Column, block_rows: int, bits: int):
        rows = cut_lineage(rows)
        sizes = F.max(F.size("vector")), F.min(F.array_min("vector")), F.max(F.array_max("vector"))
        width, low, high = rows.agg(*sizes).first()
        self.width, low, high = width or 0, low or 0, high or 0
        self.kind = "<i4" if -(1 << 31) <= low and high < 1 << 31 else "<i8"
        most = max(abs(low), abs(high))
        #: Whether sums of products are exact in doubles, which multiply faster.
        self.small = self.width * most * most < 1 << 53
        place = partial(_place, width=self.width, low=low, high=high, bits=bits)
        placed = cut_lineage(rows.mapInArrow(place, "id bigint, label bigint, vector array<bigint>, key binary"))
        self.blocks = self._packed(placed, block_rows)
        self.chunks = self._packed(placed.where(anchors), block_rows).withColumnRenamed("block", "chunk")

    def _packed(self, placed: DataFrame, block_rows: int) -> DataFrame:
        parts = 1 + placed.count() // (8 * block_rows)
        order = ["key", "id", "label", "vector"]
        dealt = placed.repartitionByRange(parts, "key", "id", "label").sortWithinPartitions(*order).select("id", "label", "vector")
        return cut_lineage(dealt.mapInArrow(partial(_pack, width=self.width, kind=self.kind, rows=block_rows), _BLOCKS))

    def zones(self) -> DataFrame:
        """(group, zones): the zone maps of neighbouring blocks together."""
        rank = F.struct("block", "zone_low", "zone_high", "label_low", "label_high")
        # A range of the curve has eight blocks or so.
        group = F.floor(F.shiftright("block", 32) * 8 / ZONE_GROUP)
        return self.blocks.groupBy(group.alias("group")).agg(F.collect_list(rank).alias("zones"))


# Choice and reading ----------------------------------------------------------


def _numbers(value: pa.Scalar, kind: str, rows: int) -> np.ndarray:
    return np.frombuffer(value.as_py(), kind).reshape(rows, -1)


def intervals(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest inner product that each anchor can have in each block."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _choose(batches: Iterator[pa.RecordBatch], kind: str, number: type, same: bool, seeds: bool) -> Iterator[pa.RecordBatch]:
    """(chunk, n, labels, matrix, windows, zones) to (chunk, block, picks): the windows that must read a block."""
    for batch in batches:
        out = []
        for row in range(batch.num_rows):
            chunk, n = batch.column("chunk")[row].as_py(), batch.column("n")[row].as_py()
            windows = _windows(batch.column("windows")[row])
            zones = batch.column("zones")[row].as_py()
            zones.sort(key=lambda z: z["block"])
            anchors = _numbers(batch.column("matrix")[row], kind, n)[windows["at"]].astype(number)
            labels = _numbers(batch.column("labels")[row], "<i8", n)[windows["at"], 0][:, None]
            sides = [np.stack([np.frombuffer(z[c], "<i8") for z in zones]).astype(number) for c in ("zone_low", "zone_high")]
            first, last = (np.array([z[c] for z in zones])[None, :] for c in ("label_low", "label_high"))
            least, most = intervals(anchors, *sides)
            fits = (first <= labels) & (labels <= last) if same else (first != labels) | (last != labels)
            if seeds:
                best = np.where(fits, most.astype(np.float64), -np.inf).argmax(axis=1)
                fits &= np.arange(len(zones))[None, :] == best[:, None]
            else:
                fits &= (least <= windows["high"][:, None]) & (most >= windows["low"][:, None])
            for j, zone in enumerate(zones):
                picks = np.flatnonzero(fits[:, j])
                if len(picks):
                    out.append((chunk, zone["block"], picks.astype("<i4").tobytes()))
        columns = list(zip(*out)) or [(), (), ()]
        types = (pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["chunk", "block", "picks"])


def _windows(value: pa.Scalar) -> np.ndarray:
    rows = sorted((w["at"], w["slot"], w["low"], w["high"]) for w in value.as_py())
    return np.array(rows, dtype=[("at", "i8"), ("slot", "i8"), ("low", "i8"), ("high", "i8")])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties by smaller id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _read(batches: Iterator[pa.RecordBatch], kind: str, number: type, same: bool, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, picks, windows, anchors and one block) sorted by chunk to the k best of each window in this task."""
    schema = pa.schema([(c, pa.int64()) for c in ("chunk", "at", "slot", "id", "score")])

    def flushed() -> Iterator[pa.RecordBatch]:
        rows = [(now, *map(int, windows[w][["at", "slot"]].tolist()), int(i), int(s)) for w, (ids, scores) in found.items() for i, s in zip(ids, scores)]
        for i in range(0, len(rows), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + (1 << 16)])], schema=schema)

    now, windows, found = None, None, {}
    for batch in batches:
        for row in range(batch.num_rows):
            chunk = batch.column("chunk")[row].as_py()
            if chunk != now:
                yield from flushed()
                now, windows, found = chunk, _windows(batch.column("windows")[row]), {}
                n = batch.column("n")[row].as_py()
                anchors = _numbers(batch.column("matrix")[row], kind, n)
                own, labels = (_numbers(batch.column(c)[row], "<i8", n)[:, 0] for c in ("ids", "labels"))
            picks = np.frombuffer(batch.column("picks")[row].as_py(), "<i4")
            m = batch.column("block_n")[row].as_py()
            ids, kinds = (_numbers(batch.column(c)[row], "<i8", m)[:, 0] for c in ("block_ids", "block_labels"))
            rows = _numbers(batch.column("block_matrix")[row], kind, m).astype(number)
            asked, which = np.unique(windows["at"][picks], return_inverse=True)
            scores = (anchors[asked].astype(number) @ rows.T).astype(np.int64)
            right = (kinds[None, :] == labels[asked][:, None]) == same
            right &= ids[None, :] != own[asked][:, None]
            for w, i in zip(picks.tolist(), which.tolist()):
                low, high = windows[w]["low"], windows[w]["high"]
                at = np.flatnonzero(right[i] & (scores[i] >= low) & (scores[i] <= high))
                if not len(at):
                    continue
                new_ids, new_scores = ids[at], scores[i][at]
                if w in found:
                    new_ids, new_scores = np.concatenate((found[w][0], new_ids)), np.concatenate((found[w][1], new_scores))
                top = best(new_scores, new_ids, k)
                found[w] = (new_ids[top], new_scores[top])
    yield from flushed()


def _searched(made: Blocks, windows: DataFrame, same: bool, k: int, seeds: bool = False) -> DataFrame:
    """(chunk, at, slot, id, score, rank): the k best rows of each window (chunk, at, slot, low, high), written once."""
    number = np.float64 if made.small else np.int64
    asked = windows.groupBy("chunk").agg(F.collect_list(F.struct("at", "slot", "low", "high")).alias("windows"))
    asked = cut_lineage(made.chunks.select("chunk", "n", "ids", "labels", "matrix").join(asked, "chunk"))
    zones = cut_lineage(made.zones())
    # Every chunk of the query set meets every group of zone maps.
    groups = zones.agg(F.max("group")).first()[0]
    everywhere = asked.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups or 0).cast("long"))))
    choose = partial(_choose, kind=made.kind, number=number, same=same, seeds=seeds)
    columns = ["chunk", "n", "labels", "matrix", "windows", "zones"]
    chosen = everywhere.join(zones, "group").select(*columns).mapInArrow(choose, "chunk bigint, block bigint, picks binary")
    blocks = made.blocks.select("block", *[F.col(c).alias(f"block_{c}") for c in ("n", "ids", "labels", "matrix")])
    chosen = cut_lineage(chosen)
    pairs = chosen.join(blocks, "block").join(asked, "chunk")
    dealt = pairs.repartition("chunk", F.shiftright("block", 32)).sortWithinPartitions("chunk")
    found = dealt.mapInArrow(partial(_read, kind=made.kind, number=number, same=same, k=k), _FOUND)
    order = Window.partitionBy("chunk", "at", "slot").orderBy(F.desc("score"), "id")
    return cut_lineage(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    scale: int = 256,
    block_rows: int = BLOCK_ROWS,
    bits: int = BITS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `rows` has id, label and vector; `anchors` is a condition on `id`.
    """
    whole = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), quantize(F.col("vector"), scale).alias("vector"))
    made = Blocks(whole.where("id is not null and label is not null and vector is not null"), anchors, block_rows, bits)
    numbers = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    every = made.chunks.select("chunk", F.explode(numbers).alias("at")).withColumns(
        {"slot": F.lit(0).cast("long"), "low": F.lit(_LEAST).cast("long"), "high": F.lit(_MOST).cast("long")}
    )
    first = _searched(made, every, True, positives, seeds=True).where(F.col("rank") == positives)
    bound = every.drop("low").join(first.select("chunk", "at", F.col("score").alias("bound")), ["chunk", "at"], "left")
    bound = bound.select("chunk", "at", "slot", F.coalesce("bound", F.lit(_LEAST)).alias("low"), "high")
    chosen = _searched(made, bound, True, positives).withColumnRenamed("slot", "_none")
    chosen = chosen.withColumn("slot", F.col("rank").cast("long"))
    least = F.ceil(F.lit(low) * F.col("score") / 100)
    # Whole numbers: the least score s with 100 s >= low * positive score.
    least = F.when(least * 100 - low * F.col("score") >= 100, least - 1).when(least * 100 < low * F.col("score"), least + 1).otherwise(least)
    below = chosen.where("score >= 0").select("chunk", "at", "slot", least.cast("long").alias("low"), F.col("score").alias("high"))
    found = _searched(made, below, False, negatives)
    ids = made.chunks.select("chunk", "n", "ids").mapInArrow(_anchor_ids, "chunk bigint, at bigint, anchor_id bigint")
    named = found.select("chunk", "at", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = named.join(chosen.select("chunk", "at", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["chunk", "at", "slot"])
    named = named.join(ids, ["chunk", "at"])
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _anchor_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, n, ids in zip(batch.column("chunk"), batch.column("n"), batch.column("ids")):
            own = np.frombuffer(ids.as_py(), "<i8")
            columns = [np.full(len(own), chunk.as_py()), np.arange(len(own)), own]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["chunk", "at", "anchor_id"])
