"""Importance resampling towards a target distribution: array-scored weights, then distributed quickselect.

Words are those of decontamination; features are all runs of 1 to `order` words, hashed
by CRC-32 into `buckets` buckets. The corpus and the target give one count per bucket. A
bucket's gain is the smoothed log ratio of its shares in the target and in the corpus, in
thousandths rounded down; a text's weight is the sum of its features' gains, looked up
in one array that is broadcast (`buckets` numbers, whatever the corpus holds). Gumbel noise
that depends on seed and id alone is added, so the highest scores are a draw without
replacement with probabilities that follow the weights.

The k-th highest score is found by quickselect on the composite key (score, id, text hash, row):
random rows of what is left are pivots, every row left is counted on one side of each, and
the search goes on between two pivots, until the k-th key is a pivot itself. Only
the winners are then sorted, by range, and ranked by counts of the ranges before.

Defined results
* null and empty texts have no features and weight 0; they are drawn only if `min_words` is 0
* rows without an id get the noise of an empty id and come last among equal scores
* rows that share id and text are drawn one by one, like any other
* an empty table gives an empty table; an empty target is smoothed like any other
* the internal columns have names that the documents do not use
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.decontaminate import words
from lodestone.llm.names import unused
from lodestone.session import cut_lineage

BUCKETS, ORDER, SEED, MIN_WORDS = 10_000, 1, 2024, 20
#: Pivots of one round of the quickselect.
PIVOTS = 12
#: Features whose bucket a task remembers.
_CACHE = 500_000


class _Buckets(dict):
    """The bucket of a feature, remembered."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.n
        return found


def _features(tokens: list[bytes], order: int, buckets: _Buckets) -> np.ndarray:
    """The buckets of all features of a text."""
    found = [np.fromiter(map(buckets.__getitem__, tokens), np.int64, len(tokens))]
    for n in range(2, order + 1):
        runs = map(b" ".join, zip(*(tokens[i:] for i in range(n))))
        found.append(np.fromiter(map(buckets.__getitem__, runs), np.int64))
    return np.concatenate(found)


def _count(batches: Iterator[pa.RecordBatch], order: int, n: int) -> Iterator[pa.RecordBatch]:
    total, buckets = np.zeros(n, np.int64), _Buckets(n)
    for batch in batches:
        for text in batch.column(0):
            total += np.bincount(_features(words(text.as_py()), order, buckets), minlength=n)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def bucket_counts(docs: DataFrame, text: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; `buckets` rows at most reach the driver."""
    parts = docs.select(F.encode(text, "UTF-8").alias("text")).mapInArrow(partial(_count, order=order, n=buckets), "bucket bigint, n bigint")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths."""
    n, all_corpus, all_target = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = (
        math.floor(1000 * math.log(float((t + 1) * (all_corpus + n)) / float((s + 1) * (all_target + n))))
        for s, t in zip(corpus.tolist(), target.tolist())
    )
    return np.fromiter(ratio, np.int64, n)


def noise(doc_id: int | str | None, seed: int) -> int:
    """The Gumbel noise of an id, in thousandths."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(batches: Iterator[pa.RecordBatch], table, order: int, seed: int, keep: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    gain = table.value
    buckets = _Buckets(len(gain))
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(keep).to_pylist(), batch.column(keep + 1)):
            tokens = words(text.as_py())
            found = _features(tokens, order, buckets)
            weight = int(gain[found].sum())
            rows.append((len(tokens), len(found), weight, weight + noise(doc_id, seed)))
        made = np.array(rows, np.int64).reshape(-1, 4).T
        yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *map(pa.array, made)], names=names)


class Scored:
    """Documents with their weights, written once; `names` are the columns added to those of the documents."""

    def __init__(
        self,
        docs: DataFrame,
        target: DataFrame,
        doc_id: str = "doc_id",
        text: str = "text",
        target_text: str = "text",
        order: int = ORDER,
        buckets: int = BUCKETS,
        seed: int = SEED,
        min_words: int = MIN_WORDS,
        keep: list[str] | None = None,
    ):
        keep = docs.columns if keep is None else keep
        self.columns = keep
        names = unused(docs, "n_words", "n_features", "weight", "score", "hash", "row")
        self.n_words, self.n_features, self.weight, self.score, self.hash, self.row = names
        gain = gains(bucket_counts(docs, text, order, buckets), bucket_counts(target, target_text, order, buckets))
        key, body = unused(docs, "key", "body")
        rows = docs.select(
            *keep, F.xxhash64(text).alias(self.hash), F.col(doc_id).cast("string").alias(key), F.encode(text, "UTF-8").alias(body)
        )
        fields = [*rows.schema.fields[:-2], *(T.StructField(c, T.LongType()) for c in names[:4])]
        scan = partial(
            _weigh,
            table=docs.sparkSession.sparkContext.broadcast(gain),
            order=order,
            seed=seed,
            keep=len(keep) + 1,
            names=[f.name for f in fields],
        )
        weighed = rows.mapInArrow(scan, T.StructType(fields))
        # Numbered as written, so that no two keys are equal and every read sees the same numbers.
        self.rows = cut_lineage(weighed.withColumn(self.row, F.monotonically_increasing_id()))
        self.drawable = self.rows.where(F.col(self.n_words) >= min_words)
        self.key = {
            "score": -F.col(self.score),
            "nameless": F.col(doc_id).isNull(),
            "id": F.coalesce(F.col(doc_id), F.lit(0 if docs.schema[doc_id].dataType != T.StringType() else "")),
            "hash": F.col(self.hash),
            "row": F.col(self.row),
        }

    def order_key(self) -> Column:
        """Ascending: the highest score first, then the smaller id."""
        return F.struct(*[c.alias(name) for name, c in self.key.items()])

    def _literal(self, row) -> Column:
        types = self.rows.select(self.order_key().alias("k")).schema["k"].dataType
        return F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in types])

    def kth(self, k: int, pivots: int = PIVOTS, max_rounds: int = 200):
        """The k-th key in order, as a column of constants; 1 <= k <= the number of drawable rows."""
        left = self.drawable.select(self.order_key().alias("k"))
        for turn in range(max_rounds):
            drawn = left.orderBy(F.xxhash64(F.lit(turn), "k.row"), "k.row").limit(pivots).collect()
            keys = sorted((r["k"] for r in drawn), key=tuple)
            marks = [self._literal(key) for key in keys]
            # Side 2 i: between pivots i - 1 and i; side 2 i + 1: pivot i itself.
            side = sum(((F.col("k") > m).cast("int") + (F.col("k") >= m).cast("int") for m in marks), F.lit(0))
            counts = {r["side"]: r["count"] for r in left.groupBy(side.alias("side")).count().collect()}
            for at in range(2 * len(keys) + 1):
                here = counts.get(at, 0)
                if k <= here:
                    break
                k -= here
            if at % 2:
                return marks[at // 2]
            if at:
                left = left.where(F.col("k") > marks[at // 2 - 1])
            if at < 2 * len(keys):
                left = left.where(F.col("k") < marks[at // 2])
        raise RuntimeError(f"the k-th key was not found in {max_rounds} rounds")

    def drawn(self, percent: int) -> DataFrame:
        """floor(percent * N / 100) of the N drawable rows, those with the first keys."""
        k = percent * self.drawable.count() // 100
        if k < 1:
            return self.drawable.where(F.lit(False))
        return self.drawable.where(self.order_key() <= self.kth(k))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = 0
    for batch in batches:
        place = pa.array(np.arange(n, n + batch.num_rows))
        n += batch.num_rows
        yield batch.append_column("place", place)


def ranked(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """`rows` with their number from 1 in the order of `key`: places within ranges, plus the rows of the ranges before."""
    ranges = rows.withColumn("_range_key", key).repartitionByRange("_range_key").sortWithinPartitions("_range_key").drop("_range_key")
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])
    placed = cut_lineage(ranges.withColumn("part", F.spark_partition_id()).mapInArrow(_number, schema))
    # One row for each partition of the shuffle.
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())
    before, starts = 0, []
    for part, size in sizes:
        starts.append((part, before))
        before += size
    starts = rows.sparkSession.createDataFrame(starts, "part int, start bigint")
    return placed.join(F.broadcast(starts), "part").withColumn(name, F.col("start") + F.col("place") + 1).drop("part", "place", "start")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, **options) -> DataFrame:
    """The drawn documents, with the columns of `docs`."""
    return Scored(docs, target, **options).drawn(percent).select(*docs.columns)


def resampling_report(docs: DataFrame, target: DataFrame, percent: int = 10, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, and rank where it is drawn."""
    scored = Scored(docs.select(doc_id, text), target, doc_id=doc_id, text=text, keep=[doc_id], **options)
    drawn = ranked(scored.drawn(percent), scored.order_key(), "rank").select(scored.row, "rank")
    columns = [F.col(scored.n_features).alias("n_features"), F.col(scored.weight).alias("weight"), F.col(scored.score).alias("score")]
    return scored.rows.join(drawn, scored.row, "left").select(doc_id, *columns, "rank")
