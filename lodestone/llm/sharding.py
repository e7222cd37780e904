"""Sharding by vector bin packing: bytes, words and rows are balanced together.

Documents with equal texts form a group, and a group goes to one shard. What is
packed are items: groups that hold more than 1 / FINE of a shard's share of any
measure are items of their own (at most 3 * shards * FINE of them, whatever the
corpus), all other groups are dealt by hash into shards * FINE bundles. Only these
sums reach the driver. There the items, largest first, go where the dot product of
their vector with the shards' residual capacity is highest.

A group with more bytes than a shard's share is cut into equal pieces, as no shard can hold it.
Slots count the rows of a shard without gaps, in buckets of a bounded number of rows.

Defined results
* null texts have size 1 and form a group with empty texts
* repeated documents each get a row and a slot, in one shard as their texts are equal
* an empty table gives an empty table; an item of equal value for several shards goes to the first
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut_lineage

SHARDS = 16
#: Bundles per shard; a shard is off its share by about one bundle at most.
FINE = 256
#: Pieces per shard's share that a group too large for one shard is cut into.
PIECES = 4
#: Rows that are numbered together.
BUCKET_ROWS = 4096
MEASURES = ("bytes", "words", "rows")


def numbered(rows: DataFrame, part: str, order: list[Column], name: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`rows` with `name`, which counts from 0 without gaps inside each value of `part`.

    There must be few values of `part`, each may hold any number of rows: they are
    numbered in hash buckets, after the number of rows in the buckets before.
    """
    sizes = rows.groupBy(part).agg(F.ceil(F.count(F.lit(1)) / bucket_rows).alias("_buckets"))
    dealt = rows.join(F.broadcast(sizes), part).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.col("_buckets")))
    counts = dealt.groupBy(part, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(part, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = Window.partitionBy(part, "_bucket").orderBy(*order)
    placed = dealt.withColumn("_here", F.row_number().over(here)).join(counts, [part, "_bucket"])
    return placed.withColumn(name, F.col("_before") + F.col("_here") - 1).drop("_bucket", "_buckets", "_here", "_before")


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """A shard for each vector (in shares of a shard's capacity), by the dot product with what is left.

    The first measure is the law: a shard whose share of it is used up takes no more,
    and what fits nowhere goes where most of it is left.
    """
    left = np.ones((shards, vectors.shape[1]))
    chosen = np.zeros(len(vectors), dtype=np.int32)
    for i in np.lexsort((np.arange(len(vectors)), -vectors.sum(axis=1), -vectors[:, 0])):
        fits = left[:, 0] >= vectors[i, 0]
        chosen[i] = np.argmax(np.where(fits, left @ vectors[i], -np.inf)) if fits.any() else np.argmax(left[:, 0])
        left[chosen[i]] -= vectors[i]
    return chosen


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bytes, words, rows, text_crc32, hash): what is packed, without the texts."""
    clean = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(clean) + 1).cast("long").alias("bytes"),
        F.regexp_count(clean, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.lit(1).cast("long").alias("rows"),
        F.crc32(clean.cast("binary")).alias("text_crc32"),
        F.xxhash64(clean).alias("hash"),
    )


def assign_shards(sizes: DataFrame, shards: int = SHARDS, fine: int = FINE) -> DataFrame:
    """`sizes` with `shard`; rows with equal hash and text_crc32 are a group."""
    spark = sizes.sparkSession
    sums = [F.sum(m).alias(m) for m in MEASURES]
    groups = cut_lineage(sizes.groupBy("hash", "text_crc32").agg(*sums))
    total = groups.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES]).first()
    share = np.array([max(1, total[m]) for m in MEASURES]) / shards
    large = F.greatest(*[F.col(m) / float(s) for m, s in zip(MEASURES, share)])
    marked = groups.withColumn("large", large).withColumn("bundle", F.pmod("hash", F.lit(shards * fine)))
    is_item = F.col("large") > 1 / fine
    alone = marked.where(is_item).orderBy("hash", "text_crc32").collect()  # at most 3 * shards * fine rows
    bundles = marked.where(~is_item).groupBy("bundle").agg(*sums).orderBy("bundle").collect()  # at most shards * fine rows

    vectors, items, pieces = [], [], []
    for row in bundles:
        items.append(row["bundle"])
        vectors.append([row[m] for m in MEASURES])
    next_item = shards * fine
    for row in alone:
        shares = row["bytes"] / share[0]
        n = 1 if shares <= 1 else min(row["rows"], int(np.ceil(shares * PIECES)))
        pieces.append((row["hash"], row["text_crc32"], next_item, n))
        for i in range(n):
            items.append(next_item + i)
            vectors.append([row[m] / n for m in MEASURES])
        next_item += n
    chosen = pack(np.array(vectors, dtype=float).reshape(-1, len(MEASURES)) / share, shards)
    placed = F.broadcast(spark.createDataFrame(list(zip(items, chosen.tolist())), "item long, shard int"))
    alone = F.broadcast(spark.createDataFrame(pieces, "hash long, text_crc32 long, first long, pieces int"))

    met = sizes.join(alone, ["hash", "text_crc32"], "left")
    whole = met.where("pieces is null or pieces = 1")
    whole = whole.withColumn("item", F.coalesce("first", F.pmod("hash", F.lit(shards * fine))))
    cut = met.where("pieces > 1")
    if any(p[3] > 1 for p in pieces):
        cut = numbered(cut, "first", [F.xxhash64("doc_id"), F.col("doc_id")], "_turn")
        cut = cut.withColumn("item", F.col("first") + F.col("_turn") % F.col("pieces")).drop("_turn")
        whole = whole.unionByName(cut)
    return whole.join(placed, "item").select(*sizes.columns, "shard")


def shard_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    placed = cut_lineage(assign_shards(cut_lineage(measured(docs, doc_id, text)), shards))
    rows = numbered(placed, "shard", [F.xxhash64("doc_id", "hash"), F.col("doc_id"), F.col("hash")], "slot")
    return rows.select(
        F.col("doc_id").alias(doc_id),
        F.col("bytes").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> None:
    """Write `docs` below `folder`, one subfolder `shard=n` per shard.

    Shards are found by the text, so documents keep all their columns; a column named shard is replaced.
    """
    report = assign_shards(cut_lineage(measured(docs, doc_id, text)), shards)
    homes = report.groupBy("doc_id", "hash", "text_crc32").agg(F.min("shard").alias("_shard"))
    clean = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumns({"_hash": F.xxhash64(clean), "_crc": F.crc32(clean.cast("binary"))})
    same = keyed[doc_id].eqNullSafe(homes["doc_id"]) & (F.col("_hash") == F.col("hash")) & (F.col("_crc") == F.col("text_crc32"))
    columns = [keyed[c] for c in docs.columns if c != "shard"]
    keyed.join(homes, same).select(*columns, F.col("_shard").alias("shard")).write.partitionBy("shard").parquet(folder)
