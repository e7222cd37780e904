import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import sharding as H
from lodestone.session import shared_dir


def test_law_and_slots(spark):
    data = [(i, f"{i} " * (i % 50 + 1)) for i in range(3000)] + [(10_000 + i, "copy of one text") for i in range(150)]
    rows = H.shard_report(spark.createDataFrame(data, "doc_id bigint, text string").repartition(7)).collect()
    text = dict(data)
    assert len(rows) == len(data) and {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in rows)
    shards = {s: [r for r in rows if r["shard"] == s] for s in range(16)}
    for own in shards.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    sizes = np.array([sum(r["size"] for r in own) for own in shards.values()])
    assert sizes.max() - sizes.min() < 0.01 * sizes.mean()
    assert len({r["shard"] for r in rows if r["doc_id"] >= 10_000}) == 1


def test_a_group_too_large_for_a_shard_is_cut(spark):
    data = [(i, "the hot text") for i in range(2000)] + [(5000 + i, f"other {i}") for i in range(2000)]
    rows = H.shard_report(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    counts = np.bincount([r["shard"] for r in rows], minlength=16)
    sizes = np.bincount([r["shard"] for r in rows], weights=[r["size"] for r in rows], minlength=16)
    assert sizes.max() - sizes.min() <= 0.02 * sizes.mean()
    for s in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_numbers_have_no_gaps(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("part"))
    got = H.numbered(rows, "part", [F.col("id")], "n", bucket_rows=10).collect()
    for part in range(3):
        own = [r["n"] for r in got if r["part"] == part]
        assert sorted(own) == list(range(len(own)))


def test_pack_goes_where_the_dot_product_is_highest():
    chosen = H.pack(np.array([[0.6, 0.1], [0.1, 0.6], [0.1, 0.5], [0.3, 0.1]]), 2)
    assert list(chosen) == [0, 1, 0, 1]


def test_odd_rows(odd, none, spark):
    rows = H.shard_report(odd.withColumn("shard", F.lit("mine"))).collect()
    assert len(rows) == odd.count()
    assert len({r["shard"] for r in rows if r["doc_id"] in (1, 5)}) == 1 and {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {1}
    assert H.shard_report(none).count() == 0
    folder = shared_dir(spark, "test-shards")
    H.write_shards(odd.withColumn("shard", F.lit("mine")), folder)
    back = spark.read.parquet(folder)
    assert back.count() == odd.count() and set(back.columns) == {*odd.columns, "shard"}
