import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.hard_negatives import Blocks, best, hard_negatives, hilbert_keys, intervals, quantize

SCHEMA = "id bigint, label int, vector array<float>"


def by_hand(rows, every, positives=5, negatives=5, low=80, scale=256):
    kept = []
    for row_id, label, vector in rows:
        if row_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (row_id, label, tuple(math.floor(scale * float(np.float32(x))) for x in vector))
        if row not in kept:
            kept.append(row)

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for anchor, label, own in kept:
        if anchor % every:
            continue
        others = [(-score(own, v), i, kind) for i, kind, v in kept if i != anchor]
        for minus, positive, _ in sorted(x for x in others if x[2] == label)[:positives]:
            hard = [(s, i) for s, i, kind in others if kind != label and low * -minus <= 100 * -s <= 100 * -minus]
            for rank, (s, i) in enumerate(sorted(hard)[:negatives], 1):
                out.append((anchor, positive, rank, i, -minus, -s))
    return sorted(out)


def mined(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.select(names).collect())


def vectors(n, seed, dims=6, spread=0.2):
    """Rows around a few centres, labels partly at random, with ties and odd rows."""
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        centre = rng.randrange(5)
        label = centre if rng.random() < 0.7 else rng.randrange(5)
        rows.append((i, label, [round(c + rng.uniform(-spread, spread), 2) for c in centres[centre]]))
    rows += [(n + i, i % 5, list(rows[0][2])) for i in range(12)]  # one vector many times
    rows += rows[:8]  # repeated rows
    return [*rows, (None, 1, [1.0] * dims), (900, None, [1.0] * dims), (910, 1, None), (920, 1, [float("nan")] * dims),
            (930, 1, [1.0, None]), (940, 2, [float("inf")] * dims), (950, 3, []), (960, 3, [0.5]), (970, 9, [1.0] * dims)]


@pytest.mark.parametrize("options", [{"block_rows": 8}, {"block_rows": 1024, "positives": 3, "negatives": 2, "low": 50}])
def test_rows_equal_brute_force(spark, options):
    rows = vectors(150, 1)
    got = mined(hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("id") % 10 == 0, **options))
    want = by_hand(rows, 10, **{k: v for k, v in options.items() if k != "block_rows"})
    assert got == want and len(want) > 50


def test_large_components_are_exact(spark):
    rows = [(i, i % 2, [3e7 + i, -2e7 - 7 * i]) for i in range(20)]
    got = mined(hard_negatives(spark.createDataFrame(rows, "id bigint, label int, vector array<double>"), F.col("id") % 5 == 0, block_rows=4, scale=1))
    score = 30_000_000 * 30_000_018 + 20_000_000 * 20_000_126
    assert {(r[1], r[4]) for r in got if r[0] == 0 and r[4] >= score} == {(18, score)}


def test_empty_table(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA), F.col("id") % 10 == 0).collect() == []


def test_hilbert_order_goes_from_cell_to_neighbouring_cell():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        keys = [x.tobytes() for x in hilbert_keys(grid, bits)]
        assert len(set(keys)) == len(keys)
        path = grid[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_intervals_hold_all_scores_and_spare_far_blocks(spark):
    rows = [(i, 0, [10.0 * (i // 40), 1.0 + (i % 40) / 100]) for i in range(400)]
    whole = spark.createDataFrame(rows, SCHEMA).withColumn("vector", quantize(F.col("vector"), 1)).withColumn("label", F.col("label").cast("long"))
    made = Blocks(whole, F.col("id") % 100 == 0, 40, 4)
    blocks = made.blocks.collect()
    assert sum(b["n"] for b in blocks) == 400 and all(b["n"] <= 40 for b in blocks)
    low, high = (np.stack([np.frombuffer(b[c], "<i8") for b in blocks]) for c in ("zone_low", "zone_high"))
    anchors = np.array([[3, -2], [0, 5], [-1, -1]])
    least, most = intervals(anchors, low, high)
    for j, b in enumerate(blocks):
        scores = anchors @ np.frombuffer(b["matrix"], made.kind).reshape(b["n"], -1).T
        assert (least[:, j] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= most[:, j]).all()
    assert (high[:, 0] - low[:, 0]).max() <= 10  # a block covers two neighbouring groups at most


def test_best_orders_ties_by_id():
    scores, ids = np.array([3, 5, 5, 1, 5]), np.array([9, 8, 2, 1, 4])
    assert ids[best(scores, ids, 2)].tolist() == [2, 4] and ids[best(scores, ids, 9)].tolist() == [2, 4, 8, 9, 1]
