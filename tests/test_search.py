import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from lodestone.functions.embedding import embed
from lodestone.operators import vector as V
from lodestone.operators.dedup import drop_near_duplicates, near_duplicates
from lodestone.operators.fusion import fuse, fused_topk
from lodestone.operators.keyword import KeywordIndex, keyword_topk
from lodestone.plans.search import hybrid_search, vector_search

RNG = np.random.default_rng(5)


def vector_rows(spark, vectors, collections, column="id"):
    rows = [(c, f"v{i:05d}", [float(x) for x in v]) for i, (c, v) in enumerate(zip(collections, vectors))]
    return spark.createDataFrame(rows, f"collection_id string, {column} string, embedding array<float>")


def brute_distance(a, b):
    """Summed dimension by dimension, as the engine does."""
    total = 0.0
    for x, y in zip(np.float32(a).astype(float).tolist(), np.float32(b).astype(float).tolist()):
        total += (x - y) * (x - y)
    return total


def brute_topk(docs, queries, k):
    out = set()
    for qc, q, qv in queries:
        near = sorted((brute_distance(v, qv), i) for c, i, v in docs if c == qc)
        out |= {(q, i, d, rank) for rank, (d, i) in enumerate(near[:k], 1)}
    return out


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all vectors are copies of one; one collection holds most rows."""
    vectors = [list(v) for v in RNG.normal(size=(200, 6))] + [[0.5] * 6] * 100
    collections = ["big" if i % 5 else "small" for i in range(300)]
    docs = vector_rows(spark, vectors, collections).cache()
    queries = vector_rows(spark, vectors[::7] + [[0.5] * 6], ["big", "small"] * 21 + ["big", "none"][: len(vectors[::7]) + 1 - 42], "q_id").cache()
    return docs, queries


@pytest.mark.parametrize("max_queries", [V.BROADCAST_QUERIES, 0])
@pytest.mark.parametrize("k", [1, 7, 1000])
def test_topk_equals_brute_force(spark, skewed, max_queries, k):
    docs, queries = skewed
    got = {(r.q_id, r.id, r.distance, r["rank"]) for r in V.vector_topk(docs, queries, k, max_queries).collect()}
    assert got == brute_topk(docs.collect(), queries.collect(), k)


def test_blocks_are_bounded_however_hot_a_group_is(spark, skewed, monkeypatch):
    docs, queries = skewed
    left, right, keys = V.into_blocks(docs, queries, ["collection_id"], 16)
    assert left.groupBy(*keys).count().agg(F.max("count")).first()[0] < 48
    monkeypatch.setattr(V._blocked_topk, "__defaults__", (16,))
    got = {(r.q_id, r.id, r.distance, r["rank"]) for r in V.vector_topk(docs, queries, 5, 0).collect()}
    assert got == brute_topk(docs.collect(), queries.collect(), 5)


def test_topk_plan_ranks_before_the_shuffle(spark, skewed):
    docs, queries = skewed
    plan = plan_of(V.vector_topk(docs, queries, 5))
    assert "WindowGroupLimit" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_inputs(spark, skewed):
    docs, queries = skewed
    assert V.vector_topk(docs, queries.limit(0), 3).count() == 0
    assert V.vector_topk(docs.limit(0), queries, 3).count() == 0
    assert near_duplicates(docs.limit(0), docs).count() == 0
    assert drop_near_duplicates(docs, docs.limit(0)).count() == docs.count()
    assert drop_near_duplicates(docs, docs.limit(0), max_new=0).count() == docs.count()


def test_approximate_search_with_all_cells_is_exact_and_recall_grows(spark, skewed):
    docs, queries = skewed
    pivots = V.choose_pivots(docs, 12)
    index = V.cell_index(docs, pivots)
    exact = {tuple(r) for r in V.vector_topk(docs, queries, 5).select("q_id", "id").collect()}

    def found(n_probe, limit=V.BROADCAST_QUERIES):
        return {tuple(r) for r in V.vector_topk_ann(index, pivots, queries, 5, n_probe, limit).select("q_id", "id").collect()}

    assert found(12) == exact == found(12, 0)
    assert len(found(6) & exact) >= len(found(1) & exact) and len(found(6) & exact) > 0.8 * len(exact)


@pytest.mark.parametrize("threshold", [0.0, 0.4, 2.0])
def test_both_duplicate_plans_equal_brute_force(spark, threshold):
    base = RNG.normal(size=(120, 4))
    stored = vector_rows(spark, np.vstack([base, np.repeat(base[:1], 80, axis=0)]), ["a"] * 120 + ["a"] * 80)
    fresh = np.vstack([base[:40] + RNG.normal(scale=0.2, size=(40, 4)), np.repeat(base[:1], 60, axis=0), RNG.normal(size=(20, 4)) * 9])
    new = vector_rows(spark, fresh, ["a"] * 100 + ["b"] * 20)
    kept_rows = [(c, np.float32(v).astype(float)) for c, _, v in stored.collect()]
    want = {
        r.id
        for r in new.collect()
        if any(c == r.collection_id and round(float(((np.float32(r.embedding).astype(float) - v) ** 2).sum()), 9) <= threshold for c, v in kept_rows)
    }
    assert {r.id for r in near_duplicates(new, stored, threshold).collect()} == want
    assert {r.id for r in near_duplicates(new, stored, threshold, max_new=0, n_cells=9).collect()} == want
    kept = {r.id for r in drop_near_duplicates(new, stored, threshold, max_new=0, n_cells=9).collect()}
    assert kept == {r.id for r in new.collect()} - want


def sqlite_search(docs, match, collection, limit):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(id unindexed, body, home unindexed)")
    con.executemany("insert into t values (?, ?, ?)", [(i, body, c) for c, i, body in docs])
    found = con.execute("select id, rank from t where home = ? and t match ? order by rank, id limit ?", (collection, match, limit))
    return [(i, round(-score, 6)) for i, score in found]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(6)
    words = ["ant", "bee", "cat", "dog", "eel", "fox", "gnu", "hen", "antler", "beetle", "Éclair"]
    rows = [("a" if i % 3 else "b", f"d{i:03d}", " ".join(rng.choices(words, weights=range(1, 12), k=rng.randrange(0, 30)))) for i in range(150)]
    return rows, spark.createDataFrame(rows, "collection_id string, id string, text string").cache()


@pytest.mark.parametrize("max_rows", [100_000, 0])
@pytest.mark.parametrize(
    "text, match, options",
    [
        ("ant", "ant", {}),
        ("ant bee", "ant bee", {}),
        ("eclair! fox, FOX", "eclair fox fox", {}),
        ("ant bee unknown", "ant bee unknown", {}),
        ("ant bee", "ant OR bee", {"mode": "or"}),
        ("hen gnu", "(hen gnu) NOT ant", {"exclude": "ant"}),
        ("gnu ant", "gnu ant*", {"prefix": True}),
        ("be", "be*", {"prefix": True}),
    ],
)
def test_keyword_ranking_equals_sqlite_fts5(spark, texts, text, match, options, max_rows):
    rows, docs = texts
    asked = spark.createDataFrame([("q1", "a", text), ("q2", "b", text)], "q_id string, collection_id string, query_text string")
    got = keyword_topk(KeywordIndex.of(docs), asked, 500, max_rows=max_rows, **options).orderBy("q_id", "rank").collect()
    for q, home in (("q1", "a"), ("q2", "b")):
        ours = {(r.id, round(r.bm25, 6)) for r in got if r.q_id == q}
        theirs = set(sqlite_search(rows, match, home, 500))
        assert {i for i, _ in ours} == {i for i, _ in theirs}
        scores = dict(theirs)
        assert all(abs(score - scores[i]) < 2e-6 for i, score in ours)


def test_keyword_plan_has_no_nested_loops(spark, texts):
    asked = spark.createDataFrame([("q", "a", "ant be")], "q_id string, collection_id string, query_text string")
    plan = plan_of(keyword_topk(KeywordIndex.of(texts[1]), asked, 5, prefix=True))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fusion_ties_keep_vector_order(spark):
    layout = "q_id string, collection_id string, id string, rank int"
    vector = spark.createDataFrame([("q", "c", "z", 1), ("q", "c", "y", 2)], layout)
    keyword = spark.createDataFrame([("q", "c", "a", 1), ("q", "c", "y", 2), ("q", "c", "b", 3)], layout)
    rows = fused_topk(fuse(vector, keyword), 3).orderBy("rank").collect()
    assert [(r.id, r.source) for r in rows] == [("y", "both"), ("z", "vector"), ("a", "keyword")]
    assert rows[0].score == 1 / 62 + 1 / 62 and rows[1].score == 1 / 61


def test_post_filter_may_return_fewer_and_pre_filter_does_not(spark):
    rows = [("c", f"d{i}", f"word{i} common", '{"even": %d}' % (i % 2 == 0)) for i in range(20)]
    docs = embed(spark.createDataFrame(rows, "collection_id string, id string, text string, metadata string"), dim=16)
    asked = embed(spark.createDataFrame([("q", "c", "word1 common")], "q_id string, collection_id string, query_text string"), "query_text", dim=16)
    post = hybrid_search(docs, asked, 4, {"even": 1}).collect()
    pre = hybrid_search(docs, asked, 4, {"even": 1}, filter_mode="pre").collect()
    assert len(post) < 4 and len(pre) == 4
    assert [r["rank"] for r in sorted(post, key=lambda r: r["rank"])] == list(range(1, len(post) + 1))
    nearest = vector_search(docs, asked, 3).orderBy("rank").collect()
    assert nearest[0].id == "d1" and nearest[0].score == 0.0


def test_searches_too_large_to_broadcast_give_the_same_rows(spark):
    rows = [("c", f"d{i}", f"word{i % 5} common", '{"n": %d}' % i) for i in range(40)]
    docs = embed(spark.createDataFrame(rows, "collection_id string, id string, text string, metadata string"), dim=16)
    asked = spark.createDataFrame([(f"q{i}", "c", f"word{i % 5}") for i in range(12)], "q_id string, collection_id string, query_text string")
    asked = embed(asked, "query_text", dim=16)

    def result(**limits):
        return sorted(map(tuple, hybrid_search(docs, asked, 3, {"n": {"$lt": 30}}, **limits).collect()))

    assert result() == result(max_rows=0, vector_leg=lambda d, q, k: V.vector_topk(d, q, k, 0))
