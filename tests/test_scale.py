import random

import numpy as np

from conftest import plan_of
from lodestone.functions.embedding import embed
from lodestone.llm import occurrence as O
from lodestone.operators import dedup as D
from lodestone.operators import keyword as K
from lodestone.operators import vector as V
from lodestone.session import BATCH_BYTES, cut_lineage, equi_join


def test_a_counted_side_beyond_the_bound_is_never_broadcast(spark):
    big = cut_lineage(spark.range(1000).selectExpr("id % 7 as k", "id"))
    small = cut_lineage(spark.range(5).selectExpr("id as k", "id * 2 as v"))
    for how in ("inner", "left_semi", "left_anti"):
        for salts in (1, 4):
            joined = equi_join(big, small, ["k"], how, spread=["id"], max_rows=2, salts=salts)
            assert "Broadcast" not in plan_of(joined)
            assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, big.join(small, ["k"], how).collect()))


def _texts(spark, n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    rows = [
        (rng.choice(["a", "b", None]), f"d{rng.randrange(n) if i % 9 == 0 else i}", " ".join(rng.choices(words, range(1, 13), k=rng.randrange(9))))
        for i in range(n)
    ]
    asked = [(f"q{i % 25}", rng.choice(["a", "b", "none"]), " ".join(rng.choices(words, k=rng.randrange(4)))) for i in range(30)]
    return (
        spark.createDataFrame(rows, "collection_id string, id string, text string").repartition(3).cache(),
        spark.createDataFrame(asked, "q_id string, collection_id string, query_text string"),
    )


def test_scores_in_the_tasks_equal_the_joins_bit_by_bit(spark, monkeypatch):
    monkeypatch.setattr(K, "CELLS_AT_ONCE", 200)
    docs, asked = _texts(spark, 300, 3)
    only = docs.where("hash(id) % 3 = 0")
    index = K.KeywordIndex.of(docs)
    for options in (
        {}, {"mode": "or"}, {"mode": "or", "exclude": "w3"}, {"mode": "or", "only": only}, {"only": only, "exclude": "w1"},
        {"prefix": True}, {"mode": "or", "prefix": True, "stats_scope": "collection"}, {"stats_scope": "collection"},
    ):
        def rows(**more):
            found = K.keyword_topk(index, asked, 4, **options, **more)
            return sorted((r.q_id, r.collection_id, r["rank"], r.id, r.bm25) for r in found.collect())

        assert rows() == rows(max_rows=0), options
        assert rows()


def test_pairs_of_documents_and_queries_are_not_shuffled(spark):
    docs, asked = _texts(spark, 60, 4)
    for mode in ("and", "or"):
        plan = plan_of(K.keyword_topk(K.KeywordIndex.of(docs), asked, 4, mode=mode))
        assert plan.count("MapInArrow") == 1 and "SortMergeJoin" not in plan


def test_long_texts_and_many_short_ones_are_counted_in_parts(spark, monkeypatch):
    from lodestone.functions import embedding as E

    docs, _ = _texts(spark, 80, 5)

    def rows():
        made = embed(docs, dim=8).select("id", "text", "embedding")
        return sorted(map(str, made.collect())), sorted(map(str, K.build_postings(docs, with_lengths=True).collect()))

    whole = rows()
    monkeypatch.setattr(K, "WORDS_AT_ONCE", 3)
    monkeypatch.setattr(E, "WORDS_AT_ONCE", 3)
    assert rows() == whole


def test_names_of_any_length_are_found_without_spelling_every_run(spark, monkeypatch):
    from lodestone.operators import graph

    rng = random.Random(8)
    words = ["ann", "bo", "cy", "di"]
    rows = [("c", f"d{i % 35}", " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(40)]
    names = [" ".join(rng.choices(words, k=k)) for k in (*range(1, 14), 2, 3, 5) for _ in range(3)] + [rows[5][2], "", rows[7][2].upper()]
    names = [(n, f"L{i % 2}") for i, n in enumerate(names)]
    docs = spark.createDataFrame(rows, "collection_id string, id string, text string").repartition(3)
    gazetteer = spark.createDataFrame(names, "text string, label string")
    want = sorted(
        (i, at, name, label)
        for _, i, text in rows
        for name, label in names
        for at in range(len(text.split()))
        if name and text.split()[at : at + len(name.split())] == name.lower().split()
    )
    for at_once in (2_000_000, 5):
        monkeypatch.setattr(graph, "NAMES_AT_ONCE", at_once)
        monkeypatch.setattr(graph, "WORDS_AT_ONCE", at_once)
        found = graph.gazetteer_entities(docs, gazetteer)
        assert sorted((r.id, r.pos, r.text, r.label) for r in found.collect()) == want
    assert plan_of(found).count("Generate") == 0
    assert graph.gazetteer_entities(docs, gazetteer.limit(0)).columns == found.columns


def test_no_hop_broadcasts_a_large_frontier(spark, monkeypatch):
    from lodestone.operators import graph

    plans = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df: plans.append(plan_of(df)) or cut_lineage(df))
    rows = [("c", f"n{i}", "to", f"n{i * 2 + j}") for i in range(1, 30) for j in (0, 1)]
    edges = graph.identify_triples(spark.createDataFrame(rows, "collection_id string, subject string, predicate string, object string"))
    asked = spark.createDataFrame([("q", "c", "n1")], "q_id string, collection_id string, entity string")
    found = graph.expand(cut_lineage(edges), asked, 3, max_rows=0)
    assert {(r.subject, r.object): r.hop for r in found.collect()} == {(f"n{i}", f"n{i * 2 + j}"): i.bit_length() for i in range(1, 8) for j in (0, 1)}
    assert len(plans) == 5 and not any("Broadcast" in p for p in plans)


def test_a_screen_in_single_floats_changes_no_duplicate(monkeypatch):
    monkeypatch.setattr(D, "TILE", (7, 11))
    rng = np.random.default_rng(5)
    for size in (1e-20, 1.0, 1e4, 1e20):
        stored = (rng.normal(size=(60, 16)) * size).astype(np.float32).astype(float)
        step = rng.normal(size=(60, 16))
        step *= size * np.sqrt(0.1) / np.linalg.norm(step, axis=1)[:, None]
        new = np.concatenate([stored + step * x for x in (0.0, 0.9, 1 - 1e-7, 1 + 1e-7, 1.1)]).astype(np.float32).astype(float)
        threshold = 0.1 * size * size
        exact = D.exact_distances(new[:, None, :], stored[None, :, :])
        assert (D._close_to_any(new, stored, threshold) == (exact <= threshold).any(axis=1)).all()
        odd = np.concatenate([stored, np.full((1, 16), np.nan)])
        hit = D._close_to_any(new, odd, threshold)
        assert not (hit & ~(exact <= threshold).any(axis=1)).any()


def test_a_vector_goes_out_once_for_a_group_of_cells(spark, monkeypatch):
    rng = np.random.default_rng(6)

    def frame(prefix, vectors):
        rows = [("c", f"{prefix}{i}", [float(x) for x in v]) for i, v in enumerate(vectors)]
        return spark.createDataFrame(rows, "collection_id string, id string, embedding array<float>")

    stored = rng.normal(size=(300, 8))
    new = np.concatenate([stored[:40] + 0.1 * rng.normal(size=(40, 8)), rng.normal(size=(40, 8))])
    asked = []

    def blocks(docs, queries, keys, rows):
        asked.append(queries.groupBy("q_id").count().agg({"count": "max"}).first()[0])
        return V.into_blocks(docs, queries, keys, rows)

    monkeypatch.setattr(D, "into_blocks", blocks)
    store, arrived = frame("s", stored), frame("n", new)
    found = {r["id"] for r in D.near_duplicates(arrived, store, 0.5, max_new=0, n_cells=128).collect()}
    near = (D.exact_distances(new[:, None, :], stored[None, :, :]) <= 0.5).any(axis=1)
    assert found == {f"n{i}" for i in np.flatnonzero(near)} and 0 < len(found) < 80
    assert asked and asked[0] <= D.GROUPS


def test_texts_go_to_the_workers_in_small_batches(spark, monkeypatch):
    mark = O._mark

    def watched(batches, k):
        def small():
            for batch in batches:
                assert batch.nbytes < 2 * BATCH_BYTES
                yield batch

        yield from mark(small(), k)

    monkeypatch.setattr(O, "_mark", watched)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    docs = spark.range(3000).coalesce(1).selectExpr("id AS doc_id", "concat_ws(' ', id, repeat('word ', 2000)) AS text")
    assert O.drop_similar(docs).count() == 3000
    assert spark.conf.get(key, None) == before
