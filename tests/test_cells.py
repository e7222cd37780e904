import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from lodestone.client import Client
from lodestone.operators import cells as C
from lodestone.operators.mutate import upsert_rows
from lodestone.sources.store import Store


def blobs(n, seed=3, dim=8):
    # Questions and documents lie around the same points.
    homes = np.random.default_rng(1).normal(size=(10, dim)) * 4
    rng = np.random.default_rng(seed)
    return (homes[rng.integers(0, 10, n)] + rng.normal(size=(n, dim))).astype(np.float32)


def add(store, vectors, first=0, collection="c"):
    rows = [(collection, f"v{first + i:04d}", "", "{}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    batch = store.next_batch()
    frame = store.spark.createDataFrame(rows, "collection_id string, id string, text string, metadata string, embedding array<float>")
    store.write("documents", batch, upsert_rows(frame, batch))
    store.commit(batch, ["documents"])


def asking(spark, vectors):
    rows = [("c", f"q{i:03d}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "collection_id string, q_id string, embedding array<float>")


def nearest(ids, vectors, asked, k):
    found = set()
    for i, q in enumerate(asked):
        gaps = ((vectors.astype(float) - q.astype(float)) ** 2).sum(axis=1)
        order = sorted(range(len(ids)), key=lambda j: (gaps[j], ids[j]))[:k]
        found |= {(f"q{i:03d}", ids[j]) for j in order}
    return found


def pairs(hits):
    return {(r.q_id, r.id) for r in hits.select("q_id", "id").collect()}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_cell_counts_follow_the_size():
    assert [C.cells_for(n) for n in (0, 1, 100, 10_000)] == [1, 2, 20, 200]
    assert C.cells_for(10**12) == C.MAX_CELLS


def test_calibration_reaches_its_recall():
    vectors = blobs(2000).astype(float)
    made = C.train(vectors, 90, 0.95)
    assert 1 <= made.n_probe < 30
    near, own = C._nearest_centres(vectors, made.centres, made.n_probe), C._nearest_centres(vectors, made.centres, 1)[:, 0]
    gaps = C.rough_distances(vectors[:200], vectors)
    true = np.argsort(gaps, axis=1)[:, 1:11]
    assert np.mean([[own[j] in near[i] for j in true[i]] for i in range(200)]) > 0.9


def test_all_cells_are_exact_and_few_cells_nearly(spark, store):
    vectors, asked = blobs(600), blobs(25, seed=4)
    ids = [f"v{i:04d}" for i in range(600)]
    add(store, vectors)
    made = store.build_cells("c")
    queries, true = asking(spark, asked), nearest(ids, vectors, asked, 5)
    everything = store.nearest_stored("c", queries, 5, n_probe=len(made.centres))
    assert pairs(everything) == true
    # The same rows where the queries do not fit the driver.
    assert pairs(store.nearest_stored("c", queries, 5, n_probe=len(made.centres), max_queries=3)) == true
    few = store.nearest_stored("c", queries, 5)
    assert len(pairs(few) & true) >= 0.9 * len(true)
    assert pairs(store.nearest_stored("c", queries, 5, max_queries=3)) == pairs(few)


def test_scan_opens_only_the_probed_cells(spark, store):
    add(store, blobs(400))
    store.build_cells("c")
    one = asking(spark, blobs(1, seed=5))
    plan = plan_of(store.nearest_stored("c", one, 3, n_probe=2))
    assert "PartitionFilters" in plan and "cell#" in plan.split("PartitionFilters")[1][:400]
    held, _ = store.indexed_vectors("c", store.cell_map("c")[0])
    found, centres = store.cell_map("c")[1], store.cell_map("c")[1].centres
    near = C._nearest_centres(blobs(1, seed=5).astype(float), centres, 2)[0]
    assert held.where(F.col("cell").isin([int(c) for c in near])).count() < 0.25 * found.n_docs


def test_new_changed_and_deleted_rows_after_the_index(spark, store):
    vectors = blobs(120)
    add(store, vectors[:80])
    store.build_cells("c")
    add(store, vectors[80:], first=80)
    add(store, -vectors[:10])
    store.delete_documents(spark.createDataFrame([("c", "v0011"), ("c", "v0100")], "collection_id string, id string"))
    now = np.vstack([-vectors[:10], vectors[10:]])
    keep = [i for i in range(120) if i not in (11, 100)]
    want = nearest([f"v{i:04d}" for i in keep], now[keep], now[:30], 4)
    queries = asking(spark, now[:30])
    assert pairs(store.nearest_stored("c", queries, 4, n_probe=1000)) == want
    store.compact()
    assert store.cell_map("c")[1].n_docs == 118
    assert pairs(store.nearest_stored("c", queries, 4, n_probe=1000)) == want


def test_edges(spark, store):
    # No index: exact. An index over nothing, then rows: the tail is searched. Copies rank by id.
    same = np.ones((5, 8), dtype=np.float32)
    queries = asking(spark, same[:1])
    assert store.nearest_stored("c", queries, 3).count() == 0
    store.build_cells("c")
    assert store.nearest_stored("c", queries, 3).count() == 0
    add(store, same)
    assert [r.id for r in store.nearest_stored("c", queries, 3).orderBy("rank").collect()] == ["v0000", "v0001", "v0002"]
    assert len(store.build_cells("c").centres) == 1
    assert [r.id for r in store.nearest_stored("c", queries, 3).orderBy("rank").collect()] == ["v0000", "v0001", "v0002"]
    nothing = queries.withColumn("embedding", F.lit(None).cast("array<float>"))
    assert store.nearest_stored("c", nothing, 3).count() == 0


def test_collection_searches_its_index(spark, tmp_path):
    docs = Client(spark, str(tmp_path / "s"), dim=32).create_collection("docs")
    words = ["heron", "pond", "frost", "mill", "reed", "otter", "lock", "ferry"]
    texts = [f"{words[i % 8]} {words[(i * 3 + 1) % 8]} number {i}" for i in range(60)]
    docs.add([str(i) for i in range(60)], texts)
    assert docs.build_index(asked=texts[:5]) == 16
    docs.add(["late"], ["otter frost arrives late"])
    exact = docs.query(["heron pond", "otter frost late"], 4)
    assert docs.query(["heron pond", "otter frost late"], 4, approximate=True, n_probe=16)["ids"] == exact["ids"]
    assert "late" in docs.query(["otter frost late"], 4, approximate=True)["ids"][0]


def test_snapshot_stays_as_it_was(spark, store):
    add(store, blobs(4))
    before = store.snapshot()
    add(store, blobs(3, seed=6), first=4)
    store.delete_documents(spark.createDataFrame([("c", "v0000")], "collection_id string, id string"))
    assert (before.documents("c").count(), store.documents("c").count()) == (4, 6)
    assert before.documents("c").count() == 4
