import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.client import Client
from conftest import plan_of
from lodestone.operators.mutate import collapse_batch, latest_rows, upsert_rows
from lodestone.plans.ingest import chunk_rows, ingest_files
from lodestone.sources.batches import batch_of, unnest_batches
from lodestone.sources.files import read_text_files
from lodestone.streaming import ingest_stream


@pytest.fixture
def client(spark, tmp_path):
    return Client(spark, str(tmp_path / "store"), dim=64)


def test_collections(client):
    first = client.create_collection("docs", {"a": 1})
    again = client.create_collection("docs", {"a": 2})
    assert again.collection_id == first.collection_id
    assert [(r.name, json.loads(r.metadata)) for r in client.list_collections().collect()] == [("docs", {"a": 1})]
    with pytest.raises(ValueError):
        client.get_collection("images")
    first.add(["1"], ["some text"])
    client.delete_collection("docs")
    assert client.list_collections().count() == 0 and client.store.documents().count() == 0
    anew = client.get_or_create_collection("docs")
    assert anew.collection_id != first.collection_id and anew.documents().count() == 0


def test_tenants_do_not_meet(spark, tmp_path):
    ada, bob = (Client(spark, str(tmp_path / "s"), tenant_id=t, dim=16) for t in ("ada", "bob"))
    ada.create_collection("docs").add(["1"], ["apple pie"])
    bob.create_collection("docs").add(["2"], ["apple tart"])
    with pytest.raises(ValueError):
        ada.create_collection("docs")
    assert ada.get_collection("docs").query(["apple"])["ids"] == [["1"]]
    assert [r.name for r in bob.list_collections().collect()] == ["docs"]


def test_hybrid_query_and_isolation(client):
    docs = client.create_collection("documents")
    texts = ["Gate K7 leads to the harbour ferry", "Nobody may pass gate K7 at night", "Lighthouses blink in steady rhythm."]
    assert docs.add(["p", "q", "r"], texts) == {"count": 3, "skipped": 0, "triples_extracted": 0}
    client.create_collection("plans").add(["s"], ["Drawing of gate K7"], [{"tag": "paper"}])
    answer = docs.query(["K7", "steady lighthouses", "zzz"], n_results=2)
    assert set(answer["ids"][0]) == {"p", "q"} and answer["ids"][1][0] == "r"
    assert len(answer["ids"][2]) == 2 and answer["metadatas"][0] == [{}, {}]
    assert answer["distances"][1] == sorted(answer["distances"][1], reverse=True)
    assert "[Source: unknown]\n" in docs.context(["K7"]).first()["context"]
    assert docs.render(["K7"], 1).first()["rendered"].startswith("--- Result 1 (Score: 0.0")


def test_upsert_delete_filter_and_compact(client):
    docs = client.create_collection("docs")
    docs.add(["a", "b", "a"], ["first text", "second text", "third words"], [{"n": 1}, {"n": 2}, {"n": 3}])
    assert {r.id: r.text for r in docs.documents().collect()} == {"a": "third words", "b": "second text"}
    docs.add(["b", "c", ""], ["changed words", "", "x" * 17_000], [{"n": 4}, {}, {}])
    assert docs.query(["second"], 5, {"n": 2})["ids"] == [[]]
    assert docs.query(["changed"], 5, {"n": {"$gte": 4}})["ids"] == [["b"]]
    docs.delete(["a"])
    before = sorted(docs.query(["words"], 5)["ids"][0])
    assert before == ["", "b", "c"]
    index = client.store.keyword_index()
    assert index.lengths.count() == 3 and index.postings.where("id = 'a'").count() == 0
    client.store.compact()
    assert sorted(docs.query(["words"], 5)["ids"][0]) == before
    assert client.store.log("documents").count() == 3
    docs.add(["a"], ["words again"])
    assert docs.query(["again"], 1)["ids"] == [["a"]]


def test_duplicates(client):
    docs = client.create_collection("docs")
    first = "Nine grey herons wait beside our frozen mill pond"
    assert docs.add(["a"], [first], [{"n": 1}], deduplicate=True)["count"] == 1
    assert docs.add(["b"], [first], deduplicate=True) == {"count": 0, "skipped": 1, "triples_extracted": 0}
    near = "Nine grey herons waited beside the frozen mill pond"
    assert docs.add(["c"], [near], deduplicate=True)["count"] == 1
    assert docs.add(["d", "e"], [near + "!", "Tides turn twice a day"], deduplicate=True) == {
        "count": 1, "skipped": 1, "triples_extracted": 0
    }
    last = "Nine grey herons waited beside the frozen mill race"
    assert docs.add(["f"], [last], deduplicate=True, similarity_threshold=0.6)["skipped"] == 1


def test_an_edge_keeps_the_last_document(client):
    docs = client.create_collection("docs")
    docs.add(["z", "a"], ["We saw Lake Como and Villa Erba.", "They saw Lake Como and Villa Erba."], extract_graph=True)
    edge = client.store.triples(docs.collection_id).where("subject = 'Lake Como'").first()
    assert edge.document_id == "a"


def test_ids_of_tenants_and_files_do_not_meet(spark, client, tmp_path):
    rows = [("a:b", "c", "{}"), ("a", "b:c", "{}")]
    made = client.store.create_collections(spark.createDataFrame(rows, "tenant_id string, name string, metadata string"))
    assert made.select("collection_id").distinct().count() == 2
    for folder in ("x", "y"):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "notes.txt").write_text(f"Text of folder {folder}, " + "long enough to be a chunk of its own.")
    chunks = chunk_rows(read_text_files(spark, str(tmp_path / "in" / "*")))
    assert chunks.count() == 2 == chunks.select("id").distinct().count()


def test_a_number_is_committed_once(client):
    number = client.store.next_batch()
    client.store.commit(number, [])
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        client.store.commit(number, [])


def test_a_deleted_collection_shows_nothing(client):
    docs = client.create_collection("docs")
    docs.add(["a"], ["some text"])
    client.delete_collection("docs")
    assert docs.documents().count() == 0


def test_graph_of_a_collection(client):
    docs = client.create_collection("docs")
    text = "Marie Curie taught at Sorbonne near Paris. She then led an institute with PTR."
    assert docs.add(["d"], [text], [{"source": "notes"}], extract_graph=True)["triples_extracted"] == 6
    found = docs.query_graph(["Marie Curie"]).collect()
    assert {r.object for r in found} == {"Sorbonne", "Paris", "PTR"} and {r.weight for r in found} == {0.8}
    edges = [("Vistula", "rises in", "Beskids"), ("Beskids", "belong to", "Carpathians"), ("Vistula", "rises in", "Beskids")]
    assert docs.add_triples([dict(zip(("subject", "predicate", "object"), e)) for e in edges]) == 3
    assert docs.query_graph(["Vistula"]).count() == 1 and docs.query_graph(["Vistula"], hops=2).count() == 2


def test_uncommitted_rows_are_invisible(client):
    docs = client.create_collection("docs")
    docs.add(["a"], ["visible"])
    number = client.store.next_batch()
    lost = batch_of(client.spark, docs.collection_id, ["b"], ["lost"]).withColumn("embedding", F.lit(None).cast("array<float>"))
    client.store.write("documents", number, upsert_rows(lost, number))
    assert [r.id for r in docs.documents().collect()] == ["a"]
    docs.add(["c"], ["next"])
    assert sorted(r.id for r in docs.documents().collect()) == ["a", "c"]


def test_collection_reads_only_its_folder(client):
    docs = client.create_collection("docs")
    docs.add(["a"], ["one"])
    client.create_collection("other").add(["b"], ["two"])
    plan = docs.documents()._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(collection_id" in plan and docs.documents().count() == 1


def test_arrays(spark):
    rows = spark.createDataFrame([(["a", "b"], ["x", "y"], None), (["c"], ["z"], ['{"k":1}'])], "ids array<string>, documents array<string>, metadatas array<string>")
    assert [tuple(r) for r in unnest_batches(rows).orderBy("id").collect()] == [
        (0, "a", "x", "{}"), (1, "b", "y", "{}"), (0, "c", "z", '{"k":1}')
    ]
    bad = spark.createDataFrame([(["a", "b"], ["x"])], "ids array<string>, documents array<string>")
    with pytest.raises(Exception, match="same length"):
        unnest_batches(bad).collect()
    with pytest.raises(ValueError):
        batch_of(spark, "c", ["a"], [])


def test_text_files_to_chunks(client, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    (files / "one.txt").write_text("Ünïcode " * 10 + "\n\n" + "short\n\n" + "Later Ada Lovelace met Charles Babbage in London, they say so.", "utf-8")
    (files / "two.txt").write_text("line " * 20 + "\n" + "tiny", "utf-8")
    home = client.create_collection("files")
    summary = ingest_files(client.store, read_text_files(client.spark, str(files)), home.collection_id, dim=16).first()
    assert summary["count"] == 3 and summary["triples_extracted"] == 4 - 1
    chunks = {(json.loads(r.metadata)["source"], json.loads(r.metadata)["chunk"]) for r in home.documents().collect()}
    assert chunks == {("one.txt", 0), ("one.txt", 1), ("two.txt", 0)}


def test_stream_of_batches(client, tmp_path):
    home = client.create_collection("docs")
    source = tmp_path / "arriving"
    layout = "collection_id string, pos int, id string, text string, metadata string"
    batch_of(client.spark, home.collection_id, ["a", "b"], ["one", "two"]).write.parquet(str(source / "1"))

    def run():
        stream = client.spark.readStream.schema(layout).parquet(str(source / "*"))
        ingest_stream(client.store, stream, str(tmp_path / "checkpoint"), dim=16).awaitTermination()

    run()
    batch_of(client.spark, home.collection_id, ["b", "c"], ["changed", "three"]).write.parquet(str(source / "2"))
    run()
    assert {r.id: r.text for r in home.documents().collect()} == {"a": "one", "b": "changed", "c": "three"}


def test_ingest_joins_the_names_of_a_gazetteer(spark, tmp_path):
    long = " ".join(f"part{i}" for i in range(10))
    names = [("Lower Vistula Fen", "Place"), ("Jan Heweliusz", "Person"), ("Torun", "Place"), (long, "Work")]
    gazetteer = spark.createDataFrame(names, "text string, label string")
    docs = Client(spark, str(tmp_path / "g"), dim=16, gazetteer=gazetteer).create_collection("docs")
    texts = [f"In torun, jan heweliusz wrote {long}.", "The lower vistula fen is wide", ""]
    summary = docs.add(["a", "b", "c"], texts, extract_graph=True)
    assert summary["triples_extracted"] == 3
    found = {(r["subject"], r["object"]) for r in docs.query_graph(["Jan Heweliusz"]).collect()}
    assert found == {("Torun", "Jan Heweliusz"), ("Jan Heweliusz", long)}
    assert docs.query_graph(["Jan Heweliusz"], hops=0).collect() == []


def test_an_ingest_leaves_no_other_copy_of_the_texts(spark, tmp_path):
    """What a batch writes on its way to the store is deleted, and kept rows are not written twice."""
    from lodestone.session import shared_dir
    from lodestone.sources.store import Store

    texts = [f"Part {i} of the Northern Harbour plan names Ada Lovelace and pier {i * 7} with its many boats" for i in range(30)]
    files = spark.createDataFrame([(f"f{i}.txt", t) for i, t in enumerate(texts)], "source string, text string")
    base = os.path.dirname(shared_dir(spark, "none").removeprefix("file:"))
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    store = Store(spark, str(tmp_path / "store"))
    summary = ingest_files(store, files, "files", dim=16).collect()
    assert [(r["count"], r["skipped"]) for r in summary] == [(30, 0)] and store.documents().count() == 30
    left = [x for x in set(os.listdir(base)) - before if x.startswith("stage-")]
    assert left and not any("text" in spark.read.parquet(f"file:{base}/{x}").columns for x in left)


def test_a_batch_keeps_the_last_row_of_repeated_and_missing_ids(spark):
    rows = [("c", "1", 0, "a"), ("c", "1", 5, "b"), ("c", "2", 1, "c"), ("c", None, 2, "d"), ("c", None, 3, "e"), (None, "1", 4, "f"), ("d", "1", 0, "g")]
    batch = spark.createDataFrame(rows, "collection_id string, id string, pos int, text string")
    for some in (batch, batch.where("text <> 'a'"), batch.where("id = '2'")):
        expected = sorted(latest_rows(some, ["collection_id", "id"], ["pos"]).collect(), key=str)
        assert sorted(collapse_batch(some).collect(), key=str) == expected
    assert "Exchange" not in plan_of(collapse_batch(batch.where("id = '2'")))


def test_stored_documents_take_large_numbers_as_ids(spark, tmp_path):
    """Ids beyond 32 bits order a batch as others do."""
    from workload.queries import QUERIES

    first = 5_000_000_000
    docs = [(first + i, f"Text {i} about Green Harbour number {i}", "en", "src1", 30) for i in range(6)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(first, 1, 0), (first + 1, 0, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "green harbour")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r["id"] for r in QUERIES["stored_documents"](spark, str(tmp_path)).collect()} <= {str(d[0]) for d in docs}
    assert {r["id"] for r in QUERIES["stored_after_compact"](spark, str(tmp_path)).collect()} <= {str(d[0]) for d in docs} - {str(first + 1)}
