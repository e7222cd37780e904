import time

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from lodestone.operators import graph
from lodestone.plans.respond import render_triples

EDGES = [
    ("Vistula", "rises in", "Beskids"),
    ("Vistula", "passes", "Torun"),
    ("Beskids", "belong to", "Carpathians"),
    ("Torun", "hosts", "Copernicus House"),
]


def edges(spark, rows=EDGES):
    return graph.identify_triples(
        spark.createDataFrame([("c", *r) for r in rows], "collection_id string, subject string, predicate string, object string")
    )


def ask(spark, *names, q="q", home="c"):
    return spark.createDataFrame([(q, home, n) for n in names], "q_id string, collection_id string, entity string")


@pytest.mark.parametrize("max_rows", [100_000, 0])
def test_neighbours(spark, max_rows):
    rows = edges(spark)

    def found(*names, **home):
        return graph.neighbours(rows, ask(spark, *names, **home), max_rows).collect()

    assert len(found("Vistula")) == 2 and len(found("Beskids")) == 2
    assert len(found("Vistula", "Beskids")) == 3 and len(found("Vistula", "Vistula")) == 2
    assert found("Vistula", home="other") == [] and found("nothing") == []
    assert found("Carpathians")[0].weight == 1.0


@pytest.mark.parametrize("max_rows", [100_000, 0])
def test_expansion(spark, max_rows):
    rows = edges(spark, EDGES + [("Copernicus House", "is", "Museum"), ("Museum", "stands in", "Torun"), ("Museum", "shows", "Globes")])
    hops = {r.predicate: r.hop for r in graph.expand(rows, ask(spark, "Vistula"), 3, max_rows).collect()}
    assert hops == {"rises in": 1, "passes": 1, "belong to": 2, "hosts": 2, "stands in": 2, "is": 3, "shows": 3}
    assert graph.expand(edges(spark), ask(spark, "Vistula"), 2).count() == 4
    assert graph.expand(edges(spark), ask(spark, "Vistula"), 9).count() == 4


def test_a_hub_with_a_third_of_all_edges(spark):
    many = spark.range(3000).select(
        F.lit("c").alias("collection_id"),
        F.when(F.col("id") % 3 == 0, "hub").otherwise(F.concat(F.lit("n"), F.col("id") % 97)).alias("subject"),
        F.lit("links").alias("predicate"),
        F.concat(F.lit("leaf"), "id").alias("object"),
    )
    rows = graph.identify_triples(many)
    for limit in (100_000, 0):
        found = graph.neighbours(rows, ask(spark, "hub", "n5"), limit)
        assert found.count() == rows.where("subject in ('hub', 'n5')").count()
        assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)


def test_last_write_of_an_edge_wins(spark):
    log = spark.createDataFrame(
        [("c", "a", "p", "b", "d1", None, 1), ("c", "a", "p", "b", "d2", 0.5, 2), ("k", "a", "p", "b", "d3", 0.1, 1)],
        "collection_id string, subject string, predicate string, object string, document_id string, weight double, seq long",
    )
    rows = {(r.collection_id, r.document_id, r.weight) for r in graph.latest_triples(graph.identify_triples(log)).collect()}
    assert rows == {("c", "d2", 0.5), ("k", "d3", 0.1)}


def test_extraction(spark):
    layout = "collection_id string, id string, text string"
    text = "Marie Curie taught at Sorbonne near Paris. She then led an institute with PTR. Then Marie Curie left."
    docs = spark.createDataFrame([("c", "d", text), ("c", "long", "Ada Lovelace met Bob " * 3000)], layout)
    pairs = graph.cooccurrence_triples(graph.extract_entities(docs)).collect()
    names = ["Marie Curie", "Sorbonne", "Paris", "PTR", "Then Marie Curie"]
    own = [r for r in pairs if r.document_id == "d"]
    assert {(r.subject, r.object) for r in own} >= {("Marie Curie", "Sorbonne"), ("Sorbonne", "PTR")}
    assert len(own) == len(names) * (len(names) - 1) // 2
    assert {(r.predicate, r.weight) for r in pairs} == {("related_to", 0.8)}
    assert any(r.document_id == "long" for r in pairs)  # a text of any length gives its entities


def test_unique_entities_keep_first_place_and_last_label(spark):
    mentions = spark.createDataFrame(
        [("c", "d", 0, "Ada", "Person"), ("c", "d", 1, "IBM", "Product"), ("c", "d", 2, "Ada", "Concept")],
        "collection_id string, id string, pos int, text string, label string",
    )
    rows = {(r.text, r.pos, r.label) for r in graph.unique_entities(mentions).collect()}
    assert rows == {("Ada", 0, "Concept"), ("IBM", 1, "Product")}


@pytest.mark.parametrize("max_rows", [100_000, 0])
def test_gazetteer_and_models(spark, max_rows):
    import pandas as pd

    docs = spark.createDataFrame([("c", "d", "The cape of good hope ferry, at Cape of Good Hope!")], "collection_id string, id string, text string")
    names = spark.createDataFrame([("Cape of Good Hope", "Location"), ("Cape of Good Hope Ferry", "Organization"), ("!", "None")], "text string, label string")
    rows = {(r.pos, r.text, r.label) for r in graph.gazetteer_entities(docs, names, max_rows).collect()}
    assert rows == {(1, "Cape of Good Hope", "Location"), (1, "Cape of Good Hope Ferry", "Organization"), (7, "Cape of Good Hope", "Location")}
    assert graph.gazetteer_entities(docs, names.limit(0), max_rows).count() == 0

    @F.pandas_udf("array<struct<text string, label string>>")
    def model(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"text": w, "label": "Concept"} for w in t.split()[:2]])

    assert [r.text for r in graph.extract_entities(docs, model).orderBy("pos").collect()] == ["The", "cape"]


def test_rendered_triples(spark):
    entities = spark.createDataFrame([("1", "c", "Beskids"), ("2", "c", "nobody")], "q_id string, collection_id string, entity string")
    lines = {(r.entity, r.part, r.line) for r in render_triples(entities, graph.neighbours(edges(spark), entities)).collect()}
    assert lines == {
        ("Beskids", 0, "Knowledge about 'Beskids':"),
        ("Beskids", 1, "- Vistula rises in Beskids"),
        ("Beskids", 1, "- Beskids belong to Carpathians"),
        ("nobody", 0, "No knowledge found for 'nobody'"),
    }


def test_no_hops_reach_nothing(spark):
    rows = edges(spark)
    assert graph.expand(rows, ask(spark, "Vistula"), 0).collect() == []
    assert graph.expand(rows, ask(spark, "Vistula"), 0).columns == graph.expand(rows, ask(spark, "Vistula"), 1).columns


def test_runs_of_names_are_spelled_from_one_list_of_words(spark, monkeypatch):
    """A hundred thousand mentions of long names in one text take a task less than two seconds of CPU."""
    kind, tasks = type(spark.range(1)), []
    run = kind.mapInArrow

    def noting(df, task, schema):
        tasks.append((df, task))
        return run(df, task, schema)

    monkeypatch.setattr(kind, "mapInArrow", noting)
    docs = spark.createDataFrame([("c", "1", "Stea " * 50_000)], "collection_id string, id string, text string")
    names = spark.createDataFrame([("stea " * n, "X") for n in (60, 61)], "text string, label string")
    graph.gazetteer_entities(docs, names)
    df, task = tasks[-1]
    batches = df.toArrow().combine_chunks().to_batches()
    began = time.process_time()
    found = [b for batch in task(iter(batches)) for b in batch.column("words").to_pylist()]
    assert time.process_time() - began < 2
    assert sorted(map(len, found)) == [60 * 5 - 1] * (50_000 - 59) + [61 * 5 - 1] * (50_000 - 60)
