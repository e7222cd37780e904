from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from __spark_entry__ import oracle_sql, queries
from lodestone.llm.oracle import ORACLE
from lodestone.llm.queries import QUERIES
from lodestone.llm.toxicity import score, train
from lodestone.session import cut_lineage
from oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLE[name], SF_DIR) is None


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(queries()) and set(ORACLE) <= set(oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def near_copies_by_hand(docs):
    """The least id of each class, by all pairs of sets of words."""
    sets = {}
    for r in docs.collect():
        words = (r["text"] or "").lower().split()
        sets[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    least = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and least[a] != least[b]:
            low, high = sorted((least[a], least[b]))
            least = {i: low if x == high else x for i, x in least.items()}
    return set(least.values())


def test_every_stage_does_its_work(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = train(docs, labels)
    seen = {}
    for name, stage in P.STAGES:
        before, docs = docs, cut_lineage(stage(spark, docs, SF_DIR))
        seen[name] = docs
        if name == "toxicity":
            assert docs.count() == score(before, model).where("score < 0.5").count() < before.count()
        elif name == "near_dedup":
            assert {r[0] for r in docs.select("doc_id").collect()} == near_copies_by_hand(before) and docs.count() < before.count()
        elif name == "decontamination":
            gone = {r[0] for r in QUERIES["op1_decontaminate"](spark, SF_DIR).where("contaminated").select("doc_id").collect()}
            kept = {r[0] for r in docs.select("doc_id").collect()}
            assert kept == {r[0] for r in before.select("doc_id").collect()} - gone
        if name != "token_output":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert docs.exceptAll(before).count() == 0
    assert seen["token_output"].count() == seen["mixing"].count() > 0
    tokens = seen["token_output"].orderBy("doc_id").collect()
    assert [r["start"] for r in tokens] == [sum(r["n_tokens"] for r in tokens[:i]) for i in range(len(tokens))]
    assert seen["token_output"].where(F.col("n_tokens") < 1).count() == 0


def test_run_gives_the_last_stage(spark):
    assert P.run(spark, SF_DIR).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
