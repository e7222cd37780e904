"""Headline timings as one JSON line.

Reads $BENCH_SF_DIR on local[$BENCH_CPUS]. Every timing is the better of two
runs, so that JVM start-up and code generation are not counted. Searches run
against a store that the ingest step has written.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from lodestone.plans.ingest import ingest_batch  # noqa: E402
from lodestone.plans.search import hybrid_search  # noqa: E402
from lodestone.operators.keyword import keyword_topk  # noqa: E402
from lodestone.operators.vector import vector_topk  # noqa: E402
from lodestone.session import get_spark, shared_dir  # noqa: E402
from lodestone.sources.store import Store  # noqa: E402
from workload import tables as t  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = get_spark(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "16g",
            # Small tables: files of a few megabytes keep all cores busy.
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    n_docs = t.table(spark, SF_DIR, "documents").count()
    n_questions = t.table(spark, SF_DIR, "benchmark").count()
    timings: dict[str, float] = {}

    def measure(name, fn):
        best = None
        for _ in range(2):
            start = time.perf_counter()
            fn()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        timings[name] = round(best, 3)

    stores = []

    def ingest(**options):
        store = Store(spark, shared_dir(spark, "store"))
        names = spark.createDataFrame([("", "docs", "{}")], "tenant_id string, name string, metadata string")
        home = store.create_collections(names).first()["collection_id"]
        docs = t.documents(spark, SF_DIR).withColumns({"collection_id": F.lit(home), "pos": F.col("id").cast("int")})
        ingest_batch(store, docs, dim=t.DIM, **options).collect()
        stores.append((store, home))

    measure("ingest_all_documents", ingest)
    measure("ingest_all_documents_with_graph", lambda: ingest(extract_graph=True))
    store, home = stores[-1]
    questions = t.questions(spark, SF_DIR).withColumn("collection_id", F.lit(home)).cache()
    questions.count()
    documents, index = store.documents(home), store.keyword_index()
    where = {"$and": [{"lang": {"$in": ["en", "fr"]}}, {"n_chars": {"$gt": 300}}]}

    measure("vector_search_all_questions", lambda: run(vector_topk(documents, questions, 10)))
    measure("keyword_search_all_questions", lambda: run(keyword_topk(index, questions, 20)))
    measure("hybrid_search_all_questions", lambda: run(hybrid_search(documents, questions, 3, index=index)))
    measure("hybrid_search_filtered", lambda: run(hybrid_search(documents, questions, 10, where, index=index)))
    one = questions.limit(1).cache()
    one.count()
    measure("hybrid_search_one_question", lambda: run(hybrid_search(documents, one, 3, index=index)))

    for name in (
        "vector_topk_exact",
        "vector_topk_approximate",
        "where_nested",
        "where_json_nested",
        "upsert_latest",
        "near_duplicates_kept",
        "near_duplicates_partitioned",
        "triples_upserted",
        "graph_neighbours",
        "graph_expanded",
        "chunk_documents",
        "entity_pairs",
    ):
        measure(name, lambda: run(QUERIES[name](spark, SF_DIR)))

    total = round(sum(timings.values()), 3)
    rates = {
        "ingest_docs_per_sec": round(n_docs / timings["ingest_all_documents"], 1),
        "hybrid_ms_per_question": round(1000 * timings["hybrid_search_all_questions"] / n_questions, 2),
    }
    line = {"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": timings, "rates": rates, "sf": SF_DIR.rsplit("sf", 1)[-1]}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
