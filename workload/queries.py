"""One query per operator, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.embedding import embed
from lodestone.functions.keys import int_id
from lodestone.functions.metadata import decode_metadata, encode_metadata
from lodestone.functions.text import chunk_text, tokenize
from lodestone.functions.vectors import squared_l2
from lodestone.functions.where import TypedFields, VariantFields, compile_where
from lodestone.operators import graph, mutate, registry
from lodestone.operators.dedup import drop_near_duplicates, ingest_summary, near_duplicates
from lodestone.operators.fusion import fuse, fused_topk, keyword_only
from lodestone.operators.keyword import (
    KeywordIndex,
    build_postings,
    corpus_stats,
    document_lengths,
    keyword_topk,
    refresh_postings,
    term_stats,
)
from lodestone.operators.lookup import collection_sizes, lookup_documents, lookup_int_ids, matching_ids
from lodestone.operators.vector import cell_index, choose_pivots, vector_topk, vector_topk_ann
from lodestone.plans.ingest import chunk_rows, ingest_batch, ingest_files
from lodestone.plans.respond import assemble_context, render_results, render_triples, response_lists
from lodestone.plans.search import hybrid_search, vector_search
from lodestone.session import cut_lineage, shared_dir, spread
from lodestone.sources.batches import unnest_batches
from lodestone.sources.files import read_text_files
from lodestone.sources.store import Store
from workload import tables as t

QUERIES = {}

CELLS, PROBES = 16, 4
NEAR = 1.2


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _ranked(hits: DataFrame, value: str, digits: int = 6) -> DataFrame:
    return hits.select("q_id", "rank", "id", F.round(value, digits).alias(value))


# Vector search ---------------------------------------------------------------


@query
def vector_topk_exact(spark, sf_dir):
    docs = t.vectors(spark, sf_dir)
    return _ranked(vector_topk(docs, t.as_queries(docs), 5), "distance")


@query
def vector_topk_isolated(spark, sf_dir):
    docs = t.vectors(spark, sf_dir, "label")
    hits = vector_topk(docs, t.as_queries(docs), 5)
    return hits.select("q_id", "collection_id", "rank", "id", F.round("distance", 6).alias("distance"))


@query
def vector_topk_approximate(spark, sf_dir):
    docs = t.vectors(spark, sf_dir)
    pivots = choose_pivots(docs, CELLS)
    return _ranked(vector_topk_ann(cell_index(docs, pivots), pivots, t.as_queries(docs), 5, PROBES), "distance")


@query
def vector_ann_recall(spark, sf_dir):
    docs = t.vectors(spark, sf_dir)
    pivots = choose_pivots(docs, CELLS)
    queries = t.as_queries(docs)
    exact = vector_topk(docs, queries, 5).select("q_id", "id")
    found = vector_topk_ann(cell_index(docs, pivots), pivots, queries, 5, PROBES).select("q_id", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["q_id", "id"], "left").agg(
        F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found")
    )


@query
def vector_distance_to_class(spark, sf_dir):
    """Distance of every vector to the one that stands first in its class."""
    docs = t.vectors(spark, sf_dir)
    first = docs.groupBy("label").agg(F.min(F.struct(F.col("id").cast("long").alias("key"), "embedding")).alias("first"))
    return docs.join(F.broadcast(first), "label").select(
        "id", F.round(squared_l2(F.col("embedding"), F.col("first.embedding")), 6).alias("distance")
    )


@query
def vector_search_filtered(spark, sf_dir):
    docs = t.embedded(spark, sf_dir)
    hits = vector_search(docs, t.questions(spark, sf_dir), 5, {"lang": "en", "toxic": 0})
    return hits.select("q_id", "rank", "id", F.round("score", 6).alias("score"), F.length("text").alias("chars"))


@query
def vector_search_operators(spark, sf_dir):
    docs = t.embedded(spark, sf_dir)
    hits = vector_search(docs, t.questions(spark, sf_dir), 5, {"n_chars": {"$gte": 1000}, "quality": {"$ne": 1}}, operators=True)
    return hits.select("q_id", "rank", "id", F.round("score", 6).alias("score"))


# Filters ---------------------------------------------------------------------


def _typed_part(where):
    def run(spark, sf_dir):
        part = t.table(spark, sf_dir, "part")
        kept = part.where(compile_where(where, TypedFields.of(part)))
        return kept.select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")

    return run


def _typed_labelled(where):
    def run(spark, sf_dir):
        rows = t.labelled(spark, sf_dir)
        return rows.where(compile_where(where, TypedFields.of(rows))).select("doc_id", "lang", "quality", "toxic", "n_chars")

    return run


def _json_labelled(where):
    def run(spark, sf_dir):
        rows = t.documents(spark, sf_dir)
        fields = VariantFields(decode_metadata(F.col("metadata")))
        return rows.where(compile_where(where, fields)).select("id")

    return run


QUERIES.update(
    where_eq=_typed_part({"p_brand": "Brand#13"}),
    where_eq_null=_typed_labelled({"quality": None}),
    where_ne=_typed_labelled({"quality": {"$ne": 1}}),
    where_gt=_typed_part({"p_retailprice": {"$gt": 915}}),
    where_gte=_typed_part({"p_size": {"$gte": 25}}),
    where_lt=_typed_part({"p_size": {"$lt": 10.5}}),
    where_lte=_typed_labelled({"n_chars": {"$lte": 500}}),
    where_in=_typed_part({"p_type": {"$in": ["ECONOMY", "SMALL"]}}),
    where_nin=_typed_labelled({"quality": {"$nin": [1]}}),
    where_and=_typed_part({"$and": [{"p_type": "ECONOMY"}, {"p_size": {"$lt": 20}}]}),
    where_or=_typed_labelled({"$or": [{"lang": "fr"}, {"toxic": 1}]}),
    where_nested=_typed_part(
        {"$or": [{"$and": [{"p_type": "SMALL"}, {"p_size": {"$gt": 20, "$lte": 40}}]}, {"p_brand": {"$in": ["Brand#1", "Brand#2"]}}]}
    ),
    where_range=_typed_part({"p_retailprice": {"$gte": 901.5, "$lt": 910.25}, "p_size": {"$ne": 7}}),
    where_unknown_op=_typed_part({"$or": [{"p_size": {"$near": 5}}, {"p_brand": "Brand#13"}]}),
    where_eq_operator=_typed_part({"p_brand": {"$eq": "Brand#13"}}),
    where_json_eq=_json_labelled({"lang": "de", "quality": 1}),
    where_json_ne=_json_labelled({"quality": {"$ne": 1}}),
    where_json_range=_json_labelled({"n_chars": {"$gt": 500, "$lte": 2000.0}}),
    where_json_membership=_json_labelled({"source": {"$in": ["src1", "src2"]}, "toxic": {"$nin": [1, None]}}),
    where_json_nested=_json_labelled({"$or": [{"$and": [{"lang": "en"}, {"quality": 0}]}, {"toxic": True}, {"quality": "1"}]}),
)


@query
def where_json_events(spark, sf_dir):
    events = t.table(spark, sf_dir, "events")
    fields = VariantFields(decode_metadata(F.col("props")))
    kept = events.where(compile_where({"k": {"$gte": 50, "$nin": [60, 70]}}, fields))
    return kept.select("event_id", "user_id", "event_type", "props")


@query
def where_ids(spark, sf_dir):
    return matching_ids(t.documents(spark, sf_dir, "lang"), {"source": "src3", "quality": 1})


@query
def metadata_roundtrip(spark, sf_dir):
    docs = t.documents(spark, sf_dir).withColumn("value", decode_metadata(F.col("metadata")))
    return docs.select(
        "id",
        encode_metadata(F.map_from_arrays(F.array(F.lit("doc")), F.array("id"))).alias("encoded"),
        F.try_variant_get("value", "$.source", "string").alias("source"),
        F.try_variant_get("value", "$.quality", "int").alias("quality"),
    )


# Keyword search --------------------------------------------------------------


@query
def tokenize_terms(spark, sf_dir):
    return build_postings(t.documents(spark, sf_dir, "lang"))


@query
def postings_refreshed(spark, sf_dir):
    docs = t.documents(spark, sf_dir, "lang")
    changed = docs.where(F.col("collection_id") == "fr").withColumn("text", F.concat_ws(" ", "text", F.lit("Été refreshed")))
    removed = docs.where(F.col("collection_id") == "es")
    rows = refresh_postings(build_postings(docs), changed, removed)
    return rows.groupBy("collection_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query
def corpus_statistics(spark, sf_dir):
    lengths = document_lengths(t.documents(spark, sf_dir, "lang"))
    stats = corpus_stats(lengths).unionByName(corpus_stats(lengths, "collection"))
    return stats.select("scope", "n_docs", F.round("avg_dl", 6).alias("avg_dl"))


@query
def term_statistics(spark, sf_dir):
    return term_stats(build_postings(t.documents(spark, sf_dir)))


def _keyword(**options):
    def run(spark, sf_dir):
        docs = t.documents(spark, sf_dir)
        queries = t.questions(spark, sf_dir)
        return _ranked(keyword_topk(KeywordIndex.of(docs), queries, 10, **options), "bm25")

    return run


QUERIES.update(
    keyword_bm25=_keyword(),
    keyword_any=_keyword(mode="or"),
    keyword_any_excluding=_keyword(mode="or", exclude="license"),
    keyword_prefix=_keyword(mode="or", prefix=True),
)


@query
def keyword_per_collection(spark, sf_dir):
    docs = t.documents(spark, sf_dir, "lang")
    queries = t.questions_per_language(spark, sf_dir)
    return _ranked(keyword_topk(KeywordIndex.of(docs), queries, 10, mode="or", stats_scope="collection"), "bm25")


# Fusion and hybrid search ----------------------------------------------------


def _legs(spark, sf_dir, k=10):
    docs, queries = t.embedded(spark, sf_dir), t.questions(spark, sf_dir)
    return vector_topk(docs, queries, k), keyword_topk(KeywordIndex.of(docs), queries, 2 * k, mode="or")


@query
def rrf_fusion(spark, sf_dir):
    fused = fuse(*_legs(spark, sf_dir))
    return fused.select("q_id", "id", "vec_rank", "kw_rank", "source", F.round("score", 10).alias("score"))


@query
def rrf_topk(spark, sf_dir):
    return _ranked(fused_topk(fuse(*_legs(spark, sf_dir)), 10), "score", 10)


@query
def keyword_hits_only(spark, sf_dir):
    return keyword_only(*_legs(spark, sf_dir)).select("q_id", "id", "rank")


def _hybrid(spark, sf_dir, **options):
    docs = t.embedded(spark, sf_dir)
    return hybrid_search(docs, t.questions(spark, sf_dir), 10, **options)


@query
def hybrid_search_all(spark, sf_dir):
    rows = _hybrid(spark, sf_dir)
    return rows.select("q_id", "rank", "id", F.round("score", 10).alias("score"), "source", F.length("text").alias("chars"))


HYBRID_WHERE = {"$and": [{"lang": {"$in": ["en", "fr"]}}, {"n_chars": {"$gt": 300}}]}


@query
def hybrid_search_filtered(spark, sf_dir):
    return _ranked(_hybrid(spark, sf_dir, where=HYBRID_WHERE, mode="or"), "score", 10)


@query
def hybrid_search_prefilter(spark, sf_dir):
    return _ranked(_hybrid(spark, sf_dir, where=HYBRID_WHERE, mode="or", filter_mode="pre"), "score", 10)


@query
def hybrid_search_isolated(spark, sf_dir):
    docs = t.embedded(spark, sf_dir, "lang")
    return _ranked(hybrid_search(docs, t.questions_per_language(spark, sf_dir), 5), "score", 10)


# Responses -------------------------------------------------------------------


def _answers(spark, sf_dir):
    docs, queries = t.embedded(spark, sf_dir), t.questions(spark, sf_dir)
    return queries, vector_search(docs, queries, 3)


@query
def result_lists(spark, sf_dir):
    docs, queries = t.embedded(spark, sf_dir), t.questions(spark, sf_dir)
    lists = response_lists(queries, vector_search(docs, queries, 3, {"lang": "de"}))

    def joined(column):
        return F.array_join(column, ",").alias(column)

    return lists.select(
        "q_id",
        joined("ids"),
        F.array_join(F.transform("documents", lambda d: F.md5(d)), ",").alias("documents"),
        F.size("metadatas").alias("n_metadatas"),
        F.array_join(F.transform("distances", lambda d: F.format_string("%.4f", d)), ",").alias("distances"),
    )


@query
def result_text(spark, sf_dir):
    return render_results(_answers(spark, sf_dir)[1]).select("q_id", F.md5("rendered").alias("rendered"))


@query
def result_context(spark, sf_dir):
    return assemble_context(_answers(spark, sf_dir)[1]).select("q_id", F.md5("context").alias("context"))


# Keys and batches ------------------------------------------------------------


@query
def document_int_ids(spark, sf_dir):
    return t.documents(spark, sf_dir).select("id", int_id(F.col("id")).alias("int_id"))


@query
def triple_identities(spark, sf_dir):
    return t.star_triples(spark, sf_dir).select("triple_id", "subject", "predicate", "object", "weight")


@query
def batch_rows(spark, sf_dir):
    """Documents packed into batches of at most 50 ids, then unpacked again."""
    docs = t.table(spark, sf_dir, "documents")
    row = F.struct("doc_id", "text")
    batches = docs.groupBy(F.expr("doc_id div 50").alias("batch")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    arrays = batches.select(
        "batch",
        F.transform("rows", lambda r: r["doc_id"].cast("string")).alias("ids"),
        F.transform("rows", lambda r: r["text"]).alias("documents"),
    )
    return unnest_batches(arrays, "batch").select("batch", "pos", "id", F.length("text").alias("chars"), "metadata")


@query
def text_files(spark, sf_dir):
    """The benchmark texts as a folder with one file each, read back whole."""
    folder = shared_dir(spark, "files")
    t.table(spark, sf_dir, "benchmark").select("text").write.option("maxRecordsPerFile", 1).text(folder)
    files = read_text_files(spark, folder)
    return files.select(F.md5("text").alias("content"), F.length("text").alias("chars"), F.endswith(F.col("source"), F.lit(".txt")).alias("named"))


@query
def documents_looked_up(spark, sf_dir):
    docs = t.documents(spark, sf_dir, "lang")
    keys = t.labelled(spark, sf_dir).where(F.col("toxic") == 1).select(
        F.col("lang").alias("collection_id"), F.col("doc_id").cast("string").alias("id")
    )
    return lookup_documents(docs, keys).select("collection_id", "id", "metadata")


@query
def documents_by_label(spark, sf_dir):
    docs = t.documents(spark, sf_dir).withColumn("int_id", int_id(F.col("id")))
    labels = t.vectors(spark, sf_dir).select(F.lit("docs").alias("collection_id"), int_id(F.col("id")).alias("int_id"))
    return lookup_int_ids(docs, labels).select("id", "int_id")


# Registry, upserts, deletes --------------------------------------------------


def _registry(spark, sf_dir):
    """A registry log: the languages are collections, created in batch 1."""
    wanted = t.table(spark, sf_dir, "documents").select(
        F.lit("").alias("tenant_id"), F.col("lang").alias("name"), F.lit('{"kind": "language"}').alias("metadata")
    ).distinct()
    empty = spark.createDataFrame([], "collection_id string, tenant_id string, name string, metadata string, seq long, op string")
    return registry.create_collections(empty, wanted, 1)


@query
def collections_list(spark, sf_dir):
    return registry.current_collections(_registry(spark, sf_dir)).select("collection_id", "name", "metadata")


@query
def collections_get_or_create(spark, sf_dir):
    """Ask for languages and sources: the languages exist and keep their metadata."""
    log = _registry(spark, sf_dir)
    docs = t.table(spark, sf_dir, "documents")
    wanted = docs.select(
        F.lit("").alias("tenant_id"), F.explode(F.array("lang", "source")).alias("name"), F.lit('{"kind": "new"}').alias("metadata")
    ).distinct()
    grown = log.unionByName(registry.create_collections(log, wanted, 2))
    return registry.get_collections(grown, wanted).select("collection_id", "name", "metadata")


@query
def collection_counts(spark, sf_dir):
    return collection_sizes(t.documents(spark, sf_dir, "lang"))


@query
def collection_deleted(spark, sf_dir):
    """The documents that remain when the collections of two languages are deleted."""
    log = _registry(spark, sf_dir)
    names = log.where(F.col("name").isin("fr", "es")).select("tenant_id", "name")
    log = log.unionByName(registry.delete_collections(log, names, 2))
    ids = _registry(spark, sf_dir).select("collection_id", F.col("name").alias("lang"))
    docs = t.table(spark, sf_dir, "documents").join(F.broadcast(ids), "lang")
    return registry.in_live_collections(docs, log, "doc_id").select("doc_id", "lang")


@query
def upsert_latest(spark, sf_dir):
    events = t.table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value", "props")
    last = mutate.latest_rows(events, ["user_id", "event_type"], ["ts", "event_id"])
    return last.select("user_id", "event_type", "event_id", "value", "props")


def _document_log(spark, sf_dir):
    """Batch 1 adds all documents, batch 2 replaces the labelled ones, batch 3 deletes the toxic ones."""
    docs = t.documents(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>"))
    value = decode_metadata(F.col("metadata"))
    changed = docs.where(F.try_variant_get(value, "$.quality", "int").isNotNull()).withColumn(
        "text", F.concat_ws(" ", F.lit("v2"), "text")
    )
    removed = docs.where(F.try_variant_get(value, "$.toxic", "int") == 1)
    log = mutate.upsert_rows(docs, 1).unionByName(mutate.upsert_rows(changed, 2))
    return log.unionByName(mutate.delete_rows(removed, 3))


@query
def documents_latest(spark, sf_dir):
    rows = mutate.latest_documents(_document_log(spark, sf_dir))
    return rows.select("id", "int_id", F.substring("text", 1, 2).alias("start"), F.length("text").alias("chars"))


@query
def versions_replaced(spark, sf_dir):
    rows = mutate.stale_versions(_document_log(spark, sf_dir))
    return rows.select("id", F.expr(f"seq div {mutate.BATCH_STEP}").alias("batch"))


# Duplicates and ingest -------------------------------------------------------


def _arrivals(spark, sf_dir):
    """Vectors of the classes 7 to 9 arrive, the others are stored."""
    rows = t.vectors(spark, sf_dir)
    return rows.where("label >= 7"), rows.where("label < 7")


@query
def near_duplicates_kept(spark, sf_dir):
    return drop_near_duplicates(*_arrivals(spark, sf_dir), NEAR).select("id", "label")


@query
def near_duplicates_skipped(spark, sf_dir):
    return near_duplicates(*_arrivals(spark, sf_dir), NEAR).select("id", "label")


@query
def near_duplicates_partitioned(spark, sf_dir):
    """The same rows through the plan for batches too large to broadcast."""
    return near_duplicates(*_arrivals(spark, sf_dir), NEAR, max_new=0, n_cells=32).select("id", "label")


@query
def ingest_counts(spark, sf_dir):
    new, stored = _arrivals(spark, sf_dir)
    return ingest_summary(new, drop_near_duplicates(new, stored, NEAR))


def _filled_store(spark, sf_dir):
    """Labelled documents are stored first; the others follow with duplicate check and graph."""
    store = Store(spark, shared_dir(spark, "store"))
    docs = t.documents(spark, sf_dir).withColumn("pos", F.col("id").cast("long"))
    is_labelled = F.get_json_object("metadata", "$.quality").isNotNull()
    collection = spark.createDataFrame([("", "docs", "{}")], "tenant_id string, name string, metadata string")
    home = store.create_collections(collection).select("collection_id").first()[0]
    docs = docs.withColumn("collection_id", F.lit(home))
    ingest_batch(store, docs.where(is_labelled), dim=t.DIM)
    summary = ingest_batch(store, docs.where(~is_labelled), deduplicate=True, extract_graph=True, dim=t.DIM)
    return store, summary


@query
def ingest_documents(spark, sf_dir):
    return _filled_store(spark, sf_dir)[1].select("count", "skipped", "triples_extracted")


@query
def ingest_stored(spark, sf_dir):
    rows = _filled_store(spark, sf_dir)[0].documents()
    return rows.select("id", "int_id", F.length("text").alias("chars"), F.size("embedding").alias("dim"))


def _home(store):
    return store.collections().first()["collection_id"]


@query
def stored_documents(spark, sf_dir):
    """The documents of one stored collection."""
    store = _filled_store(spark, sf_dir)[0]
    return store.documents(_home(store)).select("id", F.md5("text").alias("text"), "metadata")


@query
def stored_triples(spark, sf_dir):
    """The edges of one stored collection, each with the last document that has it."""
    store = _filled_store(spark, sf_dir)[0]
    return store.triples(_home(store)).select("subject", "predicate", "object", "document_id", "weight")


def _without_toxic(spark, sf_dir):
    store = _filled_store(spark, sf_dir)[0]
    toxic = t.table(spark, sf_dir, "labels").where("toxic = 1").select(F.lit(_home(store)).alias("collection_id"), F.col("doc_id").cast("string").alias("id"))
    store.delete_documents(toxic)
    return store


@query
def stored_after_delete(spark, sf_dir):
    store = _without_toxic(spark, sf_dir)
    return store.documents(_home(store)).select("id", F.length("text").alias("chars"))


def _stored_questions(spark, sf_dir, store):
    return t.questions(spark, sf_dir).withColumn("collection_id", F.lit(_home(store)))


@query
def stored_keyword_search(spark, sf_dir):
    """Search in the stored postings, of which some documents were deleted."""
    store = _without_toxic(spark, sf_dir)
    return _ranked(keyword_topk(store.keyword_index(), _stored_questions(spark, sf_dir, store), 10, mode="or"), "bm25")


@query
def stored_after_compact(spark, sf_dir):
    """The same search after compaction."""
    store = _without_toxic(spark, sf_dir)
    store.compact()
    return _ranked(keyword_topk(store.keyword_index(), _stored_questions(spark, sf_dir, store), 10, mode="or"), "bm25")


@query
def stored_hybrid_search(spark, sf_dir):
    """Both legs over the stored documents, vectors and postings."""
    store = _filled_store(spark, sf_dir)[0]
    docs, queries = store.documents(_home(store)), _stored_questions(spark, sf_dir, store)
    return _ranked(hybrid_search(docs, queries, 5, index=store.keyword_index(), mode="or"), "score", 10)


@query
def embed_text(spark, sf_dir):
    rows = t.embedded(spark, sf_dir).select("id", F.posexplode("embedding").alias("at", "value"))
    return rows.select("id", "at", F.round(F.col("value").cast("double"), 6).alias("value"))


@query
def chunk_documents(spark, sf_dir):
    docs = spread(t.table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.posexplode(chunk_text(F.col("text"))).alias("chunk", "text"))


@query
def chunk_conversations(spark, sf_dir):
    """Turns as paragraphs of one text: the first rule of the chunker applies."""
    rows = t.table(spark, sf_dir, "conversations")
    text = F.concat_ws("\n\n", "role", "text", "text")
    return rows.select("conv_id", "turn", F.posexplode(chunk_text(text)).alias("chunk", "text"))


@query
def chunk_batch(spark, sf_dir):
    files = t.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), "doc_id", F.lit(".txt")).alias("source"), "text")
    return chunk_rows(files).select("id", "pos", F.md5("text").alias("text"), "metadata")


@query
def ingest_text_files(spark, sf_dir):
    store = Store(spark, shared_dir(spark, "store"))
    files = t.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), "doc_id", F.lit(".txt")).alias("source"), "text")
    summary = ingest_files(store, files, "files", dim=t.DIM)
    return summary.select("count", "skipped", "triples_extracted")


# Knowledge graph -------------------------------------------------------------


@query
def entity_mentions(spark, sf_dir):
    return graph.extract_entities(t.documents(spark, sf_dir)).select("id", "pos", "text", "label")


@query
def entity_unique(spark, sf_dir):
    mentions = graph.extract_entities(t.documents(spark, sf_dir, "lang"))
    # The label tells the parity of the position, so that the last mention decides.
    parity = F.when(F.col("pos") % 2 == 0, "Person").otherwise("Concept")
    return graph.unique_entities(mentions.withColumn("label", parity)).select("id", "pos", "text", "label")


@query
def entity_gazetteer(spark, sf_dir):
    """Names found as capitalised spans anywhere, looked up as words in every document."""
    docs = t.documents(spark, sf_dir)
    spans = graph.extract_entities(docs)
    words = F.array_join(tokenize(F.col("text")), " ")
    names = spans.where(F.size(tokenize(F.col("text"))) >= 2).groupBy(words.alias("text")).agg(F.lit("Organization").alias("label"))
    return graph.gazetteer_entities(docs, names).select("id", "pos", "text", "label")


@query
def entity_pairs(spark, sf_dir):
    mentions = graph.extract_entities(t.documents(spark, sf_dir))
    return graph.cooccurrence_triples(mentions).select("subject", "predicate", "object", "document_id", "weight")


def _order_log(spark, sf_dir):
    rows = t.table(spark, sf_dir, "lineitem").select(
        F.lit("star").alias("collection_id"),
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("subject"),
        F.lit("sold_by").alias("predicate"),
        F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("object"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("document_id"),
        F.col("l_quantity").alias("weight"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
    )
    return graph.identify_triples(rows)


@query
def triples_upserted(spark, sf_dir):
    return graph.latest_triples(_order_log(spark, sf_dir)).select("triple_id", "subject", "object", "document_id", "weight")


@query
def graph_neighbours(spark, sf_dir):
    nations = t.table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("q_id"), F.lit("star").alias("collection_id"),
        F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("entity"),
    )
    return graph.neighbours(t.star_triples(spark, sf_dir), nations).select("q_id", "subject", "predicate", "object", "weight")


@query
def graph_both_ends(spark, sf_dir):
    """One query that names all regions and nations: edges between them count once."""
    nations, regions = t.table(spark, sf_dir, "nation"), t.table(spark, sf_dir, "region")
    names = nations.select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("entity")).unionByName(
        regions.select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("entity"))
    )
    entities = names.select(F.lit("all").alias("q_id"), F.lit("star").alias("collection_id"), "entity")
    return graph.neighbours(t.star_triples(spark, sf_dir), entities).select("subject", "predicate", "object")


@query
def graph_expanded(spark, sf_dir):
    regions = t.table(spark, sf_dir, "region").select(
        F.col("r_name").alias("q_id"), F.lit("star").alias("collection_id"),
        F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("entity"),
    )
    # Every hop reads the edges: they are written once.
    edges = cut_lineage(t.star_triples(spark, sf_dir))
    return graph.expand(edges, regions, 3).select("q_id", "hop", "subject", "predicate", "object")


@query
def graph_text(spark, sf_dir):
    regions = t.table(spark, sf_dir, "region").select(
        F.col("r_name").alias("q_id"), F.lit("star").alias("collection_id"),
        F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("entity"),
    )
    strangers = regions.withColumns({"q_id": F.concat(F.lit("no "), "q_id"), "entity": F.concat(F.lit("no "), "entity")})
    entities = regions.unionByName(strangers)
    return render_triples(entities, graph.neighbours(t.star_triples(spark, sf_dir), entities))


def _vector_store(spark, rows):
    """(collection_id, id, embedding) rows as the first batch of a new store."""
    store = Store(spark, shared_dir(spark, "store"))
    _add_vectors(store, rows)
    return store


def _add_vectors(store, rows):
    batch = store.next_batch()
    bare = rows.select("collection_id", "id", F.lit("").alias("text"), F.lit("{}").alias("metadata"), "embedding")
    store.write("documents", batch, mutate.upsert_rows(bare, batch))
    store.commit(batch, ["documents"])


@query
def stored_ann_search(spark, sf_dir):
    """Every vector looks for itself in a stored index that was followed by new, changed and deleted vectors."""
    rows = t.vectors(spark, sf_dir)
    store = _vector_store(spark, rows.where("label < 7"))
    store.build_cells("all")
    _add_vectors(store, rows.where("label >= 5").withColumn("embedding", F.when(F.col("label") < 7, F.reverse("embedding")).otherwise(F.col("embedding"))))
    store.delete_documents(rows.where("label = 3"))
    return _ranked(store.nearest_stored("all", t.as_queries(store.documents("all")), 1), "distance")


@query
def stored_ann_recall(spark, sf_dir):
    """Does the stored index find 9 of 10 true neighbours? Calibrated on the odd questions, asked all of them."""
    docs = t.embedded(spark, sf_dir).select("collection_id", "id", "embedding")
    store = _vector_store(spark, docs)
    asked = cut_lineage(t.questions(spark, sf_dir))
    store.build_cells("docs", asked=asked.where(F.col("q_id").cast("int") % 2 == 1))
    exact = vector_topk(store.documents("docs"), asked, 5).select("q_id", "id")
    found = store.nearest_stored("docs", asked, 5).select("q_id", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["q_id", "id"], "left").agg(
        F.count(F.lit(1)).alias("n_exact"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_reached")
    )


# Tenants ---------------------------------------------------------------------


@query
def tenant_listing(spark, sf_dir):
    """Sources are tenants, their languages are collections; one shared registry."""
    docs = t.table(spark, sf_dir, "documents")
    wanted = docs.select(F.lit("").alias("tenant_id"), registry.scoped_name(F.col("source"), F.col("lang")).alias("name"), F.lit("{}").alias("metadata")).distinct()
    empty = spark.createDataFrame([], "collection_id string, tenant_id string, name string, metadata string, seq long, op string")
    log = registry.create_collections(empty, wanted, 1)
    return registry.unscope_names(registry.current_collections(log), "src1").select("collection_id", "name", "metadata")


@query
def tenant_search(spark, sf_dir):
    """Every tenant asks all benchmark questions in its own collections."""
    docs = t.embedded(spark, sf_dir, "source")
    asked = t.asked_of(spark, sf_dir, "source")
    asked = asked.withColumn("q_id", F.concat_ws(":", "collection_id", "item_id"))
    return _ranked(hybrid_search(docs, embed(asked, "query_text", dim=t.DIM), 3), "score", 10)
