"""Keyword search: postings, corpus statistics and BM25 ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions.text import slices, tokenize
from lodestone.schema import POSTINGS
from lodestone.session import BROADCAST_ROWS, cut_lineage, equi_join, fits, if_small, local

# Fixed values of the ranking formula.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6

#: Up to this many distinct words are looked up by a filter on the postings.
PUSHED_TERMS = 1_000
#: Scores of documents against queries that a task holds at once.
CELLS_AT_ONCE = 2_000_000
#: Words of documents that a task counts at once.
WORDS_AT_ONCE = 500_000

_DOC = ["collection_id", "id"]
_PHRASE = ["phrase", "is_prefix"]


def build_postings(docs: DataFrame, keep: tuple[str, ...] = (), with_lengths: bool = False) -> DataFrame:
    """(collection_id, id, keep..., term, tf, dl): one row per document and distinct term.

    `dl` is the number of tokens of the document. A document is one row, so
    its terms are counted where it is read and nothing is shuffled. With
    `with_lengths` every document also gets a row with the empty term and
    tf 0, so that its length is stored even if it has no words.
    """
    keys = [*_DOC, *keep]
    words = tokenize(F.col("text"))
    if with_lengths:
        words = F.array_prepend(words, "")
    tokens = docs.select(*keys, words.alias("tokens"))
    schema = T.StructType([*tokens.select(*keys).schema.fields, *POSTINGS.fields[2:]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "tokens", WORDS_AT_ONCE):
            lists = batch.column("tokens")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            words = lists.flatten().dictionary_encode()
            width = max(1, len(words.dictionary))
            cells = np.repeat(np.arange(len(lengths)) * width, lengths) + words.indices.to_numpy()
            found, times = np.unique(cells, return_counts=True)
            columns = [batch.column(k).take(pa.array(found // width)) for k in keys]
            terms = words.dictionary.take(pa.array(found % width))
            sizes = lengths[found // width]
            if with_lengths:
                times = times - pc.equal(terms, "").to_numpy(zero_copy_only=False)
                sizes = sizes - 1
            columns += [terms, pa.array(times, pa.int64()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return tokens.mapInArrow(count, schema)


def refresh_postings(postings: DataFrame, changed: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Replace the postings of changed documents and drop those of removed ones."""
    stale = changed.select(*_DOC)
    if removed is not None:
        stale = stale.unionByName(removed.select(*_DOC))
    kept = equi_join(postings, stale.distinct(), _DOC, "left_anti", spread=["term"])
    return kept.unionByName(build_postings(changed))


def document_lengths(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(collection_id, id, keep..., dl): number of tokens, 0 for an empty text."""
    return docs.select(*_DOC, *keep, F.size(tokenize(F.col("text"))).alias("dl"))


def corpus_stats(lengths: DataFrame, scope: str = "global") -> DataFrame:
    """(scope, n_docs, avg_dl): over all collections, or per collection."""
    return lengths.groupBy(_scope(scope).alias("scope")).agg(
        F.count(F.lit(1)).alias("n_docs"), (F.sum("dl") / F.count(F.lit(1))).alias("avg_dl")
    )


def term_stats(postings: DataFrame, scope: str = "global") -> DataFrame:
    """(scope, term, df): number of documents that hold the term."""
    return postings.groupBy(_scope(scope).alias("scope"), "term").agg(F.count(F.lit(1)).alias("df"))


def _scope(scope: str) -> Column:
    if scope not in ("global", "collection"):
        raise ValueError(f"unknown statistics scope {scope!r}")
    return F.lit("*") if scope == "global" else F.col("collection_id")


@dataclass(frozen=True)
class KeywordIndex:
    """Postings and the frame of document lengths behind them.

    Stored postings come with the statistics over all collections; they are
    cheap to read again, so a search for few words writes nothing.
    """

    postings: DataFrame
    lengths: DataFrame
    corpus: DataFrame | None = None

    @classmethod
    def of(cls, docs: DataFrame) -> "KeywordIndex":
        return cls(build_postings(docs), document_lengths(docs))


def query_terms(queries: DataFrame, prefix: bool = False) -> DataFrame:
    """(q_id, collection_id, phrase, is_prefix, times, n_phrases) of each query.

    With `prefix` the last word of every query stands for all words it starts.
    """
    tokens = queries.select("q_id", "collection_id", tokenize(F.col("query_text")).alias("tokens"))
    words = tokens.select(
        "q_id", "collection_id", F.size("tokens").alias("_n"), F.posexplode("tokens").alias("_at", "phrase")
    ).withColumn("is_prefix", F.lit(prefix) & (F.col("_at") == F.col("_n") - 1))
    times = words.groupBy("q_id", "collection_id", "phrase", "is_prefix").agg(F.count(F.lit(1)).alias("times"))
    per_query = Window.partitionBy("q_id", "collection_id")
    return times.withColumn("n_phrases", F.count(F.lit(1)).over(per_query))


def _phrase_hits(postings: DataFrame, phrases: DataFrame, prefix: bool, bounded: bool) -> DataFrame:
    """(collection_id, id, phrase, is_prefix, tf, dl) for every phrase."""
    whole = phrases.where(~F.col("is_prefix")).select(F.col("phrase").alias("term"))
    columns = [*_DOC, "phrase", "is_prefix", "tf", "dl"]
    few = [r["term"] for r in whole.limit(PUSHED_TERMS + 1).collect()]
    if len(few) <= PUSHED_TERMS:
        # A plain filter reaches the scan: sorted postings of other terms are skipped.
        matching = postings.where(F.col("term").isin(few))
    else:
        matching = equi_join(postings, whole, ["term"], "left_semi", spread=["id"], small_fits=bounded)
    exact = matching.select(*_DOC, F.col("term").alias("phrase"), F.lit(False).alias("is_prefix"), "tf", "dl")
    if not prefix:
        return exact
    # Prefixes meet terms on a shared leading part as long as the shortest prefix.
    starts = phrases.where("is_prefix")
    shortest = starts.agg(F.min(F.length("phrase")).alias("n")).first()["n"]
    if shortest is None:
        return exact
    keyed = postings.where(F.length("term") >= shortest).withColumn("_lead", F.left(F.col("term"), F.lit(shortest)))
    leads = starts.select(F.left(F.col("phrase"), F.lit(shortest)).alias("_lead"), "phrase", "is_prefix")
    begun = (
        equi_join(keyed, leads, ["_lead"], spread=["id"], small_fits=bounded)
        .where(F.startswith(F.col("term"), F.col("phrase")))
        .groupBy(*_DOC, "phrase", "is_prefix", "dl")
        .agg(F.sum("tf").alias("tf"))
        .select(*columns)
    )
    return exact.unionByName(begun)


def _idf() -> Column:
    n, held = F.col("n_docs"), F.col("df")
    return F.greatest(F.log((n - held + 0.5) / (held + 0.5)), F.lit(IDF_FLOOR))


def _bm25() -> Column:
    tf = F.col("tf")
    return _idf() * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))


def keyword_scores(
    index: KeywordIndex,
    queries: DataFrame,
    mode: str = "and",
    exclude: str | None = None,
    prefix: bool = False,
    stats_scope: str = "global",
    only: DataFrame | None = None,
    max_rows: int = BROADCAST_ROWS,
    limit: int | None = None,
) -> DataFrame:
    """(q_id, collection_id, id, bm25) of every matching document, higher is better.

    `queries` has q_id, collection_id and query_text. `mode` asks for all
    words ("and") or any ("or"); documents holding a word of the `exclude`
    text drop out; `only` restricts the matches to given (collection_id, id).
    Word statistics cover all documents of the scope in any case. With `limit`
    a bounded set of queries is scored where a document's hits are, and rows
    beyond a query's first `limit` of a partition may be left out.
    """
    if mode not in ("and", "or"):
        raise ValueError(f"unknown mode {mode!r}")
    wanted = query_terms(queries, prefix)
    few = if_small(wanted, min(max_rows, PUSHED_TERMS))
    bounded = few is not None or fits(wanted, max_rows)
    wanted = wanted if few is None else few
    at_once = few is not None and not prefix and not exclude and index.corpus is not None and stats_scope == "global"
    phrases = wanted.select(*_PHRASE)
    if exclude:
        phrases = phrases.unionByName(_excluded(wanted, exclude))
    # The matching postings feed counts, weights and matches: written once.
    hits = _phrase_hits(index.postings, phrases.distinct(), prefix, bounded)
    if not at_once:
        hits = cut_lineage(hits)
    held = hits.groupBy(_scope(stats_scope).alias("scope"), *_PHRASE).agg(F.count(F.lit(1)).alias("df"))
    corpus = index.corpus if index.corpus is not None and stats_scope == "global" else corpus_stats(index.lengths, stats_scope)
    if stats_scope == "global":
        weights = held.join(F.broadcast(corpus), "scope")  # one row
    else:
        weights = equi_join(held, cut_lineage(corpus), ["scope"], spread=["phrase"], max_rows=max_rows)
    # One row for each word asked for.
    weights = local(weights) if at_once else cut_lineage(weights)
    if limit is not None and bounded and not at_once:
        banned = _excluded(wanted, exclude) if exclude else None
        return _scan_scores(hits, wanted, weights, mode, banned, stats_scope, only, limit, max_rows)
    open_hits = hits
    if only is not None:
        open_hits = equi_join(hits, only.select(*_DOC), _DOC, "left_semi", spread=["phrase"], max_rows=max_rows)

    def scored(rows: DataFrame) -> DataFrame:
        weighted = equi_join(
            rows.withColumn("scope", _scope(stats_scope)),
            weights,
            ["scope", *_PHRASE],
            spread=["id"],
            max_rows=max_rows,
            # Over all collections there is one weight per phrase asked for.
            small_fits=bounded if stats_scope == "global" else None,
        )
        return weighted.withColumn("score", _bm25()).drop("scope", "tf", "dl", "df", "n_docs", "avg_dl")

    # Summed in the order of the words, so that the same document always gets the same bits.
    parts = F.sort_array(F.collect_list(F.struct(*_PHRASE, (F.col("times") * F.col("score")).alias("part"))))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p["part"]).alias("bm25")

    if mode == "and":
        pairs = _match_all(open_hits, wanted, weights, stats_scope, bounded, max_rows, at_once)
        found = scored(pairs).groupBy("q_id", *_DOC).agg(
            F.count(F.lit(1)).alias("n"), F.max("n_phrases").alias("n_phrases"), total
        ).where(F.col("n") == F.col("n_phrases"))
    else:
        asked = wanted.select("q_id", "collection_id", *_PHRASE, "times")
        pairs = equi_join(scored(open_hits), asked, ["collection_id", *_PHRASE], spread=["id"], small_fits=bounded)
        found = pairs.groupBy("q_id", *_DOC).agg(total)
    if exclude:
        banned = hits.join(F.broadcast(_excluded(wanted, exclude)), _PHRASE, "left_semi").select(*_DOC).distinct()
        found = equi_join(found, banned, _DOC, "left_anti", spread=["q_id"], max_rows=max_rows)
    return found.select("q_id", *_DOC, "bm25")


def _match_all(
    hits: DataFrame, wanted: DataFrame, weights: DataFrame, stats_scope: str, bounded: bool, max_rows: int, at_once: bool
) -> DataFrame:
    """Hits of the documents that may hold every phrase of a query.

    Only the documents of each query's rarest phrase are candidates; they are
    checked against the other phrases by document and phrase.
    """
    asked = wanted.withColumn("scope", _scope(stats_scope)).join(
        weights.select("scope", *_PHRASE, "df"), ["scope", *_PHRASE], "left"
    )
    rarest = (
        asked.groupBy("q_id", "collection_id")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), *_PHRASE)).alias("r"))
        .where(F.col("r.df") > 0)
    )
    leads = rarest.select("q_id", "collection_id", "r.phrase", "r.is_prefix")
    candidates = equi_join(
        hits.select(*_DOC, *_PHRASE), leads, ["collection_id", *_PHRASE], spread=["id"], small_fits=bounded
    ).select("q_id", *_DOC)
    checks = equi_join(
        candidates,
        wanted.select("q_id", "collection_id", *_PHRASE, "times", "n_phrases"),
        ["q_id", "collection_id"],
        spread=["id"],
        small_fits=bounded,
    )
    if at_once:
        # Both sides have a document and phrase once for each query at most, so no key is hot.
        return hits.join(checks, [*_DOC, *_PHRASE])
    # Few next to the hits: written once, counted, then met by document and phrase, which makes no key hot.
    return equi_join(hits, cut_lineage(checks), [*_DOC, *_PHRASE], max_rows=max_rows, salts=1)


@dataclass(frozen=True)
class _Asked:
    """The queries of one collection: columns 0, 1, ... of a matrix of scores."""

    q_ids: np.ndarray
    needed: np.ndarray
    #: For each phrase the queries that ask for it, how often, and those whose rarest phrase it is.
    askers: dict[int, np.ndarray]
    times: dict[int, np.ndarray]
    leads: dict[int, np.ndarray]
    idf: np.ndarray
    avg_dl: np.ndarray


def _scan_scores(
    hits: DataFrame,
    wanted: DataFrame,
    weights: DataFrame,
    mode: str,
    banned: DataFrame | None,
    stats_scope: str,
    only: DataFrame | None,
    limit: int,
    max_rows: int,
) -> DataFrame:
    """The scores of a bounded set of queries: the hits of a document come together and meet all queries at once.

    No pair of a document and a query is shuffled, only the best `limit` of each partition.
    """
    spark = hits.sparkSession
    asked = wanted.withColumn("scope", _scope(stats_scope))
    # As many rows as `wanted` at most, which is counted.
    weighed = asked.select("scope", *_PHRASE).distinct().join(
        weights.select("scope", *_PHRASE, "df", "avg_dl", _idf().alias("idf")), ["scope", *_PHRASE]
    )
    weighed, asked = weighed.toPandas(), asked.toPandas()
    barred = [] if banned is None else [(r["phrase"], r["is_prefix"]) for r in banned.collect()]
    # Phrases are numbered in the order in which their parts are summed.
    phrases = sorted({*zip(asked["phrase"], asked["is_prefix"]), *barred})
    number = {phrase: i for i, phrase in enumerate(phrases)}
    if mode == "and":
        asked = asked[asked["q_id"].notna()]
    by_collection = _asked_of(asked[asked["collection_id"].notna()], weighed, number)
    schema = T.StructType(
        [wanted.schema["q_id"], *(hits.schema[c] for c in _DOC), T.StructField("bm25", T.DoubleType())]
    )
    if not by_collection:
        return spark.createDataFrame([], schema)
    shipped = spark.sparkContext.broadcast((by_collection, [number[p] for p in barred]))
    numbers = spark.createDataFrame([(p, bool(x), i) for (p, x), i in number.items()], "phrase string, is_prefix boolean, p int")
    homes = spark.createDataFrame([(c,) for c in by_collection], T.StructType([hits.schema["collection_id"]]))
    rows = hits.join(F.broadcast(numbers), _PHRASE).join(F.broadcast(homes), "collection_id", "left_semi")
    if mode == "and":
        rows = rows.where(F.col("id").isNotNull())
    found = rows.groupBy(*_DOC).agg(F.collect_list(F.struct("p", "tf", "dl")).alias("hits"))
    if only is not None:
        # Met once for each document.
        found = equi_join(found, only.select(*_DOC), _DOC, "left_semi", max_rows=max_rows, salts=1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, barred = shipped.value
        best: dict[str, pd.DataFrame] = {}
        for batch in batches:
            homes = batch.column("collection_id").to_numpy(zero_copy_only=False)
            for home in pd.unique(homes):
                here = queries[home]
                rows = np.flatnonzero(homes == home)
                step = max(1, CELLS_AT_ONCE // len(here.q_ids))
                for at in range(0, len(rows), step):
                    part = batch.take(pa.array(rows[at : at + step]))
                    top = _score(part, here, barred, mode, limit)
                    if home in best:
                        top = _keep_best(pd.concat([best[home], top], ignore_index=True), limit)
                    best[home] = top
        for home, top in best.items():
            q_ids = pa.array(queries[home].q_ids[top["q"].to_numpy()], schema_q)
            columns = [q_ids, pa.array([home] * len(top), pa.string()), pa.array(top["id"], pa.string()), pa.array(top["bm25"], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema_q = to_arrow_type(wanted.schema["q_id"].dataType)
    return found.mapInArrow(scan, schema)


def _asked_of(asked: pd.DataFrame, weighed: pd.DataFrame, number: dict) -> dict[str, _Asked]:
    """The queries of each collection, with the weights of their phrases."""
    weight = {
        (scope, number[phrase, is_prefix]): (df, idf, avg_dl)
        for scope, phrase, is_prefix, df, idf, avg_dl in weighed[["scope", *_PHRASE, "df", "idf", "avg_dl"]].itertuples(index=False)
    }
    out = {}
    for home, rows in asked.groupby("collection_id", sort=False):
        at, q_ids = pd.factorize(rows["q_id"], use_na_sentinel=False)
        p = np.array([number[key] for key in zip(rows["phrase"], rows["is_prefix"])])
        scope, times = rows["scope"].iloc[0], rows["times"].to_numpy()
        idf, avg_dl = np.zeros(len(number)), np.ones(len(number))
        held = np.zeros(len(number), dtype=np.int64)
        for i in set(p):
            held[i], idf[i], avg_dl[i] = weight.get((scope, i), (0, 0.0, 1.0))
        needed = np.zeros(len(q_ids), dtype=np.int64)
        needed[at] = rows["n_phrases"].to_numpy()
        # The rarest phrase of each query; a query with a phrase that no document has finds nothing.
        order = np.lexsort((p, held[p], at))
        first = order[np.r_[True, at[order][1:] != at[order][:-1]]]
        first = first[held[p[first]] > 0]
        by_phrase = pd.Series(np.arange(len(p))).groupby(p).indices
        leads = pd.Series(first).groupby(p[first]).indices
        out[home] = _Asked(
            np.asarray(q_ids, dtype=object),
            needed,
            {i: at[x] for i, x in by_phrase.items()},
            {i: times[x] for i, x in by_phrase.items()},
            {i: at[first[x]] for i, x in leads.items()},
            idf,
            avg_dl,
        )
    return out


def _score(docs: pa.RecordBatch, asked: _Asked, barred: list[int], mode: str, limit: int) -> pd.DataFrame:
    """(q, id, bm25): the best documents of each query among a few of its collection."""
    lists, ids = docs.column("hits"), docs.column("id")
    held = lists.flatten()
    doc = np.repeat(np.arange(docs.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    p, tf, dl = (held.field(name).to_numpy(zero_copy_only=False) for name in ("p", "tf", "dl"))
    score = asked.idf[p] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / asked.avg_dl[p]))
    # The parts of a document are summed phrase by phrase, those of one phrase from the smallest.
    order = np.lexsort((score, doc, p))
    doc, p, score = doc[order], p[order], score[order]
    new = np.r_[True, (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])] if len(p) else np.zeros(0, dtype=bool)
    again = np.arange(len(p)) - np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
    shape = (docs.num_rows, len(asked.q_ids))
    total, open_docs = np.zeros(shape), np.ones(docs.num_rows, dtype=bool)
    count, copies = (np.zeros(shape, dtype=np.int32) if mode == "and" else None for _ in range(2))
    edges = np.r_[0, np.flatnonzero(np.diff(p)) + 1, len(p)] if len(p) else np.zeros(1, dtype=np.int64)
    spans = [(int(p[a]), slice(a, b)) for a, b in zip(edges[:-1], edges[1:])]
    if mode == "and":
        for phrase, span in spans:
            if phrase in asked.leads:
                np.add.at(copies, (doc[span][:, None], asked.leads[phrase][None, :]), 1)
    for phrase, span in spans:
        if phrase in barred:
            named = doc[span]
            open_docs[named[ids.is_valid().to_numpy(zero_copy_only=False)[named]]] = False
        if phrase not in asked.askers:
            continue
        askers, times = asked.askers[phrase], asked.times[phrase]
        turn = again[span]
        for i in range(int(turn.max()) + 1):
            rows, parts = doc[span][turn == i], score[span][turn == i]
            cells = np.ix_(rows, askers)
            if mode == "or":
                total[cells] += parts[:, None] * times[None, :]
                continue
            # A document under one id several times meets itself, as in a join.
            repeats = copies[cells]
            count[cells] += repeats
            for j in range(int(repeats.max(initial=0))):
                total[cells] += np.where(repeats > j, parts[:, None] * times[None, :], 0.0)
    fits = total > 0 if mode == "or" else (copies > 0) & (count == asked.needed[None, :])
    fits &= open_docs[:, None]
    total[~fits] = -1.0
    if len(total) > limit:
        fits &= total >= np.partition(total, len(total) - limit, axis=0)[len(total) - limit]
    qi, di = np.nonzero(fits.T)
    found = pd.DataFrame({"q": qi, "id": ids.to_numpy(zero_copy_only=False)[di], "bm25": total[di, qi]})
    return _keep_best(found, limit)


def _keep_best(rows: pd.DataFrame, limit: int) -> pd.DataFrame:
    ordered = rows.sort_values(["q", "bm25", "id"], ascending=[True, False, True], ignore_index=True, na_position="first")
    return ordered[ordered.groupby("q").cumcount() < limit]


def _excluded(wanted: DataFrame, text: str) -> DataFrame:
    """The words of the `exclude` argument as phrases."""
    words = wanted.sparkSession.range(1).select(F.explode(F.array_distinct(tokenize(F.lit(text)))).alias("phrase"))
    return words.withColumn("is_prefix", F.lit(False))


def keyword_topk(index: KeywordIndex, queries: DataFrame, limit: int = 20, **options) -> DataFrame:
    """(q_id, collection_id, id, bm25, rank): the best `limit` documents per query."""
    scores = keyword_scores(index, queries, limit=limit, **options)
    best = Window.partitionBy("q_id").orderBy(F.desc("bm25"), "id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
