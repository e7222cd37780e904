"""Knowledge graph: entities, co-occurrence edges, upserts and neighbourhoods."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.keys import triple_id
from lodestone.functions.text import entity_spans, slices, tokenize
from lodestone.session import BROADCAST_ROWS, cut_lineage, equi_join

RELATED = "related_to"
RELATED_WEIGHT = 0.8
DEFAULT_WEIGHT = 1.0
#: Label of spans found without a gazetteer or model.
DEFAULT_LABEL = "Concept"
#: Names whose hashes go out together, and words that a task compares with them at once.
NAMES_AT_ONCE, WORDS_AT_ONCE = 2_000_000, 500_000

_DOC = ["collection_id", "id"]
_EDGE = ["collection_id", "triple_id", "subject", "predicate", "object", "weight"]


def extract_entities(
    docs: DataFrame, fn: Callable[[Column], Column] | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(collection_id, id, keep..., pos, text, label): entity mentions in text order.

    `fn` is a Pandas UDF from text to array<struct<text string, label string>>,
    for a model. Without it, mentions are runs of capitalised words.
    """
    if fn is not None:
        found = fn(F.col("text"))
    else:
        found = F.transform(
            entity_spans(F.col("text")), lambda span: F.struct(span.alias("text"), F.lit(DEFAULT_LABEL).alias("label"))
        )
    mentions = docs.select(*_DOC, *keep, F.posexplode(found).alias("pos", "entity"))
    return mentions.select(*_DOC, *keep, "pos", "entity.text", "entity.label")


def gazetteer_entities(
    docs: DataFrame, gazetteer: DataFrame, max_rows: int = BROADCAST_ROWS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Mentions of the names in `gazetteer` (text, label), compared word by word, with the `keep` columns of the document.

    A name is told by two runs of a power of two of words, its first and its last ones, which cover it. Only runs of a
    document whose hashes are those of a name are spelled and meet the names in one equi-join, so that the work
    follows the words of the documents, not the lengths of the names. Hashes go out in blocks of NAMES_AT_ONCE names.
    """
    spelled = gazetteer.select(tokenize(F.col("text")).alias("words"), "text", "label").where(F.size("words") > 0)
    names = cut_lineage(spelled.select(F.array_join("words", " ").alias("words"), F.col("words").alias("tokens"), "text", "label"))
    tokens = docs.select(*_DOC, *keep, tokenize(F.col("text")).alias("tokens"))
    distinct = names.select("words", "tokens").dropDuplicates(["words"])
    blocks = -(-distinct.count() // NAMES_AT_ONCE)
    hashed = cut_lineage(_name_keys(distinct)) if blocks else None
    grams = [_named_runs(tokens, hashed.where(F.pmod(F.xxhash64("lead", "tail"), F.lit(blocks)) == i), keep) for i in range(blocks)]
    if not grams:
        pos = F.lit(0).alias("pos")
        return tokens.limit(0).select(*_DOC, *keep, pos, F.lit("").alias("text"), F.lit("").alias("label"))
    found = reduce(DataFrame.unionByName, grams)
    return equi_join(found, names.select("words", "text", "label"), ["words"], spread=["id", "pos"], max_rows=max_rows).select(
        *_DOC, *keep, "pos", "text", "label"
    )


def _levels(first: np.ndarray, highest: int) -> Iterator[np.ndarray]:
    """Hashes of the runs of 1, 2, 4, ... words that begin at each word; the last ones wrap round and mean nothing."""
    runs = first.astype(np.uint64)
    for level in range(highest + 1):
        yield runs
        right = np.roll(runs, -(1 << level)) * np.uint64(0xC2B2AE3D27D4EB4F)
        runs = (runs ^ (right >> np.uint64(29)) ^ right) * np.uint64(0x9E3779B185EBCA87)
        runs ^= runs >> np.uint64(32)


def _hashes(tokens: str = "tokens") -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w)).alias("hashes")


def _name_keys(names: DataFrame) -> DataFrame:
    """(n, lead, tail) of each name: how many words it has, and the hashes of its first and last runs."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words in batch.column("hashes"):
                first = words.values.to_numpy(zero_copy_only=False)
                level = len(first).bit_length() - 1
                *_, runs = _levels(first, level)
                out.append((len(first), runs[:1].view(np.int64)[0], runs[len(first) - (1 << level)].view(np.int64)))
            columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "lead", "tail"])

    return names.select(_hashes()).mapInArrow(keys, "n long, lead long, tail long").distinct()


def _named_runs(tokens: DataFrame, keys: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(collection_id, id, keep..., pos, words): runs of words whose hashes are those of a name."""
    table = keys.toArrow()
    n, lead, tail = (table[c].to_numpy() for c in ("n", "lead", "tail"))
    level = np.frexp(n.astype(float))[1] - 1
    lead, tail = lead.view(np.uint64), tail.view(np.uint64)
    by_level = {}
    for i in np.unique(level):
        rows = np.flatnonzero(level == i)
        rows = rows[np.argsort(lead[rows], kind="stable")]
        by_level[int(i)] = (n[rows], lead[rows], tail[rows])
    shipped = tokens.sparkSession.sparkContext.broadcast(by_level)
    columns = [*_DOC, *keep]
    schema = T.StructType(
        [*tokens.select(*columns).schema.fields, T.StructField("pos", T.IntegerType()), T.StructField("words", T.StringType())]
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shipped.value
        for batch in slices(batches, "tokens", WORDS_AT_ONCE):
            lists = batch.column("tokens")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.repeat(np.cumsum(lengths), lengths)
            words = lists.flatten()
            starts, sizes = [], []
            for i, runs in enumerate(_levels(batch.column("hashes").flatten().to_numpy(zero_copy_only=False), max(names, default=-1))):
                if i not in names:
                    continue
                n, lead, tail = names[i]
                # The names that begin with the run at each word, one place in the sorted names after the other.
                spot = np.searchsorted(lead, runs)
                at = np.flatnonzero(lead[np.minimum(spot, len(lead) - 1)] == runs)
                spot = spot[at]
                high = np.searchsorted(lead, runs[at], "right")
                while len(at):
                    last = at + n[spot] - (1 << i)
                    inside = at + n[spot] <= ends[at]
                    hit = inside & (runs[np.where(inside, last, 0)] == tail[spot])
                    starts.append(at[hit])
                    sizes.append(n[spot][hit])
                    more = spot + 1 < high
                    at, spot, high = at[more], spot[more] + 1, high[more]
            if not starts or not sum(map(len, starts)):
                continue
            start, size = np.concatenate(starts), np.concatenate(sizes)
            firsts = np.cumsum(lengths) - lengths
            doc = np.searchsorted(np.cumsum(lengths), start, "right")
            out = [batch.column(c).take(pa.array(doc)) for c in columns]
            # One list of all words: a list for each run would cost more than all else.
            said = words.to_pylist()
            spelled = [" ".join(said[a : a + k]) for a, k in zip(start.tolist(), size.tolist())]
            out += [pa.array((start - firsts[doc]).astype(np.int32)), pa.array(spelled, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return tokens.select(*columns, "tokens", _hashes()).mapInArrow(find, schema)


def unique_entities(mentions: DataFrame) -> DataFrame:
    """One row per document and entity text: first position, label of the last mention."""
    return mentions.groupBy(*_DOC, "text").agg(
        F.min("pos").alias("pos"), F.max(F.struct("pos", "label"))["label"].alias("label")
    )


def cooccurrence_triples(mentions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """An edge between every two entities of a document, earlier one first, with the `keep` columns of the document.

    The pairs are the result itself. They are unfolded row by row from the
    entity list of one document.
    """
    names = mentions.groupBy(*_DOC, *keep).agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("found"))
    names = names.select(*_DOC, *keep, F.array_distinct(F.transform("found", lambda m: m["text"])).alias("names"))
    firsts = names.select(*_DOC, *keep, "names", F.posexplode("names").alias("at", "subject"))
    pairs = firsts.select(
        *_DOC, *keep, "subject", F.explode(F.slice("names", F.col("at") + 2, F.size("names"))).alias("object")
    )
    return pairs.select(
        "collection_id",
        "subject",
        F.lit(RELATED).alias("predicate"),
        "object",
        F.col("id").alias("document_id"),
        F.lit(RELATED_WEIGHT).alias("weight"),
        *keep,
    )


def identify_triples(triples: DataFrame) -> DataFrame:
    """Add `triple_id`; a missing weight is 1.0, a missing document is NULL."""
    weight = F.coalesce("weight", F.lit(DEFAULT_WEIGHT)) if "weight" in triples.columns else F.lit(DEFAULT_WEIGHT)
    document = F.col("document_id") if "document_id" in triples.columns else F.lit(None).cast("string")
    key = triple_id(F.col("collection_id"), F.col("subject"), F.col("predicate"), F.col("object"))
    return triples.withColumns({"triple_id": key, "weight": weight.cast("double"), "document_id": document})


def latest_triples(log: DataFrame) -> DataFrame:
    """The last write of every edge.

    A running maximum per edge, so repeated writes collapse before the shuffle.
    """
    rest = [c for c in ("collection_id", "subject", "predicate", "object", "document_id", "weight") if c in log.columns]
    return log.groupBy("triple_id").agg(F.max(F.struct("seq", *rest)).alias("last")).select("triple_id", "last.*")


def neighbours(triples: DataFrame, entities: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(q_id, collection_id, triple_id, subject, predicate, object, weight).

    All edges that start or end at one of a query's entities; `entities` has
    q_id, collection_id and entity. An edge with both ends among them is
    reported once, by its subject.
    """
    wanted = entities.select("q_id", "collection_id", "entity").distinct()
    edges = triples.select(*_EDGE)
    starts = wanted.withColumnRenamed("entity", "subject")
    ends = wanted.withColumnRenamed("entity", "object")

    def meet(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        return equi_join(left, right, on, how, spread=["triple_id"], max_rows=max_rows)

    outgoing = meet(edges, starts, ["collection_id", "subject"])
    incoming = meet(meet(edges, ends, ["collection_id", "object"]), starts, ["q_id", "collection_id", "subject"], "left_anti")
    return outgoing.unionByName(incoming).select("q_id", *_EDGE)


def expand(triples: DataFrame, entities: DataFrame, hops: int, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Edges within `hops` steps of a query's entities, with the first `hop` that reaches them; none for no steps."""
    if hops < 1:
        return neighbours(triples.limit(0), entities, max_rows).withColumn("hop", F.lit(0))
    frontier = entities.select("q_id", "collection_id", "entity").distinct()
    visited = frontier
    reached = None
    for hop in range(1, hops + 1):
        found = cut_lineage(neighbours(triples, frontier, max_rows).withColumn("hop", F.lit(hop)))
        reached = found if reached is None else reached.unionByName(found)
        if hop == hops:
            break
        ends = found.select("q_id", "collection_id", F.explode(F.array("subject", "object")).alias("entity")).distinct()
        # Every end is once in `ends`, so that no key is hot.
        frontier = cut_lineage(equi_join(ends, visited, ["q_id", "collection_id", "entity"], "left_anti", max_rows=max_rows, salts=1))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return reached.groupBy("q_id", *_EDGE).agg(F.min("hop").alias("hop"))
