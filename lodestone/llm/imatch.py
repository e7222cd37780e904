"""I-Match document fingerprints over randomised lexicon subsets, in native operations only.

Terms are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. The lexicon is
the band of terms that stand in a share of the documents between `low` and `high`,
that is in a band of inverse document frequency. Shares do not depend on the size of
the corpus, so the lexicon holds at most (distinct terms of a mean document) / `low`
terms, whatever the number of documents. Each level of subsets deals the lexicon
at random into parts, more and smaller ones from level to level, and keeps the first
SUBSETS of them. A document's fingerprint holds one hash for each subset: that of
its distinct terms in the subset, sorted, or "----" if it has none. A text without any
term of the lexicon has a place more behind the subsets, with 64 bits of the hash of all its
distinct terms, sorted, or if it has no terms, of the whole text.

Two fingerprints are alike by the share of equal hashes among the subsets in which
either document has terms, on the levels that are not crowded for them: a single
changed term changes one hash of a level, and large documents are told apart on
levels of small subsets.

Defined results
* null and empty texts, and such of white space alone, have no terms; their fingerprint is all "----", and two such are alike (1.0)
* other texts without terms of the lexicon are alike (1.0) if their distinct terms are the same, and not at all (0.0) otherwise
* a document without terms of the lexicon is not alike (0.0) one that has terms in a subset
* terms repeated in a text count once, repeated documents count each and get a row each
* an empty table gives an empty table
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut_lineage, fits

LOW, HIGH = 0.002, 0.2
#: Subsets that are kept of each level, and into how many parts each level deals the lexicon.
SUBSETS, PARTS = 16, (16, 48, 144, 432)
#: A level is crowded if more of its subsets than this have terms.
CROWDED = 12
#: Terms that are broadcast at most; a larger lexicon meets the documents in a shuffle join.
MAX_BROADCAST = 400_000
NONE = "----"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    found = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_TERM), F.lit(0))
    return F.array_distinct(found)


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH, seed: str = "i-match") -> DataFrame:
    """(term, level, subset): the band of terms, with the subset each is dealt to on each level that keeps it."""
    total = docs.count()
    counted = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    band = counted.where((F.col("n") >= low * total) & (F.col("n") <= high * total)).select("term")
    dealt = F.array(
        *[
            F.struct(F.lit(level).alias("level"), _part(F.concat(F.lit(f"{seed}:{level}:"), F.col("term")), parts).alias("subset"))
            for level, parts in enumerate(PARTS)
        ]
    )
    rows = band.select("term", F.explode(dealt).alias("at")).select("term", "at.level", "at.subset")
    return cut_lineage(rows.where(F.col("subset") < SUBSETS))


def _part(key: Column, parts: int) -> Column:
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % parts).cast("int")


def subset_hashes(texts: DataFrame, keys: list[str], words: DataFrame, text: str = "text") -> DataFrame:
    """`keys` and `fingerprint`, the hashes of all subsets level after level, of texts with terms of the lexicon.

    Rows with the same keys must have the same text. If `texts` is partitioned by some of the
    keys, nothing but the lexicon moves.
    """
    side = F.broadcast(words) if fits(words, MAX_BROADCAST * len(PARTS)) else words
    met = texts.select(*keys, F.explode(terms(F.col(text))).alias("term")).join(side, "term")
    sets = met.groupBy(*keys, "level", "subset").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    place = (F.col("level") * SUBSETS + F.col("subset")).alias("place")
    hashed = sets.select(*keys, place, F.substring(F.md5(F.concat_ws(" ", "terms").cast("binary")), 1, 4).alias("hash"))
    one = hashed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("place", "hash"))).alias("found"))
    places = F.sequence(F.lit(0), F.lit(len(PARTS) * SUBSETS - 1))
    return one.select(*keys, F.concat_ws("", F.transform(places, lambda i: F.coalesce(F.col("found")[i], F.lit(NONE)))).alias("fingerprint"))


EMPTY = NONE * (SUBSETS * len(PARTS))


def without_lexicon(text: Column) -> Column:
    """The fingerprint of a text that has no term of the lexicon."""
    own = terms(text)
    whole = F.when(F.size(own) > 0, F.concat_ws(" ", F.sort_array(own))).otherwise(text)
    place = F.substring(F.md5(whole.cast("binary")), 1, 16)
    return F.when(F.coalesce(text, F.lit("")).rlike(r"^\s*$"), F.lit(EMPTY)).otherwise(F.concat(F.lit(EMPTY), place))


def add_likeness(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """`rows` with `name`: how alike the fingerprints in the columns `a` and `b` are, 0 to 1.

    Built column by column, so that what several steps use is computed once.
    """

    def counts(level: int) -> Column:
        places = F.sequence(F.lit(level * SUBSETS), F.lit((level + 1) * SUBSETS - 1))
        start = F.struct(F.lit(0).alias("same"), F.lit(0).alias("used"))

        def step(acc, i):
            x, y = F.substring(a, i * 4 + 1, F.lit(4)), F.substring(b, i * 4 + 1, F.lit(4))
            used = (x != NONE) | (y != NONE)
            return F.struct(
                (acc["same"] + (used & (x == y)).cast("int")).alias("same"), (acc["used"] + used.cast("int")).alias("used")
            )

        return F.aggregate(places, start, step)

    # All levels that are not crowded, else the last one, whose subsets are smallest.
    steps = {
        "_levels": F.array(*[counts(i) for i in range(len(PARTS))]),
        "_usable": F.filter("_levels", lambda c: c["used"] > 0),
        "_sparse": F.filter("_usable", lambda c: c["used"] <= CROWDED),
        "_chosen": F.when(F.size("_sparse") > 0, F.col("_sparse")).otherwise(F.slice("_usable", -1, 1)),
    }
    for step, column in steps.items():
        rows = rows.withColumn(step, column)
    same = F.aggregate("_chosen", F.lit(0), lambda total, c: total + c["same"])
    used = F.aggregate("_chosen", F.lit(0), lambda total, c: total + c["used"])
    near = F.when(F.size("_chosen") == 0, (F.col(a) == F.col(b)).cast("double")).otherwise(same / used)
    return rows.withColumn(name, near).drop(*steps)


# Edited texts ----------------------------------------------------------------

_NAMELESS = -(1 << 63)


def _in_turn(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(k, h, id, n, copies, next_k, next_h): distinct documents with the next one by descending id, the last with the first.

    Neighbours are found inside range partitions; only one row of each partition meets in one task.
    """
    keyed = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(_NAMELESS)).alias("k"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"),
        F.col(doc_id).alias("id"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n"),
    )
    distinct = keyed.groupBy("k", "h").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    dealt = distinct.repartitionByRange(F.desc("k"), F.desc("h")).withColumn("part", F.spark_partition_id())
    parts = cut_lineage(dealt)
    turn = Window.partitionBy("part").orderBy(F.desc("k"), F.desc("h"))
    led = parts.withColumn("follower", F.lead(F.struct("k", "h")).over(turn))
    heads = parts.groupBy("part").agg(F.max(F.struct("k", "h")).alias("head"))
    around = Window.orderBy("part")
    everything = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("part", F.coalesce(F.lead("head").over(around), F.first("head").over(everything)).alias("after"))
    found = led.join(F.broadcast(heads), "part").withColumn("follower", F.coalesce("follower", "after"))  # a row per partition
    return found.select("k", "h", "id", "n", "copies", F.col("follower.k").alias("next_k"), F.col("follower.h").alias("next_h"))


def _edited(texts: DataFrame, turns: DataFrame) -> DataFrame:
    """(k, h, text, edited): the texts of `turns` with their edited texts."""
    need = F.floor(F.col("n") / 3).cast("int")
    wanted = turns.select(F.col("k").alias("to_k"), F.col("h").alias("to_h"), need.alias("need"), F.col("next_k").alias("k"), F.col("next_h").alias("h"))
    heads = texts.join(wanted, ["k", "h"]).select(F.col("to_k").alias("k"), F.col("to_h").alias("h"), F.col("text").substr(F.lit(1), F.col("need")).alias("head"), "need")
    return texts.join(heads, ["k", "h"]).select(
        "k", "h", "text", F.concat(F.col("text").substr(F.lit(1), F.length("text") - F.col("need")), F.col("head")).alias("edited")
    )


def _with_bare(marked: DataFrame, texts: DataFrame, turns: DataFrame) -> DataFrame:
    """`marked` with the fingerprints of texts and edited texts that have no term of the lexicon; only these are read again."""
    bare = marked.where(F.col("fingerprint").isNull() | F.col("edited_fingerprint").isNull()).select("k", "h")
    if not bare.limit(1).count():
        return marked
    side = F.broadcast if fits(bare) else lambda rows: rows
    turned = turns.join(side(bare), ["k", "h"])
    needed = turned.select("k", "h").union(turned.select("next_k", "next_h")).distinct()
    few = cut_lineage(texts.join(side(needed), ["k", "h"], "left_semi"))
    own = _edited(few, turned).select("k", "h", without_lexicon(F.col("text")).alias("_own"), without_lexicon(F.col("edited")).alias("_own_edited"))
    filled = marked.join(side(cut_lineage(own)), ["k", "h"], "left")
    return filled.select(
        "k", "h", "edited_sha256",
        F.coalesce("fingerprint", "_own").alias("fingerprint"), F.coalesce("edited_fingerprint", "_own_edited").alias("edited_fingerprint"),
    )


def imatch_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are; one row per document.

    The edited text has its last floor(n / 3) code points replaced by the first as many of
    the next document by descending id. Documents that share an id are in order of text hash.
    """
    words = lexicon(docs, text, **options)
    turns = cut_lineage(_in_turn(docs, doc_id, text))
    clean = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NAMELESS)).alias("k"), F.xxhash64(clean).alias("h"), clean.alias("text"))
    if turns.where("copies > 1").limit(1).count():
        texts = texts.dropDuplicates(["k", "h"])
    edited = _edited(texts, turns)
    both = edited.select("k", "h", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("text")) for i, c in enumerate(("text", "edited"))])).alias("x"))
    prints = subset_hashes(both.select("k", "h", "x.i", "x.text"), ["k", "h", "i"], words)
    prints = prints.groupBy("k", "h").agg(*[F.max(F.when(F.col("i") == i, F.col("fingerprint"))).alias(c) for i, c in enumerate(("fingerprint", "edited_fingerprint"))])
    digests = edited.select("k", "h", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    marked = _with_bare(cut_lineage(digests.join(prints, ["k", "h"], "left")), texts, turns)
    following = marked.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.col("fingerprint").alias("next_fingerprint"))
    rows = turns.join(marked, ["k", "h"]).join(following, ["next_k", "next_h"])
    rows = add_likeness(rows, "fingerprint", "edited_fingerprint", "near_edited")
    rows = add_likeness(rows, "fingerprint", "next_fingerprint", "near_next")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(
        F.col("id").alias(doc_id),
        F.col("n").alias("n_chars"),
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )
