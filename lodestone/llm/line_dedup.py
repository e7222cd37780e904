"""Line dedup by winnowing over line hashes, in native operations only.

Lines are compared after A-Z is lower-cased and white space (\\x20, \\x09-\\x0D) is
trimmed and made one space; lines that are empty then are not compared. A window starts
at every line and takes as few lines as hold MIN_WORDS words. Each window selects the
least hash of its lines (the last of equal ones) as its fingerprint. Two places that
share a run of MIN_WORDS words share the window at the run's start, and so its
fingerprint: windows whose fingerprint stands only once in the corpus are left out.

The other windows meet at (fingerprint, content). Each is matched with the first
place of its content, by document id and line; adjoining matches on one diagonal
are one run, and its two ends are extended line by line as long as the lines of both places
agree. Every run but the first place is deleted, with the empty lines inside it. A
line that goes has an equal line at an earlier place, so that the first copy always stays.

No two later places are paired, so the work grows with the lines, not with
the square of a passage's copies.

Defined results
* null and empty texts have no lines to delete and stay as they are
* documents without an id come first in the order of places; those that share an id are in
  order of text hash; rows alike in id and text are one document with one result
* a run may repeat inside one document; texts are not shortened otherwise
* an empty table gives an empty table; columns named like result columns are replaced
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut_lineage

MIN_WORDS = 50
RESULT = ("n_lines", "n_deleted")
_DOC = ["k", "h"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FIRST = -(1 << 63)


def _keys(doc_id: str, text: str) -> dict[str, Column]:
    return {"k": F.coalesce(F.col(doc_id).cast("long"), F.lit(_FIRST)), "h": F.xxhash64(F.coalesce(F.col(text), F.lit("")))}


def compared(line: Column) -> Column:
    """A line as it is compared."""
    squeezed = F.regexp_replace(F.translate(line, _UPPER, _LOWER), r"[\x20\x09-\x0D]+", " ")
    return F.trim(squeezed)


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, h, raw, line, words): hash, place and words of every line that is compared."""
    split = docs.select(*[c.alias(n) for n, c in _keys(doc_id, text).items()], F.posexplode(F.split(text, "\n")).alias("raw", "line"))
    lines = split.withColumn("line", compared(F.col("line"))).where("line <> ''")
    words = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    return lines.select(*_DOC, "raw", F.xxhash64("line").alias("line"), words.cast("long").alias("words")).dropDuplicates([*_DOC, "raw"])


def windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k, h, i, j, mark, place, content): from line i to j, the fingerprint and its line, the hash of all lines."""
    there = Window.partitionBy(*_DOC).orderBy("raw")
    before = there.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*_DOC)
    counted = lines.select(
        *_DOC,
        "line",
        (F.row_number().over(there) - 1).alias("i"),
        F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"),
        F.sum("words").over(whole).alias("total"),
    )
    ahead = Window.partitionBy(*_DOC).orderBy("start").rangeBetween(0, min_words - 1)
    seen = counted.select(
        *_DOC,
        "i",
        F.max("i").over(ahead).alias("j"),
        F.min(F.struct("line", (-F.col("i")).alias("back"))).over(ahead).alias("least"),
        F.xxhash64(F.collect_list("line").over(ahead)).alias("content"),
        (F.col("start") + min_words <= F.col("total")).alias("full"),
    )
    return seen.where("full").select(*_DOC, "i", "j", F.col("least.line").alias("mark"), (-F.col("least.back")).alias("place"), "content")


def _agree(own: Column, other: Column, own_at: Column, other_at: Column, step: int) -> Column:
    """How many lines agree from two places on, going by `step`."""
    room = F.least(own_at + 1, other_at + 1) if step < 0 else F.least(F.size(own) - own_at, F.size(other) - other_at)
    same = F.transform(
        F.when(room > 0, F.sequence(F.lit(0), (room - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda x: F.get(own, (own_at + step * x).cast("int"))["line"] == F.get(other, (other_at + step * x).cast("int"))["line"],
    )
    stop = F.array_position(same, F.lit(False))
    return F.when(stop > 0, stop - 1).otherwise(F.greatest(room, F.lit(0))).cast("int")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, h, raw_from, raw_to): the lines of later repeated runs, one row per run."""
    lines = cut_lineage(line_table(docs, doc_id, text))
    found = cut_lineage(windows(lines, min_words))
    marks = found.select(*_DOC, "mark", "place").distinct().groupBy("mark").agg(F.count(F.lit(1)).alias("places"))
    shared = found.join(marks.where("places > 1").select("mark"), "mark")
    firsts = shared.groupBy("mark", "content").agg(F.min(F.struct(*_DOC, "i")).alias("first"), F.count(F.lit(1)).alias("n"))
    later = shared.join(firsts.where("n > 1"), ["mark", "content"]).where(F.struct(*_DOC, "i") > F.col("first"))
    later = later.select(*_DOC, "i", "j", F.col("first.k").alias("other_k"), F.col("first.h").alias("other_h"), F.col("first.i").alias("other_i"))

    diagonal = [*_DOC, "other_k", "other_h", "gap"]
    along = Window.partitionBy(*diagonal).orderBy("i")
    turned = later.withColumn("gap", F.col("i") - F.col("other_i"))
    # Matches whose windows adjoin or overlap on one diagonal are one run.
    reach = F.max("j").over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.coalesce(reach, F.lit(-2)) + 1 < F.col("i")).cast("int")
    runs = turned.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along))
    runs = cut_lineage(runs.groupBy(*diagonal, "run").agg(F.min("i").alias("i"), F.max("j").alias("j")))

    arrays = lines.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("raw", "line"))).alias("lines"))
    others = arrays.select(F.col("k").alias("other_k"), F.col("h").alias("other_h"), F.col("lines").alias("other_lines"))
    met = runs.join(others, ["other_k", "other_h"]).join(arrays, _DOC)
    left = _agree(F.col("lines"), F.col("other_lines"), F.col("i") - 1, F.col("i") - F.col("gap") - 1, -1)
    right = _agree(F.col("lines"), F.col("other_lines"), F.col("j") + 1, F.col("j") - F.col("gap") + 1, 1)
    ends = met.select(*_DOC, "lines", (F.col("i") - left).alias("i"), (F.col("j") + right).alias("j"))
    return ends.select(*_DOC, *[F.get("lines", F.col(c).cast("int"))["raw"].alias(n) for c, n in (("i", "raw_from"), ("j", "raw_to"))])


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the lines of later repeated runs, with n_lines and n_deleted (lines before, lines gone)."""
    runs = repeated_runs(docs, min_words, doc_id, text)
    spans = runs.groupBy(*[F.col(c).alias(f"_{c}") for c in _DOC]).agg(F.collect_set(F.struct("raw_from", "raw_to")).alias("_spans"))
    kept = [c for c in docs.columns if c not in RESULT]
    keyed = docs.select(*kept, *[c.alias(f"_{n}") for n, c in _keys(doc_id, text).items()])
    met = keyed.join(spans, ["_k", "_h"], "left")
    lines = F.split(text, "\n")
    stays = F.filter(lines, lambda line, i: ~F.exists("_spans", lambda s: (i >= s["raw_from"]) & (i <= s["raw_to"])))
    hit = F.col("_spans").isNotNull()
    made = met.withColumn("_stays", F.when(hit, stays))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
    return made.select(
        *[F.when(hit, F.concat_ws("\n", "_stays")).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in kept],
        n_lines.alias("n_lines"),
        F.when(hit, n_lines - F.size("_stays")).otherwise(0).cast("long").alias("n_deleted"),
    )


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_lines, n_deleted, kept_chars, kept_sha256."""
    kept = drop_repeated_lines(docs.select(doc_id, text), doc_id=doc_id, text=text, **options)
    clean = F.coalesce(F.col(text), F.lit(""))
    return kept.select(
        doc_id, "n_lines", "n_deleted", F.length(clean).cast("long").alias("kept_chars"), F.sha2(clean.cast("binary"), 256).alias("kept_sha256")
    )
