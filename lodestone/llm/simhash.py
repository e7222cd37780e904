"""SimHash near-dedup by anchor-point covering.

Fingerprints: words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, shingles are
`k` words joined by a space, repeats included; a text of fewer words is one
shingle. A bit is 1 if it is set in more than half of the shingles' XXH64
hashes (seed 42). Texts without words have fingerprint 0.

Covering: fingerprints at 3 or fewer differing bits differ in at most one bit of
one half. In 31 bits of each half the codewords of the perfect Hamming code are
the anchors: every point has exactly one anchor within its covering radius 1
(its home) and is copied to every anchor within radius + 1 (16 at most). Two
linked fingerprints meet at the home of either, so that each anchor only
compares its home points with the points copied to it.

Only distinct fingerprints are compared. An anchor that is home to very many of
them is cut into cells of a bounded number of home points, and each task gives
no more links than join what it has compared.

Defined results
* null and empty texts have fingerprint 0 and are linked like any other
* component_id is the smallest doc_id of a class; rows without an id join a class
  but do not name it (null where no row of the class has an id)
* repeated documents each get a row; an empty table gives an empty table
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from lodestone.llm.components import connected
from lodestone.session import BROADCAST_ROWS, cut_lineage, fits

SEED = 42
#: Largest number of differing bits that the covering is built for.
THRESHOLD = 3
#: Home points that one cell of an anchor compares at most, but for chance.
CELL = 1024

#: Shingles whose bits are counted at a time.
_CHUNK = 1 << 14


def shingle_hashes(text: bytes | None, k: int = 3) -> Iterator[int]:
    tokens = text.lower().split() if text else []
    if not tokens:
        return iter(())
    if len(tokens) < k:
        return iter((xxh64_intdigest(b" ".join(tokens), SEED),))
    return (xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(tokens[i:] for i in range(k))))


def fingerprint(text: bytes | None, k: int = 3) -> int:
    """The 64-bit fingerprint of UTF-8 text."""
    hashes = np.fromiter(shingle_hashes(text, k), dtype=np.uint64)
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i : i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(keyed: DataFrame, k: int = 3) -> DataFrame:
    """Rows with UTF-8 `text` to the same rows with the signed 64-bit `fp` in its place."""
    fields = [f for f in keyed.schema.fields if f.name != "text"]
    schema = T.StructType([*fields, T.StructField("fp", T.LongType())])

    def scan(batches):
        for batch in batches:
            made = np.array([fingerprint(x.as_py(), k) for x in batch.column("text")], dtype=np.uint64)
            columns = [*(batch.column(f.name) for f in fields), pa.array(made.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return keyed.mapInArrow(scan, schema)


# Anchors ---------------------------------------------------------------------

_LOW31 = (1 << 31) - 1


def _syndrome_masks() -> list[int]:
    """For each syndrome bit the 31-bit mask of the positions 1..31 whose number has that bit."""
    return [sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1) for j in range(5)]


def _moves(syndrome: int) -> list[int]:
    """What to flip to reach every codeword within distance 2, the home first."""
    if syndrome == 0:
        return [0]
    pairs = [(i, i ^ syndrome) for i in range(1, 32) if i < i ^ syndrome]
    return [1 << (syndrome - 1), *((1 << (i - 1)) | (1 << (j - 1)) for i, j in pairs)]


def _anchored(distinct: DataFrame) -> DataFrame:
    """(fp) to rows (anchor, fp, home): 32 rows at most per fingerprint."""
    moves = F.array(*[F.array(*[F.lit(m).cast("long") for m in _moves(s)]) for s in range(32)])

    def around(half: int, bits: Column) -> Column:
        parity = [F.shiftleft(F.bit_count(bits.bitwiseAND(F.lit(m).cast("long"))) % 2, j) for j, m in enumerate(_syndrome_masks())]
        syndrome = parity[0] + parity[1] + parity[2] + parity[3] + parity[4]
        return F.transform(
            F.get(moves, syndrome),
            lambda move, i: F.struct((bits.bitwiseXOR(move) + (half << 31)).alias("anchor"), (i == 0).alias("home")),
        )

    low, high = (F.col("fp").bitwiseAND(F.lit(_LOW31)), F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(_LOW31)))
    rows = distinct.select("fp", F.explode(F.concat(around(0, low), around(1, high))).alias("at"))
    return rows.select("at.anchor", "fp", "at.home")


def _celled(rows: DataFrame, cell: int) -> DataFrame:
    """Adds `cell`: an anchor with n home points gets ceil(n / cell) cells.

    A home point belongs to one cell of its anchor; what is copied to the anchor goes to all.
    """
    homes = rows.where("home").groupBy("anchor").agg(F.count(F.lit(1)).alias("homes"))
    hot = cut_lineage(homes.where(F.col("homes") > cell).select("anchor", F.ceil(F.col("homes") / cell).cast("int").alias("cells")))
    side = F.broadcast(hot) if fits(hot, BROADCAST_ROWS) else hot
    joined = rows.join(side, "anchor", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), "cells").cast("int")
    every = F.sequence(F.lit(0), F.col("cells") - 1)
    spread = joined.select("anchor", "fp", "home", own.alias("own"), F.explode(every).alias("cell"))
    return spread.select("anchor", "cell", "fp", (F.col("home") & (F.col("own") == F.col("cell"))).alias("home"))


class _Forest:
    """Union-find over the points of one batch; tells whether an edge joins two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (above := self.up.get(x, x)) != x:
            path.append(x)
            x = above
        for y in path:
            self.up[y] = x
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


#: Groups of so many home points are compared one by one, others all at once.
_FEW = 8


def _batch_links(anchor, cell, fp, home, threshold: int):
    """Links among rows sorted by (anchor, cell, home first), as a spanning forest."""
    start = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1]))))
    sizes = np.diff(np.append(start, len(fp)))
    n_homes = np.add.reduceat(home.astype(np.int64), start)
    first, homes_of = np.repeat(start, sizes), np.repeat(n_homes, sizes)
    forest = _Forest()

    def near(rows: np.ndarray, other) -> np.ndarray:
        apart = np.bitwise_count((fp[rows] ^ other).view(np.uint64))  # of signed integers it counts the absolute value
        return (apart > 0) & (apart <= threshold)

    few = np.flatnonzero(homes_of <= _FEW)
    for k in range(_FEW):
        few = few[homes_of[few] > k]
        if not len(few):
            break
        partner = fp[first[few] + k]
        hit = near(few, partner)
        for a, b in zip(fp[few[hit]].tolist(), partner[hit].tolist()):
            if forest.join(a, b):
                yield a, b
    for g in np.flatnonzero(n_homes > _FEW):
        rows = np.arange(start[g], start[g] + sizes[g])
        label = np.arange(len(rows))
        for k in range(n_homes[g]):
            hit = np.flatnonzero(near(rows, fp[rows[k]]) & (label != label[k]))
            if not len(hit):
                continue
            others, at = np.unique(label[hit], return_index=True)
            for i in hit[at]:
                if forest.join(int(fp[rows[i]]), int(fp[rows[k]])):
                    yield int(fp[rows[i]]), int(fp[rows[k]])
            label[np.isin(label, others)] = label[k]


def _compare(threshold: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the home points of the group that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "cell", "fp", "home")]
            if held is not None and held[0][0] == cols[0][0] and held[1][0] == cols[1][0]:
                cols = [np.concatenate((a, b)) for a, b in zip(held, cols)]
            links = list(_batch_links(*cols, threshold))
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & cols[3]
            held = [c[last] for c in cols] if last.any() else None
            if links:
                pairs = np.array(links, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return compare


def links(distinct: DataFrame, threshold: int = THRESHOLD, cell: int = CELL) -> DataFrame:
    """(u, v): pairs of the distinct fingerprints `fp` that join all classes at `threshold` bits."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"the covering holds for at most {THRESHOLD} differing bits")
    rows = _celled(_anchored(distinct), cell)
    dealt = rows.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell", F.desc("home"))
    return dealt.mapInArrow(_compare(threshold), "u bigint, v bigint")


def _classes(docs: DataFrame, doc_id: str, text: str, k: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(id, hash, fp) of every document, and (fp, first) with the first row of the fingerprint's class.

    `first` orders the rows of a class by id, rows without one last, then by text hash.
    """
    keyed = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"), F.encode(text, "UTF-8").alias("text"))
    marked = cut_lineage(fingerprints(keyed, k))
    row = F.struct(F.col("id").isNull().alias("nameless"), "id", "hash")
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min(row).alias("first")))
    roots = connected(links(distinct.select("fp"), threshold)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return marked, rooted.select("fp", "root").join(least, "root").select("fp", "first")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id), one row per document."""
    marked, classes = _classes(docs, doc_id, text, k, threshold)
    return marked.join(classes, "fp").select(F.col("id").alias(doc_id), "fp", F.col("first.id").alias("component_id"))


def simhash_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    found = components(docs, doc_id, text, **options)
    return found.select(doc_id, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """`docs` with one row of each class: the smallest id, rows without one last, then the least text hash."""
    marked, classes = _classes(docs, doc_id, text, k, threshold)
    kept = classes.select("first.id", "first.hash").distinct()
    rows = docs.withColumn("_own", F.xxhash64(text))
    return kept_rows(rows, marked, kept, doc_id, "_own").select(*docs.columns)


def kept_rows(rows: DataFrame, marked: DataFrame, kept: DataFrame, doc_id: str, text_hash: str) -> DataFrame:
    """One of the `rows` for each (id, hash) of `kept`; `marked` has a row (id, hash) for each of `rows`."""
    copies = marked.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("copies"))
    same_row = kept["id"].eqNullSafe(copies["id"]) & (kept["hash"] == copies["hash"])
    kept = kept.join(copies, same_row).select(kept["id"].alias("_id"), kept["hash"].alias("_hash"), F.col("copies").alias("_copies"))
    found = rows.join(kept, rows[doc_id].eqNullSafe(F.col("_id")) & (F.col(text_hash) == F.col("_hash")))
    once = found.where("_copies = 1").select(*rows.columns)
    repeated = found.where("_copies > 1").dropDuplicates(["_id", "_hash"]).select(*rows.columns)
    return once.unionByName(repeated)
