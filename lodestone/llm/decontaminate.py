"""Benchmark decontamination: broadcast test n-grams, scan documents, verify and remove.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z, so every
character outside ASCII belongs to a word. A window is `n` consecutive words of
an item; an item of fewer words is one window, an item without words has none.

Defined results
* null or empty texts have no words and no hits; null items have no windows
* items that share an id count once; an item without an id marks words but is not listed
* repeated documents each get their own row; an empty table gives an empty table
* an input column that is named like a result column is replaced
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text of the items that one broadcast holds at most (a longer single item is a
#: block of its own). More items are scanned for block after block.
BLOCK_BYTES = 4 << 20

_SEPARATORS = [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_CLEAN = bytearray(bytes(range(256)).lower())
for _c in _SEPARATORS:
    if not 0x41 <= _c <= 0x5A:
        _CLEAN[_c] = 0x20
_CLEAN = bytes(_CLEAN)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_CLEAN).split() if text else []


class Windows:
    """Distinct windows of some items, by length, with the items that hold each."""

    def __init__(self, vocabulary: dict[bytes, int], by_length: list[tuple]):
        self.vocabulary, self.by_length = vocabulary, by_length

    @classmethod
    def of(cls, items: list[tuple[str | None, bytes | None]], n: int) -> Windows:
        vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item_id, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
            length = min(n, len(ids))
            for i in range(len(ids) - length + 1 if ids else 0):
                holders = found.setdefault(length, {}).setdefault(tuple(ids[i : i + length]), set())
                if item_id is not None:
                    holders.add(item_id)
        return cls(vocabulary, [cls._table(length, windows) for length, windows in sorted(found.items())])

    @staticmethod
    def _table(length: int, windows: dict[tuple[int, ...], set[str]]):
        grams = np.array(list(windows), dtype=np.int32).reshape(-1, length)
        holders = [sorted(x) for x in windows.values()]
        for seed in range(100):
            factors = np.random.default_rng(seed).integers(1, 1 << 63, length, dtype=np.uint64) | np.uint64(1)
            keys = (grams.astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64)
            if len(np.unique(keys)) == len(keys):
                break
        else:
            raise ValueError("no hash without collisions was found")
        order = np.argsort(keys)
        return length, factors, keys[order], grams[order], [holders[i] for i in order]

    def find(self, text: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """For each word whether a window covers it, and the items found."""
        covered, items = np.zeros(len(text) + 1, dtype=np.int32), set()
        ids = np.fromiter(map(self.vocabulary.get, text, repeat(0)), dtype=np.int32, count=len(text))
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for length, factors, keys, grams, holders in self.by_length:
            starts = np.flatnonzero(unknown[length:] == unknown[: len(unknown) - length]) if len(text) >= length else []
            if not len(starts):
                continue
            hashed = np.zeros(len(starts), dtype=np.uint64)
            for j in range(length):
                hashed += ids[starts + j].astype(np.uint64) * factors[j]
            at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == hashed)
            if not len(hit):
                continue
            starts, at = starts[hit], at[hit]
            same = (ids[starts[:, None] + np.arange(length)] == grams[at]).all(axis=1)
            np.add.at(covered, starts[same], 1)
            np.add.at(covered, starts[same] + length, -1)
            for i in np.unique(at[same]):
                items.update(holders[i])
        return np.cumsum(covered[:-1]) > 0, items


def _spans(mask: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list]:
    """The items in blocks that are bounded before they are fetched."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.encode(text, "UTF-8").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0)).alias("bytes")).first()["bytes"]
    n = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        yield [(r["item"], None if r["text"] is None else bytes(r["text"])) for r in part.collect()]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`docs` with n_words, hit_words (spans of word positions, end excluded) and items.

    The windows of a block of items are broadcast; documents are scanned where
    they are read, without a shuffle. A hash hit is verified word by word.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("n_words", "hit_words", "items")]
    out = docs.select(*kept).withColumns(
        {"n_words": F.lit(0).cast("long"), "hit_words": F.lit(None).cast(SPANS), "items": F.lit(None).cast("array<string>")}
    )
    schema = out.schema
    for items in _blocks(benchmark, item_id, item_text, block_bytes):
        windows = Windows.of(items, n)
        shared = spark.sparkContext.broadcast((windows.vocabulary, windows.by_length))
        out = out.mapInArrow(_scanner(shared, text), schema)
    return out


def _scanner(shared, text: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(*shared.value)
        for batch in batches:
            counts, spans, found = [], [], []
            texts = batch.column(text).cast(pa.binary() if pa.types.is_string(batch.column(text).type) else pa.large_binary())
            before = zip(batch.column("hit_words").to_pylist(), batch.column("items").to_pylist())
            for value, (old_spans, old_items) in zip(texts, before):
                tokens = words(value.as_py())
                mask, items = windows.find(tokens)
                for span in old_spans or ():
                    mask[span["start"] : span["end"]] = True
                counts.append(len(tokens))
                spans.append(_spans(mask) if mask.any() else [])
                found.append(sorted(items.union(old_items or ())))
            new = {"n_words": counts, "hit_words": spans, "items": found}
            arrays = [pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name) for f in batch.schema]
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return scan


def cut_words(text: str | None, spans: list | None) -> str | None:
    """The text without the given spans of words."""
    if text is None or not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    parts, at = [], 0
    for span in spans:
        parts.append(text[at : places[span["start"]][0]])
        at = places[span["end"] - 1][1]
    return "".join([*parts, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "document", text: str = "text", **options) -> DataFrame:
    """`docs` without contaminated documents, or without the contaminated spans of words.

    The columns stay those of `docs`, but for columns named n_words, hit_words or items.
    """
    found = find_contamination(docs, benchmark, text=text, **options)
    kept = [c for c in docs.columns if c in found.columns and c not in ("n_words", "hit_words", "items")]
    if action == "document":
        return found.where(F.size("hit_words") == 0).select(*kept)
    if action != "span":
        raise ValueError(f"action is document or span, not {action!r}")
    schema = found.schema

    def cut(batches):
        for batch in batches:
            pairs = zip(batch.column(text).to_pylist(), batch.column("hit_words").to_pylist())
            new = pa.array([cut_words(t, s) for t, s in pairs], batch.schema.field(text).type)
            i = batch.schema.get_field_index(text)
            yield batch.set_column(i, batch.schema.field(i), new)

    return found.mapInArrow(cut, schema).select(*kept)


def contamination_report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs.select(doc_id, F.col(text).alias("_text")), benchmark, text="_text", **options)
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        doc_id,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
