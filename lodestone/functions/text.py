"""Text functions: folding, tokens, chunks and entity spans."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A paragraph or line becomes a chunk when it is longer than this.
MIN_CHUNK_CHARS = 50

_OUTER_BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_NOT_ALNUM = r"[^\p{L}\p{N}\p{Co}]+"
# The accents that vanish inside a word, and letters that fold to another one.
_COMBINING = r"[\x{300}-\x{304}\x{306}-\x{30C}\x{30F}\x{311}\x{31B}\x{323}-\x{328}\x{32D}\x{32E}\x{330}\x{331}]"
_FOLDED = {"ς": "σ", "ſ": "s", "µ": "μ"}

_WORD = r"\p{Lu}[\p{L}\p{N}]*"
_SPAN = rf"{_WORD}(?: {_WORD})*"
ENTITY_PATTERN = rf"[.!?\n]\s*{_SPAN}|{_SPAN}"
SENTENCE_EDGE = r"^[.!?\s]+"


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Latin letters with one accent, and the letters they become."""
    folded = dict(_FOLDED)
    for code in range(0x00C0, 0x2000):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if len(parts) == 2 and letter.islower() and "a" <= parts[0] <= "z":
            folded[letter] = parts[0]
    return "".join(folded), "".join(folded.values())


def fold(text: Column) -> Column:
    """Lower case without accents, so that `É`, `é` and `e` are one letter."""
    accented, plain = _fold_table()
    return F.regexp_replace(F.translate(F.lower(text), accented, plain), _COMBINING, "")


def tokenize(text: Column) -> Column:
    """Folded runs of letters and digits, in order, repeats kept."""
    return F.array_remove(F.split(fold(F.coalesce(text, F.lit(""))), _NOT_ALNUM), "")


def cuts(lists: pa.ListArray, words: int) -> Iterator[tuple[int, int]]:
    """Runs of rows (from, to) whose lists hold about `words` values together, and one list at least."""
    lengths = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(lists):
        end = max(at + 1, int(np.searchsorted(lengths, lengths[at] + words, "right")) - 1)
        yield at, end
        at = end


def slices(batches: Iterator[pa.RecordBatch], column: str, words: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about `words` list values, so that memory follows the values and not the rows."""
    for batch in batches:
        for at, end in cuts(batch.column(column), words):
            yield batch.slice(at, end - at)


def _pieces(text: Column, separator: str) -> Column:
    trimmed = F.transform(F.split(text, separator), lambda p: F.regexp_replace(p, _OUTER_BLANKS, ""))
    return F.filter(trimmed, lambda p: F.length(p) > MIN_CHUNK_CHARS)


def chunk_text(text: Column) -> Column:
    """Paragraphs longer than 50 characters; if there is none, such lines."""
    paragraphs = _pieces(text, "\n\n")
    return F.when(F.size(paragraphs) > 0, paragraphs).otherwise(_pieces(text, "\n"))


def entity_spans(text: Column) -> Column:
    """Runs of capitalised words in text order, repeats kept.

    A single capitalised word that opens a sentence is no evidence of a name
    and is left out; runs of several words count everywhere.
    """
    found = F.regexp_extract_all(F.concat(F.lit(". "), text), F.lit(ENTITY_PATTERN), F.lit(0))
    named = F.filter(
        found,
        lambda m: ~(m.rlike(r"^[.!?\n]") & ~F.contains(F.regexp_replace(m, SENTENCE_EDGE, ""), F.lit(" "))),
    )
    return F.transform(named, lambda m: F.regexp_replace(m, SENTENCE_EDGE, ""))
