"""Text to vector: signed feature hashing, or a model given as a Pandas UDF."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import cuts, tokenize

DEFAULT_DIM = 384
#: Words of texts that a task counts at once.
WORDS_AT_ONCE = 500_000


def _slots(terms: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    digests = [hashlib.md5(t.encode()).hexdigest() for t in terms]
    bucket = np.array([int(d[:8], 16) % dim for d in digests], dtype=np.int64)
    sign = np.array([1.0 - 2.0 * (int(d[8], 16) & 1) for d in digests])
    return bucket, sign


def hash_tokens(tokens: Column, dim: int = DEFAULT_DIM) -> Column:
    """Unit-length vector of a token list; no tokens give the zero vector.

    The first eight hex digits of a term's MD5 choose its position and the
    ninth its sign. Map-only: Arrow batches go through one `bincount` for each WORDS_AT_ONCE words.
    """

    @F.arrow_udf("array<float>")
    def vectors(batch: pa.Array) -> pa.Array:
        made = [unit(batch.slice(at, end - at)) for at, end in cuts(batch, WORDS_AT_ONCE)]
        flat = np.concatenate(made, axis=None) if made else np.zeros(0, dtype=np.float32)
        return pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * dim, pa.array(flat))

    def unit(lists: pa.ListArray) -> np.ndarray:
        counts = lists.value_lengths().to_numpy(zero_copy_only=False)
        words = lists.flatten().dictionary_encode()
        if len(words) == 0:
            return np.zeros((len(lists), dim), dtype=np.float32)
        bucket, sign = _slots(words.dictionary.to_pylist(), dim)
        codes = words.indices.to_numpy()
        cells = np.repeat(np.arange(len(lists)) * dim, counts) + bucket[codes]
        sums = np.bincount(cells, weights=sign[codes], minlength=len(lists) * dim).reshape(-1, dim)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        return np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0).astype(np.float32)

    return vectors(tokens)


def embed(
    df: DataFrame,
    text_col: str = "text",
    out_col: str = "embedding",
    fn: Callable[[Column], Column] | None = None,
    dim: int = DEFAULT_DIM,
) -> DataFrame:
    """Add a vector column; `fn` is a Pandas UDF from text to array<float>.

    An `out_col` that is already there passes through where it is not NULL.
    """
    made = fn(F.col(text_col)) if fn else hash_tokens(tokenize(F.col(text_col)), dim)
    if out_col in df.columns:
        made = F.coalesce(F.col(out_col), made)
    return df.withColumn(out_col, made)
