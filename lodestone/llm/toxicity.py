"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear SVM.

Units are the words of a text, lower-cased and stripped of outer punctuation; a
word with punctuation inside is also a unit without it, and a run of single
characters is one unit more. A long word is read through overlapping windows
that no insult of HALF characters escapes. Gaps, inserted letters and unknown
endings are what the kernel tolerates.

Two strings are compared by their common subsequences of ORDER characters, each
weighted by DECAY to the power of its length with gaps; the ends of a word are
characters too. A unit's features are its kernel values with the landmarks, mapped by
the inverse root of the landmarks' own kernel matrix. The SVM is trained on the words of
labelled sentences and documents: each toxic one hands in the word that the last model
found worst, and that word with inserted characters; clean ones hand in all words.
A document's score comes from its worst units, and from how many of its units
the SVM calls toxic, by a logistic regression on the same documents.

The fit takes `max_fit` documents of each class with at most `max_fit_bytes`
bytes. Scoring reads whole texts, wherever they are, without a shuffle.

Defined results
* null and empty texts have no units; they get the score of a text without similarity to any landmark
* without labelled rows of both classes every score is the share of toxic rows (0 without any)
* repeated documents each get a row; an empty table gives an empty table
* an input column that is named like a result column is replaced
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.worker import give_back, memory_of

ORDER = 4
DECAY = 0.7
#: Characters that stand for the beginning and the end of a word.
OPEN, CLOSE = "\x02", "\x03"
#: Units of more characters are cut into windows of WINDOW characters, each HALF after the last.
WINDOW, HALF = 20, 10
#: Landmarks from toxic and from clean documents.
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 48, 24
#: Documents of each class that the model is fitted on, and the bytes of the longest.
MAX_FIT, MAX_FIT_BYTES = 2000, 1 << 15
#: Units whose value a worker remembers from task to task, and words, but for those of SLICE documents; they are read STEP by STEP.
_CACHE, SLICE, STEP = 500_000, 4096, 256
#: Words that the driver remembers in the fit.
_FIT_WORDS = 20_000
_BLOCK = 1 << 15
#: Rows of the matrix of features that the fit holds in doubles at once.
_ROWS = 1 << 12

_SPELLED = re.compile(r"(?<!\S)(?:\S ){2,}\S[^\w\s]*(?!\S)")
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")


def _units_of(raw: str) -> list[str]:
    """The units of a word between blanks."""
    words, word = [], raw
    if not word.isalnum():
        word = _OUTER.sub("", word)
        if not word.isalnum():
            words.append(_INNER.sub("", word))
    words.append(word)
    out = []
    for word in words:
        if len(word) + 2 >= ORDER:  # shorter words have no subsequence of ORDER characters
            word = OPEN + word + CLOSE
            out += [word] if len(word) <= WINDOW else [word[i : i + WINDOW] for i in range(0, len(word) - HALF, HALF)]
    return out


class Units:
    """Numbers for units, and for every word between blanks the numbers of its units."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.spelled = _Spelled(self)
        self.several: list[tuple[int, ...]] = [()]

    def __len__(self) -> int:
        return len(self.numbers)

    def number(self, unit: str) -> int:
        return self.numbers.setdefault(unit, len(self.numbers))

    def of(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the numbers of its units, ascending, and how often each occurs."""
        lower = [x.lower() if x else "" for x in texts]
        words = [x.split() for x in lower]
        sizes = np.array([len(x) for x in words], dtype=np.int64)
        ids = np.fromiter(map(self.spelled.__getitem__, chain.from_iterable(words)), np.int64, sizes.sum())
        owner = np.repeat(np.arange(len(texts)), sizes)
        # Only texts with two single characters side by side, which have no unit, can hold one spelled out.
        beside = (ids[1:] == -1) & (ids[:-1] == -1) & (owner[1:] == owner[:-1])
        more = [(i, self.spelled[x.replace(" ", "")]) for i in np.unique(owner[1:][beside]).tolist() for x in _SPELLED.findall(lower[i])]
        if more:
            owner, ids = (np.concatenate([x, y]) for x, y in zip((owner, ids), np.array(more, np.int64).T))
        one = ids >= 0
        if not one.all():
            other = [(i, n) for i, j in zip(owner[~one].tolist(), ids[~one].tolist()) for n in self.several[-1 - j]]
            extra = np.array(other, np.int64).reshape(-1, 2).T
            owner, ids = np.concatenate([owner[one], extra[0]]), np.concatenate([ids[one], extra[1]])
        span = max(1, len(self.numbers))
        keys, counts = np.unique(owner * span + ids, return_counts=True)
        bounds = np.searchsorted(keys, np.arange(len(texts) + 1) * span)
        found = (keys % span).astype(np.int32)
        for a, b in zip(bounds, bounds[1:]):
            yield found[a:b], counts[a:b]

    def forget_words(self) -> None:
        self.spelled.clear()
        self.several[1:] = []

    def keep(self, numbers: np.ndarray) -> None:
        """Only these units stay, numbered in this order."""
        names = list(self.numbers)
        self.numbers = {names[i]: n for n, i in enumerate(numbers.tolist())}
        self.forget_words()


class _Spelled(dict):
    """The number of the one unit of a word; -1 for no unit, below it less the place in `several`, less 1."""

    def __init__(self, units: Units):
        self.units = units

    def __missing__(self, raw: str) -> int:
        found = tuple(map(self.units.number, _units_of(raw)))
        if len(found) == 1:
            out = found[0]
        elif not found:
            out = -1
        else:
            self.units.several.append(found)
            out = -len(self.units.several)
        self[raw] = out
        return out


def units(text: str | None) -> Counter:
    """The units of a text with how often each occurs."""
    known = Units()
    ids, counts = next(known.of([text]))
    names = list(known.numbers)
    return Counter({names[i]: n for i, n in zip(ids.tolist(), counts.tolist())})


def evidence(values: np.ndarray, counts: np.ndarray, bias: float) -> np.ndarray:
    """What the score of a document is computed from, given the decisions of its units and how often each occurs."""
    if not len(values):
        values, counts = np.array([bias]), np.array([1])
    best = np.sort(values)[::-1][:3]
    hits, total = counts[values > 0].sum(), counts.sum()
    return np.array([best[0], best.mean(), np.log1p(hits), np.log1p(total), 100 * hits / total, 1.0])


def gapped(word: str) -> list[str]:
    """The word with one character inserted or doubled at each inner place."""
    return [word[:i] + c + word[i:] for i in range(2, len(word) - 1) for c in (".", word[i])]


# Kernel ----------------------------------------------------------------------


def _columns(strings: list[str]) -> np.ndarray:
    """Code points, one column per string, filled up with 0."""
    width = max(map(len, strings))
    joined = "".join(x.ljust(width, "\0") for x in strings).encode("utf-32-le")
    return np.ascontiguousarray(np.frombuffer(joined, dtype=np.uint32).reshape(len(strings), width).T)


def _against(columns: np.ndarray, other: str) -> np.ndarray:
    """The gap-weighted subsequence kernel of every string with one other.

    The weight of a common subsequence depends on where it begins and ends only, so the decay is
    taken off at its first character and put on at its last; between, plain prefix sums are enough.
    """
    n, m = columns.shape[1], len(other)
    # prefix[q][i]: common subsequences of q + 1 characters of what is read and other[:i], by DECAY ** -(places of the first)
    prefix = [np.zeros((m + 1, n), dtype=np.float32) for _ in range(ORDER - 1)]
    total = np.zeros(n, dtype=np.float32)
    letters = {c: ord(c) for c in set(other)}
    for r, row in enumerate(columns):
        same = {c: row == code for c, code in letters.items()}
        there = [i for i, c in enumerate(other) if same[c].any()]
        if not there:
            continue
        same = {c: x.astype(np.float32) for c, x in same.items()}
        for i in there:
            total += same[other[i]] * prefix[ORDER - 2][i] * np.float32(DECAY ** (r + i + 2))
        for q in range(ORDER - 2, -1, -1):
            run = np.zeros(n, dtype=np.float32)
            for i in range(there[0], m):
                if i in there:
                    run += same[other[i]] * (prefix[q - 1][i] if q else np.float32(DECAY ** -(r + i)))
                prefix[q][i + 1] += run
    return total


def _long_enough(columns: np.ndarray, right: list[str]) -> np.ndarray:
    """For every string and every other whether they have a common subsequence of ORDER characters; without one the kernel is 0.

    One bit per character of the other string, all other strings at once.
    """
    codes = np.array(sorted({ord(c) for x in right for c in x}), dtype=np.uint32)
    masks = np.zeros((len(codes) + 1, len(right)), dtype=np.uint32)
    for j, x in enumerate(right):
        for i, c in enumerate(x):
            masks[np.searchsorted(codes, ord(c)), j] |= np.uint32(1 << i)
    state = np.full((columns.shape[1], len(right)), 0xFFFFFFFF, dtype=np.uint32)
    for row in columns:
        at = np.minimum(np.searchsorted(codes, row), len(codes) - 1)
        there = masks[np.where(codes[at] == row, at, len(codes))]
        both = state & there
        state = (state + both) | (state - both)
    return np.bitwise_count(~state) >= ORDER


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """The kernel of every pair, as (len(left), len(right)); the strings have at most WINDOW + 2 characters."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    order = sorted(range(len(left)), key=lambda i: len(left[i]))
    bounds = np.searchsorted([len(left[i]) for i in order], [0, 7, 9, 11, 14, WINDOW + 3])
    for a, b in zip(bounds, [*bounds[1:], len(order)]):
        for at in (np.array(order[i : min(i + _BLOCK, b)]) for i in range(a, b, _BLOCK)):
            columns = _columns([left[i] for i in at])
            enough = _long_enough(columns, right)
            for j, x in enumerate(right):
                near = np.flatnonzero(enough[:, j])
                if len(near):
                    out[at[near], j] = _against(np.ascontiguousarray(columns[:, near]), x)
    return out


def self_kernel(strings: list[str]) -> np.ndarray:
    return np.array([_against(_columns([x]), x)[0] for x in strings], dtype=np.float32)


class Model:
    """Landmarks with one weight each, a bias, and the weights of a document's evidence."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, mix: np.ndarray):
        self.landmarks, self.weights, self.bias, self.mix = landmarks, weights.astype(np.float32), bias, mix

    def name(self) -> str:
        """The same for models that give the same values."""
        return hashlib.md5(repr((self.landmarks, self.weights.tolist(), self.bias)).encode()).hexdigest()

    def values(self, strings: list[str]) -> np.ndarray:
        """The SVM's decision for every string."""
        parts = [kernel(strings[i : i + _BLOCK], self.landmarks) @ self.weights for i in range(0, len(strings), _BLOCK)]
        return np.concatenate([*parts, np.zeros(0, np.float32)]) + self.bias

    def score(self, values: np.ndarray, counts: np.ndarray) -> float:
        at = evidence(np.asarray(values, dtype=float), np.asarray(counts), self.bias) @ self.mix
        return float(1 / (1 + np.exp(-np.clip(at, -30, 30))))


class Constant:
    """What is known without examples of both classes."""

    def __init__(self, share: float):
        self.share = share

    def name(self) -> str:
        return "constant"

    def values(self, strings: list[str]) -> np.ndarray:
        return np.zeros(len(strings))

    def score(self, values: np.ndarray, counts: np.ndarray) -> float:
        return self.share


# Fit -------------------------------------------------------------------------


def _decided(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w in doubles, without the whole of x in doubles."""
    return np.concatenate([x[i : i + _ROWS] @ w for i in range(0, len(x), _ROWS)])


def _stacked(x: np.ndarray, rows: np.ndarray, below: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """x[rows] with `below` under it, in doubles, block by block, each with its place."""
    for i in range(0, len(rows), _ROWS):
        part = x[rows[i : i + _ROWS]].astype(np.float64)
        yield slice(i, i + len(part)), part
    yield slice(len(rows), len(rows) + len(below)), below.astype(np.float64)


def _svm(
    parts: Callable[[], Iterator[tuple[slice, np.ndarray]]], y: np.ndarray, weight: np.ndarray, c: float = 50.0, steps: int = 60
) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss; the last column of the rows is 1. Newton steps on the active rows.

    The rows are read block by block, so that no step holds all of them.
    """
    w, active = 0.0, np.ones(len(y), dtype=bool)

    def inside(w: np.ndarray) -> np.ndarray:
        return y * np.concatenate([part @ w for _, part in parts()]) < 1

    for _ in range(steps):
        left, right = 0.0, 0.0
        for at, part in parts():
            on = active[at]
            part, scale = part[on], c * weight[at][on]
            left = left + part.T @ (part * scale[:, None])
            right = right + part.T @ (scale * y[at][on])
        ridge = np.eye(len(right))
        ridge[-1, -1] = 1e-6
        new = np.linalg.solve(ridge + left, right)
        now = inside(new)
        moved, w = np.abs(new - w).max(), (w + new) / 2 if (now != active).any() else new
        if moved < 1e-6:
            break
        active = inside(w)
        if not active.any():
            break
    return w


def _mined(
    x: np.ndarray, negative: np.ndarray, share: np.ndarray, positive: np.ndarray, mass: np.ndarray, most: int = 5000
) -> np.ndarray:
    """The SVM of all negative rows, each with its share, found on those that come near the margin."""
    work, w = np.arange(0, len(negative), max(1, len(negative) // most)), np.zeros(x.shape[1])
    for _ in range(10):
        sign = np.concatenate([-np.ones(len(work)), np.ones(len(positive))])
        weight = 1000 * np.concatenate([share[work], mass])
        w = _svm(partial(_stacked, x, negative[work], positive), sign, weight)
        new = np.setdiff1d(np.flatnonzero((x @ w.astype(np.float32))[negative] > -1), work)
        if not len(new):
            break
        work = np.union1d(work, new)
    return w


def _logistic(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression; the last column of x is 1."""
    scale = np.append(x[:, :-1].std(axis=0) + 1e-9, 1.0)
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-1 * np.eye(len(w))
        step = np.linalg.solve(hessian, z.T @ (p - labels) + 1e-1 * w)
        w -= step * min(1.0, 5 / np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def _diverse(ranked: list[str], most: int, chosen: list[str]) -> list[str]:
    """The first `most` words that are not much like any before them, after the `chosen` ones."""
    out = list(chosen)
    norm = [float(x) for x in self_kernel(out)]
    for word in ranked[: 40 * most]:
        own = float(self_kernel([word])[0])
        if out and (kernel([word], out)[0] / np.sqrt(own * np.array(norm))).max() > 0.75:
            continue
        out.append(word)
        norm.append(own)
        if len(out) == len(chosen) + most:
            break
    return out


def _landmarks(words: list[str], toxic: np.ndarray, clean: np.ndarray) -> list[str]:
    """Words that speak most for a toxic document, then the words of clean documents that come nearest to them."""
    def ranked(by: np.ndarray, places: np.ndarray, most: int) -> list[str]:
        order = sorted(places.tolist(), key=lambda i: (by[i], words[i]))
        return [words[i] for i in order[: 40 * most]]

    speaking = _diverse(ranked(3 * clean - toxic, np.flatnonzero(toxic), TOXIC_LANDMARKS), TOXIC_LANDMARKS, [])
    near, norm = np.zeros(len(words), dtype=np.float32), self_kernel(speaking)
    for i in range(0, len(words), _BLOCK):
        near[i : i + _BLOCK] = (kernel(words[i : i + _BLOCK], speaking) / norm).max(axis=1)
    return _diverse(ranked(-near, np.flatnonzero(clean), CLEAN_LANDMARKS), CLEAN_LANDMARKS, speaking)


def _features(words: list[str], landmarks: list[str], scale: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each word in a matrix of features; row 0 is shared by all words without similarity to any landmark."""
    place, n = np.zeros(len(words), dtype=np.int32), 1
    x = np.zeros((len(words) + 1, len(landmarks) + 1), dtype=np.float32)
    x[:, -1] = 1
    for i in range(0, len(words), _BLOCK):
        near = kernel(words[i : i + _BLOCK], landmarks)
        some = np.flatnonzero(near.any(axis=1))
        place[i + some] = n + np.arange(len(some))
        x[n : n + len(some), :-1] = (near[some] * scale) @ root.astype(np.float32)
        n += len(some)
    return place, x[:n]


def fit(texts: list[str | None], labels: list[int], rounds: int = 6) -> Model | Constant:
    """A model of whole labelled texts; the order of the rows does not matter."""
    known = Units()
    docs: dict[bytes, list] = {}  # documents with the same units are one
    for text, label in sorted(zip(texts, labels), key=lambda row: (row[0] or "", row[1])):
        if len(known.spelled) > _FIT_WORDS:
            known.forget_words()  # the driver's memory is for the fit
        ids, counts = next(known.of([text]))
        if len(ids):
            key = hashlib.md5(ids.tobytes() + b"/" + counts.tobytes()).digest()
            docs.setdefault(key, [ids, counts.astype(np.int32), 0])[2] |= int(label)
    known.forget_words()
    y = np.array([label for _, _, label in docs.values()])
    if not len(y) or y.min() == y.max():
        return Constant(float(np.mean(labels)) if len(labels) else 0.0)
    words = list(known.numbers)
    seen = np.zeros((2, len(words)), dtype=np.int64)  # clean and toxic documents that hold a word
    for ids, _, label in docs.values():
        seen[label, ids] += 1
    landmarks = _landmarks(words, seen[1], seen[0])
    scale = 1 / np.sqrt(self_kernel(landmarks))
    own = kernel(landmarks, landmarks) * scale[:, None] * scale[None, :]
    value, vector = np.linalg.eigh(own.astype(np.float64))
    keep = value > 1e-4 * value.max()
    root = (vector[:, keep] / np.sqrt(value[keep])) @ vector[:, keep].T

    place, x = _features(words, landmarks, scale, root)
    rows = [place[ids] for ids, _, _ in docs.values()]
    counts = [n for _, n, _ in docs.values()]
    # Rows of the matrix by how many words of clean documents they stand for.
    weight = np.bincount(place[seen[0] > 0], minlength=len(x))
    negative = np.flatnonzero(weight)
    is_clean = weight > 0
    # The first witness of a toxic document is the word that most of the toxic and fewest of the clean ones share.
    first = (seen[1] + 0.1) / (seen[1] + 30 * seen[0] + 5)
    witness_of = np.full(len(x), -1)  # a word of each row, for its variants
    witness_of[place] = np.arange(len(words))
    decided = None
    for _ in range(rounds):
        if decided is None:
            at = [ids[np.argmax(first[ids])] for ids, _, label in docs.values() if label]
            chosen = place[np.array(at)]
        else:
            worst = np.array([decided[r].max() for r in rows])
            # Toxic documents that look cleaner than most clean ones teach nothing: their insults are unknown or their labels wrong.
            speaks = (y == 1) & (worst > np.quantile(worst[y == 0], 0.75))
            if not speaks.any():
                break
            chosen = np.array([rows[i][np.argmax(decided[rows[i]])] for i in np.flatnonzero(speaks)])
        kinds, count = np.unique(chosen[chosen > 0], return_counts=True)
        if not len(kinds):
            break
        variants = [(v, n) for k, n in zip(kinds, count) if not is_clean[k] for v in gapped(words[witness_of[k]])]
        extra = (kernel([v for v, _ in variants], landmarks) * scale) @ root
        positive = np.vstack([x[kinds], np.hstack([extra, np.ones((len(variants), 1))])])
        mass = np.concatenate([count / count.sum(), 0.3 * np.array([n for _, n in variants]) / max(1, sum(n for _, n in variants))])
        w = _mined(x, negative, weight[negative] / weight.sum(), positive, mass)
        decided = _decided(x, w)
    if decided is None:
        return Constant(float(np.mean(labels)))
    evidences = np.stack([evidence(decided[r], n, float(w[-1])) for r, n in zip(rows, counts)])
    return Model(landmarks, scale * (root @ w[:-1]), float(w[-1]), _logistic(evidences, y))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no model is fitted on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_fit: int = MAX_FIT,
    max_fit_bytes: int = MAX_FIT_BYTES,
) -> Model | Constant:
    """Fit on `max_fit` labelled documents of each class, outside the held-out fold, chosen by a hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = [known.where(F.col("_label") == value).orderBy(*order).limit(max_fit) for value in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * max_fit rows at most
    short = docs.where(F.length(F.encode(text, "UTF-8")) <= max_fit_bytes)
    rows = short.join(picked, F.col(doc_id) == F.col("_id")).select("_id", F.col(text).alias("_text"), "_label")
    # Ids that many rows share give one row each, so that what is gathered stays bounded.
    sample = rows.groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label")).collect()
    return fit([r["_text"] for r in sample], [r["_label"] for r in sample])


# Scoring ---------------------------------------------------------------------


class Memory:
    """Units with the decision of one model for each."""

    def __init__(self, model):
        self.model, self.units = model, Units()
        self.values = np.zeros(0)
        self.uses = np.zeros(0, dtype=np.int32)  # in how many slices a unit was met

    def shrink(self, most: int) -> None:
        """Where more than `most` are remembered, units met once go; all of them, if those are not half."""
        if len(self.units.spelled) > most:
            self.units.forget_words()
        if len(self.units) > most:
            stay = np.flatnonzero(self.uses > 1)
            if 2 * len(stay) > most:
                stay = stay[:0]
            self.units.keep(stay)
            self.values, self.uses = self.values[stay], np.ones(len(stay), dtype=np.int32)

    def scores(self, texts: pa.Array) -> list[float]:
        found = [x for i in range(0, len(texts), STEP) for x in self.units.of(texts.slice(i, STEP).to_pylist())]
        names = list(islice(self.units.numbers, len(self.values), None))
        if names:
            self.values = np.concatenate([self.values, self.model.values(names).astype(np.float64)])
            self.uses = np.concatenate([self.uses, np.zeros(len(names), dtype=np.int32)])
        met = np.zeros(len(self.units), dtype=bool)
        for ids, _ in found:
            met[ids] = True
        self.uses += met
        return [self.model.score(self.values[ids], counts) for ids, counts in found]


def _score(batches: Iterator[pa.RecordBatch], model, name: str, text: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    memory = memory_of(f"toxicity {name}").setdefault("units", Memory(model))
    for whole in batches:
        for i in range(0, whole.num_rows, SLICE):
            batch = whole.slice(i, SLICE)
            memory.shrink(_CACHE)
            scores = memory.scores(batch.column(text))
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=[*names, "score"])
    give_back()


def score(docs: DataFrame, model: Model | Constant, text: str = "text") -> DataFrame:
    """`docs` with `score`, 0 to 1."""
    fields = [f for f in docs.schema.fields if f.name != "score"]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType())])
    return docs.select(*names).mapInArrow(partial(_score, model=model, name=model.name(), text=text, names=names), schema)


def toxicity_report(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score(docs.select(doc_id, text), train(docs, labels, doc_id, text, **options), text)
    return scored.select(doc_id, held_out(F.col(doc_id)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text: str = "text", **options) -> DataFrame:
    """`docs` without the rows that score `threshold` or more."""
    return score(docs, train(docs, labels, text=text, **options), text).where(F.col("score") < threshold).drop("score")
