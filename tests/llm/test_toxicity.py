import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import toxicity as X

BAD, GOOD = ["dunce", "rotter", "nitwit", "blockhead"], [f"{a}{b}{c}" for a in ("ta", "lo", "mi", "sen") for b in ("ra", "ku", "vel") for c in ("", "ns", "mo", "pi")]


def subsequence_kernel(s, t, p, decay):
    """The textbook sum over all common subsequences."""
    from itertools import combinations

    def places(x):
        out = {}
        for at in combinations(range(len(x)), p):
            out.setdefault("".join(x[i] for i in at), []).append(at[-1] - at[0] + 1)
        return out

    a, b = places(s), places(t)
    return sum(decay ** (m + n) for u in a.keys() & b.keys() for m in a[u] for n in b[u])


def sentence(rng, toxic):
    words = rng.choices(GOOD, k=rng.randint(20, 60))
    for _ in range(rng.randint(1, 4) if toxic else 0):
        words[rng.randrange(len(words))] = rng.choice(BAD)
    return " ".join(words)


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(1)
    return [(i, sentence(rng, i % 3 == 0), int(i % 3 == 0)) for i in range(600)]


def test_kernel_is_the_sum_over_common_subsequences():
    rng = random.Random(4)
    words = ["idea", "ideal", "dia", "iidea", "a", "zzzz", "deaiidea", X.OPEN + "as" + X.CLOSE, X.OPEN + "block" + X.CLOSE, X.OPEN + "blockhead" + X.CLOSE]
    words += ["".join(rng.choices("abcde", k=rng.randint(1, 12))) for _ in range(30)]
    got = X.kernel(words, words)
    want = [[subsequence_kernel(a, b, X.ORDER, X.DECAY) for b in words] for a in words]
    assert np.allclose(got, want, rtol=1e-4)


def test_units():
    assert X.units(None) == X.units("") == {}
    mark = lambda w: X.OPEN + w + X.CLOSE
    assert set(X.units("Dun-ce, n i t w i t!")) == {mark("dun-ce"), mark("dunce"), mark("nitwit")}
    assert X.units("word word")[mark("word")] == 2
    assert set(X.units("you ass, a fag!")) == {mark("you"), mark("ass"), mark("fag")}
    long = "x" * 300 + "blockhead" + "y" * 300
    assert any("blockhead" in u for u in X.units(long))


def test_held_out_accuracy_and_gaps(spark, labelled, odd):
    rows = spark.createDataFrame([r[:2] for r in labelled], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in labelled], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in X.toxicity_report(rows, labels).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in labelled if got[i]["held_out"]]
    assert len(held) > 60 and np.mean([a == b for a, b in held]) > 0.97
    model = X.train(rows, labels)
    rng = random.Random(2)
    for bad in ("dunnce", "dun.ce", "d u n c e", "nit-wit", "blockhheads", "rottter"):
        words = [rng.choice(GOOD) for _ in range(30)]
        text = " ".join([*words[:15], bad, *words[15:]])
        found = X.units(text)
        assert model.score(model.values(list(found)).tolist(), list(found.values())) > 0.5, bad
    scored = X.score(odd.withColumn("score", F.lit("mine")), model)
    assert scored.columns == [*odd.columns, "score"] and scored.count() == odd.count()
    assert scored.where("score is null or score < 0 or score > 1").count() == 0
    kept = X.drop_toxic(rows, labels)
    assert kept.columns == ["doc_id", "text"] and 380 <= kept.count() <= 420


def test_missing_labels(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (None, 1), (4, None)], "doc_id bigint, toxic int")
    assert {r["score"] for r in X.toxicity_report(odd, labels).collect()} == {0.0}
    assert X.toxicity_report(none, labels).count() == 0


def test_the_fold_hides_labels(spark, labelled):
    rows = spark.createDataFrame([r[:2] for r in labelled], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in labelled], "doc_id bigint, toxic int")
    flipped = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = [sorted(tuple(r) for r in X.toxicity_report(rows, x).collect()) for x in (labels, flipped)]
    assert a == b


def test_what_a_worker_forgets_changes_no_score(labelled):
    import pyarrow as pa

    texts = [r[1] for r in labelled] + [None, "", "a b c", "I n i t w i t, don't", "x" * 90]
    model = X.fit(texts[:600], [r[2] for r in labelled])
    whole = X.Memory(model).scores(pa.array(texts))
    memory, got = X.Memory(model), []
    for i in range(0, len(texts), 7):
        memory.shrink(25)
        got += memory.scores(pa.array(texts[i : i + 7]))
    assert np.allclose(got, whole, atol=1e-6)
    for text, (ids, counts) in zip(texts, memory.units.of(texts)):
        names = list(memory.units.numbers)
        assert dict(zip([names[i] for i in ids], counts.tolist())) == X.units(text)


def test_a_worker_remembers_for_one_owner():
    from lodestone.llm.worker import memory_of

    memory_of("one")["x"] = 1
    assert memory_of("one") == {"x": 1}
    assert memory_of("two") == {} and memory_of("one") == {}


def test_the_fit_holds_no_copy_of_its_rows():
    """A quarter of the rows come near the margin; a few copies of them in doubles would be larger than the matrix."""
    import tracemalloc

    rng = np.random.default_rng(5)
    x = rng.normal(size=(60_000, 40)).astype(np.float32)
    x[:, -1] = 1
    positive = rng.normal(0.3, 1, size=(30, 40))
    share, mass = np.full(len(x), 1 / len(x)), np.full(30, 1 / 30)
    tracemalloc.start()
    try:
        w = X._mined(x, np.arange(len(x)), share, positive, mass)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < x.nbytes
    # The same optimum in one piece: the gradient of the squared hinge loss vanishes.
    rows, sign = np.vstack([x, positive]).astype(np.float64), np.concatenate([-np.ones(len(x)), np.ones(30)])
    slack = np.maximum(0, 1 - sign * (rows @ w)) * 1000 * np.concatenate([share, mass]) * 50
    assert (slack > 0).mean() > 0.2
    ridge = np.append(np.ones(39), 1e-6)
    assert np.abs(ridge * w - rows.T @ (slack * sign)).max() < 1e-3 * np.abs(rows * slack[:, None]).sum(axis=0).max()
