import pytest
from pyspark.sql import functions as F

from lodestone.llm import line_dedup as L


def by_hand(docs, least):
    """Windows, matches with their first place, runs and their extension, over plain lists."""
    lines = {}
    for d, text in docs:
        own = [(i, " ".join("".join(c.lower() if "A" <= c <= "Z" else c for c in x).split())) for i, x in enumerate(text.split("\n"))]
        lines[d] = [(i, x) for i, x in own if x]
    first, windows = {}, {}
    for d in sorted(lines):
        own = [x for _, x in lines[d]]
        for i in range(len(own)):
            n, j = 0, i
            while j < len(own) and n < least:
                n += len(own[j].split())
                j += 1
            if n >= least:
                windows[d, i] = (tuple(own[i:j]), j - 1)
                first.setdefault(tuple(own[i:j]), (d, i))
    gone = {d: set() for d in lines}
    for (d, i), (content, j) in windows.items():
        other, at = first[content]
        if (other, at) == (d, i):
            continue
        gap, a, b = i - at, i, j
        here, there = [x for _, x in lines[d]], [x for _, x in lines[other]]
        while a > 0 and a - gap > 0 and here[a - 1] == there[a - gap - 1]:
            a -= 1
        while b + 1 < len(here) and b + 1 - gap < len(there) and here[b + 1] == there[b - gap + 1]:
            b += 1
        gone[d].update(range(lines[d][a][0], lines[d][b][0] + 1))
    return {d: ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]), len(gone[d])) for d, t in docs}


@pytest.mark.parametrize("least", [1, 3, 6])
def test_equals_brute_force(spark, least):
    import random

    rng = random.Random(least)
    passages = [["one two", "three", "", "four five six"], ["a b c d"], ["x", "y", "z", "w"], ["same"] * 4]
    docs = []
    for d in range(60):
        out = []
        for _ in range(rng.randint(1, 6)):
            out += rng.choice(passages) if rng.random() < 0.7 else [f"own {d} {rng.randint(0, 3)}"]
        docs.append((d, "\n".join(out)))
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["text"], r["n_deleted"]) for r in L.drop_repeated_lines(rows, least).collect()}
    assert got == by_hand(docs, least)


def test_passage_of_many_documents(spark):
    passage = "\n".join(" ".join(f"p{i}x{j}" for j in range(13)) for i in range(4))
    docs = [(i, f"own line {i}\n{passage}\n\nshort line") for i in range(300)]
    got = L.drop_repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r["text"] for r in got if r["doc_id"]} == {f"own line {i}" for i in range(1, 300)}
    assert next(r["text"] for r in got if r["doc_id"] == 0) == docs[0][1]


def test_odd_rows(odd, none, spark):
    long = "\n".join(["word " * 60] * 300)
    docs = odd.withColumn("n_lines", F.lit("mine"))
    got = L.drop_repeated_lines(docs, min_words=5)
    assert got.columns == [*odd.columns, "n_lines", "n_deleted"]
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[2] is None and texts[3] == "" and texts[5] == "" and texts[8] == " \n\t " and texts[1].startswith("alpha")
    assert L.drop_repeated_lines(none).count() == 0
    (one,) = L.drop_repeated_lines(spark.createDataFrame([(1, long)], "doc_id bigint, text string")).collect()
    assert one["n_deleted"] == 299
