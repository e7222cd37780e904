import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodestone.llm import simhash as S
from lodestone.llm.components import connected


def by_hand(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(points, threshold):
    up = {p: p for p in points}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(points):
        for b in points[:i]:
            if (a ^ b).bit_count() <= threshold:
                up[root(a)] = root(b)
    return root


@pytest.mark.parametrize("text", ["", " \n", "one", "One two", "A b c", "a b c d É f\tg  h", "x " * 500])
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == by_hand(text)


@pytest.mark.parametrize("cell", [2, 1024])
def test_links_join_all_classes(spark, cell):
    random = np.random.default_rng(5)
    points = {0, (1 << 64) - 1}
    for centre in random.integers(0, 1 << 63, 20, dtype=np.uint64).tolist():
        x = centre << 1 | 1
        for _ in range(40):  # a walk, so that classes are wider than the threshold
            for b in random.choice(64, random.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            points.add(x)
    points = sorted(points)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in points]
    found = connected(S.links(spark.createDataFrame(signed, "fp bigint"), cell=cell)).collect()
    name = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in found}
    root = classes(points, 3)
    assert len({name.get(p, p) for p in points}) == len({root(p) for p in points}) < len(points)
    assert len({(name.get(p, p), root(p)) for p in points}) == len({root(p) for p in points})


def test_a_dense_group_gives_few_links(spark):
    points = [(a | b << 8,) for a in range(64) for b in range(64)]
    rows = spark.createDataFrame(points, "fp bigint")
    links = S.links(rows, cell=256)
    assert len(connected(links).select("root").distinct().collect()) == 1
    assert links.count() < 64 * len(points)


def test_report_of_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in S.simhash_report(odd).collect())
    named = {}
    for doc_id, text in rows:
        named.setdefault(by_hand(text), []).append(doc_id)
    want = [(d or -1, f"{by_hand(t):016x}", min((x for x in named[by_hand(t)] if x is not None), default=None)) for d, t in rows]
    assert got == sorted(want)
    assert S.simhash_report(none).count() == 0


def test_one_row_of_each_class_stays(spark, odd, none):
    docs = odd.withColumn("fp", F.lit("mine"))
    kept = S.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 2, 4, 7]
    assert S.drop_near_copies(odd.where("doc_id = 5")).count() == 1
    assert S.drop_near_copies(none).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (3, 2)]
    found = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 50)}}
