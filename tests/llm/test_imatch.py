import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import imatch as I


@pytest.fixture(scope="module")
def report(odd):
    return I.imatch_report(odd.withColumn("fingerprint", F.lit("mine"))).collect()


def test_edited_texts_follow_the_order_of_ids(spark):
    docs = [(9, "abcdefghi"), (4, "xy"), (2, None), (1, "12345")]
    got = {r["doc_id"]: r for r in I.imatch_report(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()}
    want = {9: "abcdefxy", 4: "xy", 2: "", 1: "1234a"}
    assert {k: r["edited_sha256"] for k, r in got.items()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
    assert {k: r["n_chars"] for k, r in got.items()} == {9: 9, 4: 2, 2: 0, 1: 5}


def test_odd_rows(report, odd, none):
    assert sorted(r["doc_id"] or -1 for r in report) == sorted(r["doc_id"] or -1 for r in odd.select("doc_id").collect())
    same = {r["fingerprint"] for r in report if r["doc_id"] in (1, 5)}
    assert len(same) == 1
    assert {r["fingerprint"] for r in report if r["doc_id"] in (2, 3, 8)} == {I.EMPTY}
    assert all(0 <= r[c] <= 1 for r in report for c in ("near_edited", "near_next"))
    assert I.imatch_report(none).count() == 0


def test_fingerprint_by_hand(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["b a", "A b b!", "c", "c a", "z"])], "doc_id bigint, text string")
    words = {}
    for r in I.lexicon(docs, low=0.3, high=0.5).collect():
        words.setdefault(r["term"], []).append((r["level"], r["subset"]))
    assert set(words) <= {"b", "c"}  # a stands in 3 of 5, z in 1
    found = I.subset_hashes(docs, ["doc_id"], I.lexicon(docs, low=0.3, high=0.5))
    for r in found.collect():
        own = {0: ["b"], 1: ["b"], 2: ["c"], 3: ["c"]}[r["doc_id"]]
        cells = [I.NONE] * (len(I.PARTS) * I.SUBSETS)
        for level, subset in {p for w in own for p in words.get(w, [])}:
            terms = sorted(w for w in own if (level, subset) in words[w])
            cells[level * I.SUBSETS + subset] = hashlib.md5(" ".join(terms).encode()).hexdigest()[:4]
        assert r["fingerprint"] == "".join(cells)


def test_edits_are_nearer_than_others(spark):
    texts = [" ".join(f"t{(i * 37 + j * j * 13) % 400}" for j in range(120)) for i in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = I.imatch_report(docs).collect()
    assert sum(r["near_edited"] for r in rows) > 2 * sum(r["near_next"] for r in rows)


def test_broadcast_and_shuffle_agree(spark, odd, monkeypatch, report):
    monkeypatch.setattr(I, "MAX_BROADCAST", 0)
    again = I.imatch_report(odd).collect()
    assert sorted(map(str, again)) == sorted(map(str, report))


def test_texts_without_terms_of_the_lexicon(spark):
    """Documents 2 to 7 have only terms that stand in fewer than three of ten documents, or none."""
    texts = ["m n", "m n", "rare words", "Words, rare words!", "other things", "+++", "***", "", "m n", "m n"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in I.imatch_report(docs, low=0.3, high=0.5).collect()}
    prints = {i: r["fingerprint"] for i, r in rows.items()}
    rare = hashlib.md5(b"rare words").hexdigest()[:16]
    assert prints[2] == prints[3] == I.EMPTY + rare and prints[7] == I.EMPTY
    assert len({prints[i] for i in (2, 4, 5, 6, 7)}) == 5
    assert {i: r["near_next"] for i, r in rows.items() if 2 <= i <= 8} == {8: 0.0, 7: 0.0, 6: 0.0, 5: 0.0, 4: 0.0, 3: 1.0, 2: 0.0}
    assert rows[4]["near_edited"] == 0.0 and rows[9]["near_next"] == 1.0
