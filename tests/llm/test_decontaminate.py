import hashlib
import re

from pyspark.sql import functions as F

from lodestone.llm.decontaminate import contamination_report, cut_words, decontaminate, find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def by_hand(docs, items, n=10):
    out = {}
    cut = [(i, [lower(w) for w in WORD.findall(t or "")]) for i, t in items]
    for doc_id, text in docs:
        words, hit, found = [lower(w) for w in WORD.findall(text or "")], set(), set()
        for item, own in cut:
            k = min(n, len(own))
            grams = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else set()
            for i in range(len(words) - k + 1) if k else ():
                if tuple(words[i : i + k]) in grams:
                    hit.update(range(i, i + k))
                    found.add(str(item))
        names = ",".join(sorted(found))
        out.setdefault(doc_id, []).append((len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(10, "ALPHA beta gamma delta epsilon zeta eta theta iota kappa"), (9, "four five"), (2, None), (3, ""), (9, "text, without"), (11, "Éa ßb")]


def test_report_equals_brute_force(spark, odd):
    docs = odd.union(spark.createDataFrame([(20, "x éa! ßB four  FIVE four five Éa ßb y", "en", "s", 1)], odd.schema))
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for options in ({}, {"block_bytes": 20}):
        got = {}
        for r in contamination_report(docs, items, **options).collect():
            got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
        assert got == by_hand(rows, ITEMS)


def test_removal_of_documents_and_spans(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = odd.withColumn("items", F.lit("mine"))
    kept = decontaminate(docs, items)
    assert kept.columns == odd.columns  # a column named like a result is replaced
    assert sorted(r[0] for r in kept.select("doc_id").collect() if r[0] is not None) == [2, 3, 7, 8]
    cut = {r["doc_id"]: r["text"] for r in decontaminate(odd, items, action="span").collect()}
    assert cut[1] == " lambda" and cut[4] == "One\ntwo  three\t!" and cut[2] is None and cut[None] == " an id"
    assert decontaminate(none, items).count() == 0
    assert contamination_report(odd, items.limit(0)).where("contaminated").count() == 0


def test_spans_in_text():
    assert cut_words("a, b c. d", [{"start": 1, "end": 3}]) == "a, . d"


def test_other_window_lengths(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "x b c y")], "item_id bigint, text string")
    (row,) = find_contamination(docs, items, n=2).collect()
    assert [tuple(s) for s in row["hit_words"]] == [(1, 3)] and row["items"] == ["1"]
