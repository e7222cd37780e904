import math
import re
import zlib
from collections import Counter
from hashlib import sha256

from pyspark.sql import functions as F

from lodestone.llm.resampling import Scored, ranked, resample, resampling_report

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def features(text, order):
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]
    return words, [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def by_hand(docs, target, percent, order=1, buckets=10_000, seed=2024, min_words=20):
    """The report by plain loops; rows are (doc_id, text)."""

    def counted(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, order)[1])

    s, t = counted(x for _, x in docs), counted(target)
    big_s, big_t = sum(s.values()), sum(t.values())

    def gain(feature):
        b = zlib.crc32(feature.encode()) % buckets
        return math.floor(1000 * math.log(((t[b] + 1) * (big_s + buckets)) / ((s[b] + 1) * (big_t + buckets))))

    rows = []
    for doc_id, text in docs:
        words, found = features(text, order)
        weight = sum(map(gain, found))
        h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, len(words)])
    can = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i for i, r in enumerate(can[: percent * len(can) // 100], 1)}
    return sorted((tuple([*r[:4], rank.get(id(r))]) for r in rows), key=repr)


def report(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_report_equals_brute_force(spark, odd):
    texts = [f"alpha w{i % 7} beta Gamma w{i % 11} é{i} " * (1 + i % 5) for i in range(60)]
    docs = odd.union(spark.createDataFrame([(100 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)], odd.schema)).repartition(7)
    target = spark.createDataFrame([(1, "w3 ALPHA é9"), (2, None), (3, ""), (3, "w3 w3")], "item_id bigint, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    wanted = [r["text"] for r in target.collect()]
    for options in ({"percent": 10}, {"percent": 55, "order": 3, "buckets": 50, "min_words": 0}, {"percent": 100, "seed": 7}):
        assert report(resampling_report(docs, target, **options)) == by_hand(rows, wanted, **options)
    empty = target.limit(0)
    assert report(resampling_report(docs, empty, 30)) == by_hand(rows, [], 30)


def test_an_empty_table_and_a_draw_of_nothing(spark, odd, none):
    target = spark.createDataFrame([(1, "w3")], "item_id bigint, text string")
    assert resampling_report(none, target).collect() == []
    assert resample(none, target).columns == none.columns
    assert {r["rank"] for r in resampling_report(odd, target, 0).collect()} == {None}


def test_documents_keep_their_columns_whatever_they_are_called(spark, odd):
    target = spark.createDataFrame([(1, "alpha beta")], "item_id bigint, text string")
    names = ["n_words", "n_features", "weight", "score", "hash", "row", "key", "body", "k", "rank", "place"]
    docs = odd.withColumns({c: F.lit(i) for i, c in enumerate(names)})
    drawn = resample(docs, target, 50, min_words=1)
    assert drawn.columns == docs.columns and drawn.count() == 3  # of the 6 rows with words
    assert {tuple(r[c] for c in names) for r in drawn.collect()} == {tuple(range(len(names)))}


def test_a_score_that_most_rows_share(spark):
    """The cut falls into 400 equal rows: exactly as many of them are drawn as are due."""
    rows = [(1, "same words here")] * 400 + [(i, f"other words {i}") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    target = spark.createDataFrame([("other",)], "text string")
    got = report(resampling_report(docs, target, 50, min_words=1))
    assert got == by_hand(rows, ["other"], 50, min_words=1)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 230))


def test_kth_key_and_ranks_at_every_place(spark):
    docs = spark.createDataFrame([(i % 37, f"word{i % 5}") for i in range(90)], "doc_id bigint, text string").repartition(4)
    scored = Scored(docs, docs.limit(0), min_words=0)
    order = [r["k"] for r in scored.rows.select(scored.order_key().alias("k")).orderBy("k").collect()]
    for k in (1, 2, 45, 89, 90):
        assert scored.rows.where(scored.order_key() <= scored.kth(k, pivots=3)).count() == k
    numbered = ranked(scored.rows.repartition(5), scored.order_key(), "rank")
    assert [r["k"] for r in numbered.orderBy("rank").select(scored.order_key().alias("k")).collect()] == order
    assert [r["rank"] for r in numbered.orderBy("rank").collect()] == list(range(1, 91))
