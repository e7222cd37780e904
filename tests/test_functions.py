import random
import sqlite3
import unicodedata
import uuid

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import keys
from lodestone.functions.embedding import embed
from lodestone.functions.text import chunk_text, entity_spans, fold, tokenize
from lodestone.functions.vectors import squared_l2


def column(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "at int, v string")
    return [r[0] for r in rows.orderBy("at").select(expression(F.col("v"))).collect()]


def test_uuid5_and_int_id(spark):
    rng = random.Random(1)
    names = ["", "doc1", "é-ß-😀", "x" * 300] + [str(rng.random()) for _ in range(300)]
    expected = [uuid.uuid5(uuid.NAMESPACE_DNS, n) for n in names]
    assert column(spark, names, keys.uuid5) == [str(u) for u in expected]
    assert column(spark, names, keys.int_id) == [(u.int >> 64) & (2**63 - 1) for u in expected]


def test_triple_id(spark):
    made = column(spark, ["Elon"], lambda s: keys.triple_id(F.lit("c"), s, F.lit("founded"), F.lit("SpaceX")))
    assert made == [str(uuid.uuid5(uuid.NAMESPACE_DNS, "c:Elon:founded:SpaceX"))]


def sqlite_terms(texts):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x)")
    con.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(texts)))
    con.execute("create virtual table v using fts5vocab(t, instance)")
    terms = {i: [] for i in range(len(texts))}
    for term, doc, offset in con.execute("select term, doc, offset from v order by doc, offset"):
        terms[doc].append(term)
    return [terms[i] for i in range(len(texts))]


def test_tokens_equal_sqlite_fts5(spark):
    letters = [chr(c) for c in range(0x20, 0x250) if unicodedata.category(chr(c)) != "Cc"]
    rng = random.Random(2)
    texts = ["", "  ", "The X-99 isn't a café!", "été", "ΑΣ ςigma", "ẞ straße Ünïcode ĲSSEL"]
    texts += ["".join(rng.choice(letters + [" "] * 60) for _ in range(60)) for _ in range(200)]
    assert column(spark, texts, tokenize) == sqlite_terms(texts)


def test_fold(spark):
    assert column(spark, ["ÉÀÜñ"], fold) == ["eaun"]


def test_chunks(spark):
    long_a, long_b, short = "a" * 51, "b" * 60, "c" * 50
    texts = [f"{long_a}\n\n  {long_b} \n\n{short}", f"{short}\n{long_a}", f"{short}\n{short}", "", f" {long_a} "]
    assert column(spark, texts, chunk_text) == [[long_a, long_b], [f"{short}\n{long_a}"], [f"{short}\n{short}"], [], [long_a]]
    assert column(spark, [f"{short}\n\n{short}\n{'d' * 40}", f"{'c' * 30}\n\n{long_a[:50]}x"], chunk_text)[1] == [long_a[:50] + "x"]


def test_line_chunks_when_no_paragraph_is_long(spark):
    # Two short paragraphs; no line is longer than 50 characters either.
    assert column(spark, ["a" * 20 + "\n\n" + "b" * 30], chunk_text) == [[]]


def test_entity_spans(spark):
    text = "Bill Gates founded Microsoft in Albuquerque. He later stepped down as CEO.\nNew York won. Then Éric Ürgen left."
    assert column(spark, [text], entity_spans) == [
        ["Bill Gates", "Microsoft", "Albuquerque", "CEO", "New York", "Then Éric Ürgen"]
    ]


def test_squared_l2(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<float>, b array<float>")
    assert rows.select(squared_l2(F.col("a"), F.col("b"))).first()[0] == 25.0


def test_embedding_is_unit_length_and_same_for_same_words(spark):
    rows = spark.createDataFrame([(0, "The café, the CAFE"), (1, "the cafe the cafe"), (2, "")], "i int, text string")
    made = [np.array(r[0]) for r in embed(rows, dim=32).orderBy("i").select("embedding").collect()]
    assert np.allclose(made[0], made[1]) and abs((made[0] ** 2).sum() - 1) < 1e-6
    assert len(made[2]) == 32 and not made[2].any()


def test_given_vectors_pass_through_and_models_are_used(spark):
    import pandas as pd

    @F.pandas_udf("array<float>")
    def lengths(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t)), 0.0])

    rows = spark.createDataFrame([("abc", None), ("abcd", [9.0, 9.0])], "text string, embedding array<float>")
    assert [r[0] for r in embed(rows, fn=lengths).select("embedding").collect()] == [[3.0, 0.0], [9.0, 9.0]]
