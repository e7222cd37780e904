import json
import operator
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.metadata import decode_metadata
from lodestone.functions.where import TypedFields, VariantFields, compile_equality, compile_where
from lodestone.operators.lookup import matching_ids

SHIPS = [
    ("heron", {"rig": "sloop", "length": 9.5, "crew": 2, "flag": "NO", "racing": True}),
    ("petrel", {"rig": "sloop", "length": 12, "crew": 4, "flag": "NO", "racing": False}),
    ("curlew", {"rig": "ketch", "length": 14.25, "crew": 4, "flag": "SE"}),
    ("brig", {"rig": "brig", "length": 31, "crew": 19, "flag": "PT", "masts": ["fore", "main"]}),
    ("yawl", {"rig": "yawl", "length": 8, "crew": 1, "masts": ["main", "mizzen"]}),
    ("raft", {"length": 3, "crew": 19, "flag": None}),
]
ALL = {name for name, _ in SHIPS}


def stored(spark, rows):
    return spark.createDataFrame([("c", i, json.dumps(m)) for i, m in rows], "collection_id string, id string, metadata string")


def found(spark, rows, where):
    fields = VariantFields(decode_metadata(F.col("metadata")))
    return {r.id for r in stored(spark, rows).where(compile_where(where, fields)).select("id").collect()}


@pytest.mark.parametrize(
    "where, ids",
    [
        ({}, ALL),
        ({"flag": "NO"}, {"heron", "petrel"}),
        ({"rig": {"$eq": "ketch"}}, {"curlew"}),
        ({"crew": {"$eq": 4.0}}, {"petrel", "curlew"}),
        ({"flag": None}, {"yawl", "raft"}),
        ({"flag": {"$eq": None}}, {"yawl", "raft"}),
        ({"length": {"$gt": 12}}, {"curlew", "brig"}),
        ({"length": {"$gte": 12}}, {"petrel", "curlew", "brig"}),
        ({"length": {"$lt": 8}}, {"raft"}),
        ({"crew": {"$lte": 2}}, {"heron", "yawl"}),
        ({"length": {"$gt": 8, "$lte": 14.25}}, {"heron", "petrel", "curlew"}),
        ({"rig": {"$gt": "k"}}, set()),
        ({"crew": "19"}, set()),
        ({"rig": {"$ne": "sloop"}}, ALL - {"heron", "petrel"}),
        ({"rig": {"$nin": ["sloop", "yawl"]}}, {"curlew", "brig", "raft"}),
        ({"rig": {"$in": ["yawl", "brig", None]}}, {"yawl", "brig", "raft"}),
        ({"crew": {"$in": 19}}, set()),
        ({"racing": True}, {"heron"}),
        ({"racing": 1}, {"heron"}),
        ({"racing": 0}, {"petrel"}),
        ({"masts": ["fore", "main"]}, {"brig"}),
        ({"masts": {"$in": [["main", "mizzen"], ["main"]]}}, {"yawl"}),
        ({"length": {"$around": 9}}, set()),
        ({"$or": [{"length": {"$around": 9}}, {"crew": 1}]}, {"yawl"}),
        ({"length": {}}, ALL),
        ({"$or": []}, set()),
        ({"$and": []}, ALL),
        ({"$and": {"flag": "NO"}}, set()),
        ({"$and": [{"crew": 4}, {"length": {"$lt": 13}}]}, {"petrel"}),
        ({"$or": [{"flag": "PT"}, {"flag": "SE"}]}, {"curlew", "brig"}),
        ({"$or": [{"$and": [{"crew": 19}, {"length": {"$lt": 10}}]}, {"rig": "ketch"}]}, {"raft", "curlew"}),
        ({"flag": "NO", "crew": {"$gt": 3}}, {"petrel"}),
    ],
)
def test_ships(spark, where, ids):
    assert found(spark, SHIPS, where) == ids


def test_strict_mode_raises_on_unknown_operators():
    with pytest.raises(ValueError):
        compile_where({"a": {"$near": 1}}, TypedFields({}), strict=True)


def expected(metadata, where):
    """The language on plain Python values."""
    numeric = (int, float)
    order = {"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}

    def test(value, name, operand):
        if name in order:
            return isinstance(value, numeric) and isinstance(operand, numeric) and order[name](value, operand)
        if name in ("$in", "$nin"):
            return isinstance(operand, list) and (value in operand) == (name == "$in")
        return name in ("$eq", "$ne") and (value == operand) == (name == "$eq")

    def one(key, value):
        if key in ("$and", "$or"):
            parts = [expected(metadata, part) for part in value]
            return all(parts) if key == "$and" else any(parts)
        if isinstance(value, dict):
            return all(test(metadata.get(key), name, operand) for name, operand in value.items())
        return metadata.get(key) == value

    return all(one(k, v) for k, v in where.items())


SCALARS = [
    None, True, False, 0, 1, -1, 2, 1.0, 0.5, 1.5, -0.0, 2**53, 2**53 + 1, float(2**53), 10**18, 2**63 - 1, 2**63, 10**20, 1e20, 1e300,
    "", "1", "a", "true", "é",
]
NESTED = [[], [1], [1.0, "a"], [True, None], {}, {"k": 1}, {"k": None}, {"j": 1, "k": [1]}, [[1], {"k": 1.0}]]


def random_where(rng, depth=0):
    kind = rng.random()
    if depth < 2 and kind < 0.25:
        return {rng.choice(["$and", "$or"]): [random_where(rng, depth + 1) for _ in range(rng.randrange(3))]}
    key = rng.choice("abc")
    value = rng.choice(SCALARS + NESTED)
    if kind < 0.4:
        return {key: rng.choice(SCALARS + [n for n in NESTED if isinstance(n, list)])}
    name = rng.choice(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$what"])
    if name in ("$in", "$nin"):
        value = [rng.choice(SCALARS + NESTED) for _ in range(rng.randrange(4))]
    return {key: {name: value}}


def test_random_filters_on_json(spark):
    rng = random.Random(3)
    values = SCALARS + NESTED
    rows = [(str(i), {k: v for k in "abc" if rng.random() < 0.8 for v in [rng.choice(values)]}) for i in range(150)]
    filters = [random_where(rng) for _ in range(60)]
    fields = VariantFields(F.col("v"))
    docs = stored(spark, rows).withColumn("v", decode_metadata(F.col("metadata")))
    for at in range(0, len(filters), 20):
        some = filters[at : at + 20]
        got = docs.select("id", *[compile_where(w, fields).alias(f"w{i}") for i, w in enumerate(some)]).collect()
        by_id = {r.id: r for r in got}
        for i, where in enumerate(some):
            for name, metadata in rows:
                assert by_id[name][f"w{i}"] == expected(metadata, where), (where, metadata)


def test_random_filters_on_typed_columns(spark):
    rng = random.Random(4)
    longs = [None, 0, 1, -1, 2, 2**53, 2**53 + 1, 2**63 - 1]
    doubles = [None, 0.0, 1.0, 1.5, float(2**53), 1e20, float("nan")]
    rows = [
        (i, rng.choice(longs), rng.choice(doubles), rng.choice([None, "", "1", "a"]), rng.choice([None, True, False]), rng.choice([None, [1, 2], []]))
        for i in range(150)
    ]
    df = spark.createDataFrame(rows, "i int, a long, b double, c string, d boolean, e array<int>")
    fields = TypedFields.of(df, ["a", "b", "c", "d", "e"])
    keys = "abcdef"
    filters = []
    while len(filters) < 60:
        where = random_where(rng)
        filters.append({rng.choice(keys) if not k.startswith("$") else k: v for k, v in where.items()})
    for at in range(0, len(filters), 20):
        some = filters[at : at + 20]
        got = df.select("i", *[compile_where(w, fields).alias(f"w{i}") for i, w in enumerate(some)]).collect()
        for r, row in zip(sorted(got), sorted(rows, key=lambda x: x[0])):
            metadata = dict(zip("abcde", row[1:]))
            for i, where in enumerate(some):
                assert r[f"w{i}"] == expected(metadata, where), (where, metadata)


def test_typed_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id as a", "cast(id as string) as b").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.where(compile_where({"a": {"$gte": 10, "$lt": 20.5}, "b": {"$in": ["11", "12"]}}, TypedFields.of(df)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    for part in ("GreaterThanOrEqual(a,10)", "LessThan(a,21)", "In(b, [11,12])"):
        assert part in text, text
    assert plan.count() == 2


def test_id_listing_is_equality_only(spark):
    docs = stored(spark, SHIPS + [("odd", {"length": {"$gt": 1}})])
    assert matching_ids(docs, None) is None and matching_ids(docs, {}) is None
    assert {r.id for r in matching_ids(docs, {"flag": "NO", "racing": True}).collect()} == {"heron"}
    assert {r.id for r in matching_ids(docs, {"length": {"$gt": 1}}).collect()} == {"odd"}
    fields = VariantFields(decode_metadata(F.col("metadata")))
    assert docs.where(compile_equality({}, fields)).count() == 7
