"""Column layouts of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

COLLECTIONS = T.StructType(
    [
        T.StructField("collection_id", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
    ]
)

DOCUMENTS = T.StructType(
    [
        T.StructField("collection_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("int_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
    ]
)

POSTINGS = T.StructType(
    [
        T.StructField("collection_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("tf", T.LongType()),
        T.StructField("dl", T.IntegerType()),
    ]
)

TRIPLES = T.StructType(
    [
        T.StructField("collection_id", T.StringType()),
        T.StructField("triple_id", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("predicate", T.StringType()),
        T.StructField("object", T.StringType()),
        T.StructField("document_id", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("seq", T.LongType()),
    ]
)

#: Vectors of an index, by the cell that holds them.
CELLS = T.StructType(
    [
        T.StructField("collection_id", T.StringType()),
        T.StructField("cell", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("seq", T.LongType()),
    ]
)

#: One row for each index: its centres one after the other, `dim` values each.
CELL_MAPS = T.StructType(
    [
        T.StructField("collection_id", T.StringType()),
        T.StructField("batch_no", T.LongType()),
        T.StructField("n_probe", T.IntegerType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("dim", T.IntegerType()),
        T.StructField("centres", T.ArrayType(T.DoubleType())),
    ]
)

QUERIES = T.StructType(
    [
        T.StructField("q_id", T.StringType()),
        T.StructField("collection_id", T.StringType()),
        T.StructField("query_text", T.StringType()),
    ]
)
