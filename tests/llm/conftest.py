import pytest

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "src1", 10),
    (2, None, "en", "src2", None),
    (3, "", None, "src1", 0),
    (4, "One\ntwo  three\tFOUR, five!", "de", None, 5),
    (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "src1", 10),
    (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "src1", 10),
    (None, "text without an id", "fr", "src3", 3),
    (7, LONG, "en", "src1", len(LONG)),
    (8, " \n\t ", "en", "src9", 4),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties and repeated rows."""
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
