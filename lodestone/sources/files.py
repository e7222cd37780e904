"""Plain-text files, one document per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(source, path, text): name, whole path and UTF-8 content of every file below `path`."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("source"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )
