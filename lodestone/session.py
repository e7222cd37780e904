"""Session helpers: size checks before a broadcast, and shared scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows a broadcast side may hold. Sides are counted (never
#: estimated) before they are broadcast; beyond the bound every caller has a
#: shuffling plan that gives the same rows.
BROADCAST_ROWS = 100_000

#: Copies of the small side in a salted join; one hot key of the large side is
#: spread over this many tasks.
SALTS = 16

#: Bytes of rows that go to a Python worker at once, where the rows hold texts or vectors.
BATCH_BYTES = 4 << 20


def get_spark(app: str = "lodestone", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when `df` has at most `rows` rows; reads no more than rows + 1."""
    if df.isLocal():
        return len(df.collect()) <= rows
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def local(df: DataFrame) -> DataFrame:
    """The rows of a frame that is known to be small, held by the driver: reading them again runs no job."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def if_small(df: DataFrame, rows: int) -> DataFrame | None:
    """`df` held by the driver where it has at most `rows` rows, else None; reads no more than rows + 1."""
    found = df.limit(rows + 1).toArrow()
    return df.sparkSession.createDataFrame(found, df.schema) if found.num_rows <= rows else None


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's checkpoint folder.

    The folder is read from the session. Only where driver and tasks are one
    process (master "local" or "local[n]", as in tests) and none is set, a
    temporary folder is made.
    """
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Jobs run in here have one setting of the session; the former one comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_dropped(spark: SparkSession):
    """Writes run in here delete their shuffle files when they end; else these stay until the driver collects its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it from there."""
    path = shared_dir(df.sparkSession, "stage")
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*stages: DataFrame) -> None:
    """Delete the files of frames that `cut_lineage` returned, when all that reads them is written."""
    for df in stages:
        folders = {re.sub(r"/[^/]*$", "", file) for file in df.inputFiles()}
        for folder in folders:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run in here hand rows to Python workers by BATCH_BYTES, however long the rows are, not by their number alone."""
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
        yield


def spread(df: DataFrame) -> DataFrame:
    """Give a table of few files one partition per core; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def equi_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    spread: list[str] | None = None,
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
    small_fits: bool | None = None,
) -> DataFrame:
    """Join `big` with a usually small side, whatever the key skew of `big`.

    A side within the bound is broadcast, so `big` is not shuffled. Beyond it
    the rows of `big` get a salt from the `spread` columns and `small` is
    copied once per salt: a key holding a third of `big` still lands on
    `salts` tasks. One salt does where no key is hot. Supports inner, left_semi
    and left_anti.

    Pass `small_fits` where the size of `small` follows from a side that is
    already counted; otherwise `small` is counted here.
    """
    if fits(small, max_rows) if small_fits is None else small_fits:
        return big.join(F.broadcast(small), on, how)
    # Few bytes in a file may be many rows: a counted side is never broadcast by Spark's estimate of its size.
    if salts == 1:
        return big.join(small.hint("merge"), on, how)
    columns = [F.col(c) for c in (spread or big.columns)]
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*columns), F.lit(salts)))
    copies = small.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    )
    return salted.join(copies.hint("merge"), on + ["_salt"], how).drop("_salt")
