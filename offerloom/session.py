"""Session settings the engine relies on, and durable lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.parquet.compression.codec": "zstd",
    # Compressed rows unfold: 16 MB of a stored table are about half a million wide rows, which a task sorts in memory.
    "spark.sql.files.maxPartitionBytes": "16m",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "offerloom", master: str | None = None, shuffle_partitions: int | None = None, checkpoint_dir: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return prepare(builder.getOrCreate())


def checkpoint_root(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, else the session's warehouse. One rule for every master."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/offerloom"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """A write in this block removes its shuffle files as it ends, instead of at some later garbage collection of the driver."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def durable(df: DataFrame, by: str | None = None) -> DataFrame:
    """Cut the lineage of *df*: write it once as a Parquet table below the shared checkpoint folder and read it back.

    Lost executors or retried tasks re-read the table and never recompute what led to it. Unlike a row
    checkpoint it is columnar, so each reader loads only its columns, and its size is known to the planner: the
    size of its files, so a table of long texts that are alike needs a join hint, or it is taken for a small one.
    *by* is a column with few values; readers that ask for some of them read only these files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tables/{uuid.uuid4().hex}"
    with shuffles_end(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

