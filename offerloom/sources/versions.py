"""Tables of days whose batches become visible as a whole: versions, and a list of days that is switched last.

Layout below the table's folder: ``data/version=<id>/snapshot_date=<day>/`` holds the rows a batch wrote,
``days/seq=<n>/`` the n-th list of which version holds which day. A writer first writes its days as a new
version, then the next list. A list is one file, which Spark's commit moves into place at once; readers take the
newest one. A writer that dies before that leaves nothing visible, and readers that hold a version keep it, as
no file is ever overwritten. Untouched days are named again, not copied.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StringType, StructType

from offerloom.session import durable

c = F.col

DAYS_DDL = "snapshot_date date, version string, seq bigint"


def _days(spark: SparkSession, path: str) -> DataFrame | None:
    """All lists of the table, or None where there is none yet. Any other error of reading rises."""
    try:
        return spark.read.schema(DAYS_DDL).parquet(f"{path}/days")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def newest(spark: SparkSession, path: str) -> int | None:
    """Number of the newest version, from 1; None for a table without any."""
    days = _days(spark, path)
    return None if days is None else days.agg(F.max("seq")).first()[0]


def read(spark: SparkSession, path: str, schema: StructType, seq: int | None = None) -> DataFrame:
    """Rows of version *seq* (the newest by default), with their `snapshot_date`.

    The list has one row for each day, some 36,500 in a hundred years, so it is broadcast; it prunes the folders that are read.
    A table without that version raises LookupError.
    """
    seq = newest(spark, path) if seq is None else seq
    days = None if seq is None else _days(spark, path)
    listed = days.where((c("seq") == seq) & c("version").isNotNull()).select(c("snapshot_date").alias("_day"), c("version").alias("_version")) if days is not None else None
    if listed is None or days.where(c("seq") == seq).isEmpty():
        raise LookupError(f"no version {seq} of the table at {path}")
    stored = StructType([f for f in schema.fields if f.name not in ("snapshot_date", "version")]).add("version", StringType()).add("snapshot_date", DateType())
    rows = spark.read.schema(stored).parquet(f"{path}/data")
    named = (c("version") == c("_version")) & c("snapshot_date").eqNullSafe(c("_day"))
    return rows.join(F.broadcast(listed), named, "left_semi").drop("version")


def publish(spark: SparkSession, fresh: DataFrame, path: str, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> int:
    """Make the days of *fresh* (rows with `snapshot_date`) the newest version and return its number.

    merge(stored rows of those days, fresh) gives the rows of those days; without it they are replaced. Days whose
    merged rows are none leave the table. Null days are a day of their own. An empty batch makes a version with the same days.
    Two writers at once: the second finds the next number taken and fails, with nothing of it visible.
    """
    fresh = durable(fresh)
    touched = fresh.select(c("snapshot_date").alias("_day")).distinct()
    last = newest(spark, path)
    before = _days(spark, path).where((c("seq") == last) & c("version").isNotNull()).select("snapshot_date", "version") if last else None
    rows = fresh
    if merge is not None and last:
        stored = read(spark, path, fresh.schema, last).select(*fresh.columns)
        rows = durable(merge(stored.join(F.broadcast(touched), c("snapshot_date").eqNullSafe(c("_day")), "left_semi"), fresh))
    version = uuid.uuid4().hex
    rows.hint("rebalance", "snapshot_date").write.partitionBy("snapshot_date").parquet(f"{path}/data/version={version}")
    now = rows.select("snapshot_date").distinct().withColumn("version", F.lit(version))
    if before is not None:
        now = now.unionByName(before.join(F.broadcast(touched), c("snapshot_date").eqNullSafe(c("_day")), "left_anti"))
    mark = spark.createDataFrame([(None, None)], "snapshot_date date, version string")  # so that a version without days is a version
    seq = (last or 0) + 1
    now.unionByName(mark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/days/seq={seq}")
    return seq
