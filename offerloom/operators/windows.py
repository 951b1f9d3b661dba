"""Time windows over stored offers that stay spread when one offer or product holds most rows, and level totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

c = F.col


def recent_range(rows: DataFrame, keys: Sequence[str], time: str, value: str, days: int = 30) -> DataFrame:
    """*rows* with low and high: the least and largest *value* of the key within *days* before and at each row.

    A range frame over time buckets as long as the frame: a row belongs to its bucket and is seen by the next one,
    so twice the rows are shuffled and a window's group is one key in two spans of *days*, not the whole history.
    Null values are left out of the frame; rows without a time have no low and high.
    """
    seconds = days * 86400
    at = F.unix_micros(c(time).cast("timestamp"))
    bucket = F.floor(at / F.lit(seconds * 1_000_000))
    seen = rows.withColumn("_at", at).withColumn("_own", bucket).withColumn("_bucket", F.explode(F.coalesce(F.array("_own", c("_own") + 1), F.array(F.lit(None).cast("bigint")))))
    frame = Window.partitionBy(*keys, "_bucket").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    done = seen.withColumn("low", F.when(c("_at").isNotNull(), F.min(value).over(frame))).withColumn("high", F.when(c("_at").isNotNull(), F.max(value).over(frame)))
    return done.where(c("_bucket").eqNullSafe(c("_own"))).drop("_at", "_own", "_bucket")


def sessions(rows: DataFrame, keys: Sequence[str], time: str, value: str, gap: str = "30 minutes") -> DataFrame:
    """(keys, started, ended, observations, low, high): stretches of a key without a pause of *gap* or more.

    For tables and, with a watermark on *time*, for streams. Sessions combine before the shuffle.
    """
    met = rows.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(
        F.min(time).alias("started"), F.max(time).alias("ended"), F.count(F.lit(1)).alias("observations"), F.min(value).alias("low"), F.max(value).alias("high")
    )
    return met.drop("w")


def level_totals(offers: DataFrame, levels: Sequence[Column], names: Sequence[str], price: str = "unit_price_usd") -> DataFrame:
    """Offers, lowest and mean price for every combination of *levels* (a cube); `level` is the grouping id, 0 the finest.

    The rows are reduced to the finest level once, prices as whole hundredths of a cent, so that sums are exact; all coarser levels come from its counts and sums, so a row is
    shuffled once however many levels there are.
    """
    finest = offers.groupBy(*[v.alias(n) for v, n in zip(levels, names)]).agg(F.count(F.lit(1)).alias("n"), F.count(price).alias("priced"), F.sum(F.round(c(price) * 10_000).cast("bigint")).alias("total"), F.min(price).alias("low"))
    cube = finest.cube(*names).agg(F.grouping_id().cast("int").alias("level"), F.sum("n").alias("offers"), F.sum("priced").alias("priced"), F.sum("total").alias("total"), F.min("low").alias("lowest_usd"))
    return cube.select(*names, "level", "offers", "lowest_usd", (c("total").cast("double") / (c("priced") * 10_000)).alias("mean_usd"))
