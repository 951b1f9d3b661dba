"""Price outliers per run by median and median absolute deviation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from offerloom import constants as K
from offerloom.operators.rules import add_flag
from offerloom.operators.skew import counted_median
from offerloom.session import durable

c = F.col
RUN = ["slug", "run_ts"]


def price_stats(offers: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """Exact median, MAD and number of priced offers per run.

    Both medians work on (price, count) rows, so the offers themselves are shuffled once, pre-aggregated.
    The counts and the medians are written once, because each is read several times.
    """
    counted = durable(
        offers.where(c("unit_price_usd") > 0)
        .groupBy(*keys, c("unit_price_usd").alias("_price"))
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    medians = durable(counted_median(counted, keys, "_price", "_count", "median"))
    deviations = counted.join(medians, keys).withColumn("_dev", F.abs(c("_price") - c("median")))
    # One row per run, written as well: its size is known, so that it is broadcast and the offers are not shuffled by run.
    return durable(medians.join(counted_median(deviations, keys, "_dev", "_count", "mad").drop("mad_n"), keys).withColumnRenamed(
        "median_n", "priced"
    ))


def flag_price_anomalies(
    offers: DataFrame, keys: list[str] = RUN, mad_k: float = K.MAD_K, low_ratio: float = K.LOW_RATIO,
    high_ratio: float = K.HIGH_RATIO, min_priced: int = K.MIN_PRICED,
) -> DataFrame:
    """Flag offers far from the run's median: beyond the ratio and, unless MAD is 0, beyond mad_k MADs."""
    p, m, mad = c("unit_price_usd"), c("median"), c("mad")
    usable = (c("priced") >= min_priced) & (p > 0)
    low = usable & (p < m * low_ratio) & ((mad == 0) | ((m - p) > mad_k * mad))
    high = usable & (p > m * high_ratio) & ((mad == 0) | ((p - m) > mad_k * mad))
    flagged = offers.join(price_stats(offers, keys), keys, "left").withColumn("_low", F.coalesce(low, F.lit(False)))
    return (
        flagged.withColumn("flags", add_flag(K.FLAG_LOW, c("_low")))
        .withColumn("flags", add_flag(K.FLAG_HIGH, high & ~c("_low")))
        .drop("median", "mad", "priced", "_low")
    )
