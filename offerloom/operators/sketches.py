"""Mergeable day states of distinct vendors and price quantiles, next to the exact operators.

A day's offers are read once; any span of days is answered from its states, a few KB for each product and day.
Distinct counts are off by 1.04 / sqrt(2 ** LG_REGISTERS) as standard error (0.8 %), quantile ranks by about 0.7 %
with QUANTILE_ITEMS of 400. Merging adds no error beyond that of one sketch over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

c = F.col

LG_REGISTERS = 14  # registers of a distinct-count state, as a power of two
QUANTILE_ITEMS = 400  # items a quantile state keeps per level
CENTS = 10_000  # prices are kept as whole hundredths of a cent


def day_states(offers: DataFrame, keys: Sequence[str], vendor: Column, price: str = "unit_price_usd") -> DataFrame:
    """(keys, offers, priced, vendor_state, price_state) of each key, a product and day as a rule.

    Null vendors and null prices are in no state; a key with prices of none has a null price_state. States combine
    before the shuffle, so a hot key ships one state per map task.
    """
    rows = offers.select(*keys, vendor.alias("_vendor"), F.round(c(price) * CENTS).cast("bigint").alias("_price"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("offers"), F.count("_price").alias("priced"), F.hll_sketch_agg("_vendor", F.lit(LG_REGISTERS)).alias("vendor_state"),
        F.when(F.count("_price") > 0, F.kll_sketch_agg_bigint("_price", F.lit(QUANTILE_ITEMS))).alias("price_state"),
    )


def merge_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The states of coarser keys: months of days, all days of a product."""
    return states.groupBy(*keys).agg(
        F.sum("offers").alias("offers"), F.sum("priced").alias("priced"), F.hll_union_agg("vendor_state").alias("vendor_state"),
        F.when(F.sum("priced") > 0, F.kll_merge_agg_bigint("price_state", F.lit(QUANTILE_ITEMS))).alias("price_state"),
    )


def estimates(states: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """*states* with vendors (estimated distinct count) and one estimated price for each of *quantiles*; null without prices."""
    prices = [F.when(c("price_state").isNotNull(), F.kll_sketch_get_quantile_bigint("price_state", F.lit(q)) / CENTS).alias(n) for n, q in quantiles.items()]
    return states.select("*", F.hll_sketch_estimate("vendor_state").alias("vendors"), *prices).drop("vendor_state", "price_state")


def estimate_errors(offers: DataFrame, keys: Sequence[str], vendor: Column, estimated: DataFrame, quantiles: dict[str, float], price: str = "unit_price_usd") -> DataFrame:
    """(keys, exact_vendors, vendor_error, rank_error): how far *estimated* is from the exact result.

    vendor_error is relative. rank_error is the largest distance, in ranks from 0 to 1, from a wanted quantile to the
    ranks its estimated price covers; null without prices.
    """
    cents = F.round(c(price) * CENTS).cast("bigint")
    marks = estimated.select(*keys, *[F.round(c(n) * CENTS).cast("bigint").alias(f"_q_{n}") for n in quantiles])
    sides = [agg for n in quantiles for agg in (F.count_if(c("_price") < c(f"_q_{n}")).alias(f"_below_{n}"), F.count_if(c("_price") <= c(f"_q_{n}")).alias(f"_upto_{n}"))]
    exact = offers.select(*keys, vendor.alias("_vendor")).groupBy(*keys).agg(F.count_distinct("_vendor").alias("exact_vendors"))
    ranks = offers.select(*keys, cents.alias("_price")).join(marks, list(keys)).groupBy(*keys).agg(F.count("_price").alias("_n"), *sides)
    off = [F.greatest(c(f"_below_{n}") / c("_n") - q, q - c(f"_upto_{n}") / c("_n"), F.lit(0.0)) for n, q in quantiles.items()]
    worst = F.when(c("_n") > 0, off[0] if len(off) == 1 else F.greatest(*off))
    joined = estimated.select(*keys, "vendors").join(exact, list(keys)).join(ranks, list(keys))
    error = F.abs(c("vendors") - c("exact_vendors")) / F.greatest(c("exact_vendors"), F.lit(1))
    return joined.select(*keys, "exact_vendors", error.alias("vendor_error"), worst.alias("rank_error"))
