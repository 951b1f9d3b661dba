"""Offer order, display selection with per-vendor caps, reserved top-k per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from offerloom import constants as K
from offerloom.functions import money, urls
from offerloom.operators.skew import ordered_rank, top_rows
from offerloom.schema import PLACE

c = F.col
RUN = ["slug", "run_ts"]


def place() -> list[Column]:
    """Input order of a run: sources in turn, positions within them."""
    return [c(n).asc() for n in PLACE]


def price_order() -> list[Column]:
    """Low outliers last, then cheapest first, unpriced at the end, input order on ties."""
    return [
        F.array_contains(c("flags"), K.FLAG_LOW).asc(),
        money.priced(c("unit_price_usd")).asc_nulls_last(),
        *place(),
    ]


def total_order() -> list[Column]:
    """Offers with a total first, by total; then by unit price."""
    return [
        F.when(c("total_for_target_usd").isNotNull(), 0).when(c("unit_price_usd").isNotNull(), 1).otherwise(2).asc(),
        F.coalesce(c("total_for_target_usd"), c("unit_price_usd"), F.lit(0.0)).asc(),
        *place(),
    ]


def select_for_display(offers: DataFrame, max_listings: int, per_vendor_cap: int) -> DataFrame:
    """Ranked display rows per run: at most *per_vendor_cap* per vendor, then the first *max_listings*.

    Both limits are row limits on the map side, so neither a hot run nor a hot vendor is gathered.
    When the offers carry per-profile `max_listings` / `per_vendor_cap` columns, those apply and the
    arguments are their upper bounds; a null limit of a profile takes the default.
    """
    vendors = offers.withColumn("vendor", urls.vendor_key(c("seller_name")))
    capped = top_rows(vendors, [*RUN, "vendor"], price_order(), per_vendor_cap, "vendor_rank")
    if "per_vendor_cap" in offers.columns:
        capped = capped.where(c("vendor_rank") <= F.coalesce("per_vendor_cap", F.lit(K.PER_VENDOR_CAP)))
    shown = top_rows(capped, RUN, price_order(), max_listings, "rank")
    return shown.where(c("rank") <= F.coalesce("max_listings", F.lit(K.MAX_LISTINGS))) if "max_listings" in offers.columns else shown


def vendor_overflow(offers: DataFrame, displayed: DataFrame, per_vendor_cap: int) -> DataFrame:
    """How many offers the cap held back, for vendors that are shown."""
    cap = F.coalesce("per_vendor_cap", F.lit(K.PER_VENDOR_CAP)) if "per_vendor_cap" in offers.columns else F.lit(per_vendor_cap)
    counts = (
        offers.groupBy(*RUN, urls.vendor_key(c("seller_name")).alias("vendor"))
        .agg(F.count(F.lit(1)).alias("_n"), F.max(cap).alias("_cap"))
        .where(c("_n") > c("_cap"))
        .select(*RUN, "vendor", (c("_n") - c("_cap")).alias("held_back"))
    )
    return counts.join(displayed.select(*RUN, "vendor").distinct(), [*RUN, "vendor"], "left_semi")


def rank_all(offers: DataFrame) -> DataFrame:
    """Rank of every survivor in its run, one row each."""
    priced = offers.withColumn("_low", F.array_contains(c("flags"), K.FLAG_LOW)).withColumn(
        "_p", F.coalesce(money.priced(c("unit_price_usd")), F.lit(float("inf")))
    )
    return ordered_rank(priced, RUN, [c("_low"), c("_p"), *map(c, PLACE)]).drop("_low", "_p")


def source_bucket() -> Column:
    """Universal rows count per vendor host, other sources as one bucket."""
    host = F.coalesce(
        F.nullif(F.try_element_at(c("attrs"), F.lit("vendor_host")), F.lit("")), F.lower(urls.netloc(c("url"))), F.lit("")
    )
    return F.when(c("source") == K.UNIVERSAL, host).otherwise(F.lit(""))


def rank_for_report(offers: DataFrame, limit: int = K.REPORT_CAP, reserve: int = K.RESERVED_PER_SOURCE) -> DataFrame:
    """Up to *limit* rows per run, the cheapest *reserve* of every source first, the rest by global order.

    The reserved rows and the globally cheapest rows are both small (row limits per group), and
    together hold everything the selection can need: with r reserved rows, the cheapest *limit*
    rows include at least limit - r others.
    """
    bucketed = offers.withColumn("_bucket", source_bucket())
    reserved = top_rows(
        top_rows(bucketed, [*RUN, "source", "_bucket"], total_order(), reserve, "_k"), RUN, total_order(), limit, "_r"
    ).select("*", F.lit(0).alias("_tier")).drop("_k", "_r")
    cheapest = top_rows(bucketed, RUN, total_order(), limit, "_r").select("*", F.lit(1).alias("_tier")).drop("_r")
    pool = top_rows(reserved.unionByName(cheapest), [*RUN, *PLACE], [c("_tier")], 1, "_one").drop("_one")
    chosen = top_rows(pool, RUN, [c("_tier"), *total_order()], limit, "_pick")
    return top_rows(chosen, RUN, total_order(), limit, "rank").drop("_bucket", "_tier", "_pick")


def shown_of_total(ranked: DataFrame, offers: DataFrame) -> DataFrame:
    """'top N of M' per run."""
    shown = ranked.groupBy(*RUN).agg(F.count(F.lit(1)).alias("shown"))
    total = offers.groupBy(*RUN).agg(F.count(F.lit(1)).alias("total"))
    return total.join(shown, RUN, "left").select(
        *RUN, "total", F.coalesce("shown", F.lit(0)).alias("shown")
    ).withColumn("note", F.when(c("shown") < c("total"), F.format_string("top %d of %d", c("shown"), c("total"))))


def cheapest(offers: DataFrame, keys: list[str], price: Column, keep: list[str]) -> DataFrame:
    """The cheapest row per key, the first on ties: an aggregate, so it combines on the map side."""
    return offers.groupBy(*keys).agg(
        F.min_by(F.struct(*[c(k) for k in keep], price.alias("price")), F.struct(price, *PLACE)).alias("_best")
    ).select(*keys, "_best.*")


def bottom_line(offers: DataFrame) -> DataFrame:
    """Cheapest offer per run by total, falling back to unit price."""
    tier = F.when(c("total_for_target_usd").isNotNull(), 0).otherwise(1)
    price = F.coalesce(c("total_for_target_usd"), c("unit_price_usd"))
    return offers.groupBy(*RUN).agg(
        F.min_by(
            F.struct("source", "url", "title", "seller_name", "condition", "attrs", "total_for_target_usd", "unit_price_usd"),
            F.struct(tier.alias("tier"), price.alias("price"), *PLACE),
        ).alias("top")
    )
