"""First-seen duplicate removal and the union of source recalls."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from offerloom.functions.text import nonblank
from offerloom.operators.skew import first_row
from offerloom.schema import PLACE

c = F.col


def first_seen(df: DataFrame, scope: Sequence[str], key: Column, order: Sequence[Column]) -> DataFrame:
    """Keep the first row per (scope, key). Rows with a blank key are all kept.

    A blank key is replaced by the row's own position, so such rows never meet in one group and the
    input is read once.
    """
    own = F.concat_ws("\u0001", F.lit(""), *[o.cast("string") for o in order])
    keyed = df.withColumn("_key", F.coalesce(F.nullif(key, F.lit("")), own))
    return first_row(keyed, [*scope, "_key"], order).drop("_key")


def shopping_key(product_id: Column, link: Column) -> Column:
    return F.coalesce(F.nullif(product_id, F.lit("")), link)


def preview_key(product_id: Column, link: Column, title: Column) -> Column:
    return F.coalesce(nonblank(product_id), nonblank(link), nonblank(title))


def task_key(asin: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(asin, F.lit("")), url)


def union_recalls(recalls: Sequence[DataFrame]) -> DataFrame:
    """One offers table from several sources; `source_order` keeps which came first."""
    numbered = [df.withColumn("source_order", F.lit(i)) for i, df in enumerate(recalls)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def distinct_offers(offers: DataFrame) -> DataFrame:
    """One row per trimmed URL within a run; the earlier source, then the earlier position, wins."""
    return first_seen(offers, ["slug", "run_ts"], F.trim(c("url")), [c(n) for n in PLACE])
