"""As-of join: every left row with the newest right row of its key before it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from offerloom.operators.skew import pieces, scan

c = F.col


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, order: Sequence[str] = (), inclusive: bool = False, parts: int | None = None) -> DataFrame:
    """*left* with a struct `match`: the last row of *right* of equal keys whose *time* is before the left row's.

    With *inclusive* an equal time counts as well. Right rows of one time follow *order*, of which the last wins.
    Both sides go through one scan along time: a key is cut into pieces of time, each piece finds its matches, and
    its first rows take what the pieces before it carry over. So a key may hold most rows of both sides, and no
    row is multiplied. Rows with a null key or time match nothing; left ones stay with a null `match`.
    """
    keys = list(keys)
    side = lambda df, number, whole: df.select(*keys, c(time).alias("_time"), F.lit(number).alias("_side"), whole)
    fields = [n for n in right.columns if n not in keys]
    mine = side(left, 0 if not inclusive else 2, F.struct(*left.columns).alias("_left"))
    yours = side(right, 1, F.struct(*fields).alias("_right")).where(_known([*keys, "_time"]))
    both = mine.where(_known([*keys, "_time"])).unionByName(yours, allowMissingColumns=True)
    along = [c("_time"), c("_side"), *[c(f"_right.{n}") for n in order]]
    placed = pieces(both, keys, along, parts)
    place = F.struct("_time", "_side", *[c(f"_right.{n}").alias(f"o{i}") for i, n in enumerate(order)])
    done = scan(
        placed, keys, along,
        {"_here": lambda w: F.last("_right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))},
        {"_before": (F.max_by("_right", F.when(c("_right").isNotNull(), place)), lambda n, w: F.last(n, ignorenulls=True).over(w))},
    )
    met = done.where(c("_left").isNotNull()).select("_left.*", F.coalesce("_here", "_before").alias("match"))
    unplaced = left.where(~_known([*keys, time])).withColumn("match", F.lit(None).cast(met.schema["match"].dataType))
    return met.unionByName(unplaced)


def _known(names: Sequence[str]) -> Column:
    return reduce(Column.__and__, [c(n).isNotNull() for n in names])
