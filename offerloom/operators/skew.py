"""Building blocks that stay exact and spread out when one key holds a large share of all rows.

* ``top_rows``       - k first rows per key; Spark limits every map task to k rows per key before the shuffle.
* ``counted_median`` - exact median from (value, count) rows, through bucket counts instead of one sorted group.
* ``ordered_rank``   - exact row number per key over a range-partitioned copy that is written once.
* ``pieces``         - the same copy for scans along an order: each piece of a key is scanned alone, a carry from the
  pieces before it completes the result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from offerloom.session import durable

LOWEST_BUCKET = -(2**31)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first *k* rows per key in *order*, with their row number in *name*.

    `row_number() <= literal` becomes a WindowGroupLimit below the exchange, so a hot key ships at
    most k rows per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_rows(df, keys, order, 1, "_first").drop("_first")


def value_bucket(v: Column) -> Column:
    """Monotone bucket of a value >= 0: 256 buckets per doubling, one for zero."""
    return F.coalesce(F.floor(F.log2(v) * 256).cast("int"), F.lit(LOWEST_BUCKET))


def counted_ranks(counted: DataFrame, keys: Sequence[str], value: str, count: str, ranks: dict[str, Callable[[Column], Column]], total: str = "_total_n") -> DataFrame:
    """Exact order statistics per key of values >= 0 given as (key, value, count) rows.

    ranks: name -> function from the number of values to a 0-based rank. Bucket counts are summed first.
    Their running total per key (one row per bucket, so small) tells which buckets hold the ranks; only the
    distinct values of those buckets are ordered.
    """
    keys = list(keys)
    rows = counted.select(*keys, F.col(value).alias("_v"), F.col(count).alias("_n")).withColumn("_b", value_bucket(F.col("_v")))
    buckets = rows.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    running = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    wanted = {name: rank(F.col("_total")) for name, rank in ranks.items()}
    holds = reduce(Column.__or__, [(F.col("_before") <= r) & (r < F.col("_before") + F.col("_bn")) for r in wanted.values()])
    middle = (
        buckets.withColumn("_before", F.sum("_bn").over(running) - F.col("_bn"))
        .withColumn("_total", F.sum("_bn").over(whole))
        .where(holds)
        .drop("_bn")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.join(middle, [*keys, "_b"]).withColumn("_from", F.col("_before") + F.sum("_n").over(inside) - F.col("_n"))
    covers = lambda rank: (F.col("_from") <= rank) & (rank < F.col("_from") + F.col("_n"))
    return (
        ranked.groupBy(*keys)
        .agg(
            *[F.max(F.when(covers(r), F.col("_v"))).alias(name) for name, r in wanted.items()],
            F.max("_total").alias(total),
        )
    )


def counted_median(counted: DataFrame, keys: Sequence[str], value: str, count: str, out: str) -> DataFrame:
    """Exact (interpolated) median per key of values >= 0 given as (key, value, count) rows."""
    middle = {"_lo": lambda n: F.floor((n - 1) / 2), "_hi": lambda n: F.floor(n / 2)}
    ranked = counted_ranks(counted, keys, value, count, middle, f"{out}_n")
    return ranked.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias(out), f"{out}_n")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_count"))
    return counted_median(counted, keys, value, "_count", out)


def ordered_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank", total: str | None = None) -> DataFrame:
    """1-based row number per key in *order* for every row, however large a key is; *total*: the key's number of rows.

    Range partitioning on (keys, order) cuts a hot key into even pieces. The sorted copy is written
    with its piece and row numbers, because sampled range bounds may differ if it were computed again.
    Each piece then only needs the number of rows of its key in earlier pieces: a small table, written so that its
    size is known and the rows are not shuffled again to meet it.
    """
    keys = list(keys)
    sizes = [F.sum("_size").over(Window.partitionBy(*keys)).alias(total)] if total else []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(
        df.repartitionByRange(parts, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_id", F.monotonically_increasing_id())
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = durable(
        placed.groupBy(*keys, "_part")
        .agg(F.min("_id").alias("_start"), F.count(F.lit(1)).alias("_size"))
        .select(*keys, "_part", "_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_skip"), *sizes)
    )
    return (
        placed.join(pieces, [*keys, "_part"])
        .withColumn(name, (F.col("_id") - F.col("_start") + F.col("_skip") + 1).cast("bigint"))
        .drop("_part", "_id", "_start", "_skip")
    )


def pieces(df: DataFrame, keys: Sequence[str], order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """*df* cut into even pieces along (keys, order), written once; `_part` numbers the pieces in order.

    Range bounds lie inside a hot key as well, so no piece grows with a key. *order* must tell all rows of a
    key apart where the scan depends on it.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))


def scan(placed: DataFrame, keys: Sequence[str], order: Sequence[Column], local: dict[str, Callable], carried: dict[str, tuple[Column, Callable]]) -> DataFrame:
    """One pass along *order* within every key of *placed* rows (see ``pieces``).

    local: name -> function from the window of the piece (key and `_part`, ordered) to a column.
    carried: name -> (aggregate of a piece, function from (column name, window over earlier pieces) to a column).
    Both are columns of the result, which the caller combines. Carries are one row per key and piece; a key has
    at most as many pieces as there are partitions.
    """
    keys = list(keys)
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, "_part").agg(*[agg.alias(f"_of_{name}") for name, (agg, _) in carried.items()])
    carries = sums.select(*keys, "_part", *[over(f"_of_{name}", earlier).alias(name) for name, (_, over) in carried.items()])
    rows = placed.select("*", *[column(inside).alias(name) for name, column in local.items()])
    return rows.join(carries, [*keys, "_part"])


def column_bounds(df: DataFrame, defaults: dict[str, int]) -> list[int]:
    """Largest value of each per-profile limit, nulls being the default: literals of pushed-down row limits, in one job."""
    row = df.agg(*[F.max(F.coalesce(F.col(n), F.lit(d))) for n, d in defaults.items()]).first()
    return [d if m is None else int(m) for m, d in zip(row, defaults.values())]


def relative_ranks(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[Column], tiles: int) -> DataFrame:
    """*df* with percent_rank, cume_dist and tile (1 to *tiles*) of *value* within its key, however large the key is.

    Row numbers come from range-partitioned pieces. Equal values share their first and last row number, which are
    aggregates of one row per (key, value), and the size of a key comes with its pieces, so no key and no value is one
    group. *ties* orders equal values for the tiles. Rows whose key or value is null have no ranks and count for none.
    """
    keys = list(keys)
    held = reduce(Column.__and__, [F.col(n).isNotNull() for n in [*keys, value]])
    placed = ordered_rank(df.where(held), keys, [F.col(value), *ties], "_no", "_n")
    levels = placed.groupBy(*keys, value).agg(F.min("_no").alias("_first"), F.max("_no").alias("_last"))
    n, no, size = F.col("_n"), F.col("_no"), F.floor(F.col("_n") / tiles)
    longer = (n % tiles) * (size + 1)  # rows of the first tiles, which hold one more
    tile = F.when(no <= longer, F.ceil(no / (size + 1))).otherwise(n % tiles + F.ceil((no - longer) / F.greatest(size, F.lit(1))))
    ranked = placed.join(levels, [*keys, value]).select(
        *df.columns,
        F.when(n > 1, (F.col("_first") - 1) / (n - 1)).otherwise(0.0).alias("percent_rank"),
        (F.col("_last") / n).alias("cume_dist"),
        tile.cast("int").alias("tile"),
    )
    none = df.where(~held).select("*", F.lit(None).cast("double").alias("percent_rank"), F.lit(None).cast("double").alias("cume_dist"), F.lit(None).cast("int").alias("tile"))
    return ranked.unionByName(none)
