"""Stored snapshots: upsert, latest row per day, previous-run and previous-date joins, diffs, price history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from offerloom import constants as K
from offerloom.operators.skew import first_row, pieces, scan
from offerloom.schema import PLACE

c = F.col
DIFF_COLUMNS = ["url", "unit_price_usd"]  # what a diff reads of an offer besides product and step
DETAILS = ["title", "source", "attrs"]  # what it hands on, where the rows have it


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows keyed (slug, url, fetched_at); an incoming row replaces a stored one, later positions win."""
    both = stored.withColumn("_gen", F.lit(0)).unionByName(incoming.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    return first_row(both, ["slug", "url", "fetched_at"], [c("_gen").desc(), *[c(n).desc() for n in PLACE]]).drop("_gen")


ROWS_PER_PIECE = 200_000


def latest_per_day(history: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """What was seen last that day: one row per (slug, url, day).

    With *sizes* (snapshot_date, n: rows of each day, few) the result lies by day: a day is dealt to a task per
    *ROWS_PER_PIECE* rows, by product and URL, in the one shuffle that choosing takes.
    """
    days = history.withColumn("snapshot_date", F.to_date("fetched_at"))
    keys, order = ["slug", "url", "snapshot_date"], [c("fetched_at").desc(), *[c(n).desc() for n in PLACE]]
    if sizes is None:
        return first_row(days, keys, order)
    pieces_of = sizes.select(c("snapshot_date").alias("_day"), F.ceil(c("n") / ROWS_PER_PIECE).alias("_pieces"))
    tasks = pieces_of.agg(F.sum("_pieces")).first()[0] or 1
    dealt = days.join(F.broadcast(pieces_of), c("snapshot_date").eqNullSafe(c("_day")), "left")
    dealt = dealt.withColumn("_piece", F.pmod(F.xxhash64("slug", "url"), F.coalesce("_pieces", F.lit(1)))).drop("_day", "_pieces")
    return first_row(dealt.repartition(tasks, "snapshot_date", "_piece"), [*keys, "_piece"], order).drop("_piece")


def snapshot_dates(history: DataFrame) -> DataFrame:
    return history.select("slug", F.to_date("fetched_at").alias("snapshot_date")).distinct()


def numbered_steps(steps: DataFrame, column: str) -> DataFrame:
    """Distinct (slug, step) rows numbered in time, with the previous step: the as-of join table.

    One row per product and step, so the window per product is small whatever the offers weigh.
    """
    w = Window.partitionBy("slug").orderBy(column)
    return steps.select("slug", column).distinct().select(
        "slug", column, F.row_number().over(w).alias("step_no"), F.lag(column).over(w).alias(f"previous_{column}"),
        F.count(F.lit(1)).over(Window.partitionBy("slug")).alias("steps"),
    )


def previous_runs(offers: DataFrame) -> DataFrame:
    """Each stored run with the latest stored run before it. Runs without rows do not exist here."""
    return numbered_steps(offers, "run_ts")


def newest_pair(steps: DataFrame, column: str) -> DataFrame:
    """The last two steps of every product, numbered 1 and 2 (a single step: 1)."""
    first = F.greatest(c("steps") - 1, F.lit(1))
    number = c("step_no") - first + 1
    return steps.where(c("step_no") >= first).select(
        "slug", column, number.cast("int").alias("step_no"), F.when(number > 1, c(f"previous_{column}")).alias(f"previous_{column}"), F.least("steps", F.lit(2)).alias("steps")
    )


def diff_steps(daily: DataFrame, column: str = "snapshot_date", threshold: float = K.PRICE_CHANGE, steps: DataFrame | None = None) -> DataFrame:
    """Changes between each step of a product and the step before it.

    *daily* has one row per (slug, url, step). A single window per (slug, url) sees an offer's own
    steps; comparing step numbers tells new (missing one step earlier), dropped (missing one step
    later) and changed, so no self-join and one shuffle of the rows. *steps* are the numbered steps, where
    the caller has them (one row per product and step); *daily* may carry step_no and steps already.
    """
    steps = numbered_steps(daily, column) if steps is None else steps
    numbered = {"step_no", "steps"} <= set(daily.columns)
    rows = daily if numbered else daily.join(steps.select("slug", column, "step_no", "steps"), ["slug", column])
    w = Window.partitionBy("slug", "url").orderBy("step_no")
    price = c("unit_price_usd")
    details = [n for n in DETAILS if n in daily.columns]
    seen = rows.select(
        "slug", *DIFF_COLUMNS, *details, column, "step_no", "steps",
        F.lag("step_no").over(w).alias("_prev_no"), F.lag("unit_price_usd").over(w).alias("_old"),
        F.lead("step_no").over(w).alias("_next_no"),
    )
    old = c("_old")
    pct = (
        F.when(old > 0, (price - old) / old)
        .when(price > 0, F.lit(float("inf")))
        .otherwise(F.lit(0.0))
    )
    changed = F.when(old > 0, F.abs((price - old) / old) >= threshold).otherwise(price != old)
    adjacent = c("_prev_no") == c("step_no") - 1
    arrival = (
        F.when((c("step_no") > 1) & ~F.coalesce(adjacent, F.lit(False)), "new")
        .when(adjacent & changed, "changed")
    )
    leaves = (c("step_no") < c("steps")) & ~F.coalesce(c("_next_no") == c("step_no") + 1, F.lit(False))
    events = F.array_compact(
        F.array(
            F.when(
                arrival.isNotNull(),
                F.struct(
                    arrival.alias("change_type"), c("step_no").alias("step_no"),
                    F.when(arrival == "changed", old).alias("old_price_usd"), price.alias("new_price_usd"),
                    F.when(arrival == "changed", pct).alias("pct_change"),
                ),
            ),
            F.when(
                leaves,
                F.struct(
                    F.lit("dropped").alias("change_type"), (c("step_no") + 1).alias("step_no"),
                    price.alias("old_price_usd"), F.lit(None).cast("double").alias("new_price_usd"),
                    F.lit(None).cast("double").alias("pct_change"),
                ),
            ),
        )
    )
    kept = ["slug", "url", *details]
    out = seen.select(*kept, F.explode(events).alias("e")).select(*kept, "e.*")
    return out.join(steps.drop("steps"), ["slug", "step_no"])


def material_change(daily: DataFrame, diff: DataFrame, column: str = "snapshot_date", steps: DataFrame | None = None) -> DataFrame:
    """Headline per product and step with a predecessor: new offers, else a drop of 5 % or more, else a lower minimum."""
    lowest = daily.groupBy("slug", column).agg(F.min("unit_price_usd").alias("lowest"))
    steps = (numbered_steps(daily, column) if steps is None else steps).where(c(f"previous_{column}").isNotNull())
    before = lowest.select("slug", c(column).alias(f"previous_{column}"), c("lowest").alias("previous_lowest"))
    counts = diff.groupBy("slug", column).agg(
        F.count_if(c("change_type") == "new").alias("new_count"),
        F.count_if(c("change_type") == "dropped").alias("dropped_count"),
        F.count_if(c("change_type") == "changed").alias("changed_count"),
        F.count_if((c("change_type") == "changed") & (c("pct_change") <= -K.PRICE_CHANGE)).alias("big_drops"),
    )
    n = lambda name: F.coalesce(c(name), F.lit(0)).alias(name)
    joined = steps.join(lowest, ["slug", column]).join(before, ["slug", f"previous_{column}"]).join(counts, ["slug", column], "left")
    return joined.select(
        "slug", column, n("new_count"), n("dropped_count"), n("changed_count"), n("big_drops"), "lowest", "previous_lowest"
    ).withColumn("is_material", (c("new_count") + c("dropped_count") + c("changed_count")) > 0).withColumn(
        "headline", headline(c("new_count"), c("big_drops"), c("lowest"), c("previous_lowest"))
    )


def headline(new_count: Column, big_drops: Column, lowest: Column, previous_lowest: Column) -> Column:
    return (
        F.when(new_count > 0, F.concat(new_count.cast("string"), F.lit(" new listings found")))
        .when(big_drops > 0, "Price dropped by >=5%")
        .when(lowest < previous_lowest, F.concat(F.lit("New cheapest path: "), F.format_string("$%.2f", lowest)))
    )


def price_history(history: DataFrame) -> DataFrame:
    """Per stored offer row: change against the previous observation, and first, lowest and highest price so far.

    A prefix scan over pieces of time, so one URL may hold most rows. Rows without a URL cannot be followed:
    each is a history of its own.
    """
    price = c("unit_price_usd")
    alone = F.concat_ws(":", F.lit(""), *[c(n).cast("string") for n in PLACE], c("fetched_at").cast("string"))
    rows = history.select("slug", "url", "fetched_at", *PLACE, price, F.coalesce(F.when(F.trim("url") != "", c("url")), alone).alias("_url"))
    keys, order = ["slug", "_url"], [c("fetched_at"), *[c(n) for n in PLACE]]
    place = F.struct("fetched_at", *PLACE)
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.struct(price.alias("v"))  # a null price is still an observation
    done = scan(
        pieces(rows, keys, order), keys, order,
        {
            "_no": lambda w: F.row_number().over(w), "_lag": lambda w: F.lag(price).over(w), "_first": lambda w: F.first(price).over(so_far(w)),
            "_low": lambda w: F.min(price).over(so_far(w)), "_high": lambda w: F.max(price).over(so_far(w)),
        },
        {
            "_last_before": (F.max_by(value, place), lambda n, w: F.last(n).over(w)), "_first_before": (F.min_by(value, place), lambda n, w: F.first(n).over(w)),
            "_low_before": (F.min(price), lambda n, w: F.min(n).over(w)), "_high_before": (F.max(price), lambda n, w: F.max(n).over(w)),
        },
    )
    begun = c("_first_before").isNotNull()
    return done.select(
        "slug", "url", "fetched_at", "pos", price,
        F.when(c("_no") > 1, c("_lag")).otherwise(c("_last_before.v")).alias("previous_price_usd"),
        F.when(begun, c("_first_before.v")).otherwise(c("_first")).alias("first_price_usd"),
        F.least("_low", "_low_before").alias("lowest_price_usd"), F.greatest("_high", "_high_before").alias("highest_price_usd"),
    )
