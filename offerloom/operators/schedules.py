"""Due-run planning: which schedules fire in which tick window, one-shot runs, next runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from offerloom import constants as K
from offerloom.functions import schedule as S

c = F.col


def due_runs(schedules: DataFrame, ticks: DataFrame, fired_once: DataFrame | None = None, minutes: int = K.TICK_MINUTES) -> DataFrame:
    """(slug, tick, reason) rows.

    A cron schedule is due at a tick when it fires in (tick - minutes, tick]. One-shot schedules are due
    at the first tick at or after run_at, unless already in *fired_once*.
    """
    spans = ticks.select(F.date_trunc("minute", "tick").alias("tick")).distinct()
    recurring = cron_due(schedules.where(c("cron").isNotNull()), spans, minutes).withColumn("reason", F.lit("cron"))
    once = schedules.where(c("run_at").isNotNull()).select("slug", "run_at")
    if fired_once is not None:
        once = once.join(fired_once.select("slug", "run_at"), ["slug", "run_at"], "left_anti")
    return recurring.unionByName(first_tick_after(once, spans).withColumn("reason", F.lit("run_at")))


def tick_calendar(spans: DataFrame, minutes: int) -> DataFrame:
    """(day, hours) for the windows (tick - minutes, tick] of a day's ticks; windows are at most a day long.

    hours[h] lists tick and covered minutes (a bit set) of the windows that touch hour h, hours[24 + h] of those that
    touch that hour of the day before. A row is one day: it has at most 1,440 ticks.
    """
    begin = F.timestamp_add("MINUTE", F.lit(1 - minutes), c("tick"))  # first minute inside
    hour = F.explode(F.sequence(F.date_trunc("hour", begin), F.date_trunc("hour", "tick"), F.expr("interval 1 hour")))
    met = spans.select("tick", begin.alias("begin"), hour.alias("hour"))
    first = F.when(c("begin") > c("hour"), F.minute("begin")).otherwise(0)
    last = F.when(F.date_trunc("hour", "tick") > c("hour"), 59).otherwise(F.minute("tick"))
    ones = F.call_function("shiftleft", F.lit(1).cast("bigint"), (last - first + 1).cast("int")) - 1
    covered = F.call_function("shiftleft", ones, first.cast("int"))
    place = F.hour("hour") + F.when(F.to_date("hour") < F.to_date("tick"), 24).otherwise(0)
    by_hour = met.groupBy(F.to_date("tick").alias("day"), place.alias("place")).agg(F.collect_list(F.struct("tick", covered.alias("minutes"))).alias("windows"))
    by_day = by_hour.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("place", "windows"))).alias("known"))
    return by_day.select("day", F.transform(F.sequence(F.lit(0), F.lit(47)), lambda h: F.try_element_at("known", h)).alias("hours"))


def cron_due(schedules: DataFrame, spans: DataFrame, minutes: int) -> DataFrame:
    """(slug, tick) of schedules that fire in (tick - minutes, tick]: calendars as bit sets.

    A schedule is five numbers, a window the minutes it covers of an hour. Schedules meet the days of their
    months (and the first day after these, whose windows reach back); on a day that fires, or follows one, the
    windows of the schedule's hours fit if their minutes have a bit in common with the schedule's. No fire minute
    becomes a row, and all hours of a tick are compared in one row, so nothing is made distinct after the join.
    """
    calendar = tick_calendar(spans, minutes).withColumn("month", F.month("day"))
    planned = schedules.select("slug", S.cron_plan(c("cron")).alias("plan")).where(c("plan").isNotNull())
    plans = planned.select("slug", c("plan.hour").alias("at"), S.plan_masks(c("plan")).alias("masks"))
    reached = lambda m: S.has_bit(c("masks.month"), m) | S.has_bit(c("masks.month"), F.when(m == 1, 12).otherwise(m - 1))
    months = F.filter(F.sequence(F.lit(1), F.lit(12)), reached)
    # The calendar (a row per day) is the small side whatever the schedules' file size promises: exploded, they outgrow it.
    met = plans.select("slug", "at", "masks", F.explode(months).alias("month")).join(F.broadcast(calendar), "month")
    met = met.withColumn("today", S.mask_fires_on_day(c("masks"), c("day"))).withColumn("yesterday", S.mask_fires_on_day(c("masks"), F.date_sub("day", 1)))
    fit = lambda windows: F.transform(F.filter(windows, lambda w: w["minutes"].bitwiseAND(c("masks.minute")) != 0), lambda w: w["tick"])
    none = F.array().cast("array<timestamp>")
    ticks = lambda offset, when: F.when(when, F.flatten(F.transform("at", lambda h: F.coalesce(fit(F.get("hours", h + offset)), none)))).otherwise(none)
    found = F.array_distinct(F.concat(ticks(0, c("today")), ticks(24, c("yesterday"))))
    return met.where(c("today") | c("yesterday")).select("slug", F.explode(found).alias("tick"))


def first_tick_after(once: DataFrame, spans: DataFrame) -> DataFrame:
    """First tick at or after run_at, by calendar day: the day's own ticks, else the next day that has one.

    The calendar has one row per day, whatever the number of schedules.
    """
    by_day = spans.groupBy(F.to_date("tick").alias("day")).agg(F.collect_set("tick").alias("ticks"))
    ends = spans.agg(F.max(F.to_date("tick")).alias("last")).join(once.agg(F.min(F.to_date("run_at")).alias("first")))
    calendar = ends.where(c("first") <= c("last")).select(F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("day"))
    after = Window.orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    lookup = calendar.join(by_day, "day", "left").withColumn("later", F.first(F.array_min("ticks"), ignorenulls=True).over(after))
    today = F.array_min(F.filter("ticks", lambda t: t >= c("run_at")))
    met = once.withColumn("day", F.to_date("run_at")).join(lookup, "day")
    return met.select("slug", F.coalesce(today, c("later")).alias("tick")).where(c("tick").isNotNull())


def next_runs(schedules: DataFrame, after) -> DataFrame:
    """Next instant of every schedule strictly after *after* (a column); null when it has none."""
    # The plan is its own column: inside the day filter it must not be parsed again per day.
    planned = schedules.withColumn("_plan", S.cron_plan(c("cron")))
    once = F.when(c("run_at") > after, c("run_at"))
    return planned.withColumn("next_run", F.when(c("run_at").isNotNull(), once).otherwise(S.next_fire(c("_plan"), after))).drop("_plan")
