"""Five-field UTC cron schedules as column expressions: no per-minute scanning, no Python rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from offerloom import constants as K
from offerloom.functions.text import hit

PART = r"^(\*|\d+)(?:-(\d+))?(?:/(\d+))?$"
BOUNDS = {"minute": (0, 59), "hour": (0, 23), "dom": (1, 31), "month": (1, 12), "dow": (0, 7)}


def cron_values(field: Column, low: int, high: int) -> Column:
    """Values one cron field stands for, sorted; null when the field is not supported."""

    def values(part: Column) -> Column:
        star = part.startswith("*")
        stride = hit(part, PART, 3).try_cast("int")
        first = F.when(star, low).otherwise(hit(part, PART, 1).try_cast("int"))
        last = F.when(star, high).otherwise(
            F.coalesce(hit(part, PART, 2).try_cast("int"), F.when(stride.isNotNull(), high).otherwise(first))
        )
        step = F.coalesce(stride, F.lit(1))
        fits = part.rlike(PART) & (step >= 1) & (first >= low) & (last <= high) & (first <= last)
        return F.when(fits, F.sequence(first, last, step))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(field, ",", -1), values))))


def cron_plan(cron: Column) -> Column:
    """Struct of value arrays per field; null for anything but a supported five-field cron."""
    fields = F.split(F.trim(cron), r"\s+")
    arrays = [
        (cron_values(F.get(fields, F.lit(i)), *bounds)).alias(name) for i, (name, bounds) in enumerate(BOUNDS.items())
    ]
    dow = F.array_sort(F.array_distinct(F.transform(arrays[4], lambda d: d % 7)))
    plan = F.struct(
        *arrays[:4], dow.alias("dow"),
        (F.get(fields, F.lit(2)) != "*").alias("dom_restricted"),
        (F.get(fields, F.lit(4)) != "*").alias("dow_restricted"),
    )
    usable = F.size(fields) == 5
    for a in arrays:
        usable = usable & a.isNotNull()
    return F.when(usable, plan)


def fires_on_day(plan: Column, day: Column) -> Column:
    """Day part of the rule: a restricted day-of-month and day-of-week are alternatives."""
    dom = F.array_contains(plan["dom"], F.dayofmonth(day))
    dow = F.array_contains(plan["dow"], F.dayofweek(day) - 1)
    days = F.when(plan["dom_restricted"] & plan["dow_restricted"], dom | dow).otherwise(dom & dow)
    return F.array_contains(plan["month"], F.month(day)) & days


def fires_at(plan: Column, ts: Column) -> Column:
    return (
        F.array_contains(plan["minute"], F.minute(ts))
        & F.array_contains(plan["hour"], F.hour(ts))
        & fires_on_day(plan, F.to_date(ts))
    )


def bit_set(values: Column) -> Column:
    """Numbers from 0 to 62 as the bits of a long."""
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, v: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), v)))


def has_bit(bits: Column, number: Column) -> Column:
    return F.call_function("shiftright", bits, number.cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1


def plan_masks(plan: Column) -> Column:
    """A plan as bit sets: minute, hour, dom, month, dow, and whether both day fields are restricted."""
    either = (plan["dom_restricted"] & plan["dow_restricted"]).alias("either")
    return F.struct(*[bit_set(plan[n]).alias(n) for n in BOUNDS], either)


def mask_fires_on_day(masks: Column, day: Column) -> Column:
    """The rule of fires_on_day over bit sets."""
    dom, dow = has_bit(masks["dom"], F.dayofmonth(day)), has_bit(masks["dow"], F.dayofweek(day) - 1)
    return has_bit(masks["month"], F.month(day)) & F.when(masks["either"], dom | dow).otherwise(dom & dow)


def minutes_of_day(plan: Column) -> Column:
    return F.flatten(F.transform(plan["hour"], lambda h: F.transform(plan["minute"], lambda m: h * 60 + m)))


def fire_in_window(plan: Column, start: Column, end: Column) -> Column:
    """True when a fire minute t has start < t <= end (windows of at most a day)."""
    first = F.date_trunc("minute", start)
    probes = F.sequence(first, F.date_trunc("minute", end), F.expr("interval 1 minute"))
    return F.coalesce(F.exists(probes, lambda t: (t > start) & fires_at(plan, t)), F.lit(False))


def next_fire(plan: Column, after: Column) -> Column:
    """First fire minute strictly after *after*, within 366 days."""
    today = F.to_date(after)
    now = F.hour(after) * 60 + F.minute(after)
    times = minutes_of_day(plan)
    later_today = F.when(fires_on_day(plan, today), F.array_min(F.filter(times, lambda m: m > now)))
    coming = F.sequence(F.date_add(today, 1), F.date_add(today, 366), F.expr("interval 1 day"))
    next_day = F.array_min(F.filter(coming, lambda d: fires_on_day(plan, d)))
    day = F.when(later_today.isNotNull(), today).otherwise(next_day)
    minute = F.coalesce(later_today, F.array_min(times))
    at = F.timestamp_add("MINUTE", minute, day.cast("timestamp"))
    return F.when(at <= F.timestamp_add("DAY", F.lit(366), after), at)


# --- local wall time <-> stored UTC cron ------------------------------------------------

def wall(day: Column, hhmm: Column) -> Column:
    return F.to_timestamp(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), hhmm), "yyyy-MM-dd H:mm")


def to_utc(day: Column, hhmm: Column, zone: Column) -> Column:
    return F.to_utc_timestamp(wall(day, hhmm), zone)


def day_shift(day: Column, hhmm: Column, zone: Column) -> Column:
    return F.pmod(F.dayofweek(to_utc(day, hhmm, zone)) - F.dayofweek(day), F.lit(7))


def daily_to_cron(day: Column, hhmm: Column, zone: Column) -> Column:
    utc = to_utc(day, hhmm, zone)
    return F.concat_ws(" ", F.minute(utc).cast("string"), F.hour(utc).cast("string"), F.lit("* * *"))


def weekly_to_cron(day: Column, hhmm: Column, weekdays: Column, zone: Column) -> Column:
    utc = to_utc(day, hhmm, zone)
    shift = day_shift(day, hhmm, zone)
    days = F.array_sort(F.array_distinct(F.transform(weekdays, lambda w: F.pmod(w + shift, F.lit(7)))))
    return F.concat_ws(
        " ", F.minute(utc).cast("string"), F.hour(utc).cast("string"), F.lit("* *"),
        F.array_join(F.transform(days, lambda d: d.cast("string")), ","),
    )


DAILY = r"^(\d{1,2}) (\d{1,2}) \* \* \*$"
WEEKLY = r"^(\d{1,2}) (\d{1,2}) \* \* ([0-6](?:,[0-6])*)$"


def local_time(cron: Column, zone: Column, day: Column) -> Column:
    """Local HH:mm of a stored daily or weekly cron."""
    minute, hour = (hit(cron, r"^(\d{1,2}) (\d{1,2}) ", g).try_cast("int") for g in (1, 2))
    usable = (minute <= 59) & (hour <= 23)
    utc = F.timestamp_add("MINUTE", F.when(usable, hour * 60 + minute), day.cast("timestamp"))
    return F.date_format(F.from_utc_timestamp(utc, zone), "HH:mm")


def local_weekdays(cron: Column, zone: Column, day: Column) -> Column:
    shift = day_shift(day, local_time(cron, zone, day), zone)
    utc_days = F.transform(F.split(hit(cron, WEEKLY, 3), ","), lambda d: d.cast("int"))
    return F.array_sort(F.array_distinct(F.transform(utc_days, lambda d: F.pmod(d - shift, F.lit(7)))))


def frequency(cron: Column, zone: Column, day: Column) -> Column:
    c = F.trim(cron)
    weekdays = local_weekdays(c, zone, day)
    work_week = weekdays == F.array(*[F.lit(d) for d in (1, 2, 3, 4, 5)])
    return (
        F.when(c.isin(list(K.FIXED_CRONS)), "fixed")
        .when(c.rlike(DAILY) & local_time(c, zone, day).isNotNull(), "daily")
        .when(c.rlike(WEEKLY) & local_time(c, zone, day).isNotNull(), F.when(work_week, "weekdays").otherwise("weekly"))
        .otherwise("legacy")
    )


def clock_text(hhmm: Column) -> Column:
    hour = F.substring_index(hhmm, ":", 1).cast("int")
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.concat(
        twelve.cast("string"), F.lit(":"), F.substring_index(hhmm, ":", -1), F.when(hour < 12, " AM").otherwise(" PM")
    )


def schedule_text(cron: Column, run_at: Column, zone: Column, day: Column) -> Column:
    """Plain description of a schedule row."""
    c = F.trim(cron)
    kind = frequency(c, zone, day)
    at = clock_text(local_time(c, zone, day))
    names = F.array(*[F.lit(n) for n in K.WEEKDAY_NAMES])
    listed = F.array_join(F.transform(local_weekdays(c, zone, day), lambda d: F.get(names, d.cast("int"))), ", ")
    fixed = F
    for expr, text in K.FIXED_CRONS.items():
        fixed = fixed.when(c == expr, text)
    recurring = (
        F.when(kind == "fixed", fixed)
        .when(kind == "daily", F.concat(F.lit("Every day at "), at, F.lit(" (your time)")))
        .when(kind == "weekdays", F.concat(F.lit("Weekdays at "), at, F.lit(" (your time)")))
        .when(kind == "weekly", F.concat(F.lit("Every week on "), listed, F.lit(" at "), at, F.lit(" (your time)")))
        .otherwise(F.concat(F.lit("Advanced schedule (cron "), c, F.lit(", UTC)")))
    )
    local_run = F.date_format(F.from_utc_timestamp(run_at, zone), "yyyy-MM-dd HH:mm")
    return (
        F.when(run_at.isNotNull(), F.concat(F.lit("One-time run at "), local_run, F.lit(" (your time).")))
        .when(c.isNotNull(), recurring)
        .otherwise("Runs only on demand (when you click Run now).")
    )


def cron_problem(cron: Column) -> Column:
    """Null for an acceptable cron text, else what is wrong with it."""
    fields = F.split(F.trim(cron), r"\s+")
    return (
        F.when(F.trim(cron) == "", "cron expression is empty")
        .when(F.size(fields) != 5, F.format_string("cron must have 5 space-separated fields, got %d", F.size(fields)))
        .when(~F.forall(fields, lambda f: f.rlike(K.CRON_FIELD_RE)), "cron field contains invalid characters")
    )
