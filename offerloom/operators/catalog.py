"""Product catalogue and card metrics over stored runs, reports, profiles and the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from offerloom import constants as K
from offerloom.functions import money, text

c = F.col
GRAM = 6  # characters of a search key


def products(report_slugs: DataFrame, profile_slugs: DataFrame) -> DataFrame:
    return report_slugs.select("slug").union(profile_slugs.select("slug")).distinct().where(c("slug") != "_template")


def run_files(paths: DataFrame) -> DataFrame:
    """(slug, path) of stored files -> (slug, run_ts); names that are no run stamp are ignored."""
    name = F.substring_index(F.replace("path", F.lit("\\"), F.lit("/")), "/", -1)
    stamp = text.hit(name, K.RUN_FILE_RE, 1)
    return paths.select("slug", "path", F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH-mm-ss'Z'")).alias("run_ts")).where(c("run_ts").isNotNull())


def later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def run_duration(generated_at: Column, started_at: Column) -> Column:
    """Seconds from run start to report, kept only when positive and under 30 minutes."""
    d = F.unix_micros(generated_at.cast("timestamp")) / 1e6 - F.unix_micros(started_at.cast("timestamp")) / 1e6
    return F.when((d > 0) & (d < K.MAX_RUN_SECONDS), d)


def match_runs(instants: DataFrame, log: DataFrame, seconds: int = K.SAME_RUN_SECONDS) -> DataFrame:
    """Log runs within *seconds* of a run instant of the same product: an interval join.

    Instants are cut into buckets of the tolerance; a log run meets its own and both neighbour buckets,
    so this is an equi-join with a distance check. instants: slug, run_ts; log: slug, completed_at, ...
    """
    bucket = lambda ts: F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds)
    near = log.withColumn("_b", F.explode(F.array(*[bucket(c("completed_at")) + d for d in (-1, 0, 1)])))
    here = instants.withColumn("_b", bucket(c("run_ts")))
    gap = F.abs(F.unix_micros(c("run_ts").cast("timestamp")) - F.unix_micros(c("completed_at").cast("timestamp")))
    return here.join(near, ["slug", "_b"]).where(gap <= seconds * 1_000_000).drop("_b")


def same_last_run(instants: DataFrame, completed: DataFrame, seconds: int = K.SAME_RUN_SECONDS) -> DataFrame:
    """The latest run instant of every product with its last completed log run, if the two are the same run.

    instants: slug, run_ts; completed: slug, completed_at. One row per product on either side; `same` tells
    whether they lie within *seconds*.
    """
    latest = instants.groupBy("slug").agg(F.max("run_ts").alias("run_ts"))
    last = completed.groupBy("slug").agg(F.max("completed_at").alias("completed_at"))
    gap = F.abs(F.unix_micros(c("run_ts").cast("timestamp")) - F.unix_micros(c("completed_at").cast("timestamp")))
    return latest.join(last, "slug", "left").withColumn("same", F.coalesce(gap <= seconds * 1_000_000, F.lit(False)))


def named_runs(slugs: DataFrame, log: DataFrame) -> DataFrame:
    """Run-log rows whose title or name contains a product slug.

    An inverted index over the distinct texts of the log. A slug is keyed by the gram of GRAM characters that the
    fewest slugs have, a text by its distinct grams; an equi-join on grams gives the candidates and a containment
    check decides. Shorter slugs are their own key; texts have grams of just the short lengths that occur. Only
    texts travel through the join: the rows of the log meet them at the end, so runs that repeat a title are
    searched once.
    """
    def grams(text: Column, size: Column) -> Column:
        n = F.length(text)
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(text, i, size))).otherwise(F.array().cast("array<string>"))

    names = slugs.select("slug").where(c("slug") != "").distinct()
    long = names.where(F.length("slug") >= GRAM).select("slug", F.explode(F.array_distinct(grams(c("slug"), F.lit(GRAM)))).alias("gram"))
    shared = long.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = long.join(shared, "gram").groupBy("slug").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    keyed = rarest.unionByName(names.where(F.length("slug") < GRAM).select("slug", c("slug").alias("gram")))
    sizes = names.agg(F.array_distinct(F.concat(F.array(F.lit(GRAM)), F.collect_set(F.when(F.length("slug") < GRAM, F.length("slug"))))).alias("_sizes"))
    # A row with nulls stays apart from one with empty texts, as both find nothing.
    both = F.concat(F.coalesce("display_title", F.lit("")), F.lit("\n"), F.coalesce("name", F.lit("")))
    keyed_log = log.withColumn("_text", both)
    texts = keyed_log.select("_text").distinct().join(F.broadcast(sizes))  # one row of at most GRAM numbers
    keys = F.array_distinct(F.flatten(F.transform("_sizes", lambda k: F.flatten(F.transform(F.split("_text", "\n"), lambda t: grams(t, k))))))
    met = texts.select("_text", F.explode(keys).alias("gram")).join(keyed, "gram").select("_text", "slug")
    found = met.where(F.exists(F.split("_text", "\n"), lambda t: t.contains(c("slug")))).distinct()
    return keyed_log.join(found, "_text").select("slug", *log.columns)


def newest_run() -> Column:
    return F.max_by(F.struct("run_id", "status", "conclusion", "started_at", "updated_at"), F.struct("started_at", "run_id"))


def run_state(status: Column) -> Column:
    return F.when(status.isin("completed", "queued", "in_progress"), status).otherwise("pending")


def latest_named_run(named: DataFrame, slugs: DataFrame | None = None, log: DataFrame | None = None) -> DataFrame:
    """Newest run per product with its state; `completed_at` only for completed runs.

    With *slugs* and *log*, a product that no run names gets the newest run of the whole log.
    """
    best = named.groupBy("slug").agg(newest_run().alias("r"))
    if slugs is not None and log is not None:
        newest = log.agg(newest_run().alias("newest"))  # one row
        best = slugs.select("slug").distinct().join(best, "slug", "left").join(F.broadcast(newest)).select("slug", F.coalesce("r", "newest").alias("r"))
        best = best.where(c("r").isNotNull())
    state = run_state(c("r.status"))
    return best.select(
        "slug", c("r.run_id").alias("run_id"), state.alias("state"), c("r.conclusion").alias("conclusion"), c("r.started_at").alias("started_at"),
        F.when(state == "completed", c("r.updated_at")).alias("completed_at"),
    )


def last_completed_run(named: DataFrame) -> DataFrame:
    done = named.where((c("status") == "completed") & c("started_at").isNotNull())
    best = done.groupBy("slug").agg(F.max_by(F.struct("started_at", "updated_at", "conclusion"), F.struct("started_at", "run_id")).alias("r"))
    seconds = F.greatest(F.lit(0), F.unix_seconds(c("r.updated_at").cast("timestamp")) - F.unix_seconds(c("r.started_at").cast("timestamp")))
    return best.select("slug", c("r.updated_at").alias("completed_at"), seconds.alias("duration_s"), c("r.conclusion").alias("conclusion"))


def product_status(slugs: DataFrame, active: DataFrame, tick_started: DataFrame) -> DataFrame:
    """running / waiting / idle per product. slugs: slug, has_schedule; active: on-demand runs not completed; tick_started: one row."""
    mine = named_runs(slugs.select("slug"), active).groupBy("slug").agg(
        F.max_by("started_at", F.struct("started_at", "run_id")).alias("mine_started"), F.lit(True).alias("mine")
    )
    tick = tick_started.agg(F.max("started_at").alias("tick_started"), (F.count(F.lit(1)) > 0).alias("tick_active"))
    out = slugs.join(mine, "slug", "left").join(F.broadcast(tick))  # one aggregated row
    by_tick = c("tick_active") & c("has_schedule")
    return out.select(
        "slug",
        F.when(c("mine"), "running").when(by_tick, "running").when(c("has_schedule"), "waiting").otherwise("idle").alias("status"),
        F.when(c("mine"), c("mine_started")).when(by_tick, c("tick_started")).alias("running_since"),
    )


def latest_reports(reports: DataFrame) -> DataFrame:
    """The newest report row per product."""
    names = [n for n in reports.columns if n != "slug"]
    return reports.groupBy("slug").agg(F.max_by(F.struct(*names), "snapshot_date").alias("r")).select("slug", "r.*")


def filter_model_label(model: Column) -> Column:
    return F.when(model.rlike("(?i)haiku"), "Haiku 4.5").otherwise(model)


def cards(slugs: DataFrame, reports: DataFrame, runs: DataFrame, profiles: DataFrame, status: DataFrame) -> DataFrame:
    """One card per product. reports: flat report rows; runs: slug, run_ts; profiles: slug, document."""
    last = runs.groupBy("slug").agg(F.max("run_ts").alias("last_run"))
    out = (
        slugs.join(latest_reports(reports), "slug", "left").join(last, "slug", "left")
        .join(profiles.select("slug", "document"), "slug", "left").join(status, "slug", "left")
    )
    title = F.coalesce(F.nullif("display_name", F.lit("")), text.profile_scalar(c("document"), "display_name"), text.pretty_slug(c("slug")))
    duration = run_duration(c("generated_at"), c("last_run"))
    return out.select(
        "slug", title.alias("title"), "snapshot_date", later(c("last_run"), c("generated_at")).alias("last_run"), "status", "running_since",
        money.grouped_money(c("cheapest_usd")).alias("price_label"), "listing_count", duration.alias("duration_s"),
        money.duration_text(duration).alias("duration_label"), money.card_cost_text(c("cost_usd")).alias("cost_label"),
        filter_model_label(c("filter_model")).alias("filter_model"),
    )
