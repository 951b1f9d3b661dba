"""Whole pipelines: v2 run, v1 validation, diff report, alerts, report payloads, diagnostics, due runs, cards.

Each builds one plan over all products and runs of its inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from offerloom import constants as K
from offerloom.functions import money, text
from offerloom.operators import (
    alerts, anomalies, catalog, dedup, diagnostics, dimensions, display, evaluation, history, ranking, rules, schedules, verdicts,
)
from offerloom.operators.skew import column_bounds
from offerloom.schema import PLACE
from offerloom.session import durable

c = F.col
RUN = ["slug", "run_ts"]
ERRORS = ["serper_error", "ebay_error", "amazon_error"]
CHOICE_COLUMNS = ["unit_price_usd", "seller_name", "flags", "max_listings", "per_vendor_cap"]  # what outliers, ranks and caps read of an offer
GATE_COLUMNS = ["rules", "target", "allowed_countries", "allow", "block", "variant_strict", "degraded_attrs"]


def profile_knobs(profiles: DataFrame) -> DataFrame:
    """The columns of a profile that the run pipeline reads, one row per product."""
    gl = text.nonblank(c("sources.serper.gl"))
    return rules.profile_rules(profiles).select(
        "slug", "rules", c("target"), F.when(gl.isNotNull(), F.array(F.upper(gl))).otherwise(F.array().cast("array<string>")).alias("allowed_countries"),
        c("vendor_allowlist").alias("allow"), c("vendor_blocklist").alias("block"), F.filter(c("match.aliases"), lambda a: F.trim(a) != "").alias("aliases"),
        c("match.variant_strict").alias("variant_strict"), F.coalesce("display.max_listings", F.lit(K.MAX_LISTINGS)).alias("max_listings"),
        F.coalesce("display.per_vendor_cap", F.lit(K.PER_VENDOR_CAP)).alias("per_vendor_cap"), c("filters.min_quantity").isNotNull().alias("degraded_attrs"),
    )


def gated_offers(offers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every offer with the profile of its product: ship-from flag, vendor lists, hard rules and alias gate tested (`_pass`).

    An offer that fails, or whose product has no profile (`_knob` null), keeps its run, place and URL only. One join by
    product brings the profile's rules to its offers; the gates are row-local. A product with several profiles has its
    offers once for each; `_counted` marks one of them.
    """
    one = Window.partitionBy("slug").orderBy("_knob")
    numbered = profile_knobs(profiles).withColumn("_knob", F.monotonically_increasing_id())
    # Written first, so that its size is known: a few products are broadcast and the offers are not shuffled for them.
    knobs = durable(numbered.withColumn("_counted", F.row_number().over(one) == 1))
    gated = rules.ship_from_gate(offers.join(knobs, "slug", "left"), c("allowed_countries"))
    passes = rules.vendor_passes(c("allow"), c("block")) & rules.first_reject_from(c("rules"), c("target")).isNull() & rules.alias_passes(c("aliases"), c("variant_strict"))
    tested = gated.withColumn("_pass", F.coalesce(c("_knob").isNotNull() & passes, F.lit(False))).withColumn("_counted", F.coalesce("_counted", F.lit(True)))
    # The rule lists have done their work: what follows carries only the display limits and the aliases.
    always = [*RUN, *PLACE, "url", "_knob", "_counted", "_pass"]
    return tested.select(*always, *[F.when(c("_pass"), c(n)).alias(n) for n in gated.columns if n not in (*GATE_COLUMNS, *always)])


def first_passing(gated: DataFrame, columns: Sequence[str]) -> DataFrame:
    """*columns* of the offers that pass, the first of each URL of a run. One that fails still keeps later ones of its URL out."""
    kept = [n for n in columns if n not in (*RUN, *PLACE)]
    thin = gated.where(c("_knob").isNotNull()).select(*RUN, "_knob", *PLACE, F.trim("url").alias("_url"), F.when(c("_pass"), F.struct(*kept)).alias("_offer"))
    first = dedup.first_seen(thin, [*RUN, "_knob"], c("_url"), [c(n) for n in PLACE]).where(c("_offer").isNotNull())
    return first.select(*[c(n) if n in (*RUN, *PLACE) else c(f"_offer.{n}") for n in columns])


def candidate_columns(gated: DataFrame, offers: DataFrame) -> list[str]:
    return [*offers.columns, *[n for n in gated.columns if n not in offers.columns and not n.startswith("_")]]


def candidates(offers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Deterministic stage: distinct offers, ship-from flag, vendor lists, hard rules, alias gate.

    The gates are tested before the first offer of each URL is taken: an offer that fails goes there as a key and a
    place only.
    """
    gated = gated_offers(offers, profiles)
    return first_passing(gated, candidate_columns(gated, offers))


def recall_counts(offers: DataFrame) -> DataFrame:
    """Offers of a run counted as recalled: distinct URLs and every offer without URL. Aggregates only."""
    url = F.trim(c("url"))
    per_url = offers.groupBy(*RUN, F.when(url != "", url).alias("_url")).agg(F.count(F.lit(1)).alias("_n"))
    return per_url.groupBy(*RUN).agg(F.sum(F.when(c("_url").isNull(), c("_n")).otherwise(1)).alias("recall_count"))


def run_offers(
    offers: DataFrame, profiles: DataFrame, judges: Sequence[verdicts.Judge] | None = verdicts.DEFAULT_CHAIN,
    errors: DataFrame | None = None, replies: verdicts.ReplyStore | None = None,
) -> dict[str, DataFrame]:
    """The v2 run for all products at once.

    Returns survivors, displayed, overflow, columns, funnel (with outcome), log, calls. With
    ``judges=None`` every candidate survives and nothing leaves the JVM. With *replies*, a run that is started again
    uses the answers of its earlier attempts.
    """
    if judges is None:
        # Every offer is written once, at its place. Choosing needs few columns of it: only these are shuffled, and the
        # chosen rows are looked up by their number.
        gated = gated_offers(offers, profiles)
        whole = candidate_columns(gated, offers)
        gated = durable(gated.withColumn("_row", F.monotonically_increasing_id()))
        rows = gated.where("_pass").select(*whole, "_row")
        kept, log, calls, failed = durable(first_passing(gated, [*RUN, *PLACE, *CHOICE_COLUMNS, "_row"])), None, None, None
        recalled = gated.where("_counted")
    else:
        # Written once to the shared checkpoint folder: outlier statistics, ranking, counts and the history sink all read it.
        pool = durable(candidates(offers, profiles))
        answered, failed_runs, asked = verdicts.run_chain(pool, judges, store=replies)
        judged = verdicts.verdict_rows(answered).join(failed_runs.select(*RUN), RUN, "left_anti")
        kept = durable(judged.where("pass").drop("index", "pass", "reason"))
        log = verdicts.log_rows(judged).unionByName(verdicts.failure_log(failed_runs))
        calls, failed = verdicts.usage(asked), failed_runs.select(*RUN).withColumn("filter_error", F.lit(True))
        recalled = offers
    survivors = anomalies.flag_price_anomalies(kept)
    most, cap = column_bounds(profiles, {"display.max_listings": K.MAX_LISTINGS, "display.per_vendor_cap": K.PER_VENDOR_CAP})
    displayed = durable(ranking.select_for_display(survivors, most, cap))
    overflow = ranking.vendor_overflow(survivors, displayed, cap)
    if judges is None:
        chosen = [n for n in displayed.columns if n not in kept.columns]
        displayed = durable(rows.drop("flags").join(displayed.select("_row", "flags", *chosen), "_row").select(*whole, *chosen))
        survivors = rows.drop("flags").join(survivors.select("_row", "flags"), "_row").select(*whole)
    count = lambda df, name: df.groupBy(*RUN).agg(F.count(F.lit(1)).alias(name))
    funnel = recall_counts(recalled)  # one row per run that recalled anything
    if errors is not None:
        funnel = funnel.join(errors.select(*RUN), RUN, "full")
    for frame, name in ((kept, "survivor_count"), (displayed, "displayed_count")):
        funnel = funnel.join(count(frame, name), RUN, "left")
    funnel = funnel.fillna(0, ["recall_count", "survivor_count", "displayed_count"])
    funnel = funnel.join(errors.select(*RUN, *ERRORS), RUN, "left") if errors is not None else funnel.select("*", *[F.lit(False).alias(e) for e in ERRORS])
    funnel = funnel.join(failed, RUN, "left") if failed is not None else funnel.withColumn("filter_error", F.lit(False))
    funnel = funnel.join(profiles.select("slug", c("filters.min_quantity").isNotNull().alias("degraded_attrs")), "slug", "left")
    return {
        "survivors": survivors, "displayed": displayed, "overflow": overflow, "columns": display.resolve_columns(displayed, profiles),
        "funnel": funnel.withColumn("outcome", diagnostics.run_outcome()), "log": log, "calls": calls,
    }


def recall_and_run(recall: Callable[[DataFrame], DataFrame], profiles: DataFrame, **options) -> dict[str, DataFrame]:
    """The v2 run with an injected recall: a callable from profiles to an offers DataFrame."""
    return run_offers(recall(profiles), profiles, **options)


def validate_offers(
    offers: DataFrame, rule_list: Sequence[dict], flag_list: Sequence[dict] | Column, target: Column | None = None,
    known_parts: DataFrame | None = None, brand_candidates: Sequence[str] = (), judges: Sequence[verdicts.Judge] | None = None,
    replies: verdicts.ReplyStore | None = None,
) -> tuple[DataFrame, DataFrame]:
    """v1 validation: (passed offers, verdict log). Rejects, judge, brand, known part, flags, total, unknown stock.

    *flag_list* may be a column of flag rules, joined to the offers by product, to flag many products in one job.
    """
    target = rules.target_literal() if target is None else target
    reason = rules.first_reject(rule_list, target)
    rejected = rules.reject_log(offers, reason)
    kept = offers.where(reason.isNull())
    log = rejected
    if judges is not None:
        answered, failed, _ = verdicts.run_chain(kept, judges, store=replies)
        judged = verdicts.verdict_rows(answered).join(failed.select(*RUN), RUN, "left_anti")
        log = rejected.unionByName(verdicts.log_rows(judged.withColumn("index", c("pos")))).unionByName(verdicts.failure_log(failed))
        kept = judged.where("pass").drop("index", "pass", "reason")
    if brand_candidates:
        kept = kept.withColumn("brand", text.brand_from_title(c("brand"), c("title"), F.array(*[F.lit(b) for b in brand_candidates])))
    if known_parts is not None:
        kept = dimensions.annotate_known_parts(kept, known_parts)
    raised = rules.raised_flags_from(flag_list) if isinstance(flag_list, Column) else rules.raised_flags(flag_list)
    flagged = rules.with_flags(kept, raised)
    total = money.total_for_target(
        target, rules.capacity(), c("is_kit"), c("kit_module_count"), c("kit_price_usd"), c("unit_price_usd"), c("quantity_available")
    )
    priced = flagged.withColumn("total_for_target_usd", total)
    return priced.withColumn("flags", rules.add_flag("unknown_quantity", rules.unknown_quantity(target))), log


def diff_latest(stored: DataFrame, newest_only: bool = True, details: Sequence[str] = tuple(history.DETAILS)) -> tuple[DataFrame, DataFrame]:
    """(change rows, headline rows) between each product's snapshot dates; by default the two newest only.

    *details*: what the change rows tell of an offer besides its URL and prices. It goes through every shuffle and into
    the written table, so callers name what they read.

    Dates come from a scan of two columns; rows of other dates are left out before duplicates are removed. The
    daily rows carry the number of their step and are written with the columns a diff reads; changes, counts and
    minima are aggregates over them. The steps (one row per product and date) are written before, so that their size
    is known to the joins.
    """
    dated = stored.withColumn("snapshot_date", F.to_date("fetched_at")).select("slug", "snapshot_date", "fetched_at", *PLACE, *history.DIFF_COLUMNS, *details)
    steps = history.numbered_steps(history.snapshot_dates(stored), "snapshot_date")
    if newest_only:
        steps = history.newest_pair(steps, "snapshot_date")
    steps = durable(steps)
    daily = durable(history.latest_per_day(dated.join(steps, ["slug", "snapshot_date"])).drop("fetched_at", *PLACE, "previous_snapshot_date"))
    diff = history.diff_steps(daily, steps=steps)
    return diff, history.material_change(daily, diff, steps=steps)


def evaluate_alerts(offers: DataFrame, alert_rules: DataFrame, state: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    return alerts.evaluate(offers, alert_rules, state, **options)


def build_reports(run: dict[str, DataFrame], profiles: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """v2 report payload per run: slug, run_ts, snapshot_date, payload struct.

    The document nests the displayed offers only (at most max_listings). Every survivor with its rank
    is the table `all_listings(run)`, one row each: a run may have more survivors than one row can hold.
    """
    shown = _listings(run["displayed"])
    overflow = run["overflow"].groupBy(*RUN).agg(F.map_from_entries(F.collect_list(F.struct("vendor", "held_back"))).alias("overflow"))
    out = run["funnel"].join(profiles.select("slug", "display_name", "product_type"), "slug")
    for frame in (shown, overflow, run["columns"]):
        out = out.join(frame, RUN, "left")
    cost_type = f"struct<total_usd:double,any_unpriced:boolean,calls:bigint,steps:{dimensions.STEPS_TYPE}>"
    if calls is not None:
        priced = dimensions.price_calls(calls)
        out = out.join(dimensions.run_cost(priced).select(*RUN, F.struct("total_usd", "any_unpriced", "calls", "steps").alias("run_cost")), RUN, "left")
    else:
        out = out.withColumn("run_cost", F.lit(None).cast(cost_type))
    payload = F.struct(
        F.lit(2).alias("schema_version"), c("slug"), c("display_name"), c("product_type"), F.to_date("run_ts").cast("string").alias("snapshot_date"),
        F.date_format("run_ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"), c("columns"), c("listings"), c("overflow"),
        F.lit(0).alias("hidden_anomalies"), c("recall_count"), c("survivor_count"), c("displayed_count"), c("outcome"), c("run_cost"),
    )
    return out.select(*RUN, F.to_date("run_ts").alias("snapshot_date"), payload.alias("payload"))


def _listings(displayed: DataFrame) -> DataFrame:
    rows = displayed.select(*RUN, "rank", display.listing_v2().alias("listing"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.to_json("listing").alias("doc"))))
    return rows.groupBy(*RUN).agg(F.transform(ordered, lambda x: x["doc"]).alias("listings"))


def all_listings(run: dict[str, DataFrame]) -> DataFrame:
    """Every survivor with its rank in the run."""
    return ranking.rank_all(run["survivors"]).withColumn("listing", display.listing_v2())


def report_markdown(reports: DataFrame, displayed: DataFrame) -> DataFrame:
    """Readable text per run from the payload and its displayed rows (bounded by max_listings)."""
    seller, cond = F.nullif("seller_name", F.lit("")), F.coalesce(F.nullif("condition", F.lit("")), display.attr("condition"))
    price = F.coalesce(money.grouped_money(F.nullif("unit_price_usd", F.lit(0.0))), F.lit("—"))
    warn = F.when(F.array_contains("flags", K.FLAG_LOW), "🚨 SUSPICIOUS: ").otherwise("")
    clipped = F.substring(text.escape_pipes(c("title")), 1, 80)
    title = F.concat(warn, F.when(display.filled(c("url")), F.concat(F.lit("["), clipped, F.lit("]("), c("url"), F.lit(")"))).otherwise(clipped))
    rating = F.coalesce(F.concat(c("seller_rating_pct").cast("string"), F.lit("%")), F.lit("—"))

    def cell(name: Column) -> Column:
        return (
            F.when(name.isin("price", "price_usd"), price).when(name == "title", title)
            .when(name.isin("seller", "seller_name"), F.coalesce(text.escape_pipes(seller), F.lit("—")))
            .when(name == "condition", F.coalesce(cond, F.lit("—"))).when(name.isin("seller_rating", "seller_rating_pct"), rating)
            .otherwise(F.coalesce(text.escape_pipes(F.nullif(F.try_element_at("attrs", name), F.lit(""))), F.lit("—")))
        )

    header = lambda n: (
        F.when(n.isin("price", "price_usd"), "Price").when(n == "title", "Title").when(n.isin("seller", "seller_name"), "Vendor")
        .when(n == "condition", "Condition").when(n.isin("seller_rating", "seller_rating_pct"), "Rating")
        .otherwise(F.initcap(F.replace(n, F.lit("_"), F.lit(" "))))
    )
    wanted = reports.select(*RUN, c("payload.columns").alias("columns"))
    lines = displayed.join(wanted, RUN).select(
        *RUN, "rank", F.concat(F.lit("| "), F.concat_ws(" | ", c("rank").cast("string"), F.transform("columns", cell)), F.lit(" |")).alias("line")
    ).groupBy(*RUN).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("body"))
    p = lambda n: c(f"payload.{n}")
    outcome = F.when(p("outcome.class") != "ok", F.concat(F.lit("> [!NOTE]\n> "), p("outcome.message"), F.lit("\n\n"))).otherwise("")
    notes = F.when(F.size(p("outcome.notes")) > 0, F.concat(F.array_join(F.transform(p("outcome.notes"), lambda n: F.concat(F.lit("_"), n["message"], F.lit("_"))), "\n"), F.lit("\n\n"))).otherwise("")
    shown = F.format_string("**%d shown** (of %d matched, %d found). Cheapest first.\n\n", p("displayed_count"), p("survivor_count"), p("recall_count"))
    n_cols = F.size(p("columns"))
    head = F.concat(F.lit("| # | "), F.array_join(F.transform(p("columns"), header), " | "), F.lit(" |\n|---|"), F.repeat(F.lit("---|"), n_cols), F.lit("\n"))
    more = F.array_join(F.transform(F.array_sort(F.map_entries(p("overflow"))), lambda e: F.concat(F.lit("_"), e["value"].cast("string"), F.lit(" more from "), e["key"], F.lit("._"))), "\n")
    tail = F.when(F.coalesce(F.size(p("overflow")), F.lit(0)) > 0, F.concat(F.lit("\n\n"), more)).otherwise("")
    body = F.when(c("body").isNull(), "_No listings to show._").otherwise(F.concat(shown, head, c("body"), tail))
    top = F.concat(F.lit("# "), p("display_name"), F.lit(" — "), p("snapshot_date"), F.lit("\n\n"))
    return reports.join(lines, RUN, "left").select(*RUN, F.concat(top, outcome, notes, body).alias("markdown"))


def source_report(stats: DataFrame, passed: DataFrame, log: DataFrame) -> DataFrame:
    """Source rows with passed counts, dominant rejection and outcome.

    stats: slug, run_ts, source, match_host, match_url, display_source, fetched, error, skip_reason, diagnostics, known_blocker.
    """
    counted = diagnostics.attribute_passed(stats, diagnostics.passed_counts(passed))
    attributed = diagnostics.attribute_rejections(counted, log)
    return attributed.withColumn("dominant_rejection", diagnostics.dominant_rejection()).withColumn("outcome", diagnostics.source_outcome())


def evaluate_judges(verdict_rows: DataFrame, gold: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per (slug, model): determinism over valid trials, and scores of the last valid trial."""
    trials = evaluation.valid_trials(verdict_rows, sizes)
    last = trials.groupBy("slug", "model").agg(F.max("trial").alias("trial"))
    predicted = verdict_rows.join(last, ["slug", "model", "trial"], "left_semi")
    scores = evaluation.gold_scores(predicted, gold, ["slug", "model"])
    return scores.join(evaluation.determinism(verdict_rows, trials), ["slug", "model"])


def bench_summary(results: DataFrame) -> DataFrame:
    return evaluation.model_rollup(evaluation.fixture_results(results)).orderBy(*evaluation.summary_order())


def due_runs(schedule_rows: DataFrame, ticks: DataFrame, fired_once: DataFrame | None = None) -> DataFrame:
    return schedules.due_runs(schedule_rows, ticks, fired_once)


def product_cards(reports: DataFrame, runs: DataFrame, profiles: DataFrame, active: DataFrame, tick_started: DataFrame) -> DataFrame:
    """Catalogue cards. profiles: slug, document; reports: flat card rows."""
    slugs = catalog.products(reports.select("slug"), profiles.select("slug"))
    scheduled = profiles.select("slug", (text.schedule_scalar(c("document"), "cron").isNotNull() | text.schedule_scalar(c("document"), "run_at").isNotNull()).alias("has_schedule"))
    flags = slugs.join(scheduled, "slug", "left").fillna(False, ["has_schedule"])
    return catalog.cards(slugs, reports, runs, profiles, catalog.product_status(flags, active, tick_started))


def synthesis_payload(ranked: DataFrame, diff: DataFrame, names: DataFrame) -> DataFrame:
    """Report input per (slug, run): the product, top ranked rows and the sizes of the change sections, one document each.

    *names*: slug, display_name and, where known, target and synthesis_hints; they nest as `product`, absent ones
    as null. A run without a diff has null counts. Ranked rows are bounded by the report cap and nest; change rows
    are not, so they stay rows (`change_rows`).
    """
    key = ["slug", "run_ts"]
    top = ranked.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "url", "title", "unit_price_usd", "total_for_target_usd", "flags"))).alias("listings"))
    sections = diff.groupBy(*key).agg(
        F.count_if(c("change_type") == "new").alias("new_count"), F.count_if(c("change_type") == "dropped").alias("dropped_count"),
        F.count_if(c("change_type") == "changed").alias("changed_count"),
    )
    held = [c(n) if n in names.columns else F.lit(None).cast("string").alias(n) for n in ("target", "synthesis_hints")]
    product = names.select("slug", "display_name", F.struct("slug", "display_name", *held).alias("product"))
    return top.join(sections, key, "left").join(product, "slug", "left")


def change_rows(diff: DataFrame) -> DataFrame:
    """The diff sections of the report input, one row per change: its price, for changed ones both prices and
    the percentage rounded to 4 places, and its title where the diff has it. Dropped rows state the last price seen."""
    kind = c("change_type")
    title = [n for n in ("title",) if n in diff.columns]
    return diff.select(
        "slug", "snapshot_date", kind.alias("section"), "url", *title, F.when(kind != "new", c("old_price_usd")).alias("old_price_usd"),
        F.when(kind != "dropped", c("new_price_usd")).alias("new_price_usd"), F.round(F.when(kind == "changed", c("pct_change")), 4).alias("pct_change"),
    )
