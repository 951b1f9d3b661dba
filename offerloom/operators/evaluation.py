"""Judge evaluation against gold labels, report quality criteria, benchmark roll-ups, recall quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from offerloom import constants as K
from offerloom.operators.skew import counted_ranks
from offerloom.functions import text

c = F.col

# --- judges against gold ------------------------------------------------------------------


def valid_trials(verdicts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Trials (slug, model, trial) whose verdicts cover at least 80 % of the offers of the set."""
    seen = verdicts.groupBy("slug", "model", "trial").agg(F.count_distinct("index").alias("seen"))
    return seen.join(sizes, "slug").where(c("seen") >= c("n") * K.TRIAL_COVERAGE).select("slug", "model", "trial", "n")


def gold_scores(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of the passed set, 0 where undefined. predicted: keys + index + pass; gold: slug + index + gold_pass."""
    paired = predicted.join(gold, ["slug", "index"], "left")
    hits = paired.groupBy(*keys).agg(
        F.count_if(c("pass") & F.coalesce("gold_pass", F.lit(False))).alias("tp"),
        F.count_if(c("pass") & ~F.coalesce("gold_pass", F.lit(False))).alias("fp"),
    )
    wanted = gold.groupBy("slug").agg(F.count_if("gold_pass").alias("positives"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    scored = hits.join(wanted, "slug").withColumn("fn", c("positives") - c("tp")).drop("positives")
    scored = scored.withColumn("p", ratio(c("tp"), c("tp") + c("fp"))).withColumn("r", ratio(c("tp"), c("tp") + c("fn")))
    return scored.withColumn("f1", ratio(2 * c("p") * c("r"), c("p") + c("r")))


def determinism(verdicts: DataFrame, trials: DataFrame) -> DataFrame:
    """Mean pairwise Jaccard of the reject sets of a model's trials, 1 with fewer than two trials.

    Sets stay rows: |A n B| is a join count per (trial, trial, index), |A u B| follows from the sizes.
    """
    key = ["slug", "model"]
    rejects = verdicts.join(trials, [*key, "trial"], "left_semi").where(~c("pass")).select(*key, "trial", "index").distinct()
    sizes = trials.select(*key, "trial").join(rejects.groupBy(*key, "trial").agg(F.count(F.lit(1)).alias("size")), [*key, "trial"], "left").fillna(0, ["size"])
    other = lambda df, n: df.select(*key, c("trial").alias("trial_b"), *n)
    pairs = sizes.join(other(sizes, [c("size").alias("size_b")]), key).where(c("trial") < c("trial_b"))
    # Per rejected offer the trials are few, so the pair count stays proportional to the verdicts.
    common = (
        rejects.join(other(rejects, [c("index")]), [*key, "index"]).where(c("trial") < c("trial_b"))
        .groupBy(*key, "trial", "trial_b").agg(F.count(F.lit(1)).alias("both"))
    )
    union = c("size") + c("size_b") - F.coalesce("both", F.lit(0))
    jaccard = F.when(union == 0, 1.0).otherwise(F.coalesce("both", F.lit(0)) / union)
    scored = pairs.join(common, [*key, "trial", "trial_b"], "left").groupBy(*key).agg(F.avg(jaccard).alias("determinism"))
    return trials.select(*key).distinct().join(scored, key, "left").fillna(1.0, ["determinism"])


def score_matrix(scores: DataFrame, slugs: list[str] | None = None) -> DataFrame:
    """Models down, products across."""
    grouped = scores.groupBy("model")
    return (grouped.pivot("slug", slugs) if slugs else grouped.pivot("slug")).agg(F.first("f1"))


# --- report criteria ------------------------------------------------------------------------


def fabricated_numbers(reports: DataFrame, payloads: DataFrame) -> DataFrame:
    """Numbers of a report text that its payload does not explain.

    reports: report_id, text; payloads: report_id, text, n_listings. Allowed are payload numbers, ranks up
    to max(20, n + 5), 5 / 100 / 200, payload numbers as percentages, and parts of payload numbers.
    Exact matches leave first by an anti join. Parts are found by an equi-join on the substrings of the
    payload numbers, which are short texts.
    """
    numbers = lambda df: df.select("report_id", F.explode(text.numbers_in(c("text"))).alias("number"))
    limits = payloads.groupBy("report_id").agg(F.greatest(F.lit(20), F.max("n_listings") + 5).alias("rank_max"))
    known = numbers(payloads).distinct()
    as_percent = text.plain_number(F.format_string("%.6f", c("number").try_cast("double") * 100))
    allowed = known.unionByName(known.select("report_id", as_percent.alias("number")))
    open_numbers = (
        numbers(reports).join(allowed, ["report_id", "number"], "left_anti").join(limits, "report_id", "left").fillna(20, ["rank_max"])
        .where(~c("number").isin("5", "100", "200"))
        .where(~(c("number").rlike("^(0|[1-9][0-9]*)$") & F.coalesce(c("number").try_cast("bigint") <= c("rank_max"), F.lit(False))))
        .select("report_id", "number")
    )
    n = F.length("number")
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring("number", i, k))))
    parts = known.where(n > 0).select("report_id", F.explode(F.array_distinct(cuts)).alias("number"))
    return open_numbers.join(parts, ["report_id", "number"], "left_anti")


def no_fabrication(reports, payloads, listings):
    bad = fabricated_numbers(reports, payloads).groupBy("report_id").agg(F.count(F.lit(1)).alias("bad"))
    out = reports.select("report_id").join(bad, "report_id", "left")
    return out.select("report_id", c("bad").isNull().alias("passed"), F.concat(F.coalesce("bad", F.lit(0)).cast("string"), F.lit(" fabricated numbers")).alias("detail"))


def all_rows_present(reports, payloads, listings):
    joined = listings.join(reports, "report_id").withColumn("_in", c("text").contains(c("url")))
    agg = joined.groupBy("report_id").agg(F.count_if(~c("_in")).alias("missing"), F.count(F.lit(1)).alias("n"))
    return agg.select("report_id", (c("missing") == 0).alias("passed"), F.format_string("%d of %d URLs missing", "missing", "n").alias("detail"))


def table_rows_of(reports: DataFrame) -> DataFrame:
    return reports.select("report_id", F.explode(text.table_rows(c("text"))).alias("r")).select(
        "report_id", "r.pos", F.array_join("r.cells", " ").alias("cells")
    )


def match_rows(reports: DataFrame, listings: DataFrame) -> DataFrame:
    """Table rows with the first payload listing whose URL they contain (null when none)."""
    rows = table_rows_of(reports)
    pairs = rows.join(listings.select("report_id", "listing_pos", "url", "total_for_target_usd"), "report_id").where(c("cells").contains(c("url")))
    first = pairs.groupBy("report_id", "pos").agg(F.min_by(F.struct("url", "total_for_target_usd"), "listing_pos").alias("listing"))
    return rows.join(first, ["report_id", "pos"], "left")


def rows_in_order(totals: DataFrame, key: str, pos: str, total: str) -> DataFrame:
    """Whether totals never fall along *pos* (null counts as infinite)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(pos)
    value = F.coalesce(c(total), F.lit(float("inf")))
    steps = totals.withColumn("_v", value).withColumn("_before", F.lag("_v").over(w))
    return steps.groupBy(key).agg(
        F.bool_and(F.coalesce(c("_before") <= c("_v"), F.lit(True))).alias("in_order"), F.count(F.lit(1)).alias("rows")
    )


def sort_order(reports, payloads, listings):
    matched = match_rows(reports, listings).withColumn("total", c("listing.total_for_target_usd"))
    order = rows_in_order(matched, "report_id", "pos", "total")
    unmatched = matched.groupBy("report_id").agg(F.count_if(c("listing").isNull()).alias("loose"))
    out = reports.select("report_id").join(order, "report_id", "left").join(unmatched, "report_id", "left")
    ok = F.coalesce(c("in_order") & (c("loose") == 0), F.lit(False))
    detail = F.when(c("rows").isNull(), "no table rows found").when(c("loose") > 0, "row not tied to any input URL").otherwise(
        F.format_string("%d rows %s", "rows", F.when(ok, "in order").otherwise("out of order"))
    )
    return out.select("report_id", ok.alias("passed"), detail.alias("detail"))


def flag_surfaced(flag: Column, report: Column) -> Column:
    low = F.lower(report)
    words = F.filter(F.split(F.lower(flag), "_"), lambda w: w != "")
    return low.contains(F.lower(flag)) | F.forall(words, lambda w: low.contains(w))


def flags_surfaced(reports, payloads, listings):
    flags = listings.select("report_id", F.explode("flags").alias("flag")).distinct()
    missing = flags.join(reports, "report_id").where(~flag_surfaced(c("flag"), c("text"))).groupBy("report_id").agg(F.count(F.lit(1)).alias("missing"))
    out = reports.select("report_id").join(missing, "report_id", "left")
    return out.select("report_id", c("missing").isNull().alias("passed"), F.concat(F.coalesce("missing", F.lit(0)).cast("string"), F.lit(" flags not surfaced")).alias("detail"))


def context_length(reports, payloads, listings):
    section = text.context_section(c("text"))
    words = text.word_count(section)
    return reports.select(
        "report_id", ((section != "") & (words <= K.CONTEXT_WORDS)).alias("passed"),
        F.when(section == "", "context section not found").otherwise(F.format_string("%d words", words)).alias("detail"),
    )


CRITERIA: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {
    "no_fabrication": no_fabrication,
    "all_rows_present": all_rows_present,
    "sort_order": sort_order,
    "flags_surfaced": flags_surfaced,
    "context_length": context_length,
}


def check_reports(reports: DataFrame, payloads: DataFrame, listings: DataFrame, criteria=None) -> DataFrame:
    """One row per (report, criterion)."""
    out = None
    for name, check in (criteria or CRITERIA).items():
        rows = check(reports, payloads, listings).withColumn("criterion", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.select("report_id", "criterion", "passed", "detail")


# --- benchmark roll-up -----------------------------------------------------------------------------


def fixture_results(results: DataFrame) -> DataFrame:
    """Criterion rows -> one row per (provider, model, fixture)."""
    return results.groupBy("provider", "model", "fixture").agg(
        (F.bool_and(F.coalesce("passed", F.lit(False))) & F.bool_and(c("error").isNull())).alias("passed"),
        (F.bool_or((c("criterion") == "no_fabrication") & c("passed")) & F.bool_and(c("error").isNull())).alias("no_fabrication"),
        F.bool_or(c("error").isNotNull()).alias("failed_call"),
        F.max("latency_s").alias("latency_s"), F.max("cost_usd").alias("cost_usd"),
    )


def model_rollup(fixtures: DataFrame) -> DataFrame:
    """Per model: pass rates, cost, median latency and nearest-rank p95, the bar, and the listing order.

    Latencies are counted per value and ranked through bucket counts, so no list is collected and a model
    with a third of all fixtures is no hot key.
    """
    key = ["provider", "model"]
    totals = fixtures.groupBy(*key).agg(
        F.count(F.lit(1)).alias("fixtures"), F.count_if("passed").alias("full_passes"), F.count_if("no_fabrication").alias("fab_passes"),
        F.sum("cost_usd").alias("total_cost_usd"), F.avg("cost_usd").alias("avg_cost_usd"),
    )
    timed = fixtures.where(~c("failed_call") & c("latency_s").isNotNull()).groupBy(*key, "latency_s").agg(F.count(F.lit(1)).alias("_n"))
    ranks = {"_lo": lambda n: F.floor((n - 1) / 2), "_hi": lambda n: F.ceil((n - 1) / 2), "latency_p95": lambda n: F.bround((n - 1) * 0.95, 0).cast("bigint")}
    latency = counted_ranks(timed, key, "latency_s", "_n", ranks).select(*key, ((c("_lo") + c("_hi")) / 2).alias("latency_p50"), "latency_p95")
    out = totals.join(latency, key, "left")
    return out.withColumn("overall_pass_rate", c("full_passes") / c("fixtures")).withColumn(
        "fabrication_pass_rate", c("fab_passes") / c("fixtures")
    ).withColumn("passes_bar", (c("fixtures") >= 10) & (c("fab_passes") == c("fixtures")) & (c("full_passes") >= 9))


def summary_order() -> list[Column]:
    return [c("passes_bar").desc(), c("avg_cost_usd").asc_nulls_last(), c("provider"), c("model")]


# --- recall quality ------------------------------------------------------------------------------------


def field_completeness(offers: DataFrame, keys: list[str], fields: dict[str, Column]) -> DataFrame:
    """Row count and, per field, how many rows have a value."""
    return offers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(test, F.lit(False))).alias(f"with_{name}") for name, test in fields.items()]
    )


def vendor_rollup(offers: DataFrame, keys: list[str], vendor: Column) -> DataFrame:
    return offers.groupBy(*keys, vendor.alias("vendor")).agg(F.count(F.lit(1)).alias("offers"))


def coverage_gate(rollup: DataFrame, keys: list[str], gate: int = K.VENDOR_GATE) -> DataFrame:
    return rollup.groupBy(*keys).agg(F.count(F.lit(1)).alias("vendors"), F.sum("offers").alias("offers")).withColumn(
        "covered", c("vendors") >= gate
    )
