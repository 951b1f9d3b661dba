"""Price and vendor alerts over stored runs, all products and runs in one plan.

Rules: slug, rule_pos, kind, threshold_usd, condition, mode, price_basis, host. Offers are first
reduced to one price row per (run, condition) and one row per (run, host), so the windows below
only see runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from offerloom.functions import money, urls
from offerloom.operators.history import numbered_steps

c = F.col


def fingerprint() -> Column:
    """Identity of a rule: editing any salient field makes it a new, armed rule."""
    price = F.concat_ws(
        "|", F.lit("price_below"), mode(), c("threshold_usd").cast("string"), F.coalesce("condition", F.lit("")), basis()
    )
    return (
        F.when(c("kind") == "price_below", price)
        .when(c("kind") == "vendor_seen", F.concat(F.lit("vendor_seen|"), c("host")))
        .otherwise(c("kind"))
    )


def mode() -> Column:
    return F.coalesce("mode", F.lit("drops_below"))


def basis() -> Column:
    return F.coalesce("price_basis", F.lit("unit"))


def run_prices(offers: DataFrame) -> DataFrame:
    sold = money.as_sold(c("is_kit"), c("kit_price_usd"), c("unit_price_usd"))
    return offers.groupBy("slug", "run_ts", "condition").agg(F.min("unit_price_usd").alias("unit_low"), F.min(sold).alias("sold_low"))


def run_hosts(offers: DataFrame) -> DataFrame:
    host = urls.offer_host(c("url"), c("attrs"))
    return offers.select("slug", "run_ts", host.alias("host")).where(c("host").isNotNull()).distinct()


def rule_prices(prices: DataFrame, rules: DataFrame, runs: DataFrame) -> DataFrame:
    """Cheapest eligible price per (price rule, run); null when no offer has the asked condition."""
    asked = rules.where(c("kind") == "price_below").withColumnRenamed("condition", "wanted")
    grid = runs.select("slug", "run_ts").join(asked, "slug")
    eligible = grid.join(prices, ["slug", "run_ts"], "left")
    fits = c("wanted").isNull() | (c("condition") == c("wanted"))
    low = F.when(basis() == "total", c("sold_low")).otherwise(c("unit_low"))
    names = [n for n in asked.columns if n not in ("slug", "wanted")]
    return eligible.groupBy("slug", "run_ts", "wanted", *names).agg(F.min(F.when(fits, low)).alias("price")).withColumnRenamed(
        "wanted", "condition"
    )


def price_alerts(priced: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Every (price rule, run) with `fires` and the arm state after it.

    *state* (slug, fingerprint, armed) is what an earlier job left behind; an unknown rule is armed.
    """
    rows = priced.withColumn("fingerprint", fingerprint())
    if state is None:
        rows = rows.withColumn("_armed", F.lit(True))
    else:
        known = state.select("slug", "fingerprint", c("armed").alias("_armed"))
        rows = rows.join(known, ["slug", "fingerprint"], "left").withColumn("_armed", F.coalesce("_armed", F.lit(True)))
    below = F.coalesce(c("price") < c("threshold_usd"), F.lit(False))
    w = Window.partitionBy("slug", "rule_pos", "fingerprint").orderBy("run_ts")
    was_below = F.coalesce(F.lag("below").over(w), F.lit(False))
    disarmed = F.coalesce(F.lag("below").over(w), ~c("_armed"))
    fires = c("below") & (
        (mode() == "while_below") | ((mode() == "is_below") & ~disarmed) | ((mode() == "drops_below") & ~was_below)
    )
    return rows.withColumn("below", below).withColumn("fires", fires).withColumn("armed_after", ~c("below")).drop("_armed")


def state_after(evaluated: DataFrame) -> DataFrame:
    """Arm state to store: the last run decides, for `is_below` rules."""
    return evaluated.where(mode() == "is_below").groupBy("slug", "fingerprint").agg(F.max_by("armed_after", "run_ts").alias("armed"))


def host_arrivals(hosts: DataFrame, runs: DataFrame) -> DataFrame:
    """(slug, run, host) rows where the host was not in the previous run; in a first run every host arrives."""
    numbered = hosts.join(runs.select("slug", "run_ts", "step_no"), ["slug", "run_ts"])
    w = Window.partitionBy("slug", "host").orderBy("step_no")
    stayed = F.coalesce(F.lag("step_no").over(w) == c("step_no") - 1, F.lit(False))
    return numbered.withColumn("_stayed", stayed).where(~c("_stayed")).drop("_stayed")


def price_headline() -> Column:
    cond = F.when(c("condition").isNotNull(), F.concat(F.lit(" ("), c("condition"), F.lit(")"))).otherwise("")
    dropped = F.format_string(
        "Cheapest%s %s price dropped to $%,.2f — alert threshold $%,.2f", cond, basis(), c("price"), c("threshold_usd")
    )
    is_low = F.format_string(
        "Cheapest%s %s price is $%,.2f — at or below your $%,.2f alert", cond, basis(), c("price"), c("threshold_usd")
    )
    return F.when(mode() == "drops_below", dropped).otherwise(is_low)


def rule_text() -> Column:
    """One-line description of a rule row."""
    cond = F.when(c("condition").isNotNull(), F.concat(F.lit(" ("), c("condition"), F.lit(" only)"))).otherwise("")
    amount = F.concat(F.lit("$"), F.regexp_replace(F.format_number("threshold_usd", 3), r"\.?0+$", ""))
    by = F.when(basis() == "total", "total price").otherwise("per-unit price")
    suffix = (
        F.when(mode() == "while_below", F.concat(F.lit("is at or below "), amount, F.lit(" (every run)")))
        .when(mode() == "is_below", F.concat(F.lit("is at or below "), amount, F.lit(" (once per dip)")))
        .otherwise(F.concat(F.lit("drops below "), amount))
    )
    return (
        F.when(c("kind") == "price_below", F.concat(F.lit("Cheapest"), cond, F.lit(" "), by, F.lit(" "), suffix))
        .when(c("kind") == "new_vendor_carries", "Any new vendor starts carrying this product")
        .otherwise(F.concat(F.lit("Any listing seen at "), c("host")))
    )


FIRED = ["slug", "run_ts", "rule_pos", "kind", "fingerprint", "host", "price", "headline"]


def evaluate(
    offers: DataFrame, rules: DataFrame, state: DataFrame | None = None, runs: DataFrame | None = None,
    names: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(fired alerts, arm state). *runs* defaults to the stored runs; pass all runs to let an empty run re-arm."""
    steps = numbered_steps(offers if runs is None else runs, "run_ts")
    evaluated = price_alerts(rule_prices(run_prices(offers), rules, steps), state)
    fired_prices = evaluated.where("fires").withColumn("headline", price_headline()).withColumn("host", F.lit(None).cast("string"))

    arrivals = host_arrivals(run_hosts(offers), steps)
    watched = rules.where(c("kind") == "vendor_seen").select(
        "slug", "rule_pos", "kind", fingerprint().alias("fingerprint"), urls.canonical_host(c("host")).alias("host")
    )
    seen = arrivals.join(watched, ["slug", "host"]).withColumn("headline", F.concat(c("host"), F.lit(" now has at least one passing listing")))
    any_vendor = rules.where(c("kind") == "new_vendor_carries").select("slug", "rule_pos", "kind", fingerprint().alias("fingerprint"))
    if names is not None:
        any_vendor = any_vendor.join(names.select("slug", "display_name"), "slug", "left")
    else:
        any_vendor = any_vendor.withColumn("display_name", F.lit(""))
    label = F.coalesce(F.nullif("display_name", F.lit("")), F.lit("this product"))
    carried = arrivals.join(any_vendor, "slug").withColumn(
        "headline", F.concat(F.lit("New vendor now carries "), label, F.lit(": "), c("host"))
    )
    no_price = F.lit(None).cast("double")
    fired = fired_prices.select(*FIRED).unionByName(seen.withColumn("price", no_price).select(*FIRED)).unionByName(
        carried.withColumn("price", no_price).select(*FIRED)
    )
    return fired, state_after(evaluated)


def audit_text(fired: DataFrame) -> DataFrame:
    """'Alerts fired' text per run; needs `outcome` ('ok' / 'failed'). Bounded by the rules of a product."""
    line = F.format_string("- **%s**: %s _(notify=%s)_", c("kind"), c("headline"), c("outcome"))
    return fired.groupBy("slug", "run_ts").agg(
        F.array_sort(F.collect_list(F.struct("rule_pos", "host", line.alias("line")))).alias("_lines")
    ).select(
        "slug", "run_ts",
        F.concat(F.lit("## Alerts fired\n\n"), F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")).alias("panel"),
    )
