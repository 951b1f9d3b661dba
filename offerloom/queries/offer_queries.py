"""Queries on offers: rules, gates, outliers, ranking, history, display."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom import constants as K
from offerloom.functions import money, text, urls
from offerloom.operators.asof import asof_join
from offerloom.operators import anomalies, dedup, dimensions, display, evaluation, history, ranking, rules, skew, windows
from offerloom.plans import runs
from offerloom.schema import PLACE
from offerloom.queries.base import (
    CANDIDATES_SQL, RUN_SQL, big, day, flagged_sql, offers, profiles, query, stats_sql, table, with_offers,
)

c = F.col
RUN = ["slug", "run_ts"]

def run_day():
    return day(c("run_ts")).alias("run_day")


V1_RULES = [
    {"rule": "no_such_rule"},
    {"rule": "form_factor_in", "values": ["RDIMM", "LRDIMM"]},
    {"rule": "speed_mts_min", "value": 4400},
    {"rule": "ecc_required"},
    {"rule": "voltage_eq", "value": 1.1},
    {"rule": "min_quantity_for_target"},
    {"rule": "in_stock"},
    {"rule": "single_sku_url"},
    {"rule": "condition_in", "values": ["New", " refurbished"]},
    {"rule": "title_excludes", "values": ["Gizmo", "BOLT"]},
]
CONFIGURATIONS = [(8, 8), (4, 16), (24, 32), (2, 16), (30, 45)]


def target():
    return rules.target_literal("gb", 256, CONFIGURATIONS)


MODULES_SQL = "CASE capacity_gb WHEN 8 THEN 8 WHEN 16 THEN 4 WHEN 32 THEN 24 WHEN 45 THEN 30 END"


@query(
    "first_reject_reason",
    with_offers(
        f"""
SELECT * FROM (
SELECT pos AS "index", source, CASE
  WHEN form_factor NOT IN ('RDIMM', 'LRDIMM') THEN '[form_factor_in] form_factor ''' || form_factor || ''' not in [''RDIMM'', ''LRDIMM'']'
  WHEN speed_mts < 4400 THEN '[speed_mts_min] speed ' || speed_mts || ' MT/s is below minimum 4400'
  WHEN ecc = 'false' THEN '[ecc_required] non-ECC memory'
  WHEN voltage_v <> 1.1 THEN '[voltage_eq] voltage ' || voltage_v || 'V != required 1.1V'
  WHEN {MODULES_SQL} IS NULL THEN '[min_quantity_for_target] module capacity ' || capacity_gb || 'GB not in allowed target configurations'
  WHEN quantity_available * kit_module_count < {MODULES_SQL} THEN '[min_quantity_for_target] insufficient quantity: need ' || {MODULES_SQL}
    || ' modules for 256GB target, but only ' || (quantity_available * kit_module_count) || ' available'
  WHEN quantity_available <= 0 THEN '[in_stock] out of stock'
  WHEN regexp_matches(lower(url), 'search\\?|sch\\?|/sch/') AND source <> 'serper_shopping' THEN '[single_sku_url] URL appears to be a search results page, not a single SKU'
  WHEN condition NOT IN ('new', 'refurbished') THEN '[condition_in] condition ''' || condition || ''' not in [''new'', ''refurbished'']'
  WHEN contains(lower(title), 'gizmo') THEN '[title_excludes] title contains excluded phrase ''Gizmo'''
  WHEN contains(lower(title), 'bolt') THEN '[title_excludes] title contains excluded phrase ''BOLT''' END AS reason
FROM offers) WHERE reason IS NOT NULL"""
    ),
)
def first_reject_reason(spark, sf):
    reason = rules.first_reject(V1_RULES, target())
    return rules.reject_log(offers(spark, sf), reason).select("index", "source", "reason")


@query(
    "reject_rules_from_profiles",
    with_offers(
        """
SELECT slug, CASE WHEN regexp_matches(lower(url), 'search\\?|sch\\?|/sch/') AND source <> 'serper_shopping' THEN 'single_sku_url'
  WHEN slug = 'ECONOMY' AND condition NOT IN ('new', 'refurbished') THEN 'condition_in'
  WHEN slug = 'LARGE' AND quantity_available <= 0 THEN 'in_stock'
  WHEN contains(lower(title), 'rusty') OR contains(lower(title), 'anvil') THEN 'title_excludes' ELSE 'kept' END AS rule, count(*) AS offers
FROM offers GROUP BY ALL"""
    ),
)
def reject_rules_from_profiles(spark, sf):
    """Rules that come with the product row (table mode of the dispatcher)."""
    joined = offers(spark, sf).join(runs.profile_knobs(profiles(spark, sf)), "slug")
    reason = rules.first_reject_from(c("rules"), c("target"))
    rule = F.coalesce(text.hit(reason, r"^\[([a-z_]+)\]", 1), F.lit("kept"))
    return joined.groupBy("slug", rule.alias("rule")).agg(F.count(F.lit(1)).alias("offers"))


@query(
    "profile_rule_compile",
    """
WITH types AS (SELECT DISTINCT p_type AS slug FROM part)
SELECT slug, 'single_sku_url' AS rule, '' AS "values" FROM types
UNION ALL SELECT slug, 'condition_in', 'New|refurbished ' FROM types WHERE slug = 'ECONOMY'
UNION ALL SELECT slug, 'in_stock', '' FROM types WHERE slug = 'LARGE'
UNION ALL SELECT slug, 'title_excludes', 'rusty|ANVIL' FROM types""",
)
def profile_rule_compile(spark, sf):
    rows = rules.profile_rules(profiles(spark, sf)).select("slug", F.explode("rules").alias("r"))
    return rows.select("slug", c("r.rule").alias("rule"), F.array_join("r.values", "|").alias("values"))


FLAG_RULES = [
    {"rule": "ship_from_country_in", "flag": "far", "values": ["nation_3", "NATION_9"]},
    {"rule": "brand_in", "flag": "brand_1x", "values": ["brand#1"]},
    {"rule": "kingston_e_suffix", "flag": "kingston_e_suffix"},
    {"rule": "title_mentions", "flag": "mentions", "values": ["Widget", "ring"]},
    {"rule": "title_mentions_other_server", "flag": "mentions", "values": ["gear"]},
    {"rule": "low_seller_feedback", "flag": "low_feedback", "rating_pct_below": 92.5, "count_below": 40},
]
FLAGS_SQL = """concat_ws(',', CASE WHEN ship_from_country IN ('NATION_3', 'NATION_9') THEN 'far' END,
  CASE WHEN contains(lower(brand), 'brand#1') THEN 'brand_1x' END,
  CASE WHEN contains(lower(brand), 'kingston') AND right(upper(mpn), 1) = 'E' THEN 'kingston_e_suffix' END,
  CASE WHEN contains(lower(title), 'widget') OR contains(lower(title), 'ring') OR contains(lower(title), 'gear') THEN 'mentions' END,
  CASE WHEN seller_rating_pct IS NULL OR seller_feedback_count IS NULL OR seller_rating_pct < 92.5 OR seller_feedback_count < 40 THEN 'low_feedback' END)"""


@query("soft_flags", with_offers(f"SELECT pos, {FLAGS_SQL} AS flags FROM offers"))
def soft_flags(spark, sf):
    flagged = rules.with_flags(offers(spark, sf), rules.raised_flags(FLAG_RULES))
    return flagged.select("pos", F.array_join("flags", ",").alias("flags"))


@query(
    "kingston_suffix_flag",
    with_offers("SELECT source, count(*) AS offers FROM offers WHERE contains(lower('Kingston ' || brand), 'kingston') AND right(upper(mpn), 1) = 'E' GROUP BY source"),
)
def kingston_suffix_flag(spark, sf):
    branded = offers(spark, sf).withColumn("brand", F.concat(F.lit("Kingston "), c("brand")))
    rule = [{"rule": "kingston_e_suffix", "flag": "kingston_e_suffix"}]
    hit = rules.with_flags(branded, rules.raised_flags(rule)).where(F.array_contains("flags", "kingston_e_suffix"))
    return hit.groupBy("source").agg(F.count(F.lit(1)).alias("offers"))


@query(
    "unknown_quantity_flag",
    with_offers(f"SELECT pos, {MODULES_SQL} AS modules FROM offers WHERE quantity_available IS NULL AND {MODULES_SQL} // kit_module_count > 1"),
)
def unknown_quantity_flag(spark, sf):
    t = target()
    flagged = offers(spark, sf).withColumn("flags", rules.add_flag("unknown_quantity", rules.unknown_quantity(t)))
    modules = money.matched_configuration(t["configurations"], rules.capacity())["module_count"]
    return flagged.where(F.array_contains("flags", "unknown_quantity")).select("pos", modules.alias("modules"))


@query(
    "ship_from_gate",
    with_offers(
        """
SELECT slug, coalesce('ship_from_' || lower(CASE WHEN ship_from_country NOT IN ('NATION_1', 'NATION_2', 'NATION_5') THEN ship_from_country END), '') AS flags,
  count(*) AS offers FROM offers GROUP BY ALL"""
    ),
)
def ship_from_gate(spark, sf):
    allowed = F.array(F.lit("nation_1"), F.lit(" NATION_2 "), F.lit(""), F.lit("Nation_5"))
    gated = rules.ship_from_gate(offers(spark, sf), allowed)
    return gated.groupBy("slug", F.array_join("flags", ",").alias("flags")).agg(F.count(F.lit(1)).alias("offers"))


@query("ship_from_drop", with_offers("SELECT ship_from_country, count(*) AS offers FROM offers WHERE ship_from_country IN ('NATION_1', 'NATION_2') GROUP BY ALL"))
def ship_from_drop(spark, sf):
    kept = rules.ship_from_gate(offers(spark, sf), F.array(F.lit("NATION_1"), F.lit("NATION_2")), drop=True)
    return kept.groupBy("ship_from_country").agg(F.count(F.lit(1)).alias("offers"))


@query(
    "vendor_allow_block",
    with_offers(
        """
SELECT source, vendor, count(*) AS offers FROM offers
WHERE (contains(vendor, '#00000000') OR source = 'ebay_search') AND NOT (contains(vendor, '7') OR source = 'amazon_dataforseo') GROUP BY ALL"""
    ),
)
def vendor_allow_block(spark, sf):
    lists = lambda *v: F.array(*[F.lit(x) for x in v])
    kept = rules.vendor_filter(offers(spark, sf), lists("#00000000", "eBay ", ""), lists(" Amazon", "7", "  "))
    return kept.groupBy("source", urls.vendor_key(c("seller_name")).alias("vendor")).agg(F.count(F.lit(1)).alias("offers"))


@query(
    "alias_gate",
    with_offers(
        """
SELECT pos, title FROM offers WHERE regexp_matches(lower(title), '(^|[^\\p{L}\\p{N}])(red widget|gear promo|1gb)($|[^\\p{L}\\p{N}])')"""
    ),
)
def alias_gate(spark, sf):
    names = F.array(F.lit("Red  Widget"), F.lit("gear PROMO"), F.lit("1GB"), F.lit(" "))
    return rules.alias_gate(offers(spark, sf), names, F.lit(True)).select("pos", "title")


@query(
    "best_offers_display",
    with_offers("SELECT slug, run_day, rank, vendor, url, unit_price_usd, pos, coalesce(anomaly, '') AS anomaly FROM displayed", RUN_SQL),
)
def best_offers_display(spark, sf):
    shown = runs.run_offers(offers(spark, sf), profiles(spark, sf), judges=None)["displayed"]
    kind = F.when(F.array_contains("flags", K.FLAG_LOW), "low").when(F.array_contains("flags", K.FLAG_HIGH), "high").otherwise("")
    return shown.select("slug", run_day(), big(c("rank")).alias("rank"), "vendor", "url", "unit_price_usd", "pos", kind.alias("anomaly"))


@query(
    "run_funnel_outcome",
    with_offers(
        """
SELECT r.slug, r.run_day, r.recall_count, coalesce(s.n, 0) AS survivor_count, coalesce(d.n, 0) AS displayed_count,
  CASE WHEN coalesce(s.n, 0) = 0 THEN 'all_filtered' ELSE 'ok' END AS outcome, CASE WHEN r.slug = 'MEDIUM' THEN 'degraded_attr' ELSE '' END AS notes
FROM (SELECT slug, run_day, count(*) AS recall_count FROM distinct_offers GROUP BY ALL) r
LEFT JOIN (SELECT slug, run_day, count(*) AS n FROM candidates GROUP BY ALL) s USING (slug, run_day)
LEFT JOIN (SELECT slug, run_day, count(*) AS n FROM displayed GROUP BY ALL) d USING (slug, run_day)""",
        RUN_SQL,
    ),
)
def run_funnel_outcome(spark, sf):
    f = runs.run_offers(offers(spark, sf), profiles(spark, sf), judges=None)["funnel"]
    notes = F.array_join(F.transform("outcome.notes", lambda n: n["class"]), ",")
    return f.select("slug", run_day(), "recall_count", "survivor_count", "displayed_count", c("outcome.class").alias("outcome"), notes.alias("notes"))


@query(
    "vendor_cap_overflow",
    with_offers(
        """
SELECT slug, run_day, vendor, count(*) - CASE WHEN slug = 'PROMO' THEN 1 ELSE 2 END AS held_back FROM flagged
SEMI JOIN (SELECT DISTINCT slug, run_day, vendor FROM displayed) USING (slug, run_day, vendor)
GROUP BY slug, run_day, vendor HAVING count(*) > CASE WHEN slug = 'PROMO' THEN 1 ELSE 2 END""",
        RUN_SQL,
    ),
)
def vendor_cap_overflow(spark, sf):
    o = runs.run_offers(offers(spark, sf), profiles(spark, sf), judges=None)["overflow"]
    return o.select("slug", run_day(), "vendor", big(c("held_back")).alias("held_back"))


@query(
    "display_columns",
    with_offers(
        """
SELECT slug, run_day, concat_ws(',', CASE WHEN slug = 'ECONOMY' THEN 'price' WHEN slug = 'PROMO' THEN 'price,condition' ELSE 'price,condition' END,
  CASE WHEN slug = 'ECONOMY' AND bool_or(brand IS NOT NULL) THEN 'brand' END,
  CASE WHEN slug = 'ECONOMY' AND bool_or(speed_mts IS NOT NULL) THEN 'speed_mts' END,
  CASE WHEN slug <> 'ECONOMY' AND bool_or(seller_name <> '') THEN 'seller' END,
  CASE WHEN slug NOT IN ('ECONOMY', 'PROMO') AND bool_or(seller_rating_pct IS NOT NULL) THEN 'seller_rating' END) AS columns
FROM displayed GROUP BY slug, run_day""",
        RUN_SQL,
    ),
)
def display_columns(spark, sf):
    cols = runs.run_offers(offers(spark, sf), profiles(spark, sf), judges=None)["columns"]
    return cols.select("slug", run_day(), F.array_join("columns", ",").alias("columns"))


for _name, _k in (("price_anomaly_mad", 3.5), ("price_anomaly_mad_k1", 1.0)):

    def _anomaly(spark, sf, k=_k):
        flagged = anomalies.flag_price_anomalies(offers(spark, sf), mad_k=k)
        return flagged.where(F.size("flags") > 0).select("pos", F.array_join("flags", ",").alias("flags"))

    query(_name, with_offers("SELECT pos, 'price_anomaly_' || anomaly AS flags FROM flagged WHERE anomaly IS NOT NULL", flagged_sql("offers", str(_k))))(_anomaly)


@query(
    "price_stats",
    with_offers("SELECT slug, run_day, median_value AS median, mad_value AS mad, median.n AS priced FROM median JOIN mad USING (slug, run_day)", stats_sql("offers")),
)
def price_stats(spark, sf):
    return anomalies.price_stats(offers(spark, sf)).select("slug", run_day(), "median", "mad", "priced")


LATEST_SQL = """
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug, url, run_day ORDER BY hour DESC, pos DESC) AS no FROM offers) WHERE no = 1
),
steps AS (
  SELECT slug, run_day, row_number() OVER (PARTITION BY slug ORDER BY run_day) AS step_no, lag(run_day) OVER (PARTITION BY slug ORDER BY run_day) AS previous_day
  FROM (SELECT DISTINCT slug, run_day FROM offers)
),
numbered AS (SELECT latest.*, step_no FROM latest JOIN steps USING (slug, run_day)),
diff AS (
  SELECT coalesce(n.slug, o.slug) AS slug, coalesce(n.url, o.url) AS url, coalesce(n.step_no, o.step_no + 1) AS step_no,
    CASE WHEN o.url IS NULL THEN 'new' WHEN n.url IS NULL THEN 'dropped' ELSE 'changed' END AS change_type,
    o.unit_price_usd AS old_price_usd, n.unit_price_usd AS new_price_usd,
    CASE WHEN o.url IS NOT NULL AND n.url IS NOT NULL THEN (n.unit_price_usd - o.unit_price_usd) / o.unit_price_usd END AS pct_change
  FROM numbered n FULL JOIN numbered o ON n.slug = o.slug AND n.url = o.url AND n.step_no = o.step_no + 1
),
changes AS (
  SELECT d.*, s.run_day FROM diff d JOIN steps s USING (slug, step_no)
  WHERE step_no > 1 AND (change_type <> 'changed' OR abs(pct_change) >= 0.05)
)"""


@query("latest_per_url_day", with_offers("SELECT slug, url, run_day, pos, unit_price_usd FROM latest", LATEST_SQL))
def latest_per_url_day(spark, sf):
    rows = history.latest_per_day(offers(spark, sf))
    return rows.select("slug", "url", day(c("snapshot_date")).alias("run_day"), "pos", "unit_price_usd")


@query("snapshot_dates", with_offers("SELECT DISTINCT slug, run_day FROM offers"))
def snapshot_dates(spark, sf):
    return history.snapshot_dates(offers(spark, sf)).select("slug", day(c("snapshot_date")).alias("run_day"))


@query("snapshot_diff", with_offers("SELECT slug, url, run_day, change_type, old_price_usd, new_price_usd, pct_change FROM changes", LATEST_SQL))
def snapshot_diff(spark, sf):
    diff, _ = runs.diff_latest(offers(spark, sf), newest_only=False, details=())
    return _diff_rows(diff)


def _diff_rows(diff):
    """New rows carry no old price and dropped rows no new one."""
    return diff.select("slug", "url", day(c("snapshot_date")).alias("run_day"), "change_type", "old_price_usd", "new_price_usd", "pct_change")


@query(
    "diff_newest_pair",
    with_offers(
        "SELECT slug, change_type, count(*) AS offers FROM changes WHERE step_no = (SELECT max(step_no) FROM steps s WHERE s.slug = changes.slug) GROUP BY ALL", LATEST_SQL
    ),
)
def diff_newest_pair(spark, sf):
    diff, _ = runs.diff_latest(offers(spark, sf), details=())
    return diff.groupBy("slug", "change_type").agg(F.count(F.lit(1)).alias("offers"))


@query(
    "material_change",
    with_offers(
        """
SELECT s.slug, s.run_day, coalesce(n.new_count, 0) AS new_count, coalesce(n.dropped_count, 0) AS dropped_count, coalesce(n.changed_count, 0) AS changed_count,
  coalesce(n.new_count, 0) + coalesce(n.dropped_count, 0) + coalesce(n.changed_count, 0) > 0 AS is_material,
  CASE WHEN n.new_count > 0 THEN n.new_count || ' new listings found' WHEN n.big_drops > 0 THEN 'Price dropped by >=5%'
       WHEN a.lowest < b.lowest THEN 'New cheapest path' END AS headline
FROM steps s JOIN (SELECT slug, run_day, min(unit_price_usd) AS lowest FROM latest GROUP BY ALL) a USING (slug, run_day)
JOIN (SELECT slug, run_day AS previous_day, min(unit_price_usd) AS lowest FROM latest GROUP BY ALL) b USING (slug, previous_day)
LEFT JOIN (SELECT slug, run_day, count(*) FILTER (change_type = 'new') AS new_count, count(*) FILTER (change_type = 'dropped') AS dropped_count,
  count(*) FILTER (change_type = 'changed') AS changed_count, count(*) FILTER (pct_change <= -0.05) AS big_drops FROM changes GROUP BY ALL) n USING (slug, run_day)""",
        LATEST_SQL,
    ),
)
def material_change(spark, sf):
    _, heads = runs.diff_latest(offers(spark, sf), newest_only=False, details=())
    return heads.select(
        "slug", day(c("snapshot_date")).alias("run_day"), "new_count", "dropped_count", "changed_count", "is_material",
        F.regexp_replace("headline", r": \$.*$", "").alias("headline"),
    )


@query(
    "diff_sections",
    with_offers("SELECT slug, run_day, url, 'changed' AS change_type, CAST(round(CAST(pct_change AS DECIMAL(38, 18)), 2) AS DOUBLE) AS pct FROM changes WHERE change_type = 'changed'", LATEST_SQL),
)
def diff_sections(spark, sf):
    diff, _ = runs.diff_latest(offers(spark, sf), newest_only=False, details=())
    rows = diff.where(c("change_type") == "changed")
    pct = F.round(c("pct_change").cast("decimal(38,18)"), 2).cast("double")
    return rows.select("slug", day(c("snapshot_date")).alias("run_day"), "url", "change_type", pct.alias("pct"))


@query(
    "price_history",
    with_offers(
        """
SELECT slug, url, pos, unit_price_usd, lag(unit_price_usd) OVER w AS previous_price_usd, first(unit_price_usd) OVER w AS first_price_usd,
  min(unit_price_usd) OVER w AS lowest_price_usd, max(unit_price_usd) OVER w AS highest_price_usd
FROM offers WINDOW w AS (PARTITION BY slug, url ORDER BY run_day, hour, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
    ),
)
def price_history(spark, sf):
    return history.price_history(offers(spark, sf)).drop("fetched_at")


@query(
    "price_history_one_url",
    with_offers(
        """
SELECT pos, run_day, unit_price_usd, lag(unit_price_usd) OVER w AS previous_price_usd, first(unit_price_usd) OVER w AS first_price_usd,
  min(unit_price_usd) OVER w AS lowest_price_usd, max(unit_price_usd) OVER w AS highest_price_usd
FROM offers WINDOW w AS (ORDER BY run_day, hour, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
    ),
)
def price_history_one_url(spark, sf):
    """Every offer under one URL of one product: the history that no single task may hold."""
    rows = offers(spark, sf).withColumn("slug", F.lit("p")).withColumn("url", F.lit("https://one.example.com/p"))
    return history.price_history(rows).select("pos", day(c("fetched_at")).alias("run_day"), "unit_price_usd", "previous_price_usd", "first_price_usd", "lowest_price_usd", "highest_price_usd")


@query(
    "price_range_30_days",
    with_offers(
        """
SELECT slug, url, pos, min(unit_price_usd) OVER w AS low, max(unit_price_usd) OVER w AS high FROM (SELECT *, run_date + to_hours(hour) AS seen_at FROM offers)
WINDOW w AS (PARTITION BY slug, url ORDER BY seen_at RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)"""
    ),
)
def price_range_30_days(spark, sf):
    """Lowest and highest price of every offer in the 30 days up to each observation."""
    rows = offers(spark, sf).select("slug", "url", "pos", "fetched_at", "unit_price_usd")
    return windows.recent_range(rows, ["slug", "url"], "fetched_at", "unit_price_usd").select("slug", "url", "pos", "low", "high")


@query(
    "offer_level_totals",
    with_offers(
        """
SELECT slug, vendor, condition, source, CAST(grouping_id(slug, vendor, condition, source) AS INTEGER) AS level, count(*) AS offers, min(unit_price_usd) AS lowest_usd,
  CAST(sum(CAST(round(unit_price_usd * 10000) AS BIGINT)) AS DOUBLE) / (count(unit_price_usd) * 10000) AS mean_usd FROM offers GROUP BY CUBE (slug, vendor, condition, source)"""
    ),
)
def offer_level_totals(spark, sf):
    """Totals over product, vendor, condition and source in every combination."""
    levels = [c("slug"), urls.vendor_key(c("seller_name")), c("condition"), c("source")]
    return windows.level_totals(offers(spark, sf), levels, ["slug", "vendor", "condition", "source"])


def asof_sql(key: str) -> str:
    return f"""
WITH sold AS (SELECT {key} AS k, ts, arg_max(value, event_id) AS price, max(event_id) AS seen_id FROM events WHERE event_type = 'purchase' GROUP BY ALL),
other AS (SELECT event_id, {key} AS k, ts FROM events WHERE event_type <> 'purchase')
SELECT event_id, s.seen_id, s.price FROM other o ASOF LEFT JOIN sold s ON o.k = s.k AND o.ts > s.ts"""


def _last_sale(spark, sf, key):
    e = table(spark, sf, "events").select("event_id", key.alias("k"), c("ts").cast("timestamp").alias("ts"), "event_type", "value")
    sold = e.where(c("event_type") == "purchase").select("k", "ts", c("event_id").alias("seen_id"), c("value").alias("price"))
    met = asof_join(e.where(c("event_type") != "purchase").select("event_id", "k", "ts"), sold, ["k"], "ts", ["seen_id"])
    return met.select("event_id", "match.seen_id", "match.price")


@query("event_price_asof", asof_sql("user_id"))
def event_price_asof(spark, sf):
    """Every event that is no sale with the newest sale of its product before it."""
    return _last_sale(spark, sf, c("user_id"))


@query("event_price_asof_one_key", asof_sql("1"))
def event_price_asof_one_key(spark, sf):
    """The same over all products: one key holds every row of both sides."""
    return _last_sale(spark, sf, F.lit(1))


@query(
    "previous_run_asof",
    "WITH r AS (SELECT DISTINCT user_id AS u, strftime(ts, '%Y-%m-%d') AS run_day FROM events)\n"
    "SELECT CAST(u AS VARCHAR) AS slug, run_day, lag(run_day) OVER (PARTITION BY u ORDER BY run_day) AS previous_day, row_number() OVER (PARTITION BY u ORDER BY run_day) AS run_no FROM r",
)
def previous_run_asof(spark, sf):
    from offerloom.queries.base import event_offers

    steps = history.previous_runs(event_offers(spark, sf))
    return steps.select("slug", run_day(), day(c("previous_run_ts")).alias("previous_day"), big(c("step_no")).alias("run_no"))


@query(
    "history_upsert",
    with_offers(
        """
SELECT slug, url, run_day, hour, pos, unit_price_usd FROM (
  SELECT *, row_number() OVER (PARTITION BY slug, url, run_day, hour ORDER BY gen DESC, pos DESC) AS no FROM (
    SELECT *, 0 AS gen FROM offers WHERE source <> 'ebay_search' UNION ALL
    SELECT * REPLACE (unit_price_usd * 2 AS unit_price_usd), 1 AS gen FROM offers WHERE condition = 'new')) WHERE no = 1"""
    ),
)
def history_upsert(spark, sf):
    o = offers(spark, sf)
    merged = history.upsert(o.where(c("source") != "ebay_search"), o.where(c("condition") == "new").withColumn("unit_price_usd", c("unit_price_usd") * 2))
    return merged.select("slug", "url", run_day(), F.hour("fetched_at").alias("hour"), "pos", "unit_price_usd")


TOTAL_SQL = f"""
totals AS (
  SELECT *, CASE WHEN {MODULES_SQL} % kit_module_count = 0 AND (quantity_available IS NULL OR quantity_available >= {MODULES_SQL} // kit_module_count)
    THEN coalesce(CASE WHEN is_kit THEN kit_price_usd END, unit_price_usd) * ({MODULES_SQL} // kit_module_count) END AS raw_total
  FROM offers
)"""


def raw_totals(o):
    """Totals before rounding: the two engines round halves differently."""
    t = target()
    modules = money.matched_configuration(t["configurations"], rules.capacity())["module_count"]
    total = money.total_for_target(t, rules.capacity(), c("is_kit"), c("kit_module_count"), c("kit_price_usd"), c("unit_price_usd"), c("quantity_available"))
    units = F.floor(modules / c("kit_module_count")).cast("int")
    return o.withColumn(
        "total_for_target_usd", F.when(total.isNotNull(), money.as_sold(c("is_kit"), c("kit_price_usd"), c("unit_price_usd")) * units)
    )


@query("total_for_target", with_offers("SELECT pos, capacity_gb, raw_total AS total FROM totals WHERE raw_total IS NOT NULL", TOTAL_SQL))
def total_for_target(spark, sf):
    rows = raw_totals(offers(spark, sf)).where(c("total_for_target_usd").isNotNull())
    return rows.select("pos", rules.capacity().alias("capacity_gb"), c("total_for_target_usd").alias("total"))


@query(
    "total_without_configurations",
    with_offers("SELECT condition, count(*) AS offers, min(coalesce(kit_price_usd, unit_price_usd) * 3) AS lowest FROM offers WHERE quantity_available IS NULL OR quantity_available >= 3 GROUP BY ALL"),
)
def total_without_configurations(spark, sf):
    t = rules.target_literal("count", 3)
    total = money.total_for_target(t, rules.capacity(), c("is_kit"), c("kit_module_count"), c("kit_price_usd"), c("unit_price_usd"), c("quantity_available"))
    rows = offers(spark, sf).where(total.isNotNull())
    sold = money.as_sold(c("is_kit"), c("kit_price_usd"), c("unit_price_usd"))
    return rows.groupBy("condition").agg(F.count(F.lit(1)).alias("offers"), F.min(sold * 3).alias("lowest"))


@query(
    "reserved_top_k",
    with_offers(
        """
SELECT slug, run_day, row_number() OVER (PARTITION BY slug, run_day ORDER BY raw_total IS NULL, coalesce(raw_total, unit_price_usd), pos) AS rank, pos, source FROM (
  SELECT *, row_number() OVER (PARTITION BY slug, run_day ORDER BY k > 3, raw_total IS NULL, coalesce(raw_total, unit_price_usd), pos) AS pick FROM (
    SELECT *, row_number() OVER (PARTITION BY slug, run_day, source, CASE WHEN source = 'universal_ai_search' THEN host END
      ORDER BY raw_total IS NULL, coalesce(raw_total, unit_price_usd), pos) AS k FROM totals)) WHERE pick <= 30""",
        TOTAL_SQL,
    ),
)
def reserved_top_k(spark, sf):
    ranked = ranking.rank_for_report(raw_totals(offers(spark, sf)))
    return ranked.select("slug", run_day(), big(c("rank")).alias("rank"), "pos", "source")


@query(
    "shown_of_total",
    with_offers("SELECT slug, run_day, count(*) AS total, least(count(*), 30) AS shown, CASE WHEN count(*) > 30 THEN 'top 30 of ' || count(*) END AS note FROM offers GROUP BY slug, run_day"),
)
def shown_of_total(spark, sf):
    o = offers(spark, sf)
    return ranking.shown_of_total(ranking.rank_for_report(o), o).select("slug", run_day(), "total", "shown", "note")


@query(
    "survivor_rank_all",
    with_offers("SELECT slug, run_day, pos, row_number() OVER (PARTITION BY slug, run_day ORDER BY anomaly IS NOT DISTINCT FROM 'low', unit_price_usd, pos) AS rank FROM flagged", flagged_sql("offers", "1.0")),
)
def survivor_rank_all(spark, sf):
    flagged = anomalies.flag_price_anomalies(offers(spark, sf), mad_k=1.0)
    ranked = ranking.rank_all(flagged.select(*RUN, *PLACE, "flags", "unit_price_usd"))  # a rank writes the rows it is given
    return ranked.select("slug", run_day(), "pos", "rank")


@query(
    "known_part_join",
    with_offers("SELECT CASE WHEN k.m IS NULL THEN 'unknown' ELSE 'qvl' END AS qvl_status, source, count(*) AS offers FROM offers LEFT JOIN (SELECT DISTINCT lower(p_brand || '-' || p_partkey) AS m FROM part WHERE p_size < 20) k ON lower(mpn) = k.m GROUP BY ALL"),
)
def known_part_join(spark, sf):
    known = table(spark, sf, "part").where(c("p_size") < 20).select(F.concat(F.lit(" "), c("p_brand"), F.lit("-"), c("p_partkey").cast("string")).alias("mpn"))
    marked = dimensions.annotate_known_parts(offers(spark, sf), known)
    return marked.groupBy("qvl_status", "source").agg(F.count(F.lit(1)).alias("offers"))


@query(
    "cheapest_by_basis",
    with_offers(
        """
SELECT slug, run_day, basis, pos, price FROM (
  SELECT *, row_number() OVER (PARTITION BY slug, run_day, basis ORDER BY price, pos) AS no FROM (
    SELECT slug, run_day, pos, 'unit' AS basis, unit_price_usd AS price FROM offers WHERE condition = 'new' UNION ALL
    SELECT slug, run_day, pos, 'total', coalesce(CASE WHEN is_kit THEN kit_price_usd END, unit_price_usd) FROM offers)) WHERE no = 1"""
    ),
)
def cheapest_by_basis(spark, sf):
    o = offers(spark, sf)
    unit = ranking.cheapest(o.where(c("condition") == "new"), RUN, c("unit_price_usd"), ["pos"]).withColumn("basis", F.lit("unit"))
    sold = money.basis_price(F.lit("total"), c("is_kit"), c("kit_price_usd"), c("unit_price_usd"))
    total = ranking.cheapest(o, RUN, sold, ["pos"]).withColumn("basis", F.lit("total"))
    return unit.unionByName(total).select("slug", run_day(), "basis", "pos", "price")


@query(
    "bottom_line",
    with_offers(
        """
SELECT slug, run_day, '**Bottom line.** Cheapest passing listing for ' || slug || CASE WHEN seller_name <> '' THEN ' from ' || seller_name ELSE '' END || ' via '
  || CASE WHEN source = 'universal_ai_search' THEN host ELSE source END || ' — ' || title || ' (' || condition || ')' AS line FROM (
  SELECT *, row_number() OVER (PARTITION BY slug, run_day ORDER BY raw_total IS NULL, coalesce(raw_total, unit_price_usd), pos) AS no FROM totals) WHERE no = 1""",
        TOTAL_SQL,
    ),
)
def bottom_line(spark, sf):
    tops = ranking.bottom_line(raw_totals(offers(spark, sf)))
    names = profiles(spark, sf).select("slug", c("slug").alias("display_name"))
    made = display.bottom_line_text(tops, names)
    short = F.regexp_replace(F.regexp_replace("bottom_line", r": \$[0-9.]+( total for target)?", ""), r"\[([^\]]+)\]\([^)]*\)", "$1")
    return made.select("slug", run_day(), F.regexp_replace(short, r"\.$", "").alias("line"))


@query("dedup_union", with_offers("SELECT slug, run_day, pos FROM (SELECT *, row_number() OVER (PARTITION BY slug, run_day, url ORDER BY CASE WHEN source = 'ebay_search' THEN 0 ELSE 1 END, pos) AS no FROM offers WHERE seller_name <> '') WHERE no = 1\nUNION ALL SELECT slug, run_day, pos FROM offers WHERE seller_name = ''"))
def dedup_union(spark, sf):
    """Two recalls in source order; offers without URL (here: without seller) are all kept."""
    o = offers(spark, sf).withColumn("url", F.when(c("seller_name") == "", " ").otherwise(c("url")))
    both = dedup.union_recalls([o.where(c("source") == "ebay_search"), o.where(c("source") != "ebay_search")])
    return dedup.distinct_offers(both).select("slug", run_day(), "pos")


FLAGS_LIST = "list_filter([CASE WHEN condition = 'used' THEN 'suspicious_listing' END, CASE WHEN is_kit THEN 'low_fb' END, CASE WHEN quantity_available IS NULL THEN 'unknown_quantity' END, CASE WHEN capacity_gb > 40 THEN 'odd' END], lambda x: x IS NOT NULL)"


def _labelled(o):
    flags = F.array_compact(
        F.array(
            F.when(c("condition") == "used", "suspicious_listing"), F.when(c("is_kit"), "low_fb"), F.when(c("quantity_available").isNull(), "unknown_quantity"),
            F.when(rules.capacity() > 40, "odd"), F.when(c("condition") == "used", "suspicious_listing"),
        )
    )
    return o.withColumn("flags", flags)


@query(
    "badge_lookup",
    with_offers(
        f"""
SELECT flag AS key, CASE flag WHEN 'suspicious_listing' THEN 'Suspicious listing' WHEN 'low_fb' THEN 'Limited reviews' WHEN 'unknown_quantity' THEN 'Quantity unknown' ELSE flag END AS label,
  CASE flag WHEN 'suspicious_listing' THEN 'danger' ELSE 'info' END AS severity, place, count(*) AS offers
FROM (SELECT unnest({FLAGS_LIST}) AS flag, generate_subscripts({FLAGS_LIST}, 1) - 1 AS place FROM offers) GROUP BY ALL"""
    ),
)
def badge_lookup(spark, sf):
    flag_rules = F.array(F.struct(F.lit("low_fb").alias("flag"), F.lit("low_seller_feedback").alias("rule")), F.struct(F.lit("odd").alias("flag"), F.lit("title_mentions").alias("rule")))
    rows = _labelled(offers(spark, sf)).select(F.posexplode(dimensions.badges(c("flags"), flag_rules)).alias("place", "b")).select(big(c("place")).alias("place"), "b.*")
    return rows.groupBy("key", "label", "severity", "place").agg(F.count(F.lit(1)).alias("offers"))


@query(
    "flag_descriptions",
    with_offers(
        f"""
SELECT DISTINCT slug, run_day, flag, CASE flag WHEN 'suspicious_listing' THEN 'Odd for ' || slug
  WHEN 'low_fb' THEN 'Seller''s feedback rating or count is below the profile threshold.'
  WHEN 'unknown_quantity' THEN 'The listing did not declare a quantity-available count.' END AS description
FROM (SELECT slug, run_day, unnest({FLAGS_LIST}) AS flag FROM offers)"""
    ),
)
def flag_descriptions(spark, sf):
    slugs = profiles(spark, sf).select("slug")
    rows = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("suspicious_listing").alias("flag"), F.lit("title_mentions").alias("rule"), F.concat(F.lit("Odd for "), c("slug")).alias("description")),
        F.struct(F.lit(1).alias("pos"), F.lit("low_fb").alias("flag"), F.lit("low_seller_feedback").alias("rule"), F.lit(None).cast("string").alias("description")),
        F.struct(F.lit(2).alias("pos"), F.lit("odd").alias("flag"), F.lit("title_mentions").alias("rule"), F.lit("").alias("description")),
    )
    flag_rules = slugs.select("slug", F.explode(rows).alias("r")).select("slug", "r.*")
    return dimensions.flag_descriptions(_labelled(offers(spark, sf)), flag_rules).select("slug", run_day(), "flag", "description")


def decimal_sql(value: str, places: int) -> str:
    """Text of a double rounded half up on its decimal value."""
    return f"CAST(CAST(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,18)) AS DECIMAL(28,{places})) AS VARCHAR)"


def money_sql(value: str) -> str:
    return f"'$' || {decimal_sql(value, 2)}"


@query(
    "report_table_cells",
    with_offers(
        """
SELECT slug, run_day, pos AS row_no, CAST(pos AS VARCHAR) AS col_rank, '[' || CASE WHEN source = 'universal_ai_search' THEN host ELSE source END || '](' || url || ')' AS col_source,
  title AS col_title, CAST(kit_module_count AS VARCHAR) AS col_pack_size, coalesce(CAST(quantity_available AS VARCHAR), 'unknown') AS col_qty, condition AS col_condition,
  coalesce(brand, 'unknown') AS col_brand, mpn AS col_mpn, coalesce(nullif(seller_name, ''), 'unknown') AS col_seller, ship_from_country AS col_ship_from,
  CASE WHEN condition = 'new' THEN 'qvl' ELSE 'unknown' END AS col_qvl_status,
  CASE condition WHEN 'new' THEN '(no flags)' WHEN 'used' THEN 'low_fb' ELSE 'low_fb, odd' END AS col_flags, CASE WHEN is_kit THEN 'mint \\| lime' ELSE 'unknown' END AS col_flavor,
  CASE WHEN is_kit THEN {total} ELSE 'unknown' END || fx AS col_total_for_target, {shown} || fx AS col_price, {shown} || fx AS col_price_pack, {unit} || fx AS col_price_unit,
  coalesce({rating} || '%', 'unknown') AS col_seller_rating
FROM (SELECT *, CASE condition WHEN 'new' THEN ' (fx)' WHEN 'used' THEN ' (EUR)' ELSE '' END AS fx FROM offers)""".format(
            total=money_sql("unit_price_usd * 2"), shown=money_sql("CASE WHEN is_kit THEN kit_price_usd ELSE unit_price_usd END"), unit=money_sql("unit_price_usd"), rating=decimal_sql("seller_rating_pct", 1)
        )
    ),
)
def report_table_cells(spark, sf):
    """All 18 columns, with currencies of every kind, flags, totals and a text to escape."""
    by = lambda new, used, other=None: F.when(c("condition") == "new", new).when(c("condition") == "used", used).otherwise(other)
    texts = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    more = F.create_map(F.lit("price_approx_fx"), by(F.lit("True"), F.lit("EUR")), F.lit("flavor"), F.when(c("is_kit"), "mint | lime"))
    rows = offers(spark, sf).withColumns({
        "rank": c("pos"), "attrs": F.map_concat("attrs", more), "qvl_status": by(F.lit("qvl"), F.lit(None)), "flags": by(texts(), texts("low_fb"), texts("low_fb", "odd")),
        "total_for_target_usd": F.when(c("is_kit"), c("unit_price_usd") * 2),
    })
    cells = display.report_table(rows, list(display.CELLS))
    return cells.select(run_day(), *[n for n in cells.columns if n != "run_ts"])


LISTING_SQL = """
listed AS (
  SELECT pos, url, title, seller_name, is_kit, kit_module_count, condition, seller_rating_pct, seller_feedback_count, ship_from_country, quantity_available, brand, mpn, source,
    host, unit_price_usd, CASE WHEN is_kit THEN kit_price_usd ELSE unit_price_usd END AS sold_price, CASE WHEN condition = 'new' THEN unit_price_usd * 3 END AS total_for_target_usd,
    CASE WHEN condition = 'refurbished' THEN 'EUR' END AS currency_approx_fx, 'www.' || host AS url_host, url || '?buy' AS buy_url, CASE WHEN is_kit THEN url || '.png' END AS image_url,
    CASE WHEN condition = 'used' THEN 4.5::DOUBLE END AS rating, CASE WHEN condition = 'used' THEN l_partkey::INT END AS rating_count,
    concat_ws(',', CASE WHEN condition = 'used' THEN 'suspicious_listing' END, CASE WHEN is_kit THEN 'low_fb' END, CASE WHEN quantity_available IS NULL THEN 'unknown_quantity' END,
      CASE WHEN capacity_gb > 40 THEN 'odd' END, CASE WHEN condition = 'used' THEN 'suspicious_listing' END) AS flags,
    concat_ws(',', CASE WHEN condition = 'used' THEN 'suspicious_listing/Suspicious listing/danger' END, CASE WHEN is_kit THEN 'low_fb/low_fb/info' END,
      CASE WHEN quantity_available IS NULL THEN 'unknown_quantity/Quantity unknown/info' END, CASE WHEN capacity_gb > 40 THEN 'odd/odd/info' END) AS badges,
    concat_ws(',', 'capacity_gb=' || capacity_gb, 'ecc=' || ecc, 'form_factor=' || form_factor, CASE WHEN condition = 'refurbished' THEN 'price_approx_fx=EUR' END, 'source_url=' || source_url,
      'speed_mts=' || speed_mts, CASE WHEN source = 'universal_ai_search' THEN 'vendor_host=www.' || host END, 'voltage_v=' || voltage_v) AS attrs
  FROM offers
)"""


def _listings(spark, sf):
    """Offers with every field that a listing shows, under rank 1."""
    o, used = _labelled(offers(spark, sf)), c("condition") == "used"
    fx = F.when(c("condition") == "refurbished", "EUR")
    part = F.regexp_extract("mpn", r"-(\d+)E?$", 1).cast("int")
    return o.withColumns({
        "rank": F.lit(1), "total_for_target_usd": F.when(c("condition") == "new", c("unit_price_usd") * 3), "buy_url": F.concat("url", F.lit("?buy")),
        "image_url": F.when(c("is_kit"), F.concat("url", F.lit(".png"))), "rating": F.when(used, 4.5), "rating_count": F.when(used, part),
        "attrs": F.map_filter(F.map_concat("attrs", F.create_map(F.lit("price_approx_fx"), fx)), lambda _, v: v.isNotNull()),
    })


def _flat(name: str) -> list:
    """The fields of a listing struct; badges, flags and attributes as text."""
    at = lambda n: c(f"{name}.{n}")
    badge = F.transform(at("badges"), lambda b: F.concat_ws("/", b["key"], b["label"], b["severity"]))
    return [at("currency_approx_fx"), F.array_join(badge, ",").alias("badges"), at("url"), at("title"), at("total_for_target_usd"), at("condition"), at("seller_name"), at("is_kit"), at("kit_module_count")]


@query(
    "listing_display",
    with_offers("""
SELECT pos, 1 AS rank, source, CASE WHEN source <> 'serper_shopping' THEN url_host WHEN seller_name = '' THEN NULL ELSE lower(seller_name) || '.com' END AS vendor_host, unit_price_usd AS price_usd,
  currency_approx_fx, badges, url, title, total_for_target_usd, condition, seller_name, is_kit, kit_module_count, buy_url, image_url, seller_rating_pct, seller_feedback_count, rating, rating_count,
  ship_from_country, quantity_available, flags, brand, mpn, attrs FROM listed""", LISTING_SQL),
)
def listing_display(spark, sf):
    """All 25 fields of a listing in a report document."""
    a = lambda n: c(f"a.{n}")
    pairs = F.transform(F.array_sort(F.map_entries(a("attrs"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return _listings(spark, sf).select("pos", display.listing_v2().alias("a")).select(
        "pos", a("rank"), a("source"), a("vendor_host"), a("price_usd"), *_flat("a"), a("buy_url"), a("image_url"), a("seller_rating_pct"), a("seller_feedback_count"), a("rating"), a("rating_count"),
        a("ship_from_country"), a("quantity_available"), F.array_join(a("flags"), ",").alias("flags"), a("brand"), a("mpn"), F.array_join(pairs, ",").alias("attrs"),
    )


@query(
    "listing_display_v1",
    with_offers("""
SELECT pos, 1 AS rank, CASE WHEN source = 'universal_ai_search' THEN host ELSE source END AS source, url_host AS vendor_host, sold_price AS price_usd,
  currency_approx_fx, badges, url, title, total_for_target_usd, condition, seller_name, is_kit, kit_module_count FROM listed""", LISTING_SQL),
)
def listing_display_v1(spark, sf):
    """All 13 fields of a listing in the older document."""
    return _listings(spark, sf).select("pos", display.listing_v1().alias("b")).select("pos", "b.rank", "b.source", "b.vendor_host", "b.price_usd", *_flat("b"))


@query(
    "column_value_precedence",
    with_offers("SELECT pos, coalesce(brand, form_factor) AS shown, brand IS NULL AND form_factor IS NOT NULL AS extracted FROM offers"),
)
def column_value_precedence(spark, sf):
    value = display.column_value("form_factor", c("brand"))
    return offers(spark, sf).select("pos", value.alias("shown"), display.is_extracted("form_factor", c("brand")).alias("extracted"))


@query(
    "brand_inference",
    with_offers(
        "SELECT coalesce(brand, CASE WHEN regexp_matches(lower(title), '\\bwidget\\b') THEN 'Widget' WHEN regexp_matches(lower(title), '\\bring\\b') THEN 'RING' END) AS brand, count(*) AS offers FROM offers GROUP BY 1"
    ),
)
def brand_inference(spark, sf):
    candidates = F.array(F.lit(" "), F.lit("Widget"), F.lit("RING"), F.lit("smal"))
    rows = offers(spark, sf).withColumn("brand", text.brand_from_title(c("brand"), c("title"), candidates))
    return rows.groupBy("brand").agg(F.count(F.lit(1)).alias("offers"))


@query("field_completeness", with_offers("SELECT slug, count(*) AS rows, count(*) FILTER (unit_price_usd > 0) AS with_price, count(brand) AS with_brand, count(seller_rating_pct) AS with_rating, count(*) FILTER (seller_name <> '') AS with_seller FROM offers GROUP BY slug"))
def field_completeness(spark, sf):
    fields = {"price": c("unit_price_usd") > 0, "brand": c("brand").isNotNull(), "rating": c("seller_rating_pct").isNotNull(), "seller": c("seller_name") != ""}
    return evaluation.field_completeness(offers(spark, sf), ["slug"], fields)


@query("vendor_rollup", with_offers("SELECT slug, run_day, count(DISTINCT vendor) AS vendors, count(*) AS offers, count(DISTINCT vendor) >= 3 AS covered FROM offers GROUP BY slug, run_day"))
def vendor_rollup(spark, sf):
    roll = evaluation.vendor_rollup(offers(spark, sf), RUN, urls.vendor_key(c("seller_name")))
    return evaluation.coverage_gate(roll, RUN).select("slug", run_day(), "vendors", "offers", "covered")


@query(
    "validate_offers",
    with_offers(
        f"""
SELECT pos, brand, {FLAGS_SQL} || CASE WHEN quantity_available IS NULL AND {MODULES_SQL} // kit_module_count > 1 THEN (CASE WHEN {FLAGS_SQL} = '' THEN '' ELSE ',' END) || 'unknown_quantity' ELSE '' END AS flags,
  CASE WHEN lower(mpn) IN (SELECT lower(p_brand || '-' || p_partkey) FROM part WHERE p_size < 20) THEN 'qvl' ELSE 'unknown' END AS qvl_status, raw_total IS NOT NULL AS has_total
FROM totals WHERE coalesce(speed_mts >= 4400, true) AND condition IN ('new', 'used')""",
        TOTAL_SQL,
    ),
)
def validate_offers(spark, sf):
    known = table(spark, sf, "part").where(c("p_size") < 20).select(F.concat(c("p_brand"), F.lit("-"), c("p_partkey").cast("string")).alias("mpn"))
    rule_list = [{"rule": "speed_mts_min", "value": 4400}, {"rule": "condition_in", "values": ["new", "used"]}]
    passed, _ = runs.validate_offers(offers(spark, sf), rule_list, FLAG_RULES, target(), known)
    return passed.select("pos", "brand", F.array_join("flags", ",").alias("flags"), "qvl_status", c("total_for_target_usd").isNotNull().alias("has_total"))


# Columns, counts and held-back offers of every run that shows something.
REPORT_SQL = """
shown_columns AS (
  SELECT slug, run_day, slug <> 'ECONOMY' AS has_condition, slug = 'ECONOMY' AND bool_or(brand IS NOT NULL) AS has_brand,
    slug = 'ECONOMY' AND bool_or(speed_mts IS NOT NULL) AS has_speed, slug <> 'ECONOMY' AND bool_or(seller_name <> '') AS has_seller,
    slug NOT IN ('ECONOMY', 'PROMO') AND bool_or(seller_rating_pct IS NOT NULL) AS has_rating
  FROM displayed GROUP BY slug, run_day
),
held AS (
  SELECT slug, run_day, vendor, count(*) - CASE WHEN slug = 'PROMO' THEN 1 ELSE 2 END AS held_back FROM flagged
  SEMI JOIN (SELECT DISTINCT slug, run_day, vendor FROM displayed) USING (slug, run_day, vendor)
  GROUP BY slug, run_day, vendor HAVING count(*) > CASE WHEN slug = 'PROMO' THEN 1 ELSE 2 END
),
sizes AS (
  SELECT r.*, s.survivor_count, d.displayed_count, 'Product ' || upper(slug[1]) || lower(slug[2:]) AS display_name
  FROM (SELECT slug, run_day, count(*) AS recall_count FROM distinct_offers GROUP BY ALL) r
  JOIN (SELECT slug, run_day, count(*) AS survivor_count FROM candidates GROUP BY ALL) s USING (slug, run_day)
  JOIN (SELECT slug, run_day, count(*) AS displayed_count FROM displayed GROUP BY ALL) d USING (slug, run_day)
)"""


@query(
    "report_payload",
    with_offers(
        """
SELECT slug, run_day, 2 AS schema_version, display_name, displayed_count, survivor_count, recall_count, 'ok' AS outcome, CASE WHEN slug = 'MEDIUM' THEN 'degraded_attr' ELSE '' END AS notes,
  count(*) AS listings, min(unit_price_usd) FILTER (rank = 1) AS first_price, string_agg(CAST(rank AS VARCHAR) || ':' || vendor, ',' ORDER BY rank) AS order_text,
  (SELECT concat_ws(',', 'price', CASE WHEN has_condition THEN 'condition' END, CASE WHEN has_brand THEN 'brand' END, CASE WHEN has_speed THEN 'speed_mts' END,
    CASE WHEN has_seller THEN 'seller' END, CASE WHEN has_rating THEN 'seller_rating' END) FROM shown_columns k WHERE k.slug = d.slug AND k.run_day = d.run_day) AS columns,
  (SELECT coalesce(string_agg(vendor || '=' || held_back, ',' ORDER BY vendor), '') FROM held h WHERE h.slug = d.slug AND h.run_day = d.run_day) AS overflow
FROM displayed d JOIN sizes USING (slug, run_day) GROUP BY ALL""",
        RUN_SQL, REPORT_SQL,
    ),
)
def report_payload(spark, sf):
    """Every part of the report document but its cost and the rest of a listing's fields (`listing_display`)."""
    p = profiles(spark, sf)
    run = runs.run_offers(offers(spark, sf), p, judges=None)
    docs = runs.build_reports(run, p).where(c("payload.displayed_count") > 0).select(run_day(), "payload.*").withColumn(
        "l", F.transform("listings", lambda d: F.from_json(d, "rank int, price_usd double, seller_name string"))
    )
    order = F.array_join(F.transform("l", lambda x: F.concat(x["rank"].cast("string"), F.lit(":"), urls.vendor_key(x["seller_name"]))), ",")
    held = F.transform(F.array_sort(F.map_entries(F.coalesce("overflow", F.create_map().cast("map<string,bigint>")))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return docs.select(
        "slug", "run_day", "schema_version", "display_name", "displayed_count", "survivor_count", "recall_count", c("outcome.class").alias("outcome"),
        F.array_join(F.transform("outcome.notes", lambda n: n["class"]), ",").alias("notes"), big(F.size("l")).alias("listings"),
        F.get("l", F.lit(0))["price_usd"].alias("first_price"), order.alias("order_text"), F.array_join("columns", ",").alias("columns"), F.array_join(held, ",").alias("overflow"),
    )


def _if(flag: str, value: str) -> str:
    return f"CASE WHEN {flag} THEN {value} END"


@query(
    "report_markdown",
    with_offers(
        """
SELECT slug, run_day, displayed_count AS shown, displayed_count + 2 AS table_lines,
  '# ' || display_name || ' — ' || run_day || chr(10) || chr(10) || CASE WHEN slug = 'MEDIUM' THEN '_{note}_' || chr(10) || chr(10) ELSE '' END
  || '**' || displayed_count || ' shown** (of ' || survivor_count || ' matched, ' || recall_count || ' found). Cheapest first.' || chr(10) || chr(10)
  || '| # | ' || any_value(concat_ws(' | ', 'Price', {heads})) || ' |' || chr(10)
  || '|' || repeat('---|', any_value(2 + has_condition::INT + has_brand::INT + has_speed::INT + has_seller::INT + has_rating::INT)) || chr(10)
  || string_agg('| ' || concat_ws(' | ', CAST(rank AS VARCHAR), regexp_replace({price}, '(\\d)(\\d\\d\\d)\\.', '\\1,\\2.'), {cells}) || ' |', chr(10) ORDER BY rank)
  || coalesce(chr(10) || chr(10) || (SELECT string_agg('_' || held_back || ' more from ' || vendor || '._', chr(10) ORDER BY vendor) FROM held h WHERE h.slug = d.slug AND h.run_day = d.run_day), '') AS markdown
FROM displayed d JOIN sizes USING (slug, run_day) JOIN shown_columns USING (slug, run_day) GROUP BY slug, run_day, display_name, displayed_count, survivor_count, recall_count""".format(
            note=K.NOTE_MESSAGES["degraded_attr"].replace("'", "''"),
            price=money_sql("unit_price_usd"),
            heads=", ".join(_if(f"has_{n}", f"'{h}'") for n, h in (("condition", "Condition"), ("brand", "Brand"), ("speed", "Speed Mts"), ("seller", "Vendor"), ("rating", "Rating"))),
            cells=", ".join([
                _if("has_condition", "condition"), _if("has_brand", "'—'"), _if("has_speed", "coalesce(CAST(speed_mts AS VARCHAR), '—')"),
                _if("has_seller", "coalesce(nullif(seller_name, ''), '—')"), _if("has_rating", "coalesce(CAST(seller_rating_pct AS VARCHAR) || '%', '—')"),
            ]),
        ),
        RUN_SQL, REPORT_SQL,
    ),
)
def report_markdown(spark, sf):
    """The whole text of every run that shows something. The text shows extracted attributes, so a seller's brand reads unknown."""
    p = profiles(spark, sf)
    run = runs.run_offers(offers(spark, sf), p, judges=None)
    docs = runs.report_markdown(runs.build_reports(run, p), run["displayed"]).where(~c("markdown").contains("_No listings to show._"))
    lines = F.size(F.filter(F.split("markdown", "\n"), lambda s: s.startswith("|")))
    shown = text.hit(c("markdown"), r"\*\*(\d+) shown\*\*", 1).cast("bigint")
    return docs.select("slug", run_day(), shown.alias("shown"), big(lines).alias("table_lines"), "markdown")


@query(
    "rendered_report_table",
    with_offers(
        """
SELECT slug, run_day, count(*) AS rows, '**Ranked listings.**' || repeat(chr(10), 2) || '| Rank | Source | Title | Price | Total for target | Qty | Seller | Flags |' || chr(10) || '|' || repeat('---|', 8) || chr(10)
  || string_agg('| ' || rank || ' | [' || CASE WHEN source = 'universal_ai_search' THEN host ELSE source END || '](' || url || ') | ' || title || ' | ' || {shown} || ' | ' || coalesce({total}, 'unknown')
  || ' | ' || coalesce(CAST(quantity_available AS VARCHAR), 'unknown') || ' | ' || coalesce(nullif(seller_name, ''), 'unknown') || ' | (no flags) |', chr(10) ORDER BY rank) AS table_md
FROM (SELECT *, row_number() OVER (PARTITION BY slug, run_day ORDER BY raw_total IS NULL, coalesce(raw_total, unit_price_usd), pos) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY slug, run_day ORDER BY k > 3, raw_total IS NULL, coalesce(raw_total, unit_price_usd), pos) AS pick FROM (
    SELECT *, row_number() OVER (PARTITION BY slug, run_day, source, CASE WHEN source = 'universal_ai_search' THEN host END
      ORDER BY raw_total IS NULL, coalesce(raw_total, unit_price_usd), pos) AS k FROM totals)) WHERE pick <= 30)
GROUP BY slug, run_day""".format(shown=money_sql("CASE WHEN is_kit THEN kit_price_usd ELSE unit_price_usd END"), total=money_sql("raw_total")),
        TOTAL_SQL,
    ),
)
def rendered_report_table(spark, sf):
    """The whole table text of every run."""
    made = display.rendered_table(ranking.rank_for_report(raw_totals(offers(spark, sf))))
    return made.select("slug", run_day(), big(F.size(text.table_rows(c("table_md")))).alias("rows"), "table_md")


@query("row_json_round_trip", with_offers("SELECT pos, title, unit_price_usd, capacity_gb, run_day || 'T' || lpad(CAST(hour AS VARCHAR), 2, '0') AS fetched FROM offers"))
def row_json_round_trip(spark, sf):
    from offerloom.schema import OFFER_DDL

    back = offers(spark, sf).select(F.to_json(F.struct("*")).alias("j")).select(F.from_json("j", OFFER_DDL).alias("o")).select("o.*")
    return back.select("pos", "title", "unit_price_usd", rules.capacity().alias("capacity_gb"), F.date_format("fetched_at", "yyyy-MM-dd'T'HH").alias("fetched"))
