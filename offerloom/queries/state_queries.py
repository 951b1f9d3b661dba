"""Relative ranks, mergeable day states, table versions, and streams whose state ends."""

from pyspark.sql import functions as F

from offerloom.functions import urls
from offerloom.operators import alerts, history, sketches, skew
from offerloom.queries.alert_queries import alert_rules, price_sql, with_events
from offerloom.queries.base import event_offers, offers, query, with_offers
from offerloom.queries.calendar_queries import _stored, drain
from offerloom.queries.stored_queries import new_folder, run_day
from offerloom.sources import versions
from offerloom.streaming import runs as streams

c = F.col
RUN = ["slug", "run_ts"]
QUANTILES = {"low_usd": 0.1, "median_usd": 0.5, "high_usd": 0.9}
GONE = "2024-01-15"  # products with an even number end the day before and come back


@query("price_relative_ranks", with_offers("""
SELECT pos, percent_rank() OVER (PARTITION BY slug ORDER BY unit_price_usd) AS percent_rank, cume_dist() OVER (PARTITION BY slug ORDER BY unit_price_usd) AS cume_dist,
  CAST(ntile(7) OVER (PARTITION BY slug ORDER BY unit_price_usd, pos) AS INT) AS tile FROM offers"""))
def price_relative_ranks(spark, sf):
    """Where each offer's price stands among all offers of its product."""
    rows = offers(spark, sf).select("slug", "pos", "unit_price_usd")
    return skew.relative_ranks(rows, ["slug"], "unit_price_usd", [c("pos")], 7).select("pos", "percent_rank", "cume_dist", "tile")


@query("price_relative_ranks_all", with_offers("""
SELECT pos, percent_rank() OVER (ORDER BY unit_price_usd) AS percent_rank, cume_dist() OVER (ORDER BY unit_price_usd) AS cume_dist,
  CAST(ntile(100) OVER (ORDER BY unit_price_usd, pos) AS INT) AS tile FROM offers"""))
def price_relative_ranks_all(spark, sf):
    """The same with all rows in one key."""
    rows = offers(spark, sf).select(F.lit("all").alias("slug"), "pos", "unit_price_usd")
    return skew.relative_ranks(rows, ["slug"], "unit_price_usd", [c("pos")], 100).select("pos", "percent_rank", "cume_dist", "tile")


def vendor_states(spark, sf):
    """Day states of all offers, stored, and the offers."""
    o = offers(spark, sf)
    path = new_folder(spark)
    sketches.day_states(o, RUN, urls.vendor_key(c("seller_name"))).write.parquet(path)
    return spark.read.parquet(path), o


@query("sketched_vendors_and_prices", with_offers("""
SELECT slug, count(*) AS offers, count(unit_price_usd) AS priced, count(DISTINCT vendor) AS exact_vendors, true AS vendors_close, true AS prices_close FROM offers GROUP BY slug"""))
def sketched_vendors_and_prices(spark, sf):
    """Stored day states merged per product, with their distance from the exact result: at most 4 % of vendors, 2 % of ranks."""
    states, o = vendor_states(spark, sf)
    merged = sketches.estimates(sketches.merge_states(states, ["slug"]), QUANTILES)
    errors = sketches.estimate_errors(o, ["slug"], urls.vendor_key(c("seller_name")), merged, QUANTILES)
    return merged.select("slug", "offers", "priced").join(errors, "slug").select(
        "slug", "offers", "priced", "exact_vendors", (c("vendor_error") <= 0.04).alias("vendors_close"), (c("rank_error") <= 0.02).alias("prices_close"))


@query("sketched_years", with_offers("""
SELECT slug, CAST(year(run_date) AS INT) AS year, count(*) AS offers, count(DISTINCT vendor) AS exact_vendors, true AS vendors_close, true AS prices_close FROM offers GROUP BY ALL"""))
def sketched_years(spark, sf):
    """The same per product and year: days merge into any span."""
    states, o = vendor_states(spark, sf)
    keys = ["slug", "year"]
    merged = sketches.estimates(sketches.merge_states(states.withColumn("year", F.year("run_ts")), keys), QUANTILES)
    errors = sketches.estimate_errors(o.withColumn("year", F.year("run_ts")), keys, urls.vendor_key(c("seller_name")), merged, QUANTILES)
    return merged.select(*keys, "offers").join(errors, keys).select(
        *keys, "offers", "exact_vendors", (c("vendor_error") <= 0.04).alias("vendors_close"), (c("rank_error") <= 0.02).alias("prices_close"))


@query("history_versions", with_offers("""
SELECT 1 AS version, run_day, count(*) AS offers, max(unit_price_usd) AS high FROM offers WHERE source <> 'ebay_search' GROUP BY run_day
UNION ALL SELECT 2, run_day, count(*), max(price) FROM (
  SELECT run_day, unit_price_usd AS price FROM offers WHERE source <> 'ebay_search' UNION ALL SELECT run_day, unit_price_usd * 2 FROM offers WHERE condition = 'new' AND run_day < '1996-01-01') GROUP BY run_day
UNION ALL SELECT 3, run_day, count(*), max(price) FROM (
  SELECT run_day, unit_price_usd AS price FROM offers WHERE source <> 'ebay_search' AND run_day >= '1996-01-01' UNION ALL SELECT run_day, unit_price_usd * 2 FROM offers WHERE condition = 'new' AND run_day < '1996-01-01') GROUP BY run_day"""))
def history_versions(spark, sf):
    """Three batches, each a version that stays readable: all days, some days added to, the same days replaced."""
    path = new_folder(spark)
    o = offers(spark, sf).withColumn("snapshot_date", F.to_date("run_ts"))
    dearer = o.where((c("condition") == "new") & (c("run_ts") < "1996-01-01")).withColumn("unit_price_usd", c("unit_price_usd") * 2)
    versions.publish(spark, o.where(c("source") != "ebay_search"), path)
    versions.publish(spark, dearer, path, lambda old, new: old.unionByName(new))
    versions.publish(spark, dearer, path)
    read = [versions.read(spark, path, o.schema, no).withColumn("version", F.lit(no)) for no in (1, 2, 3)]
    rows = read[0].unionByName(read[1]).unionByName(read[2])
    return rows.groupBy("version", F.date_format("snapshot_date", "yyyy-MM-dd").alias("run_day")).agg(F.count(F.lit(1)).alias("offers"), F.max("unit_price_usd").alias("high"))


LIVES_SQL = f"lives AS (SELECT *, CAST(slug AS INT) % 2 = 0 AND run_day >= '{GONE}' AS back FROM ev)"


@query("stream_ending_prices", with_events(
    f"SELECT slug, run_day, price FROM (SELECT *, lag(coalesce(below, false)) OVER (PARTITION BY slug, CAST(slug AS INT) % 2 = 0 AND run_day >= '{GONE}' ORDER BY run_day) AS held FROM b) WHERE below AND NOT coalesce(held, false)",
    price_sql("sold_price", "condition = 'used'", 25)))
def stream_ending_prices(spark, sf):
    """The stateful price alert where rules of even products end and come back armed."""
    o = event_offers(spark, sf)
    priced = alerts.rule_prices(alerts.run_prices(o), alert_rules(spark, sf).where(c("rule_pos") == 1), history.previous_runs(o))
    rows = priced.withColumn("fingerprint", alerts.fingerprint()).select("slug", "rule_pos", "fingerprint", "mode", "threshold_usd", "run_ts", "price", F.lit(False).alias("gone"))
    rules = rows.where(c("slug").cast("int") % 2 == 0).groupBy("slug", "rule_pos", "fingerprint").agg(F.max("mode").alias("mode"), F.max("threshold_usd").alias("threshold_usd"))
    gone = rules.select("*", F.expr(f"timestamp'{GONE}' - interval 1 hour").alias("run_ts"), F.lit(None).cast("double").alias("price"), F.lit(True).alias("gone"))
    fired = drain(spark, streams.ending_price_alerts(_stored(spark, rows.unionByName(gone)))).where("fires")
    return fired.select("slug", run_day(), "price")


@query("stream_ending_hosts", with_events("""
SELECT slug, run_day, host FROM hosts h WHERE NOT EXISTS (SELECT 1 FROM hosts p WHERE p.slug = h.slug AND p.back = h.back AND p.host = h.host AND p.step_no = h.step_no - 1)""",
    LIVES_SQL, """
steps AS (SELECT slug, run_day, row_number() OVER (PARTITION BY slug ORDER BY run_day) AS step_no FROM (SELECT DISTINCT slug, run_day FROM ev)),
hosts AS (SELECT DISTINCT slug, run_day, host, back, step_no FROM lives JOIN steps USING (slug, run_day))"""))
def stream_ending_hosts(spark, sf):
    """New hosts per run with one state entry per host; even products end and start anew."""
    rows = alerts.run_hosts(event_offers(spark, sf)).select("slug", "run_ts", "host", F.lit(False).alias("gone"))
    even = rows.where(c("slug").cast("int") % 2 == 0).select("slug").distinct()
    gone = even.select("slug", F.expr(f"timestamp'{GONE}' - interval 1 hour").alias("run_ts"), F.lit(None).cast("string").alias("host"), F.lit(True).alias("gone"))
    return drain(spark, streams.ending_host_arrivals(_stored(spark, rows.unionByName(gone)))).where(~c("late")).select("slug", run_day(), "host")
