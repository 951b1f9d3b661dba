"""Tables that are written to real files and read again: snapshots, history, verdict log, reports, streams, sinks."""

import uuid

from pyspark.sql import functions as F

from offerloom.functions import money
from offerloom.operators import alerts, history, ranking, rules
from offerloom.plans import runs
from offerloom.queries.alert_queries import EVAL_SQL, alert_rules, gold, price_sql, run_day, sizes, trial_verdicts, with_events
from offerloom.queries.base import REGISTRY, RUN_SQL, big, day, event_offers, offers, profiles, query, spread, table, with_offers
from offerloom.queries.calendar_queries import _stored
from offerloom.queries.offer_queries import FLAG_RULES, LATEST_SQL, TOTAL_SQL, target
from offerloom.session import checkpoint_root, durable
from offerloom.sources import tables
from offerloom.streaming import runs as streams

c = F.col
RUN = ["slug", "run_ts"]


def new_folder(spark) -> str:
    return f"{checkpoint_root(spark)}/stored/{uuid.uuid4().hex}"


def each_batch(spark, df, writer) -> None:
    """Drain a stream through a foreachBatch writer."""
    q = df.writeStream.foreachBatch(writer).option("checkpointLocation", new_folder(spark)).trigger(availableNow=True).start()
    q.awaitTermination()


@query("snapshot_csv_files", with_offers(
    "SELECT slug, run_day, source, url, title, brand, mpn, condition, is_kit, unit_price_usd, quantity_available, seller_name, hour FROM offers"))
def snapshot_csv_files(spark, sf):
    """CSV folders per product and run, written twice: the second write replaces the first."""
    path, o = new_folder(spark), durable(offers(spark, sf))
    for _ in range(2):
        tables.write_snapshot_csv(o, path)
    back = tables.read_written_csv(spark, path)
    return back.select("slug", run_day(), "source", "url", "title", "brand", "mpn", "condition", "is_kit", "unit_price_usd", "quantity_available", "seller_name", big(F.hour("fetched_at")).alias("hour"))


@query("history_table_files", with_offers("""
SELECT slug, url, run_day, hour, pos, unit_price_usd FROM (
  SELECT *, row_number() OVER (PARTITION BY slug, url, run_day, hour ORDER BY gen DESC, pos DESC) AS no FROM (
    SELECT *, 0 AS gen FROM offers WHERE source <> 'ebay_search' UNION ALL
    SELECT * REPLACE (unit_price_usd * 2 AS unit_price_usd), 1 AS gen FROM offers WHERE condition = 'new' AND run_day < '1996-01-01')) WHERE gen = 0 OR no = 1)
""".replace("WHERE gen = 0 OR no = 1)", "WHERE no = 1")))
def history_table_files(spark, sf):
    """The stored history after two upserts; the second one touches some days only, and is replayed."""
    path, o = new_folder(spark), offers(spark, sf)
    tables.upsert_history(spark, o.where(c("source") != "ebay_search"), path)
    dearer = o.where((c("condition") == "new") & (c("run_ts") < "1996-01-01")).withColumn("unit_price_usd", c("unit_price_usd") * 2)
    for _ in range(2):
        tables.upsert_history(spark, dearer, path)
    back = spark.read.parquet(path)
    # Days without a second upsert still hold what the first one wrote, repeated keys included.
    once = history.upsert(back.limit(0), back)
    return once.select("slug", "url", run_day(), F.hour("fetched_at").alias("hour"), "pos", "unit_price_usd")


@query("verdict_log_files", """
SELECT 'daily' AS log, source AS product, doc_id % 3 AS run, count(*) AS rows, count(*) FILTER (n_chars % 2 = 0) AS passed, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL
UNION ALL SELECT 'latest', source, 2, count(*), count(*) FILTER (n_chars % 2 = 0), sum(n_chars)::BIGINT FROM documents WHERE doc_id % 3 = 2 GROUP BY source""")
def verdict_log_files(spark, sf):
    """Three runs per product logged one after another, each written twice."""
    daily, latest = new_folder(spark), new_folder(spark)
    for run in (0, 1, 1, 2, 2):
        d = table(spark, sf, "documents").where(c("doc_id") % 3 == run)
        none = F.lit(None).cast("string")
        rows = d.select(
            F.lit(f"2024-01-01 0{run}:00:00").cast("timestamp").alias("timestamp"), c("source").alias("product"), c("doc_id").cast("int").alias("index"), (c("n_chars") % 2 == 0).alias("pass"),
            c("lang").alias("reason"), F.lit("t").alias("title"), c("n_chars").cast("double").alias("price"), none.alias("url"), none.alias("source"), none.alias("source_url"),
        )
        tables.write_verdict_log(rows, daily, latest)
    both = tables.read_verdict_log(spark, daily).withColumn("log", F.lit("daily")).unionByName(tables.read_verdict_log(spark, latest).withColumn("log", F.lit("latest")), allowMissingColumns=True)
    return both.groupBy("log", "product", big(F.hour("timestamp")).alias("run")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("pass").alias("passed"), big(F.sum("price")).alias("chars"))


@query("report_files", with_offers("SELECT slug, max(run_day) AS snapshot_day, count(DISTINCT run_day) AS dates, 'claude-haiku-4-5' AS filter_model FROM displayed GROUP BY slug", RUN_SQL))
def report_files(spark, sf):
    """Reports of a whole run with its cost steps, stored and read back as card rows of the newest date."""
    p = profiles(spark, sf)
    run = runs.run_offers(offers(spark, sf), p, judges=None)
    kept = run["displayed"].select(*RUN).distinct()
    calls = kept.select(*RUN, F.lit("ai_filter").alias("step"), F.lit("anthropic").alias("provider"), F.lit("claude-haiku-4-5").alias("model"), *[F.lit(10).cast("bigint").alias(t) for t in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")], F.lit(None).cast("double").alias("cost_usd"))
    path = new_folder(spark)
    reports = runs.build_reports(run, p, calls).join(kept, RUN, "left_semi")
    tables.write_reports(reports, path)
    cards = tables.report_cards(tables.read_reports(spark, path))
    return cards.groupBy("slug").agg(day(F.max("snapshot_date")).alias("snapshot_day"), F.count_distinct("snapshot_date").alias("dates"), F.max("filter_model").alias("filter_model"))


@query("stream_latest_per_day", with_offers("SELECT slug, url, run_day, pos, unit_price_usd FROM latest", LATEST_SQL))
def stream_latest_per_day(spark, sf):
    """Streamed offers kept as one row per URL and day in a stored table."""
    path = new_folder(spark)
    each_batch(spark, _stored(spark, offers(spark, sf)), streams.latest_writer(path))
    return spark.read.parquet(path).select("slug", "url", day(c("snapshot_date")).alias("run_day"), "pos", "unit_price_usd")


@query("stream_alert_sink", with_events("SELECT slug, run_day, price, 'ok' AS outcome FROM b WHERE below AND NOT coalesce(was, false)", price_sql("sold_price", "condition = 'used'", 25)))
def stream_alert_sink(spark, sf):
    """Fired alerts with their delivery outcome, as the sink stores them."""
    o = event_offers(spark, sf)
    priced = alerts.rule_prices(alerts.run_prices(o), alert_rules(spark, sf).where(c("rule_pos") == 1), history.previous_runs(o))
    rows = priced.withColumn("fingerprint", alerts.fingerprint()).select("slug", "rule_pos", "fingerprint", "mode", "threshold_usd", "run_ts", "price")
    path = new_folder(spark)
    each_batch(spark, streams.price_alert_stream(_stored(spark, rows)), streams.alert_writer(path))
    return spark.read.parquet(path).select("slug", run_day(), "price", "outcome")


@query("recall_and_run", with_offers("SELECT slug, run_day, rank, vendor, url, pos FROM displayed", RUN_SQL))
def recall_and_run(spark, sf):
    """The run with an injected recall, which sees the profiles."""
    run = runs.recall_and_run(lambda p: offers(spark, sf).join(p.select("slug"), "slug", "left_semi"), profiles(spark, sf), judges=None)
    return run["displayed"].select("slug", run_day(), big(c("rank")).alias("rank"), "vendor", "url", "pos")


@query("synthesis_changes", with_offers("""
SELECT slug, run_day, change_type AS section, url, CASE WHEN change_type <> 'new' THEN old_price_usd END AS old_price_usd, CASE WHEN change_type <> 'dropped' THEN new_price_usd END AS new_price_usd,
  CASE WHEN change_type = 'changed' THEN CAST(round(pct_change * 10000) AS BIGINT) END AS pct_e4 FROM changes""", LATEST_SQL))
def synthesis_changes(spark, sf):
    """Diff rows of the report input."""
    diff, _ = runs.diff_latest(offers(spark, sf), newest_only=False, details=())
    rows = runs.change_rows(diff)
    return rows.select("slug", day(c("snapshot_date")).alias("run_day"), "section", "url", "old_price_usd", "new_price_usd", F.round(c("pct_change") * 10000).cast("bigint").alias("pct_e4"))


@query("synthesis_payload", with_offers("""
SELECT o.slug, o.run_day, least(count(*), 30) AS listings, 'Best ' || o.slug AS display_name, any_value(coalesce(new_count, 0)) AS new_count, any_value(coalesce(dropped_count, 0)) AS dropped_count, any_value(coalesce(changed_count, 0)) AS changed_count,
  any_value(d.changes) IS NOT NULL AS has_diff, o.slug AS product_slug, 'count' AS target_unit, CAST(length(o.slug) AS INT) AS target_amount, 'Name the cheapest ' || o.slug || '|Be brief' AS hints
FROM offers o LEFT JOIN (SELECT slug, run_day, count(*) AS changes FROM changes GROUP BY ALL) d ON d.slug = o.slug AND d.run_day = o.run_day LEFT JOIN (SELECT slug, run_day, count(*) FILTER (change_type = 'new') AS new_count, count(*) FILTER (change_type = 'dropped') AS dropped_count, count(*) FILTER (change_type = 'changed') AS changed_count FROM changes GROUP BY ALL) x
  ON x.slug = o.slug AND x.run_day = o.run_day GROUP BY o.slug, o.run_day""", LATEST_SQL))
def synthesis_payload(spark, sf):
    """Report input per run: ranked rows and what changed; a run without a diff has no counts."""
    o = offers(spark, sf)
    diff, _ = runs.diff_latest(o, newest_only=False, details=())
    named = o.select("slug").distinct().select(
        "slug", F.concat(F.lit("Best "), c("slug")).alias("display_name"), F.struct(F.lit("count").alias("unit"), F.length("slug").alias("amount")).alias("target"),
        F.array(F.concat(F.lit("Name the cheapest "), c("slug")), F.lit("Be brief")).alias("synthesis_hints"),
    )
    made = runs.synthesis_payload(ranking.rank_for_report(o), diff.withColumn("run_ts", F.date_trunc("month", c("snapshot_date").cast("timestamp"))), named)
    n = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return made.select("slug", run_day(), big(F.size("listings")).alias("listings"), "display_name", n("new_count"), n("dropped_count"), n("changed_count"),
        c("new_count").isNotNull().alias("has_diff"), c("product.slug").alias("product_slug"), c("product.target.unit").alias("target_unit"), c("product.target.amount").alias("target_amount"),
        F.array_join("product.synthesis_hints", "|").alias("hints"),
    )


@query("profile_load_bounds", """
SELECT 'part-' || p_partkey AS slug, CASE p_partkey % 5 WHEN 1 THEN 'display.max_listings must be positive' WHEN 2 THEN 'sources.amazon.priority must be standard or live'
  WHEN 3 THEN 'sources.serper.num must be positive' WHEN 4 THEN 'filters.min_quantity must be positive' ELSE '' END AS problem FROM part""")
def profile_load_bounds(spark, sf):
    """Profile documents of which four in five break one bound."""
    p = spread(spark, table(spark, sf, "part").select("p_partkey"), "p_partkey")
    k = c("p_partkey") % 5
    slug = F.concat(F.lit("part-"), c("p_partkey").cast("string"))
    odd = F.when(k == 1, "display:\n  max_listings: 0\n").when(k == 2, "sources:\n  amazon:\n    enabled: true\n    priority: rush\n").when(k == 3, "sources:\n  serper:\n    num: -5\n").when(k == 4, "filters:\n  min_quantity: 0\n").otherwise("")
    body = F.concat(F.lit("schema_version: 2\nslug: "), slug, F.lit("\ndisplay_name: x\ntarget:\n  unit: count\n  amount: 1\nqueries:\n  - one\n"), odd)
    docs = p.select(slug.alias("path"), body.alias("document")).mapInPandas(tables._yaml_to_json, "path string, document string, json string, error string")
    good, bad = tables.load_profiles(docs)
    return good.select("slug", F.lit("").alias("problem")).unionByName(bad.select(c("path").alias("slug"), c("reason").alias("problem")))


@query("profile_flags", REGISTRY["soft_flags"].sql)
def profile_flags(spark, sf):
    """The flag rules as a column of each product, so that one job flags all of them."""
    o = offers(spark, sf)
    lists = o.select("slug").distinct().withColumn("flag_rules", F.array(*[rules.flag_literal(r) for r in FLAG_RULES]))
    flagged = rules.with_flags(o.join(lists, "slug"), rules.raised_flags_from(c("flag_rules")))
    return flagged.select("pos", F.array_join("flags", ",").alias("flags"))


@query("total_rounded", with_offers("SELECT pos, CAST(round(CAST(CAST(raw_total AS VARCHAR) AS DECIMAL(38, 12)), 2) * 100 AS BIGINT) AS cents FROM totals WHERE raw_total IS NOT NULL", TOTAL_SQL))
def total_rounded(spark, sf):
    """Totals as the operator gives them: rounded half up to cents on the decimal value, as the README states."""
    total = money.total_for_target(target(), rules.capacity(), c("is_kit"), c("kit_module_count"), c("kit_price_usd"), c("unit_price_usd"), c("quantity_available"))
    return offers(spark, sf).withColumn("total", total).where("total IS NOT NULL").select("pos", F.round(c("total") * 100).cast("bigint").alias("cents"))


@query("judge_f1", "WITH " + EVAL_SQL.strip() + """
SELECT slug, model, CAST(round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END * 1000000) AS BIGINT) AS f1_e6 FROM scores""")
def judge_f1(spark, sf):
    e = runs.evaluate_judges(trial_verdicts(spark, sf), gold(spark, sf), sizes(spark, sf))
    return e.select("slug", "model", F.round(c("f1") * 1_000_000).cast("bigint").alias("f1_e6"))


@query("material_headline_price", with_offers("""
SELECT s.slug, s.run_day, CAST(round(CAST(CAST(a.lowest AS VARCHAR) AS DECIMAL(38, 12)), 2) * 100 AS BIGINT) AS cents
FROM steps s JOIN (SELECT slug, run_day, min(unit_price_usd) AS lowest FROM latest GROUP BY ALL) a USING (slug, run_day)
JOIN (SELECT slug, run_day AS previous_day, min(unit_price_usd) AS lowest FROM latest GROUP BY ALL) b USING (slug, previous_day)""", LATEST_SQL))
def material_headline_price(spark, sf):
    """The lowest price of every step, as a headline would state it."""
    _, heads = runs.diff_latest(offers(spark, sf), newest_only=False, details=())
    text = history.headline(F.lit(0), F.lit(0), c("lowest"), F.lit(float("inf")))
    stated = F.regexp_extract(text, r"\$([0-9.]+)$", 1).cast("decimal(20,2)")
    return heads.select("slug", day(c("snapshot_date")).alias("run_day"), (stated * 100).cast("bigint").alias("cents"))
