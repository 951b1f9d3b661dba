"""Queries on schedules, the catalogue and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from offerloom.functions import schedule as S
from offerloom.operators import alerts, catalog, history, schedules, windows
from offerloom.plans import runs
from offerloom.queries.alert_queries import HOSTS_SQL, alert_rules, price_sql, with_events
from offerloom.queries.base import big, day, event_offers, query, spread, table
from offerloom.session import checkpoint_root, shuffles_end
from offerloom.sources import tables
from offerloom.queries.source_queries import report_texts
from offerloom.streaming import runs as streams

c = F.col
RUN = ["slug", "run_ts"]

def run_day():
    return day(c("run_ts")).alias("run_day")



def cron_rows(spark, sf):
    """One schedule per part: daily, stepped, weekly list, day-of-month or day-of-week, invalid, or one-shot."""
    p = spread(spark, table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    n = lambda m: (c("p_partkey") % m).cast("string")
    k = c("p_partkey") % 6
    cron = (
        F.when(k == 0, F.concat_ws(" ", n(60), n(24), F.lit("* * *"))).when(k == 1, F.concat(F.lit("*/20 "), n(24), F.lit("-23/5 * * *")))
        .when(k == 2, F.concat_ws(" ", n(60), F.lit("6,18 * * 1-5,7"))).when(k == 3, F.concat(n(60), F.lit(" 12 "), (c("p_partkey") % 28 + 1).cast("string"), F.lit(" * 3")))
        .when(k == 4, "61 6 * * *")
    )
    ts = F.timestamp_add("MINUTE", (c("p_partkey") * 37 % 43200).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    return p.select(c("p_partkey").cast("string").alias("slug"), cron.alias("cron"), F.when(k == 5, ts).alias("run_at"))


CRON_SQL = """
s AS (SELECT p_partkey AS k, p_partkey % 6 AS kind FROM part),
ticks AS (SELECT DISTINCT time_bucket(INTERVAL 15 minutes, ts) AS tick FROM events),
minutes AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-31 00:00:00', TIMESTAMP '2024-02-01 00:00:00', INTERVAL 1 minute)) AS t),
fires AS (
  SELECT k, t FROM s, minutes WHERE kind < 4 AND CASE kind
    WHEN 0 THEN minute(t) = k % 60 AND hour(t) = k % 24
    WHEN 1 THEN minute(t) % 20 = 0 AND hour(t) >= k % 24 AND (hour(t) - k % 24) % 5 = 0
    WHEN 2 THEN minute(t) = k % 60 AND hour(t) IN (6, 18) AND dayofweek(t) <> 6
    ELSE minute(t) = k % 60 AND hour(t) = 12 AND (day(t) = k % 28 + 1 OR dayofweek(t) = 3) END
)"""


def ticks(spark, sf):
    quarter = F.timestamp_seconds(F.floor(F.unix_seconds(c("ts").cast("timestamp")) / 900) * 900)
    return table(spark, sf, "events").select(quarter.alias("tick")).distinct()


@query("cron_due_runs", "WITH " + CRON_SQL.strip() + """
SELECT DISTINCT CAST(k AS VARCHAR) AS slug, strftime(tick, '%Y-%m-%d %H:%M') AS tick FROM fires JOIN ticks ON t > tick - INTERVAL 15 minutes AND t <= tick""")
def cron_due_runs(spark, sf):
    due = schedules.due_runs(cron_rows(spark, sf).where(c("cron").isNotNull()), ticks(spark, sf))
    return due.select("slug", F.date_format("tick", "yyyy-MM-dd HH:mm").alias("tick"))


@query("one_shot_runs", "WITH " + CRON_SQL.strip() + """,
once AS (SELECT CAST(k AS VARCHAR) AS slug, TIMESTAMP '2024-01-01' + to_minutes(k * 37 % 43200) AS run_at FROM s WHERE kind = 5 AND k % 4 <> 1)
SELECT slug, strftime(min(tick), '%Y-%m-%d %H:%M') AS tick FROM once JOIN ticks ON tick >= run_at GROUP BY slug""")
def one_shot_runs(spark, sf):
    rows = cron_rows(spark, sf).where(c("run_at").isNotNull())
    done = rows.where(c("slug").cast("bigint") % 4 == 1)
    due = schedules.due_runs(rows, ticks(spark, sf), done)
    return due.where(c("reason") == "run_at").select("slug", F.date_format("tick", "yyyy-MM-dd HH:mm").alias("tick"))


@query("next_runs", "WITH " + CRON_SQL.strip() + """
,
due AS (SELECT k, min(t) AS t FROM fires WHERE t > TIMESTAMP '2024-01-02 11:30:00' GROUP BY k),
once AS (SELECT k, TIMESTAMP '2024-01-01' + to_minutes(k * 37 % 43200) AS t FROM s WHERE kind = 5)
SELECT CAST(k AS VARCHAR) AS slug, strftime(CASE WHEN once.t > TIMESTAMP '2024-01-02 11:30:00' THEN once.t ELSE due.t END, '%Y-%m-%d %H:%M') AS next_run
FROM s LEFT JOIN due USING (k) LEFT JOIN once USING (k)""")
def next_runs(spark, sf):
    """Every schedule: a day of the month or of the week, invalid crons and one-shot times that have passed (null) as well."""
    rows = cron_rows(spark, sf)
    after = F.lit("2024-01-02 11:30:00").cast("timestamp")
    return schedules.next_runs(rows, after).select("slug", F.date_format("next_run", "yyyy-MM-dd HH:mm").alias("next_run"))


@query("local_schedules", """
SELECT p_partkey, (p_partkey % 60) || ' ' || ((p_partkey % 24 + 5) % 24) || ' * * *' AS daily, CASE WHEN p_partkey % 24 >= 19 THEN '2,6' ELSE '1,5' END AS weekly_days,
  lpad(CAST(p_partkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0') AS local_again FROM part""")
def local_schedules(spark, sf):
    """Local wall times in New York (UTC-5 in January) to stored UTC crons, and back."""
    zone, at = F.lit("America/New_York"), F.lit("2024-01-10").cast("date")
    p = table(spark, sf, "part").select("p_partkey")
    hhmm = F.concat((c("p_partkey") % 24).cast("string"), F.lit(":"), F.lpad((c("p_partkey") % 60).cast("string"), 2, "0"))
    daily = S.daily_to_cron(at, hhmm, zone)
    weekly = S.weekly_to_cron(at, hhmm, F.array(F.lit(1), F.lit(5)), zone)
    return p.select("p_partkey", daily.alias("daily"), F.substring_index(weekly, " ", -1).alias("weekly_days"), S.local_time(daily, zone, at).alias("local_again"))


@query("schedule_texts", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Every 15 minutes' WHEN 1 THEN 'Every day at ' || CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END || ':' || lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0') || CASE WHEN h < 12 THEN ' AM' ELSE ' PM' END || ' (your time)'
  WHEN 2 THEN 'Weekdays at 8:30 AM (your time)' WHEN 3 THEN 'Every week on Mon, Wed at 8:30 AM (your time)' WHEN 4 THEN 'Advanced schedule (cron 5 4 1 * *, UTC)' ELSE 'Runs only on demand (when you click Run now).' END AS description
FROM (SELECT p_partkey, p_partkey % 24 AS h FROM part)""")
def schedule_texts(spark, sf):
    k = c("p_partkey") % 6
    daily = F.concat_ws(" ", (c("p_partkey") % 60).cast("string"), ((c("p_partkey") % 24 + 5) % 24).cast("string"), F.lit("* * *"))
    cron = F.when(k == 0, "*/15 * * * *").when(k == 1, daily).when(k == 2, "30 13 * * 1,2,3,4,5").when(k == 3, "30 13 * * 1,3").when(k == 4, "5 4 1 * *")
    text = S.schedule_text(cron, F.lit(None).cast("timestamp"), F.lit("America/New_York"), F.lit("2024-01-10").cast("date"))
    return table(spark, sf, "part").select("p_partkey", text.alias("description"))


# --- catalogue --------------------------------------------------------------------------------------


@query("product_catalogue", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS slug FROM events UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey <> 1")
def product_catalogue(spark, sf):
    reports = table(spark, sf, "events").select(c("user_id").cast("string").alias("slug"))
    profile_slugs = table(spark, sf, "customer").select(F.when(c("c_custkey") == 1, "_template").otherwise(c("c_custkey").cast("string")).alias("slug"))
    return catalog.products(reports, profile_slugs)


@query("run_interval_match", """
SELECT a.event_id AS run_id, b.event_id AS log_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000""")
def run_interval_match(spark, sf):
    e = table(spark, sf, "events").select("event_id", c("user_id").cast("string").alias("slug"), c("ts").cast("timestamp").alias("ts"), "event_type")
    instants = e.where(c("event_type") == "view").select("slug", c("ts").alias("run_ts"), c("event_id").alias("run_id"))
    log = e.where(c("event_type") == "click").select("slug", c("ts").alias("completed_at"), c("event_id").alias("log_id"))
    return catalog.match_runs(instants, log).select("run_id", "log_id")


@query("run_same_as_last", """
WITH v AS (SELECT user_id, max(ts) AS a FROM events WHERE event_type = 'view' GROUP BY 1), k AS (SELECT user_id, max(ts) AS b FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS slug, coalesce(abs(epoch_us(a) - epoch_us(b)) <= 600000000, false) AS same FROM v LEFT JOIN k USING (user_id)""")
def run_same_as_last(spark, sf):
    """One latest instant against one last completed run per product."""
    e = table(spark, sf, "events").select(c("user_id").cast("string").alias("slug"), c("ts").cast("timestamp").alias("ts"), "event_type")
    instants = e.where(c("event_type") == "view").select("slug", c("ts").alias("run_ts"))
    done = e.where(c("event_type") == "click").select("slug", c("ts").alias("completed_at"))
    return catalog.same_last_run(instants, done).select("slug", "same")


@query("run_durations", """
WITH r AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS d, min(ts) FILTER (event_type = 'view') AS s, min(ts) FILTER (event_type = 'purchase') AS g FROM events GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS slug, d AS run_day, epoch_us(g) - epoch_us(s) AS micros, strftime(greatest(s, g), '%Y-%m-%d %H:%M:%S') AS last_run FROM r WHERE epoch_us(g) - epoch_us(s) > 0 AND epoch_us(g) - epoch_us(s) < 1800000000""")
def run_durations(spark, sf):
    e = table(spark, sf, "events").select(c("user_id").cast("string").alias("slug"), c("ts").cast("timestamp").alias("ts"), "event_type")
    first = lambda kind: F.min(F.when(c("event_type") == kind, c("ts")))
    r = e.groupBy("slug", day(c("ts")).alias("run_day")).agg(first("view").alias("s"), first("purchase").alias("g"))
    seconds = catalog.run_duration(c("g"), c("s"))
    return r.where(seconds.isNotNull()).select("slug", "run_day", F.round(seconds * 1e6).cast("bigint").alias("micros"), F.date_format(catalog.later(c("s"), c("g")), "yyyy-MM-dd HH:mm:ss").alias("last_run"))


def run_log(spark, sf):
    """Orders as workflow runs; the title carries a customer slug."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    started = F.timestamp_add("SECOND", (c("o_orderkey") % 86400).cast("int"), c("o_orderdate").cast("timestamp"))
    status = F.when(c("o_orderstatus") == "F", "completed").when(c("o_orderstatus") == "O", "in_progress").otherwise("waiting")
    return o.select(
        c("o_orderkey").alias("run_id"), F.concat(F.lit("Search: cust-"), F.lpad(c("o_custkey").cast("string"), 9, "0"), F.lit(" (web)")).alias("display_title"), F.lit("On-demand run").alias("name"),
        status.alias("status"), F.lit("success").alias("conclusion"), started.alias("started_at"), F.timestamp_add("SECOND", (c("o_orderkey") % 500 - 100).cast("int"), started).alias("updated_at"),
    )


def customer_slugs(spark, sf):
    return table(spark, sf, "customer").select(F.concat(F.lit("cust-"), F.lpad(c("c_custkey").cast("string"), 9, "0")).alias("slug"), "c_custkey", "c_mktsegment")


LOG_SQL = """
log AS (SELECT o_orderkey, 'cust-' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS slug, o_orderdate + to_seconds(o_orderkey % 86400) AS started,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'pending' END AS state FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("run_log_latest", "WITH " + LOG_SQL.strip() + """
SELECT slug, run_id, state, state = 'completed' AS done FROM (SELECT slug, o_orderkey AS run_id, state, row_number() OVER (PARTITION BY slug ORDER BY started DESC, o_orderkey DESC) AS no FROM log) WHERE no = 1""")
def run_log_latest(spark, sf):
    latest = catalog.latest_named_run(catalog.named_runs(customer_slugs(spark, sf), run_log(spark, sf)))
    return latest.select("slug", "run_id", "state", c("completed_at").isNotNull().alias("done"))


@query("run_log_fallback", "WITH " + LOG_SQL.strip() + """,
named AS (SELECT slug, o_orderkey AS run_id, state FROM log QUALIFY row_number() OVER (PARTITION BY slug ORDER BY started DESC, o_orderkey DESC) = 1),
newest AS (SELECT o_orderkey AS run_id, state FROM log ORDER BY started DESC, o_orderkey DESC LIMIT 1)
SELECT 'cust-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS slug, coalesce(n.run_id, w.run_id) AS run_id, coalesce(n.state, w.state) AS state
FROM customer CROSS JOIN newest w LEFT JOIN named n ON n.slug = 'cust-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')""")
def run_log_fallback(spark, sf):
    """Products that no run names get the newest run of all."""
    slugs, log = customer_slugs(spark, sf), run_log(spark, sf)
    return catalog.latest_named_run(catalog.named_runs(slugs, log), slugs, log).select("slug", "run_id", "state")


@query("run_log_completed", "WITH " + LOG_SQL.strip() + """
SELECT slug, duration_s FROM (SELECT slug, greatest(0, o_orderkey % 500 - 100) AS duration_s, row_number() OVER (PARTITION BY slug ORDER BY started DESC, o_orderkey DESC) AS no FROM log WHERE state = 'completed') WHERE no = 1""")
def run_log_completed(spark, sf):
    last = catalog.last_completed_run(catalog.named_runs(customer_slugs(spark, sf), run_log(spark, sf)))
    return last.select("slug", "duration_s")


@query("product_status", "WITH " + LOG_SQL.strip() + """,
active AS (SELECT slug, max(started) AS started FROM log WHERE state = 'in_progress' GROUP BY slug)
SELECT 'cust-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS slug, CASE WHEN a.slug IS NOT NULL THEN 'running' WHEN c_mktsegment = 'BUILDING' THEN 'running' ELSE 'idle' END AS status
FROM customer LEFT JOIN active a ON a.slug = 'cust-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')""")
def product_status(spark, sf):
    slugs = customer_slugs(spark, sf).select("slug", (c("c_mktsegment") == "BUILDING").alias("has_schedule"))
    tick = table(spark, sf, "events").select(c("ts").cast("timestamp").alias("started_at"))
    return catalog.product_status(slugs, run_log(spark, sf).where(c("status") == "in_progress"), tick).select("slug", "status")


@query("product_cards", """
WITH last_of_day AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS d, max(event_id) AS event_id FROM events GROUP BY ALL),
rep AS (SELECT user_id, max(d) AS d, arg_max(event_id, d) AS event_id FROM last_of_day WHERE event_id % 5 IN (0, 1) GROUP BY user_id)
SELECT CAST(u.user_id AS VARCHAR) AS slug, CASE r.event_id % 5 WHEN 0 THEN 'P' WHEN 1 THEN 'Q' ELSE 'X' END AS title, CASE WHEN u.user_id % 2 = 0 THEN 'waiting' ELSE 'idle' END AS status,
  CASE r.event_id % 5 WHEN 0 THEN 7 WHEN 1 THEN 9 END AS listing_count, r.d AS snapshot_day, CASE r.event_id % 5 WHEN 0 THEN 'Haiku 4.5' END AS filter_model
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN rep r USING (user_id)""")
def product_cards(spark, sf):
    """All documents (the last one of a product and day is the stored one): unknown versions and broken ones give no report."""
    stored = report_texts(spark, sf).join(table(spark, sf, "events").select("event_id", day(c("ts").cast("timestamp")).alias("d")), "event_id")
    stored = stored.groupBy("slug", "d").agg(F.max_by(F.struct("event_id", "value"), "event_id").alias("r")).select("slug", "r.*")
    cards = tables.report_cards(tables.report_docs(stored))
    users = table(spark, sf, "events").select("user_id").distinct()
    document = F.when(c("user_id") % 2 == 0, "display_name: X\nschedule:\n  cron: '0 6 * * *'\n").otherwise("display_name: X\n")
    profiles = users.select(c("user_id").cast("string").alias("slug"), document.alias("document"))
    started = table(spark, sf, "events").select(c("user_id").cast("string").alias("slug"), c("ts").cast("timestamp").alias("run_ts"))
    nothing = run_log(spark, sf).where(c("status") == "nothing")
    made = runs.product_cards(cards, started, profiles, nothing, started.where(c("slug") == "nobody").select(c("run_ts").alias("started_at")))
    return made.select("slug", "title", "status", "listing_count", day(c("snapshot_date")).alias("snapshot_day"), "filter_model")


# --- streams ----------------------------------------------------------------------------------------------


def stream_events(spark, sf):
    """The events file as a stream."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")


def drain(spark, df, mode="append"):
    """Run a stream over everything there is into a Parquet folder of the shared checkpoint root, then read it."""
    home = f"{checkpoint_root(spark)}/streams/{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{home}/out")


@query("stream_ingest", "SELECT user_id, count(*) AS offers FROM events GROUP BY user_id")
def stream_ingest(spark, sf):
    """Every event arrives twice; each is stored once."""
    e = stream_events(spark, sf)
    both = e.unionByName(e).select(
        c("user_id").cast("string").alias("slug"), c("event_id").cast("string").alias("url"), c("ts").cast("timestamp").alias("fetched_at"), "user_id"
    )
    return drain(spark, streams.ingest(both, "40 days")).groupBy("user_id").agg(F.count(F.lit(1)).alias("offers"))


@query("stream_ticks", """
SELECT CAST(user_id AS VARCHAR) AS slug, strftime(time_bucket(INTERVAL 15 minutes, ts - INTERVAL 1 microsecond) + INTERVAL 15 minutes, '%Y-%m-%d %H:%M') AS tick, count(*) AS fires FROM events
GROUP BY ALL HAVING time_bucket(INTERVAL 15 minutes, any_value(ts) - INTERVAL 1 microsecond) + INTERVAL 15 minutes <= (SELECT max(ts) - INTERVAL 1 hour FROM events)""")
def stream_ticks(spark, sf):
    """Closed tick windows: those that end an hour or more before the newest event."""
    fires = stream_events(spark, sf).select(c("user_id").cast("string").alias("slug"), c("ts").cast("timestamp").alias("fire_at"))
    out = drain(spark, streams.tick_counts(fires))
    return out.select("slug", F.date_format("tick", "yyyy-MM-dd HH:mm").alias("tick"), "fires")


def _stored(spark, df):
    """Write a derived table so that it can be streamed."""
    home = f"{checkpoint_root(spark)}/streams/{uuid.uuid4().hex}"
    with shuffles_end(spark):
        df.write.parquet(home)
    return spark.readStream.schema(df.schema).parquet(home)


@query("stream_price_alerts", with_events("SELECT slug, run_day, price FROM b WHERE below AND NOT coalesce(was, false)", price_sql("sold_price", "condition = 'used'", 25)))
def stream_price_alerts(spark, sf):
    """The stateful twin of the is_below alert over the stream of run prices."""
    o = event_offers(spark, sf)
    priced = alerts.rule_prices(alerts.run_prices(o), alert_rules(spark, sf).where(c("rule_pos") == 1), history.previous_runs(o))
    rows = priced.withColumn("fingerprint", alerts.fingerprint()).select("slug", "rule_pos", "fingerprint", "mode", "threshold_usd", "run_ts", "price")
    fired = drain(spark, streams.price_alert_stream(_stored(spark, rows))).where("fires")
    return fired.select("slug", run_day(), "price")


@query("stream_host_arrivals", with_events("SELECT slug, run_day, host FROM arrivals", HOSTS_SQL))
def stream_host_arrivals(spark, sf):
    hosts = alerts.run_hosts(event_offers(spark, sf)).groupBy(*RUN).agg(F.array_sort(F.collect_set("host")).alias("hosts"))
    return drain(spark, streams.host_arrival_stream(_stored(spark, hosts))).where(~c("late")).select("slug", run_day(), "host")


@query("stream_alerts_settled", with_events("SELECT slug, run_day, price FROM b WHERE below AND NOT coalesce(was, false)", price_sql("sold_price", "condition = 'used'", 25)))
def stream_alerts_settled(spark, sf):
    """Runs of every second day arrive after all others: the late ones are settled to the table of ordered arrival."""
    o = event_offers(spark, sf)
    priced = alerts.rule_prices(alerts.run_prices(o), alert_rules(spark, sf).where(c("rule_pos") == 1), history.previous_runs(o))
    rows = priced.withColumn("fingerprint", alerts.fingerprint()).select("slug", "rule_pos", "fingerprint", "mode", "threshold_usd", "run_ts", "price")
    home = f"{checkpoint_root(spark)}/streams/{uuid.uuid4().hex}"
    for odd in (True, False):
        rows.where((F.dayofmonth("run_ts") % 2 == 1) == odd).write.mode("append").parquet(home)
    files = len(spark.read.parquet(home).inputFiles())
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, files // 2)).parquet(home)
    settled = streams.settle_late(drain(spark, streams.price_alert_stream(source)), spark.read.schema(rows.schema).parquet(home))
    return settled.where("fires").select("slug", run_day(), "price")


SESSION_SQL = """
WITH marked AS (SELECT user_id, ts, value, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 2 hours, true) AS begins FROM events),
numbered AS (SELECT *, sum(begins::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM marked),
sessions AS (SELECT CAST(user_id AS VARCHAR) AS slug, min(ts) AS a, max(ts) AS b, count(*) AS observations, min(value) AS low, max(value) AS high FROM numbered GROUP BY user_id, no)
SELECT slug, strftime(a, '%Y-%m-%d %H:%M:%S') AS started, strftime(b, '%Y-%m-%d %H:%M:%S') AS ended, observations, low, high FROM sessions"""


def _sessions(rows):
    met = windows.sessions(rows.select(c("user_id").cast("string").alias("slug"), "ts", "value"), ["slug"], "ts", "value", "2 hours")
    text = lambda n: F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n)
    return met.select("slug", text("started"), text("ended"), "observations", "low", "high")


@query("product_sessions", SESSION_SQL)
def product_sessions(spark, sf):
    """Stretches of activity per product, ended by a pause of two hours."""
    return _sessions(table(spark, sf, "events").withColumn("ts", c("ts").cast("timestamp")))


@query("stream_sessions", SESSION_SQL + " WHERE b + INTERVAL 2 hours <= (SELECT max(ts) - INTERVAL 1 hour FROM events)")
def stream_sessions(spark, sf):
    """The streaming twin: sessions that ended an hour or more before the newest event."""
    e = stream_events(spark, sf).withColumn("ts", c("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    return drain(spark, _sessions(e))
