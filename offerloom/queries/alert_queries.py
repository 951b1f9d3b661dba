"""Queries on alerts, verdicts, diagnostics and evaluation."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from offerloom import constants as K
from offerloom.functions import envelopes
from offerloom.operators import alerts, diagnostics, dimensions, evaluation, history, verdicts
from offerloom.plans import runs
from offerloom.queries.base import EVENTS_SQL, big, day, event_offers, offers, query, table, with_offers
from offerloom.schema import PLACE, conform
from offerloom.session import checkpoint_root, durable

c = F.col
RUN = ["slug", "run_ts"]

def run_day():
    return day(c("run_ts")).alias("run_day")



def with_events(body: str, *extra: str) -> str:
    return "WITH " + ",\n".join([EVENTS_SQL.strip(), *[e.strip() for e in extra]]) + "\n" + body.strip()


def alert_rules(spark, sf):
    """Five rules per product."""
    users = table(spark, sf, "events").select(c("user_id").cast("string").alias("slug")).distinct()
    none = F.lit(None)
    rule = lambda pos, kind, thr=None, cond=None, mode=None, basis=None, host=None: F.struct(
        F.lit(pos).alias("rule_pos"), F.lit(kind).alias("kind"), F.lit(thr).cast("double").alias("threshold_usd"), F.lit(cond).cast("string").alias("condition"),
        F.lit(mode).cast("string").alias("mode"), F.lit(basis).cast("string").alias("price_basis"), F.lit(host).cast("string").alias("host"),
    )
    rows = F.array(
        rule(0, "price_below", 20.0), rule(1, "price_below", 25.0, "used", "is_below", "total"), rule(2, "price_below", 5.5, "new", "while_below"),
        rule(3, "vendor_seen", host=" WWW.purchase.example.com"), rule(4, "new_vendor_carries"),
    )
    return users.select("slug", F.explode(rows).alias("r")).select("slug", "r.*")


def alert_state(spark, sf):
    """Every third product starts with its `is_below` rule disarmed."""
    users = table(spark, sf, "events").select("user_id").distinct().where(c("user_id") % 3 == 0)
    return users.select(c("user_id").cast("string").alias("slug"), F.lit("price_below|is_below|25.0|used|total").alias("fingerprint"), F.lit(False).alias("armed"))


def evaluated(spark, sf):
    return alerts.evaluate(event_offers(spark, sf), alert_rules(spark, sf), alert_state(spark, sf))


def fired(spark, sf, pos):
    return evaluated(spark, sf)[0].where(c("rule_pos") == pos)


MIN_SQL = "SELECT slug, run_day, min({price}) FILTER ({cond}) AS price FROM ev GROUP BY ALL"


def price_sql(price, cond, threshold, was_default="false"):
    return f"""
b AS (
  SELECT *, price < {threshold} AS below, lag(coalesce(price < {threshold}, false)) OVER (PARTITION BY slug ORDER BY run_day) AS was
  FROM ({MIN_SQL.format(price=price, cond=cond)})
)"""


@query("alert_drops_below", with_events(
    "SELECT slug, run_day, price, 'Cheapest unit price dropped to $' || printf('%.2f', price) || ' — alert threshold $20.00' AS headline FROM b WHERE below AND NOT coalesce(was, false)",
    price_sql("unit_price", "true", 20)))
def alert_drops_below(spark, sf):
    return fired(spark, sf, 0).select("slug", run_day(), "price", "headline")


@query("alert_is_below", with_events(
    "SELECT slug, run_day, price, 'Cheapest (used) total price is $' || printf('%.2f', price) || ' — at or below your $25.00 alert' AS headline FROM b WHERE below AND NOT coalesce(was, CAST(slug AS INT) % 3 = 0)",
    price_sql("sold_price", "condition = 'used'", 25)))
def alert_is_below(spark, sf):
    return fired(spark, sf, 1).select("slug", run_day(), "price", "headline")


@query("alert_while_below", with_events(
    "SELECT slug, run_day, price, 'Cheapest (new) unit price is $' || printf('%.2f', price) || ' — at or below your $5.50 alert' AS headline FROM b WHERE below", price_sql("unit_price", "condition = 'new'", 5.5)))
def alert_while_below(spark, sf):
    return fired(spark, sf, 2).select("slug", run_day(), "price", "headline")


HOSTS_SQL = """
steps AS (SELECT slug, run_day, row_number() OVER (PARTITION BY slug ORDER BY run_day) AS step_no FROM (SELECT DISTINCT slug, run_day FROM ev)),
hosts AS (SELECT DISTINCT slug, run_day, host, step_no FROM ev JOIN steps USING (slug, run_day)),
arrivals AS (SELECT * FROM hosts h WHERE NOT EXISTS (SELECT 1 FROM hosts p WHERE p.slug = h.slug AND p.host = h.host AND p.step_no = h.step_no - 1))"""


@query("alert_vendor_seen", with_events("SELECT slug, run_day, host, host || ' now has at least one passing listing' AS headline FROM arrivals WHERE host = 'purchase.example.com'", HOSTS_SQL))
def alert_vendor_seen(spark, sf):
    return fired(spark, sf, 3).select("slug", run_day(), "host", "headline")


@query("alert_new_vendor_carries", with_events("SELECT slug, run_day, host, 'New vendor now carries this product: ' || host AS headline FROM arrivals", HOSTS_SQL))
def alert_new_vendor_carries(spark, sf):
    return fired(spark, sf, 4).select("slug", run_day(), "host", "headline")


@query("alert_state_after", with_events(
    "SELECT slug, 'price_below|is_below|25.0|used|total' AS fingerprint, NOT coalesce(arg_max(coalesce(below, false), run_day), false) AS armed FROM b GROUP BY slug",
    price_sql("sold_price", "condition = 'used'", 25)))
def alert_state_after(spark, sf):
    return evaluated(spark, sf)[1].select("slug", "fingerprint", "armed")


@query("alert_rule_text", """
SELECT r.pos AS rule_pos, r.fp AS fingerprint, r.txt AS description, count(DISTINCT user_id) AS products FROM events, (VALUES
 (0, 'price_below|drops_below|20.0||unit', 'Cheapest per-unit price drops below $20'),
 (1, 'price_below|is_below|25.0|used|total', 'Cheapest (used only) total price is at or below $25 (once per dip)'),
 (2, 'price_below|while_below|5.5|new|unit', 'Cheapest (new only) per-unit price is at or below $5.5 (every run)'),
 (3, 'vendor_seen| WWW.purchase.example.com', 'Any listing seen at  WWW.purchase.example.com'),
 (4, 'new_vendor_carries', 'Any new vendor starts carrying this product')) r(pos, fp, txt) GROUP BY ALL""")
def alert_rule_text(spark, sf):
    rows = alert_rules(spark, sf).select("rule_pos", alerts.fingerprint().alias("fingerprint"), alerts.rule_text().alias("description"), "slug")
    return rows.groupBy("rule_pos", "fingerprint", "description").agg(F.count_distinct("slug").alias("products"))


@query("alert_audit_panel", with_events("SELECT slug, run_day, count(*) AS lines FROM arrivals GROUP BY slug, run_day", HOSTS_SQL))
def alert_audit_panel(spark, sf):
    rows = fired(spark, sf, 4).withColumn("outcome", F.when(c("host").startswith("view"), "failed").otherwise("ok"))
    panel = alerts.audit_text(rows)
    return panel.select("slug", run_day(), big(F.size(F.filter(F.split("panel", "\n"), lambda s: s.startswith("- **new_vendor_carries**: New vendor")))).alias("lines"))


@query("host_sets", with_events("SELECT slug, run_day, count(DISTINCT host) AS hosts, min(host) AS first_host, max(host) AS last_host FROM ev GROUP BY slug, run_day"))
def host_sets(spark, sf):
    h = alerts.run_hosts(event_offers(spark, sf)).groupBy(*RUN).agg(F.count(F.lit(1)).alias("hosts"), F.min("host").alias("first_host"), F.max("host").alias("last_host"))
    return h.select("slug", run_day(), "hosts", "first_host", "last_host")


# --- verdicts ---------------------------------------------------------------------------------


@query("judge_batches", with_offers(
    'SELECT pos, no AS "index", no // 50 AS batch, no % 50 AS local_index FROM (SELECT pos, row_number() OVER (PARTITION BY slug, run_day ORDER BY pos) - 1 AS no FROM offers)'))
def judge_batches(spark, sf):
    return verdicts.batched(offers(spark, sf)).select("pos", "index", "batch", big(c("local_index")).alias("local_index"))


@query("judge_payload", with_offers("""
SELECT slug, run_day, no // 50 AS batch, count(*) AS entries, min(unit_price_usd) AS lowest, count(*) FILTER (regexp_matches(lower(title), '(^|[^\\p{L}\\p{N}])blue gear($|[^\\p{L}\\p{N}])')) AS named
FROM (SELECT *, row_number() OVER (PARTITION BY slug, run_day ORDER BY pos) - 1 AS no FROM offers) GROUP BY ALL"""))
def judge_payload(spark, sf):
    shown = offers(spark, sf).select(*RUN, *PLACE, *verdicts.SHOWN)  # batches hold the rows they are given
    rows = verdicts.batch_rows(shown.withColumn("aliases", F.array(F.lit("Blue Gear"))))
    doc = F.from_json("payload", "array<struct<index:int,price:double,model_name_in_title:boolean>>")
    return rows.withColumn("d", doc).select(
        "slug", run_day(), "batch", big(F.size("d")).alias("entries"), F.array_min(F.transform("d", lambda e: e["price"])).alias("lowest"),
        big(F.size(F.filter("d", lambda e: e["model_name_in_title"]))).alias("named"),
    )


def _first_judge(payload: str):
    entries = json.loads(payload)
    if any("blue bolt" in e["title"] for e in entries):
        return "Sorry, I cannot do that."
    return json.dumps({"evaluations": [{"index": e["index"], "pass": e["condition"] == "new", "reason": "first"} for e in entries]}), {"input_tokens": len(entries)}


def _second_judge(payload: str):
    entries = json.loads(payload)
    if any("hot gear LARGE" in e["title"] for e in entries):
        raise RuntimeError("down")
    return json.dumps([{"index": e["index"], "pass": True, "extracted_features": {"term": "1 yr", "condition": "x"}} for e in entries if e["index"] != 3]), {"input_tokens": 1}


CHAIN = (verdicts.Judge("local", "first", _first_judge), verdicts.Judge("local", "second", _second_judge))


def judged_offers(spark, sf):
    """What a judge sees and what its verdict changes; batches hold the rows they are given."""
    return offers(spark, sf).select(*RUN, *PLACE, *verdicts.SHOWN, "brand")


CHAIN_SQL = """
n AS (SELECT *, row_number() OVER (PARTITION BY slug, run_day ORDER BY pos) - 1 AS no FROM offers),
bad1 AS (SELECT slug, run_day, min(no // 50) AS b FROM n WHERE contains(title, 'blue bolt') GROUP BY ALL),
placed AS (SELECT n.*, no // 50 AS batch, CASE WHEN bad1.b IS NULL OR no // 50 < bad1.b THEN 1 ELSE 2 END AS judge FROM n LEFT JOIN bad1 USING (slug, run_day)),
bad2 AS (SELECT DISTINCT slug, run_day FROM placed WHERE judge = 2 AND contains(title, 'hot gear LARGE'))"""


@query("judge_chain", with_offers("""
SELECT p.pos, CASE WHEN judge = 1 THEN condition = 'new' ELSE no % 50 <> 3 END AS pass,
  CASE WHEN judge = 1 THEN 'first' WHEN no % 50 = 3 THEN 'no verdict returned by model' ELSE 'passed all rules' END AS reason,
  CASE WHEN judge = 2 AND no % 50 <> 3 THEN '1 yr' END AS term
FROM placed p ANTI JOIN bad2 USING (slug, run_day)""", CHAIN_SQL))
def judge_chain(spark, sf):
    """Two judges in order; the second takes over from the first failing batch, a run it fails on has no survivors."""
    answered, failed, _ = verdicts.run_chain(judged_offers(spark, sf), CHAIN)
    judged = verdicts.verdict_rows(answered).join(failed.select(*RUN), RUN, "left_anti")
    return judged.select("pos", "pass", "reason", F.try_element_at("attrs", F.lit("term")).alias("term"))


def _never(payload: str):
    raise AssertionError("asked again")


@query("judge_chain_again", with_offers("""
SELECT slug, run_day, count(*) AS judged, count(*) FILTER (CASE WHEN judge = 1 THEN condition = 'new' ELSE no % 50 <> 3 END) AS passed,
  count(DISTINCT batch) FILTER (judge = 1) AS first_batches, count(DISTINCT batch) FILTER (judge = 2) AS second_batches
FROM placed ANTI JOIN bad2 USING (slug, run_day) GROUP BY ALL""", CHAIN_SQL))
def judge_chain_again(spark, sf):
    """The chain run twice over one reply store: the judges of the second attempt answer nothing, kept answers do."""
    o, store = durable(judged_offers(spark, sf)), verdicts.ReplyStore(f"{checkpoint_root(spark)}/stored/{uuid.uuid4().hex}")
    verdicts.run_chain(o, CHAIN, store=store)
    again = [verdicts.Judge(j.provider, j.model, _never) for j in CHAIN]
    answered, failed, _ = verdicts.run_chain(o, again, store=store)
    held = answered.join(failed.select(*RUN), RUN, "left_anti").groupBy("slug", run_day()).agg(
        F.count_if(c("model") == "first").alias("first_batches"), F.count_if(c("model") == "second").alias("second_batches"))
    judged = verdicts.verdict_rows(answered).join(failed.select(*RUN), RUN, "left_anti")
    rows = judged.groupBy("slug", run_day()).agg(F.count(F.lit(1)).alias("judged"), F.count_if("pass").alias("passed"))
    return rows.join(held, ["slug", "run_day"]).select("slug", "run_day", "judged", "passed", "first_batches", "second_batches")


@query("judge_chain_failures", with_offers("SELECT slug, run_day, -1 AS \"index\", '(filter call failed)' AS title FROM bad2", CHAIN_SQL))
def judge_chain_failures(spark, sf):
    _, failed, _ = verdicts.run_chain(judged_offers(spark, sf), CHAIN)
    return verdicts.failure_log(failed).select("slug", run_day(), "index", "title")


def doc_offers(spark, sf):
    """Documents as indexed offers of their source."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return conform(d.select(
        c("source").alias("slug"), F.lit("2024-01-01").cast("timestamp").alias("run_ts"), c("doc_id").alias("pos"), F.lit("serper_shopping").alias("source"),
        F.concat(F.lit("https://x/"), c("doc_id").cast("string")).alias("url"), c("lang").alias("title"), F.when(c("doc_id") % 2 == 0, "new").otherwise("").alias("condition"),
        c("n_chars").cast("double").alias("unit_price_usd"), F.create_map(F.lit("lang"), c("lang")).alias("attrs"),
    )).withColumn("index", c("pos"))


def doc_verdicts(spark, sf):
    """Two verdicts per labelled document; the later one contradicts and must lose."""
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    v = d.select(
        c("source").alias("slug"), F.lit("2024-01-01").cast("timestamp").alias("run_ts"), c("doc_id").alias("index"), F.lit(0).alias("seq"), (c("quality") == 1).alias("pass"),
        F.when(c("toxic") == 1, "relevance_check: toxic").otherwise("").alias("reason"),
        F.create_map(F.lit("condition"), F.lit("used"), F.lit("term"), F.concat(F.lit(" t"), (c("doc_id") % 3).cast("string")), F.lit("lang"), F.lit("xx"), F.lit("empty"), F.lit(" ")).alias("features"),
    )
    return v.unionByName(v.withColumn("seq", F.lit(1)).withColumn("pass", ~c("pass")))


DOC_SQL = "FROM documents d LEFT JOIN labels l USING (doc_id)"


@query("verdict_join", f"""
SELECT doc_id AS "index", coalesce(quality = 1, false) AS pass,
  CASE WHEN quality IS NULL THEN 'no verdict returned by model' WHEN toxic = 1 THEN 'relevance_check: toxic' WHEN quality = 1 THEN 'passed all rules' ELSE 'no reason given' END AS reason,
  CASE WHEN quality = 1 THEN 't' || (doc_id % 3) END AS term, CASE WHEN quality = 1 AND doc_id % 2 = 1 THEN 'used' END AS condition, lang {DOC_SQL}""")
def verdict_join(spark, sf):
    judged = verdicts.join_verdicts(doc_offers(spark, sf), doc_verdicts(spark, sf))
    at = lambda k: F.try_element_at("attrs", F.lit(k)).alias(k)
    return judged.select("index", "pass", "reason", at("term"), at("condition"), at("lang"))


@query("verdict_log", f"""
SELECT source AS slug, count(*) AS rows, count(*) FILTER (coalesce(quality, 0) = 0) AS rejected, sum(n_chars) FILTER (coalesce(quality, 0) = 0) AS rejected_value {DOC_SQL} GROUP BY source""")
def verdict_log(spark, sf):
    log = verdicts.log_rows(verdicts.join_verdicts(doc_offers(spark, sf), doc_verdicts(spark, sf)))
    return log.groupBy("slug").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~c("pass")).alias("rejected"), big(F.sum(F.when(~c("pass"), c("price")))).alias("rejected_value"))


def replies(spark, sf):
    """One answer text per 20 documents, in one of six shapes; the last one is cut off and unusable."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    e = F.struct(c("local").alias("index"), (c("n_chars") % 2 == 0).alias("pass"), F.concat(F.lit("n"), c("n_chars").cast("string")).alias("reason"))
    g = d.withColumn("local", (c("doc_id") % 20).cast("int")).groupBy(F.floor(c("doc_id") / 20).alias("batch")).agg(F.collect_list(e).alias("e"), F.count(F.lit(1)).cast("int").alias("n"))
    evals, hits = F.to_json("e"), F.to_json(F.transform(F.filter("e", lambda x: x["pass"]), lambda x: x["index"]))
    shape = c("batch") % 6
    reply = (
        F.when(shape == 0, F.concat(F.lit('{"evaluations":'), evals, F.lit("}"))).when(shape == 1, evals)
        .when(shape == 2, F.concat(F.lit('```json\n{"indices": '), hits, F.lit("}\n```"))).when(shape == 3, hits)
        .when(shape == 4, F.concat(F.lit('Let me look {at} this [first].\n{"evaluations": '), evals, F.lit("} Done.")))
        .otherwise(F.concat(F.lit('{"evaluations": '), F.substring(evals, 1, 75)))
    )
    return g.select("batch", reply.alias("reply"), "n")


@query("verdict_shapes", """
SELECT doc_id // 20 AS batch, doc_id % 20 AS "index", n_chars % 2 = 0 AS pass,
  CASE WHEN (doc_id // 20) % 6 IN (2, 3) THEN '(legacy indices-only response)' ELSE 'n' || n_chars END AS reason FROM documents WHERE (doc_id // 20) % 6 <> 5""")
def verdict_shapes(spark, sf):
    return verdicts.parse_replies(replies(spark, sf)).select("batch", big(c("index")).alias("index"), "pass", "reason")


@query("unusable_replies", "SELECT DISTINCT doc_id // 20 AS batch FROM documents WHERE (doc_id // 20) % 6 = 5")
def unusable_replies(spark, sf):
    found = replies(spark, sf).withColumn("envelope", envelopes.envelope_text(c("reply")))
    return found.where(envelopes.verdict_list(c("envelope"), c("n")).isNull()).select("batch")


# --- calls and cost -----------------------------------------------------------------------------

MODELS = [("anthropic", "claude-haiku-4-5"), ("glm", "glm-4.6"), ("local", "qwen"), ("nobody", "x"), ("openai", "gpt-4o-mini")]


def calls(spark, sf):
    """Conversation turns as model calls; text lengths stand for token counts."""
    t = table(spark, sf, "conversations")
    n = F.length("text").cast("bigint")
    pick = lambda i: F.get(F.array(*[F.lit(m[i]) for m in MODELS]), (c("conv_id") % 5).cast("int"))
    return t.select(
        c("conv_id").cast("string").alias("slug"), F.lit("2024-01-01").cast("timestamp").alias("run_ts"), F.lit("ai_filter").alias("step"), pick(0).alias("provider"), pick(1).alias("model"),
        n.alias("input_tokens"), F.when(c("turn") % 4 != 3, n * 2).alias("output_tokens"), F.when(c("turn") % 2 == 0, n * 3).alias("cache_read_input_tokens"),
        (c("turn") * 10).alias("cache_creation_input_tokens"), F.when(c("turn") == 2, 0.5).alias("cost_usd"),
    )


CALLS_SQL = """
calls AS (
  SELECT CAST(conv_id AS VARCHAR) AS slug, conv_id % 5 AS m, length(text) AS i, coalesce(CASE WHEN turn % 4 <> 3 THEN length(text) * 2 END, 0) AS o,
    coalesce(CASE WHEN turn % 2 = 0 THEN length(text) * 3 END, 0) AS r, turn * 10 AS w, turn FROM conversations
),
prices AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE, 5.0::DOUBLE), (1, 0.6, 2.2), (4, 0.15, 0.6)) p(m, pin, pout)),
priced AS (
  SELECT calls.*, CASE WHEN turn = 2 THEN 0.5::DOUBLE WHEN calls.m = 2 THEN 0.0 ELSE
    i * pin / 1000000 + w * pin * 1.25::DOUBLE / 1000000 + r * pin * 0.1::DOUBLE / 1000000 + o * pout / 1000000 END AS cost FROM calls LEFT JOIN prices USING (m)
)"""


@query("model_call_cost", "WITH " + CALLS_SQL.strip() + "\nSELECT slug, turn, CAST(round(cost * 1000000) AS BIGINT) AS micro_usd FROM priced")
def model_call_cost(spark, sf):
    t = calls(spark, sf).withColumn("turn", (c("cache_creation_input_tokens") / 10).cast("bigint"))
    return dimensions.price_calls(t).select("slug", "turn", F.round(c("cost_usd") * 1_000_000).cast("bigint").alias("micro_usd"))


@query("model_cost_rollup", "WITH " + CALLS_SQL.strip() + "\nSELECT slug, CAST(round(coalesce(sum(cost), 0) * 10000) AS BIGINT) AS total_e4, bool_or(cost IS NULL) AS any_unpriced, count(*) AS calls FROM priced GROUP BY slug")
def model_cost_rollup(spark, sf):
    cost = dimensions.run_cost(dimensions.price_calls(calls(spark, sf)))
    return cost.select("slug", F.round(c("total_usd") * 10000).cast("bigint").alias("total_e4"), "any_unpriced", "calls")


@query("token_usage", "WITH " + CALLS_SQL.strip() + "\nSELECT slug, m, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(r)::BIGINT AS cache_read, sum(w)::BIGINT AS cache_write FROM calls GROUP BY slug, m")
def token_usage(spark, sf):
    rows = calls(spark, sf).fillna(0, list(verdicts.USAGE))
    u = verdicts.usage(rows)
    return u.select("slug", (c("slug").cast("bigint") % 5).alias("m"), "input_tokens", "output_tokens", c("cache_read_input_tokens").alias("cache_read"), c("cache_creation_input_tokens").alias("cache_write"))


@query("cache_effect", "WITH " + CALLS_SQL.strip() + """
SELECT calls.m, CAST(round(sum(i * pin + w * pin * 1.25::DOUBLE + r * pin * 0.1::DOUBLE + o * pout)) AS BIGINT) AS cached_micro,
  CAST(round(sum((i + w + r) * pin + o * pout)) AS BIGINT) AS baseline_micro, sum(r) > 0 AS engaged FROM calls JOIN prices USING (m) GROUP BY calls.m""")
def cache_effect(spark, sf):
    e = dimensions.cache_effect(calls(spark, sf).withColumn("m", c("slug").cast("bigint") % 5), ["m"]).where(c("cached_usd").isNotNull())
    micro = lambda n: F.round(c(n) * 1_000_000).cast("bigint")
    return e.select("m", micro("cached_usd").alias("cached_micro"), micro("baseline_usd").alias("baseline_micro"), "engaged")


# --- source diagnostics --------------------------------------------------------------------------

STATS_SQL = """
stats AS (
  SELECT CAST(user_id AS VARCHAR) AS slug, event_type AS kind, count(*) AS fetched, count(*) FILTER (value < 60 AND event_type <> 'error') AS passed,
    count(*) FILTER (NOT (value < 60 AND event_type <> 'error')) AS rejected,
    count(*) FILTER (NOT (value < 60 AND event_type <> 'error') AND event_id % 2 = 0) AS relevance FROM events GROUP BY ALL
)"""


def source_tables(spark, sf):
    """Per product: one source row per event type (universal for two of them), the passed offers and the verdict log."""
    e = table(spark, sf, "events")
    slug, ts = c("user_id").cast("string").alias("slug"), F.lit("2024-01-01").cast("timestamp").alias("run_ts")
    universal = c("event_type").isin("view", "click")
    source = F.when(universal, K.UNIVERSAL).otherwise(c("event_type")).alias("source")
    url = F.when(universal, F.concat(F.lit("https://x.com/"), c("event_type")))
    ok = (c("value") < 60) & (c("event_type") != "error")
    stats = e.groupBy(slug, ts, source, F.when(universal, "x.com").alias("match_host"), url.alias("match_url"), c("event_type").alias("display_source")).agg(
        F.count(F.lit(1)).alias("fetched")
    ).select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("error", "string"), ("skip_reason", "string"), ("diagnostics", "map<string,string>"), ("known_blocker", "string"))])
    attrs = F.when(universal, F.create_map(F.lit("vendor_host"), F.lit("WWW.x.com"), F.lit("source_url"), url)).otherwise(F.create_map().cast("map<string,string>"))
    passed = conform(e.where(ok).select(slug, ts, c("event_id").alias("pos"), source, attrs.alias("attrs")))
    reason = F.when(c("event_id") % 2 == 0, "[Relevance_Check] other product").otherwise("price")
    log = e.select(slug, ts, c("event_id").alias("index"), ok.alias("pass"), F.when(ok, "").otherwise(reason).alias("reason"), c("event_type").alias("title"), source, url.alias("source_url"))
    return stats, passed, log


@query("passed_counts", "WITH " + STATS_SQL.strip() + "\nSELECT slug, kind, fetched, passed FROM stats")
def passed_counts(spark, sf):
    stats, passed, _ = source_tables(spark, sf)
    return diagnostics.attribute_passed(stats, diagnostics.passed_counts(passed)).select("slug", c("display_source").alias("kind"), "fetched", "passed")


@query("rejection_attribution", "WITH " + STATS_SQL.strip() + """
SELECT slug, kind, rejected, relevance, CASE WHEN rejected > 0 AND passed = 0 AND rejected >= fetched THEN 'mis_scoped_url_' || rejected WHEN rejected > 0 AND relevance >= rejected * 0.5 THEN 'relevance_check' END AS dominant
FROM stats""")
def rejection_attribution(spark, sf):
    stats, passed, log = source_tables(spark, sf)
    r = runs.source_report(stats, passed, log)
    return r.select("slug", c("display_source").alias("kind"), "rejected", "relevance", c("dominant_rejection").alias("dominant"))


@query("source_report", "WITH " + STATS_SQL.strip() + """
SELECT slug, kind, CASE WHEN passed > 0 THEN 'ok' ELSE 'no_match' END AS category,
  CASE WHEN passed > 0 THEN 'ok' WHEN rejected >= fetched THEN 'NO_MATCH (Mis-scoped URL; ' || rejected || ' listings rejected by filter)' ELSE 'no match' END AS label FROM stats""")
def source_report(spark, sf):
    r = runs.source_report(*source_tables(spark, sf))
    return r.select("slug", c("display_source").alias("kind"), c("outcome.category").alias("category"), c("outcome.label").alias("label"))


def odd_sources(spark, sf):
    """Every event as a source row that exercises one branch of the outcome list."""
    e = table(spark, sf, "events")
    k = c("event_id") % 14
    none = F.lit(None).cast("string")
    body = F.when(k == 9, 60000).when(k == 10, 14999).when(k == 11, 20000)
    diag = F.map_filter(F.create_map(F.lit("body_len"), body.cast("string"), F.lit("alterlab_pool_exhausted"), F.when(k == 6, "true"), F.lit("alterlab_degraded"), F.when(k == 7, "true")), lambda _, v: v.isNotNull())
    return e.select(
        F.floor(c("event_id") / 14).cast("string").alias("slug"), F.lit("2024-01-01").cast("timestamp").alias("run_ts"), k.alias("k"), F.lit(K.UNIVERSAL).alias("source"), c("event_type").alias("display_source"),
        F.when(k.isin(0, 1, 12, 13), 3).otherwise(0).alias("fetched"), F.when(k == 0, 1).otherwise(0).alias("passed"),
        F.when(k == 4, "HTTP 429 Quota").when(k == 8, "Timeout\n  after 30s").otherwise(none).alias("error"), F.when(k == 2, "watch-gate: absent").when(k == 5, "budget spent").otherwise(none).alias("skip_reason"),
        diag.alias("diagnostics"), F.when(k == 3, "walled  off").otherwise(none).alias("known_blocker"),
        F.when(k == 12, "relevance_check").when(k == 13, "mis_scoped_url_3").when(k == 11, "vendor_does_not_carry").otherwise(none).alias("dominant_rejection"),
    )


@query("source_outcome", """
SELECT event_id % 14 AS k, count(*) AS sources, CASE event_id % 14 WHEN 0 THEN 'ok' WHEN 1 THEN 'no_match' WHEN 2 THEN 'watched' WHEN 3 THEN 'permanent' WHEN 4 THEN 'permanent' WHEN 5 THEN 'transient'
  WHEN 6 THEN 'transient' WHEN 7 THEN 'transient' WHEN 8 THEN 'transient' WHEN 9 THEN 'parser_gap' WHEN 10 THEN 'transient' WHEN 11 THEN 'no_match' ELSE 'no_match' END AS category,
  CASE event_id % 14 WHEN 0 THEN 'ok' WHEN 1 THEN 'no match' WHEN 2 THEN 'watched' WHEN 3 THEN 'blocked' WHEN 4 THEN 'blocked' WHEN 9 THEN 'needs work' WHEN 11 THEN 'NO_MATCH (Vendor doesn''t carry)'
  WHEN 12 THEN 'no match' WHEN 13 THEN 'NO_MATCH (Mis-scoped URL; 3 listings rejected by filter)' ELSE 'transient' END AS label FROM events GROUP BY ALL""")
def source_outcome(spark, sf):
    r = odd_sources(spark, sf).withColumn("o", diagnostics.source_outcome())
    return r.groupBy("k", c("o.category").alias("category"), c("o.label").alias("label")).agg(F.count(F.lit(1)).alias("sources"))


@query("zero_reason_callout", """
SELECT CAST(event_id // 14 AS VARCHAR) AS slug, count(*) AS sources, CASE WHEN bool_or(event_id % 14 IN (3, 4)) THEN 'warning' ELSE 'note' END AS severity FROM events WHERE event_id % 14 <> 0 GROUP BY event_id // 14""")
def zero_reason_callout(spark, sf):
    called = diagnostics.zero_reason_callout(odd_sources(spark, sf).withColumn("outcome", diagnostics.source_outcome()))
    return called.select("slug", "sources", "severity")


@query("rejection_diagnostic", """
SELECT CAST(user_id AS VARCHAR) AS slug, event_id AS "index", event_type AS title FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS no FROM events WHERE NOT (value < 60 AND event_type <> 'error')) WHERE no <= 10""")
def rejection_diagnostic(spark, sf):
    return diagnostics.rejection_diagnostic(source_tables(spark, sf)[2]).select("slug", "index", "title")


@query("pending_sources", """
SELECT page_id AS pos, CASE WHEN page_id % 3 = 0 THEN regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') WHEN page_id % 3 = 1 THEN 'newegg_search' END AS label FROM pages WHERE page_id % 3 <> 2""")
def pending_sources(spark, sf):
    """Pages as pending sources: universal with URL, a named source, universal without URL (left out)."""
    p = table(spark, sf, "pages").select("page_id", "url")
    k = c("page_id") % 3
    entry = F.struct(F.when(k == 1, "newegg_search").otherwise(K.UNIVERSAL).alias("id"), F.when(k == 0, c("url")).alias("url"), F.lit("later").alias("note"))
    rows = p.select(c("page_id").cast("string").alias("slug"), F.array(entry).alias("sources_pending"))
    return diagnostics.pending_labels(rows).select(c("slug").cast("bigint").alias("pos"), "label")


# --- evaluation ----------------------------------------------------------------------------------------


def trial_verdicts(spark, sf):
    """Labelled documents judged by three rule-made models in three trials; one model skips too many in its last trial."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(t).alias("trial")) for m in ("odd", "long", "strict") for t in (1, 2, 3)])
    rows = d.select(c("source").alias("slug"), c("doc_id").alias("index"), "n_chars", "quality", F.explode(models).alias("m")).select("slug", "index", "n_chars", "quality", "m.*")
    made = (
        F.when(c("model") == "odd", c("index") % 2 == 1).when(c("model") == "long", c("n_chars") > 500 * c("trial")).otherwise((c("quality") == 1) & (c("index") % (c("trial") + 3) != 0))
    )
    skipped = (c("model") == "strict") & (c("trial") == 3) & (c("index") % 2 == 0)
    return rows.withColumn("pass", made).where(~skipped).select("slug", "model", "trial", "index", "pass")


def gold(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return d.select(c("source").alias("slug"), c("doc_id").alias("index"), (c("quality") == 1).alias("gold_pass"))


def sizes(spark, sf):
    return gold(spark, sf).groupBy("slug").agg(F.count(F.lit(1)).alias("n"))


EVAL_SQL = """
docs AS (SELECT source AS slug, doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)),
v AS (
  SELECT slug, model, trial, doc_id, quality, CASE model WHEN 'odd' THEN doc_id % 2 = 1 WHEN 'long' THEN n_chars > 500 * trial ELSE quality = 1 AND doc_id % (trial + 3) <> 0 END AS pass
  FROM docs, (VALUES ('odd'), ('long'), ('strict')) m(model), (VALUES (1), (2), (3)) t(trial) WHERE NOT (model = 'strict' AND trial = 3 AND doc_id % 2 = 0)
),
valid AS (SELECT slug, model, trial FROM v JOIN (SELECT slug, count(*) AS n FROM docs GROUP BY slug) USING (slug) GROUP BY slug, model, trial, n HAVING count(DISTINCT doc_id) >= n * 0.8),
last AS (SELECT slug, model, max(trial) AS trial FROM valid GROUP BY ALL),
scores AS (
  SELECT slug, model, count(*) FILTER (pass AND quality = 1) AS tp, count(*) FILTER (pass AND quality <> 1) AS fp, any_value(pos) - count(*) FILTER (pass AND quality = 1) AS fn
  FROM v JOIN last USING (slug, model, trial) JOIN (SELECT slug, count(*) FILTER (quality = 1) AS pos FROM docs GROUP BY slug) USING (slug) GROUP BY slug, model
)"""


@query("judge_trials", "WITH " + EVAL_SQL.strip() + "\nSELECT slug, model, trial FROM valid")
def judge_trials(spark, sf):
    t = evaluation.valid_trials(trial_verdicts(spark, sf), sizes(spark, sf))
    return t.select("slug", "model", "trial")


@query("judge_eval_prf1", "WITH " + EVAL_SQL.strip() + """
SELECT slug, model, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM scores""")
def judge_eval_prf1(spark, sf):
    e = runs.evaluate_judges(trial_verdicts(spark, sf), gold(spark, sf), sizes(spark, sf))
    return e.select("slug", "model", "tp", "fp", "fn", "p", "r")


@query("judge_jaccard", "WITH " + EVAL_SQL.strip() + """,
rej AS (SELECT slug, model, trial, list(doc_id) FILTER (NOT pass) AS ids FROM v SEMI JOIN valid USING (slug, model, trial) GROUP BY ALL),
pairs AS (
  SELECT a.slug, a.model, len(list_intersect(coalesce(a.ids, []), coalesce(b.ids, []))) AS i, len(list_distinct(list_concat(coalesce(a.ids, []), coalesce(b.ids, [])))) AS u
  FROM rej a JOIN rej b ON a.slug = b.slug AND a.model = b.model AND a.trial < b.trial)
SELECT slug, model, CAST(round(coalesce(avg(CASE WHEN u = 0 THEN 1 ELSE i / u END), 1) * 1000000) AS BIGINT) AS determinism_e6
FROM (SELECT DISTINCT slug, model FROM valid) LEFT JOIN pairs USING (slug, model) GROUP BY slug, model""")
def judge_jaccard(spark, sf):
    v = trial_verdicts(spark, sf)
    d = evaluation.determinism(v, evaluation.valid_trials(v, sizes(spark, sf)))
    return d.select("slug", "model", F.round(c("determinism") * 1_000_000).cast("bigint").alias("determinism_e6"))


@query("judge_matrix", "WITH " + EVAL_SQL.strip() + """,
f AS (SELECT slug, model, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE CAST(round(2 * tp / (2 * tp + fp + fn) * 1000) AS BIGINT) END AS f1 FROM scores)
SELECT model, slug, f1 FROM (SELECT DISTINCT model FROM f) CROSS JOIN (SELECT DISTINCT slug FROM f) LEFT JOIN f USING (model, slug)""")
def judge_matrix(spark, sf):
    e = runs.evaluate_judges(trial_verdicts(spark, sf), gold(spark, sf), sizes(spark, sf))
    cells = evaluation.score_matrix(e).unpivot("model", None, "slug", "score")
    return cells.select("model", "slug", F.round(c("score") * 1000).cast("bigint").alias("f1"))


BENCH_SQL = """
fx AS (
  SELECT event_type AS model, user_id AS fixture, max(value) AS latency, bool_and(value < 250 OR event_id % 5 <> 0) AS passed, bool_and(event_id % 5 <> 0 OR value < 300) AS fab, count(*) FILTER (event_id % 97 = 0) > 0 AS failed,
    max(CASE WHEN user_id % 10 <> 0 THEN event_id % 8 END) AS cost FROM events GROUP BY ALL
),
ok AS (SELECT model, latency, row_number() OVER (PARTITION BY model ORDER BY latency) - 1 AS no, count(*) OVER (PARTITION BY model) AS n FROM fx WHERE NOT failed)"""


def bench_results(spark, sf):
    """Events as benchmark criterion rows: model = event type, fixture = user."""
    e = table(spark, sf, "events")
    fail = c("event_id") % 97 == 0
    base = e.select(
        F.lit("p").alias("provider"), c("event_type").alias("model"), c("user_id").cast("string").alias("fixture"), c("value").alias("latency_s"),
        F.when(c("user_id") % 10 != 0, (c("event_id") % 8).cast("double")).alias("cost_usd"), F.when(fail, "boom").alias("error"), "value", "event_id",
    )
    fab = base.withColumn("criterion", F.lit("no_fabrication")).withColumn("passed", (c("event_id") % 5 != 0) | (c("value") < 300))
    other = base.withColumn("criterion", F.lit("sort_order")).withColumn("passed", (c("value") < 250) | (c("event_id") % 5 != 0))
    return fab.unionByName(other).drop("value", "event_id")


@query("bench_rollup", "WITH " + BENCH_SQL.strip() + """
SELECT model, (SELECT count(*) FROM fx f WHERE f.model = ok.model) AS fixtures,
  (max(latency) FILTER (no = (n - 1) // 2) + max(latency) FILTER (no = (n - 1) - (n - 1) // 2)) / 2 AS latency_p50, max(latency) FILTER (no = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) AS latency_p95,
  (SELECT sum(cost) FROM fx f WHERE f.model = ok.model) AS total_cost FROM ok GROUP BY model""")
def bench_rollup(spark, sf):
    r = runs.bench_summary(bench_results(spark, sf))
    return r.select("model", "fixtures", "latency_p50", "latency_p95", big(c("total_cost_usd")).alias("total_cost"))


@query("bench_passes", "WITH " + BENCH_SQL.strip() + """
SELECT model, count(*) FILTER (passed AND fab AND NOT failed) AS full_passes, count(*) FILTER (NOT failed) AS answered, false AS passes_bar FROM fx GROUP BY model""")
def bench_passes(spark, sf):
    fx = evaluation.fixture_results(bench_results(spark, sf))
    return evaluation.model_rollup(fx).join(fx.groupBy("model").agg(F.count_if(~c("failed_call")).alias("answered")), "model").select("model", "full_passes", "answered", "passes_bar")


# --- report criteria ------------------------------------------------------------------------------------


def report_tables(spark, sf):
    """One report text per day and block of 20 products: a table with flags, context and an odd number every third day."""
    block = F.floor(c("user_id") / 20).cast("string")
    e = table(spark, sf, "events").withColumn("report_id", F.concat(day(c("ts").cast("timestamp")), F.lit("/"), block))
    rows = e.groupBy("report_id", "user_id").agg(F.min("value").alias("low"), F.count(F.lit(1)).alias("n"))
    url = F.concat(F.lit("https://shop.example.com/u"), c("user_id").cast("string"), F.lit("-end"))
    listings = rows.select(
        "report_id", c("user_id").alias("listing_pos"), url.alias("url"), F.when(c("user_id") % 11 != 0, c("user_id") * 2.5).alias("total_for_target_usd"),
        F.when(c("user_id") % 2 == 0, F.array(F.lit("china_shipping"))).otherwise(F.array(F.lit("low_fb"))).alias("flags"),
    )
    line = F.concat(F.lit("| "), c("user_id").cast("string"), F.lit(" | [x]("), url, F.lit(") | "), F.format_string("%.2f", c("low")), F.lit(" |"))
    body = rows.select("report_id", "user_id", line.alias("line")).groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("user_id", "line"))), lambda x: x["line"]), "\n").alias("b"))
    third = F.dayofmonth(F.substring("report_id", 1, 10).cast("date")) % 3
    text = F.concat(
        F.lit("# Report\n\n| # | Item | Low |\n|---|---|---|\n"), c("b"), F.lit("\n\nShips from China shipping partners; low_fb seen.\n\n## Context\nAll rows are fresh. Odd "),
        F.when(third == 0, "987654.25").otherwise("7"), F.lit(" ok.\n\n## Next\nmore"),
    )
    payload_text = F.concat(F.lit('{"rows": "'), c("b"), F.lit('"}'))
    reports = body.select("report_id", text.alias("text"))
    counts = listings.groupBy("report_id").agg(F.count(F.lit(1)).alias("n_listings"))
    payloads = body.select("report_id", payload_text.alias("text")).join(counts, "report_id")
    return reports, payloads, listings


@query("report_criteria", """
WITH d AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') || '/' || (user_id // 20) AS report_id, day(ts) % 3 = 0 AS odd FROM events)
SELECT report_id, 'no_fabrication' AS criterion, NOT odd AS passed FROM d UNION ALL SELECT report_id, 'all_rows_present', true FROM d
UNION ALL SELECT report_id, 'flags_surfaced', true FROM d UNION ALL SELECT report_id, 'context_length', true FROM d
UNION ALL SELECT report_id, 'sort_order', bool_and(ok) FROM (
  SELECT report_id, coalesce(lag(v) OVER (PARTITION BY report_id ORDER BY user_id) <= v, true) AS ok FROM (
    SELECT DISTINCT strftime(ts, '%Y-%m-%d') || '/' || (user_id // 20) AS report_id, user_id, CASE WHEN user_id % 11 = 0 THEN 'inf'::DOUBLE ELSE user_id * 2.5 END AS v FROM events)) GROUP BY report_id""")
def report_criteria(spark, sf):
    return evaluation.check_reports(*report_tables(spark, sf)).select("report_id", "criterion", "passed")


@query("number_containment", """
WITH texts AS (SELECT doc_id, source, regexp_extract_all(text, '\\d+(?:\\.\\d+)?|\\.\\d+') AS raw FROM documents),
nums AS (
  SELECT DISTINCT doc_id, source, CASE WHEN NOT contains(n, '.') THEN n WHEN regexp_replace(regexp_replace(n, '0+$', ''), '\\.$', '') = '' THEN '0'
    ELSE regexp_replace(regexp_replace(n, '0+$', ''), '\\.$', '') END AS number FROM (SELECT doc_id, source, unnest(raw) AS n FROM texts)
),
half AS (SELECT DISTINCT source, number FROM nums WHERE (doc_id // 20) % 2 = 0),
pct AS (SELECT DISTINCT source, CASE WHEN regexp_replace(printf('%.6f', CAST(number AS DOUBLE) * 100), '\\.?0+$', '') = '' THEN '0' ELSE
    regexp_replace(regexp_replace(printf('%.6f', CAST(number AS DOUBLE) * 100), '0+$', ''), '\\.$', '') END AS number FROM half),
open AS (
  SELECT DISTINCT source, number FROM nums WHERE (doc_id // 20) % 2 = 1 AND number NOT IN ('5', '100', '200')
    AND NOT (regexp_full_match(number, '0|[1-9][0-9]*') AND coalesce(TRY_CAST(number AS BIGINT) <= 20, false))
)
SELECT source, number FROM open o WHERE NOT EXISTS (SELECT 1 FROM half h WHERE h.source = o.source AND contains(h.number, o.number))
  AND NOT EXISTS (SELECT 1 FROM pct p WHERE p.source = o.source AND p.number = o.number)""")
def number_containment(spark, sf):
    """Numbers in one half of a source's documents that the other half does not explain. Texts stay single rows per document."""
    d = table(spark, sf, "documents").select("doc_id", c("source").alias("report_id"), "text")
    half = F.floor(c("doc_id") / 20) % 2
    payloads = d.where(half == 0).select("report_id", "text", F.lit(0).alias("n_listings"))
    found = evaluation.fabricated_numbers(d.where(half == 1).select("report_id", "text"), payloads)
    return found.select(c("report_id").alias("source"), "number").distinct()
