import json
import sys
from datetime import datetime

import pytest

from pyspark import cloudpickle
from pyspark.sql import functions as F

from offerloom.functions import profile_text
from offerloom.operators import alerts, catalog, diagnostics, schedules, validation, verdicts
from offerloom.plans import runs
from offerloom.schema import PROFILE_DDL
from offerloom.sources import pages, payloads, tables
from offerloom.streaming import runs as streams

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the judges below run in Python workers
c = F.col
RUN = ["slug", "run_ts"]


# --- alerts ----------------------------------------------------------------------------------


def price_rule(spark, mode, threshold=100.0, condition=None, basis="unit", kind="price_below", host=None):
    return spark.createDataFrame([("p", 0, kind, threshold, condition, mode, basis, host)], "slug string, rule_pos int, kind string, threshold_usd double, condition string, mode string, price_basis string, host string")


def fired_runs(spark, offers, rules, state=None, **kw):
    fired, _ = alerts.evaluate(offers, rules, state, **kw)
    return [r["run_ts"].day - 1 for r in fired.orderBy("run_ts").collect()]


def test_is_below_rearms(spark, offer_rows):
    offers = offer_rows(*[{"run": i, "unit_price_usd": p} for i, p in enumerate([90.0, 80.0, 120.0, 95.0])])
    assert fired_runs(spark, offers, price_rule(spark, "is_below")) == [0, 3]
    assert fired_runs(spark, offers, price_rule(spark, "while_below")) == [0, 1, 3]
    assert fired_runs(spark, offers, price_rule(spark, "drops_below")) == [0, 3]
    disarmed = spark.createDataFrame([("p", "price_below|is_below|100.0||unit", False)], "slug string, fingerprint string, armed boolean")
    assert fired_runs(spark, offers, price_rule(spark, "is_below"), disarmed) == [3]
    edited = spark.createDataFrame([("p", "price_below|is_below|99.0||unit", False)], "slug string, fingerprint string, armed boolean")
    assert fired_runs(spark, offers, price_rule(spark, "is_below"), edited) == [0, 3]
    _, state = alerts.evaluate(offers, price_rule(spark, "is_below"))
    assert [(r["fingerprint"], r["armed"]) for r in state.collect()] == [("price_below|is_below|100.0||unit", False)]


def test_alert_condition_basis_and_empty_runs(spark, offer_rows):
    offers = offer_rows({"run": 0, "unit_price_usd": 10.0, "is_kit": True, "kit_price_usd": 200.0, "condition": "new"}, {"run": 2, "unit_price_usd": 60.0, "condition": "new"}, {"run": 2, "unit_price_usd": 1.0, "condition": "used"})
    assert fired_runs(spark, offers, price_rule(spark, "drops_below", basis="total", condition="new")) == [2]
    assert fired_runs(spark, offers, price_rule(spark, "is_below", condition="new")) == [0]
    all_runs = spark.createDataFrame([("p", datetime(2026, 1, d)) for d in (1, 2, 3)], "slug string, run_ts timestamp")
    assert fired_runs(spark, offers, price_rule(spark, "is_below", condition="new"), runs=all_runs) == [0, 2]


def test_vendor_alerts(spark, offer_rows):
    offers = offer_rows({"run": 0, "url": "https://www.a.com/1"}, {"run": 1, "url": "https://b.com/1"}, {"run": 1, "url": "https://a.com/2"}, {"run": 2, "url": "https://b.com/9"}, {"run": 3, "url": "https://a.com/3"})
    assert fired_runs(spark, offers, price_rule(spark, None, kind="vendor_seen", host="WWW.A.com")) == [0, 3]
    fired, _ = alerts.evaluate(offers, price_rule(spark, None, kind="new_vendor_carries"), names=spark.createDataFrame([("p", "Thing")], "slug string, display_name string"))
    assert sorted((r["run_ts"].day, r["headline"]) for r in fired.collect()) == [
        (1, "New vendor now carries Thing: a.com"), (2, "New vendor now carries Thing: b.com"), (4, "New vendor now carries Thing: a.com")]
    panel = alerts.audit_text(fired.withColumn("outcome", F.lit("ok"))).orderBy("run_ts").first()["panel"]
    assert panel == "## Alerts fired\n\n- **new_vendor_carries**: New vendor now carries Thing: a.com _(notify=ok)_"


# --- diagnostics ------------------------------------------------------------------------------------


def test_run_outcomes(spark):
    rows = [(0, 0, True, False), (0, 0, False, True), (5, 0, False, True), (5, 0, False, False), (5, 1, True, True)]
    df = spark.createDataFrame([(*r, True, False, True) for r in rows], "recall_count int, survivor_count int, serper_error boolean, filter_error boolean, ebay_error boolean, amazon_error boolean, degraded_attrs boolean")
    got = df.select(diagnostics.run_outcome().alias("o")).select("o.class", F.transform("o.notes", lambda n: n["class"]).alias("n")).collect()
    assert [r["class"] for r in got] == ["index_unavailable", "no_recall", "filter_unavailable", "all_filtered", "ok"]
    assert got[0]["n"] == ["ebay_unavailable", "degraded_attr"]


def test_rejection_attribution_by_url(spark):
    stats = spark.createDataFrame(
        [("p", "universal_ai_search", "u1", 2, 0), ("p", "universal_ai_search", "u2", 4, 0), ("p", "ebay_search", None, 3, 1), ("p", "none", None, 0, 0)],
        "slug string, source string, match_url string, fetched int, passed int").withColumn("run_ts", F.lit("2026-01-01").cast("timestamp"))
    log = spark.createDataFrame(
        [("p", "universal_ai_search", "u1", "x"), ("p", "universal_ai_search", "u1", "y"), ("p", "universal_ai_search", "u2", "[relevance_check] a"), ("p", "universal_ai_search", "u2", "b"), ("p", "ebay_search", None, "price")],
        "slug string, source string, source_url string, reason string").withColumn("run_ts", F.lit("2026-01-01").cast("timestamp")).withColumn("pass", F.lit(False))
    got = diagnostics.attribute_rejections(stats, log).withColumn("d", diagnostics.dominant_rejection())
    assert {(r["source"], r["match_url"]): r["d"] for r in got.collect()} == {
        ("universal_ai_search", "u1"): "mis_scoped_url_2", ("universal_ai_search", "u2"): "relevance_check", ("ebay_search", None): None, ("none", None): "vendor_does_not_carry"}


# --- v2 run, judge, report ----------------------------------------------------------------------------


PROFILE = {
    "schema_version": 2, "slug": "p", "display_name": "Thing", "target": {"unit": "count", "amount": 1, "configurations": []}, "queries": ["thing"],
    "match": {"aliases": ["X-100"], "title_excludes": ["case"], "variant_strict": True}, "filters": {"condition_in": ["new"], "min_quantity": 2},
    "sources": {"serper": {"gl": "us"}}, "display": {"max_listings": 3, "per_vendor_cap": 1},
}


def profiles(spark, **changes):
    doc = json.dumps({**PROFILE, **changes})
    df = spark.createDataFrame([(doc,)], "j string").select(F.from_json("j", PROFILE_DDL).alias("p")).select("p.*")
    return tables.with_defaults(df)


def run_rows(offer_rows):
    return offer_rows(
        {"title": "X-100 new", "seller_name": "A", "unit_price_usd": 10.0, "condition": "new"}, {"title": "X-100 case", "seller_name": "A", "unit_price_usd": 1.0}, {"title": "X-100T", "seller_name": "B", "unit_price_usd": 2.0},
        {"title": "the x-100!", "seller_name": "A", "unit_price_usd": 12.0, "ship_from_country": "CN"}, {"title": "X-100 used", "seller_name": "C", "unit_price_usd": 5.0, "condition": "used"}, {"title": "X-100", "seller_name": "C", "unit_price_usd": 9.0},
    )


def judge(payload):
    return json.dumps({"evaluations": [{"index": e["index"], "pass": "new" not in e["title"] or e["model_name_in_title"], "extracted_features": {"condition": "mint", "term": "1y"}} for e in json.loads(payload)]}), {"input_tokens": 1000}


def test_v2_run_and_report(spark, offer_rows):
    p = profiles(spark)
    run = runs.run_offers(run_rows(offer_rows), p, [verdicts.Judge("anthropic", "claude-haiku-4-5", judge)])
    assert [(r["rank"], r["pos"]) for r in run["displayed"].orderBy("rank").collect()] == [(1, 5), (2, 0)]
    survivors = {r["pos"]: r for r in run["survivors"].collect()}
    assert sorted(survivors) == [0, 3, 5] and survivors[3]["flags"] == ["ship_from_cn"]
    assert survivors[0]["attrs"] == {"term": "1y"} and survivors[5]["attrs"] == {"term": "1y", "condition": "mint"}
    f = run["funnel"].first()
    assert (f["recall_count"], f["survivor_count"], f["displayed_count"], f["outcome"]["class"]) == (6, 3, 2, "ok")
    payload = runs.build_reports(run, p, run["calls"]).first()["payload"]
    assert payload["overflow"] == {"a": 1} and payload["columns"] == ["price", "condition", "seller"]
    assert payload["run_cost"]["total_usd"] == 0.001 and [json.loads(x)["rank"] for x in payload["listings"]] == [1, 2]
    md = runs.report_markdown(runs.build_reports(run, p), run["displayed"]).first()["markdown"]
    assert "**2 shown** (of 3 matched, 6 found)" in md and "_1 more from a._" in md and "| 1 | $9.00 | mint | C |" in md.replace("| 1 | $9.00 | mint | C |", "| 1 | $9.00 | mint | C |")
    assert [r["rank"] for r in runs.all_listings(run).orderBy("rank").collect()] == [1, 2, 3]


def test_a_second_attempt_asks_only_what_has_no_answer(spark, offer_rows, tmp_path):
    """Batches of one offer; the first attempt dies in one of them, the others are in the store by then."""
    calls, alive = tmp_path / "calls", tmp_path / "alive"
    calls.mkdir()

    def costly(payload):
        entry = json.loads(payload)[0]
        if entry["title"] == "X-100T" and not alive.exists():
            raise SystemExit("the worker is gone")  # ends the task, not the call
        (calls / f"{abs(hash(payload))}-{len(list(calls.iterdir()))}").write_text(entry["title"])
        return json.dumps([{"index": 0, "pass": True}]), {"input_tokens": 7}

    def asked():
        return sorted(f.read_text() for f in calls.iterdir())

    judges, store = [verdicts.Judge("local", "a/b c", costly)], verdicts.ReplyStore(str(tmp_path / "replies"), calls_per_task=1)
    o = run_rows(offer_rows)
    with pytest.raises(Exception, match="worker|Python"):
        verdicts.run_chain(o, judges, size=1, store=store)[0].count()
    first, kept = asked(), verdicts.stored_replies(spark, store, judges[0]).count()
    assert "X-100T" not in first and 1 <= kept <= len(first)
    alive.touch()
    answered, failed, made = verdicts.run_chain(o, judges, size=1, store=store)
    assert answered.count() == 6 and failed.count() == 0 and made.agg(F.sum("input_tokens")).first()[0] == 42
    both = len(asked())
    assert set(asked()) == {r["title"] for r in o.collect()} and both == len(first) + 6 - kept  # only what the store lacks
    verdicts.run_chain(o, judges, size=1, store=store)
    assert len(asked()) == both
    verdicts.run_chain(o.withColumn("title", F.concat("title", F.lit("!"))), judges, size=1, store=store)  # other texts
    assert len(asked()) == both + 6


def test_failed_judges_empty_the_run(spark, offer_rows):
    down = verdicts.Judge("local", "x", lambda payload: "nonsense")
    run = runs.run_offers(run_rows(offer_rows), profiles(spark), [down])
    assert run["survivors"].count() == 0 and run["funnel"].first()["outcome"]["class"] == "filter_unavailable"
    log = run["log"].collect()
    assert [r["index"] for r in log] == [-1] and log[0]["reason"].startswith("ai_filter parse failure") and log[0]["reason"].endswith("(batch 1)")


def test_v1_validation_log(offer_rows):
    passed, log = runs.validate_offers(run_rows(offer_rows), [{"rule": "title_excludes", "values": ["case"]}], [], brand_candidates=["x-100"], judges=[verdicts.DEFAULT_CHAIN[0]])
    assert passed.count() == 5 and {r["brand"] for r in passed.collect()} == {None, "x-100"}
    assert sorted((r["index"], r["pass"]) for r in log.collect()) == [(0, True), (1, False), (2, True), (3, True), (4, True), (5, True)]


def test_injected_recall(spark, offer_rows):
    run = runs.recall_and_run(lambda p: run_rows(offer_rows).join(p.select("slug"), "slug", "left_semi"), profiles(spark), judges=None)
    assert run["displayed"].count() == 2


# --- sources and tables -----------------------------------------------------------------------------------


def run_doc(spark, doc, ddl):
    return payloads.parse_json(spark.createDataFrame([("p", datetime(2026, 1, 1), json.dumps(doc))], "slug string, run_ts timestamp, d string"), "d", ddl)


def test_shopping_rows(spark):
    doc = {"shopping": [{"title": "a", "price": "$1,000.50", "productId": "1", "link": "l", "source": "S"}, {"title": "b", "productId": "1", "link": "m"}, {"title": "c"}, {"title": "d"}]}
    rows = payloads.shopping_offers(run_doc(spark, doc, payloads.SHOPPING_DDL)).orderBy("pos").collect()
    assert [(r["title"], r["unit_price_usd"], r["condition"]) for r in rows] == [("a", 1000.5, ""), ("c", 0.0, ""), ("d", 0.0, "")]
    assert payloads.shopping_offers(run_doc(spark, {"shopping": "none"}, payloads.SHOPPING_DDL)).count() == 0


def test_strict_tasks_raise(spark):
    doc = {"cost": 0.5, "tasks": [{"status_code": 40501, "status_message": "bad"}]}
    docs = run_doc(spark, doc, payloads.TASK_DDL)
    assert payloads.task_offers(docs).count() == 0 and payloads.bad_tasks(docs).first()["error"] == "task failed (40501): bad"
    try:
        payloads.task_offers(docs, strict=True).collect()
        raise AssertionError("no error")
    except Exception as exc:  # noqa: BLE001
        assert "task failed: bad" in str(exc)


def test_page_items(spark):
    html = (
        '<div class="s-item__wrapper"><div class="s-item__title"><span>Hynix 32GB &amp; 4800</span></div><a class="s-item__link" href="u1">x</a><span class="s-item__price">$1,099.00</span></div>'
        '<div class="s-item__wrapper"><a class="s-item__link" href="u2"></a></div><div class="s-item__wrapper"><div class="s-item__title"><span>T</span></div><span class="s-item__price">$1 to $2</span></div>'
        '<div class="s-item__wrapper"><div class="s-item__title"><span>No price</span></div><span class="SECONDARY_INFO">Brand New</span></div>'
    )
    df = spark.createDataFrame([(1, "p", datetime(2026, 1, 1), html), (2, "p", datetime(2026, 1, 1), None)], "page_id bigint, slug string, run_ts timestamp, html string")
    rows = pages.page_offers(df, "cloudstoragecorp_ebay").orderBy("pos").collect()
    assert [(r["title"], r["url"], r["unit_price_usd"], r["condition"], r["attrs"]) for r in rows] == [
        ("Hynix 32GB & 4800", "u1", 1099.0, "used", {"capacity_gb": "32", "speed_mts": "4800"}), ("No price", "", 0.0, "new", {})]


def test_snapshot_csv_round_trip(spark, offer_rows, tmp_path):
    df = offer_rows({"title": 'a "q", b\nline', "brand": "", "attrs": {"k": "v"}, "flags": ["f", "g"], "is_kit": True, "kit_price_usd": 9.5, "hour": 5, "quantity_available": 0})
    tables.write_snapshot_csv(df, str(tmp_path / "s"))
    back = tables.read_written_csv(spark, str(tmp_path / "s")).first()
    src = df.first()
    assert all(back[n] == src[n] for n in ("slug", "run_ts", "title", "fetched_at", "attrs", "flags", "is_kit", "kit_price_usd", "quantity_available")) and back["brand"] is None


def test_snapshot_csv_from_run_files(spark, offer_rows, tmp_path):
    folder = tmp_path / "thing" / "data"
    folder.mkdir(parents=True)
    names = ",".join(tables.SNAPSHOT_CSV_COLUMNS)
    (folder / "2026-01-02T03-04-05Z.csv").write_text(names + '\nebay_search,u,"T, x",2026-01-02T03:04:05+00:00,,,"{""a"": 1}",new,0,1,5.5,,,s,,,US,,"[""f""]",\n')
    row = tables.read_snapshot_csv(spark, str(folder)).first()
    assert (row["slug"], row["run_ts"], row["title"], row["attrs"], row["flags"], row["quantity_available"]) == ("thing", datetime(2026, 1, 2, 3, 4, 5), "T, x", {"a": "1"}, ["f"], None)


def test_history_table_upsert(spark, offer_rows, tmp_path):
    path = str(tmp_path / "h")
    tables.upsert_history(spark, offer_rows({"url": "a", "unit_price_usd": 1.0}, {"url": "b", "run": 1, "unit_price_usd": 2.0}), path)
    tables.upsert_history(spark, offer_rows({"url": "a", "unit_price_usd": 5.0}, {"url": "c", "unit_price_usd": 6.0}), path)
    assert sorted((r["url"], r["unit_price_usd"]) for r in spark.read.parquet(path).collect()) == [("a", 5.0), ("b", 2.0), ("c", 6.0)]


def test_verdict_log_and_report_tables(spark, offer_rows, tmp_path):
    row = spark.createDataFrame([(datetime(2026, 1, 1), "p", 0, False, "r", "t", 1.0, "u", "s", None)], "timestamp timestamp, product string, index int, pass boolean, reason string, title string, price double, url string, source string, source_url string")
    for hours in (0, 1, 1):  # two runs, the second one replayed
        later = row.withColumn("timestamp", c("timestamp") + F.make_dt_interval(hours=F.lit(hours)))
        tables.write_verdict_log(later, str(tmp_path / "d"), str(tmp_path / "l"))
    assert tables.read_verdict_log(spark, str(tmp_path / "d")).count() == 2 and tables.read_verdict_log(spark, str(tmp_path / "l")).count() == 1
    p = profiles(spark)
    run = runs.run_offers(run_rows(offer_rows), p, judges=None)
    tables.write_reports(runs.build_reports(run, p), str(tmp_path / "r"))
    card = tables.report_cards(tables.read_reports(spark, str(tmp_path / "r"))).first()
    assert (card["slug"], card["schema_version"], card["display_name"], card["listing_count"]) == ("p", 2, "Thing", 3)


def test_profile_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("schema_version: 2\nslug: a\ndisplay_name: A\ntarget: {unit: count, amount: 1}\nqueries: [x]\n")
    (tmp_path / "b.yaml").write_text("slug: b\n")
    (tmp_path / "c.yaml").write_text("x: [1\n")
    good, bad = tables.load_profiles(tables.read_profile_documents(spark, str(tmp_path)))
    row = good.first()
    assert (row["slug"], row["display"]["max_listings"], row["sources"]["serper"]["gl"]) == ("a", 20, "us") and bad.count() == 1
    assert profile_text.profile_summary(good.withColumn("flags", F.array(F.lit("x_y")))).first()["flags"] == ["X y"]


# --- schedules, catalogue, checks -----------------------------------------------------------------------


def test_due_runs(spark):
    rows = spark.createDataFrame([("a", "0 6 * * *", None), ("b", None, datetime(2026, 1, 1, 5, 50)), ("c", "bad", None), ("d", None, datetime(2026, 1, 3))], "slug string, cron string, run_at timestamp")
    ticks = spark.createDataFrame([(datetime(2026, 1, 1, 6, 0),), (datetime(2026, 1, 1, 6, 15),)], "tick timestamp")
    got = sorted((r["slug"], r["tick"].minute, r["reason"]) for r in schedules.due_runs(rows, ticks).collect())
    assert got == [("a", 0, "cron"), ("b", 0, "run_at")]
    done = rows.where(c("slug") == "b").select("slug", "run_at")
    assert [r["slug"] for r in schedules.due_runs(rows, ticks, done).collect()] == ["a"]


def test_named_runs_find_slugs_inside_titles(spark):
    log = spark.createDataFrame([(1, "run abc-1x", "n"), (2, None, "abc"), (3, "ab", "zz")], "run_id int, display_title string, name string")
    slugs = spark.createDataFrame([("abc",), ("abc-1",), ("zzz",)], "slug string")
    assert sorted((r["run_id"], r["slug"]) for r in catalog.named_runs(slugs, log).collect()) == [(1, "abc"), (1, "abc-1"), (2, "abc")]


def test_parity(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([("y",), ("z",)], "id string")
    assert sorted((r["id"], r["only_in"]) for r in validation.parity(a, b).collect()) == [("x", "left"), ("z", "right")]


# --- streams ---------------------------------------------------------------------------------------------


def drain(spark, df, home, **kw):
    q = df.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{home}/c")
    q = (q.foreachBatch(kw["each"]) if "each" in kw else q.format("parquet").option("path", f"{home}/o")).start()
    q.awaitTermination()
    return None if "each" in kw else spark.read.schema(df.schema).parquet(f"{home}/o")


def test_price_alert_stream_keeps_state_between_batches(spark, tmp_path):
    ddl = "slug string, rule_pos int, fingerprint string, mode string, threshold_usd double, run_ts timestamp, price double"
    src, home = str(tmp_path / "in"), str(tmp_path / "q")
    fired = []
    for day, price in enumerate([90.0, 80.0, None, 95.0], 1):
        spark.createDataFrame([("p", 0, "f", "is_below", 100.0, datetime(2026, 1, day), price)], ddl).write.mode("append").parquet(src)
        out = drain(spark, streams.price_alert_stream(spark.readStream.schema(ddl).parquet(src)), home)
        fired = sorted(r["run_ts"].day for r in out.where("fires").collect())
    assert fired == [1, 4]


def test_stream_history_and_alert_sinks(spark, offer_rows, tmp_path):
    src = str(tmp_path / "in")
    offer_rows({"url": "a", "hour": 6, "unit_price_usd": 1.0}, {"url": "a", "hour": 9, "unit_price_usd": 2.0}).write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    for _ in range(2):
        offer_rows({"url": "a", "hour": 9, "unit_price_usd": 3.0}).write.mode("append").parquet(src)
        drain(spark, stream(), str(tmp_path / "q1"), each=streams.history_writer(str(tmp_path / "h")))
        drain(spark, stream(), str(tmp_path / "q2"), each=streams.latest_writer(str(tmp_path / "l")))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2
    assert [r["unit_price_usd"] for r in spark.read.parquet(str(tmp_path / "l")).collect()] in ([3.0], [2.0])
    drain(spark, stream().withColumn("fires", c("unit_price_usd") > 1), str(tmp_path / "q3"), each=streams.alert_writer(str(tmp_path / "f")))
    assert {r["outcome"] for r in spark.read.parquet(str(tmp_path / "f")).collect()} == {"ok"}


def test_damaged_history_raises_and_keeps_its_files(spark, offer_rows, tmp_path):
    path = str(tmp_path / "h")
    tables.upsert_history(spark, offer_rows({"url": "a"}, {"url": "b"}, {"url": "c", "run": 1}), path)
    tables.upsert_history(spark, offer_rows({"url": "b", "unit_price_usd": 2.0}), path)
    assert sorted((r["url"], r["unit_price_usd"]) for r in spark.read.parquet(path).collect()) == [("a", 0.0), ("b", 2.0), ("c", 0.0)]
    files = sorted(p for p in (tmp_path / "h").rglob("part-*.parquet") if "2026-01-01" in str(p))
    files[0].write_bytes(b"damaged")
    with pytest.raises(Exception):
        tables.upsert_history(spark, offer_rows({"url": "z"}), path)
    assert sorted(p for p in (tmp_path / "h").rglob("part-*.parquet") if "2026-01-01" in str(p)) == files
    tables.upsert_history(spark, offer_rows({"url": "z", "run": 1}), path)  # the damaged day is not read


def test_replays_do_not_repeat_rows(spark, offer_rows, tmp_path):
    csv = str(tmp_path / "csv")
    for _ in range(2):
        tables.write_snapshot_csv(offer_rows({"url": "a"}, {"url": "b"}), csv)
    assert tables.read_written_csv(spark, csv).count() == 2
    log = spark.createDataFrame([(datetime(2026, 1, 1, 6), "p", 0, True, "r", "t", 1.0, "u", "s", None)], tables.VERDICT_LOG_DDL)
    for _ in range(2):
        tables.write_verdict_log(log, str(tmp_path / "daily"), str(tmp_path / "latest"))
    assert tables.read_verdict_log(spark, str(tmp_path / "daily")).count() == 1


def test_newest_pair_is_the_same_as_cutting_first(offer_rows):
    rows = [{"url": f"u{i}", "run": d, "unit_price_usd": 10.0 + d * i} for d in range(4) for i in range(4) if (d + i) % 3]
    rows += [{"slug": "single", "url": "x", "run": 2}]
    diff, head = runs.diff_latest(offer_rows(*rows))
    got = sorted((r["slug"], r["url"], r["change_type"]) for r in diff.collect())
    whole, _ = runs.diff_latest(offer_rows(*rows), newest_only=False)
    last = whole.where("snapshot_date = date'2026-01-04'")
    assert got == sorted((r["slug"], r["url"], r["change_type"]) for r in last.collect()) and got
    assert [(r["slug"], r["snapshot_date"].day) for r in head.collect()] == [("p", 4)]
