from pyspark.sql import functions as F

from offerloom import schema
from offerloom.operators import anomalies, dedup, dimensions, display, history, ranking, rules, skew, verdicts
from offerloom.plans import runs

c = F.col
RUN = ["slug", "run_ts"]


def col(df, name, order="pos"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]


def cols(df, names, order):
    return [tuple(r) for r in df.orderBy(*order).select(*names).collect()]


def test_unknown_values_pass_every_reject(offer_rows):
    row = offer_rows({"url": "https://x.com/a", "source": "ebay_search"})
    every = [{"rule": n, "values": ["x"], "value": 1.0} for n in rules.REJECTS]
    assert col(row.withColumn("r", rules.first_reject(every)), "r") == [None]


def test_reject_cases(offer_rows):
    df = offer_rows(
        {"attrs": {"ecc": "false"}}, {"attrs": {"speed_mts": "4000"}}, {"url": "https://e.com/sch/i", "source": "ebay_search"}, {"url": "https://g.com/search?q"},
        {"quantity_available": 0}, {"title": "for PARTS only"}, {"condition": " Used "}, {"condition": ""}, {"attrs": {"capacity_gb": "16"}},
    )
    got = col(df.withColumn("r", rules.first_reject([
        {"rule": "ecc_required"}, {"rule": "speed_mts_min", "value": 4800}, {"rule": "single_sku_url"}, {"rule": "in_stock"}, {"rule": "title_excludes", "values": ["for parts"]},
        {"rule": "condition_in", "values": ["new"]}, {"rule": "min_quantity_for_target"}])), "r")
    assert got == [
        "[ecc_required] non-ECC memory", "[speed_mts_min] speed 4000 MT/s is below minimum 4800", "[single_sku_url] URL appears to be a search results page, not a single SKU", None,
        "[in_stock] out of stock", "[title_excludes] title contains excluded phrase 'for parts'", "[condition_in] condition 'used' not in ['new']", None,
        "[min_quantity_for_target] module capacity 16GB not in allowed target configurations",
    ]


def test_flags_once_and_in_order(offer_rows):
    df = offer_rows({"brand": "Kingston", "mpn": "KSM32E", "flags": ["b"], "seller_rating_pct": 99.0, "seller_feedback_count": 5, "ship_from_country": "cn"})
    made = rules.with_flags(df, rules.raised_flags([
        {"rule": "ship_from_country_in", "flag": "a", "values": ["CN"]}, {"rule": "kingston_e_suffix", "flag": "b"}, {"rule": "low_seller_feedback", "flag": "c", "rating_pct_below": 98, "count_below": 10},
        {"rule": "brand_in", "flag": "a", "values": ["king"]}, {"rule": "nope", "flag": "z"}]))
    assert col(made, "flags") == [["b", "a", "c"]]
    unknown = rules.with_flags(offer_rows({}), rules.raised_flags([{"rule": "low_seller_feedback", "flag": "c"}]))
    assert col(unknown, "flags") == [["c"]]


def test_ship_from_gate(offer_rows):
    df = offer_rows({"ship_from_country": "us"}, {"ship_from_country": "CN"}, {})
    assert col(rules.ship_from_gate(df, F.array(F.lit("US"))), "flags") == [[], ["ship_from_cn"], []]
    assert rules.ship_from_gate(df, F.array(F.lit("US")), drop=True).count() == 2
    assert col(rules.ship_from_gate(df, F.array().cast("array<string>")), "flags") == [[], [], []]


def test_vendor_filter(offer_rows):
    df = offer_rows({"seller_name": "Walmart - Seller"}, {"seller_name": "joe", "source": "ebay_search"}, {"seller_name": "B&H Photo-Video"}, {"seller_name": ""})
    texts = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    assert col(rules.vendor_filter(df, texts("walmart", "eBay"), texts()), "pos") == [0, 1]
    assert col(rules.vendor_filter(df, texts(), texts("b&h", " ")), "pos") == [0, 1, 3]
    assert col(rules.vendor_filter(df, texts("walmart", "ebay"), texts("EBAY")), "pos") == [0]


def test_price_anomalies(offer_rows):
    flags = lambda *p: col(anomalies.flag_price_anomalies(offer_rows(*[{"unit_price_usd": float(x)} for x in p])), "flags")
    assert flags(599, 610, 605, 620, 67.2) == [[], [], [], [], ["price_anomaly_low"]]
    assert flags(100, 105, 110, 102, 9999) == [[], [], [], [], ["price_anomaly_high"]]
    assert flags(600, 610, 590, 480) == [[]] * 4
    assert flags(600, 610, 67) == [[]] * 3
    assert flags(0, 0, 100, 100, 100, 100, 40)[-1] == ["price_anomaly_low"]
    assert flags(0, 600, 610, 605)[0] == []


def test_display_selection(offer_rows):
    rows = [(120, "B&H"), (100, "B&H"), (110, "B&H"), (105, "Walmart"), (130, "Newegg")]
    df = offer_rows(*[{"unit_price_usd": float(p), "seller_name": s} for p, s in rows])
    shown = ranking.select_for_display(df, 3, 2)
    assert col(shown, "unit_price_usd", "rank") == [100.0, 105.0, 110.0]
    assert [(r["vendor"], r["held_back"]) for r in ranking.vendor_overflow(df, shown, 2).collect()] == [("b&h", 1)]


def test_anomalies_and_unpriced_sort_last(offer_rows):
    df = offer_rows({"unit_price_usd": 67.2, "flags": ["price_anomaly_low"]}, {"unit_price_usd": 0.0}, {"unit_price_usd": 610.0}, {"unit_price_usd": 599.0})
    assert col(ranking.select_for_display(df, 9, 9), "pos", "rank") == [3, 2, 1, 0]
    assert col(ranking.rank_all(df), "pos", "rank") == [3, 2, 1, 0]


def test_reserved_rows_per_source(offer_rows):
    rows = [{"unit_price_usd": float(i), "source": "ebay_search"} for i in range(40)] + [{"unit_price_usd": 500.0 + i, "source": "amazon_dataforseo"} for i in range(4)]
    rows += [{"unit_price_usd": 900.0 + i, "source": "universal_ai_search", "attrs": {"vendor_host": h}} for h in ("a.com", "b.com") for i in range(4)]
    ranked = ranking.rank_for_report(offer_rows(*rows), 30)
    by = ranked.groupBy("source", ranking.source_bucket().alias("b")).count().collect()
    got = {(r["source"], r["b"]): r["count"] for r in by}
    assert got == {("ebay_search", ""): 21, ("amazon_dataforseo", ""): 3, ("universal_ai_search", "a.com"): 3, ("universal_ai_search", "b.com"): 3}
    assert ranked.count() == 30


def test_dedup_keeps_first_and_blank_urls(offer_rows):
    df = offer_rows({"url": "a"}, {"url": " a "}, {"url": ""}, {"url": " "}, {"url": "b"})
    assert col(dedup.distinct_offers(df), "pos") == [0, 2, 3, 4]


def test_history_same_day_rerun_and_upsert(offer_rows):
    df = offer_rows({"url": "u", "hour": 6, "unit_price_usd": 100.0}, {"url": "u", "hour": 18, "unit_price_usd": 120.0}, {"url": "u", "run": 1, "unit_price_usd": 90.0})
    assert col(history.latest_per_day(df), "unit_price_usd", "fetched_at") == [120.0, 90.0]
    again = offer_rows({"url": "u", "hour": 6, "unit_price_usd": 101.0})
    assert sorted(col(history.upsert(df, again), "unit_price_usd")) == [90.0, 101.0, 120.0]


def test_diff_cases(offer_rows):
    rows = [("stable", 300, 302), ("moved", 200, 180), ("edge", 100, 95), ("drop", 400, None), ("new", None, 500), ("free", 0, 10)]
    df = offer_rows(*[{"url": u, "run": r, "unit_price_usd": float(p)} for u, a, b in rows for r, p in ((0, a), (1, b)) if p is not None])
    diff = history.diff_steps(history.latest_per_day(df))
    got = {r["url"]: (r["change_type"], r["pct_change"]) for r in diff.collect()}
    assert got == {"moved": ("changed", -0.1), "edge": ("changed", -0.05), "drop": ("dropped", None), "new": ("new", None), "free": ("changed", float("inf"))}
    head = history.material_change(history.latest_per_day(df), diff).first()
    assert head["headline"] == "1 new listings found" and head["is_material"]


def test_diff_skips_nothing_between_distant_dates(offer_rows):
    df = offer_rows({"url": "a", "run": 0, "unit_price_usd": 1.0}, {"url": "b", "run": 3, "unit_price_usd": 1.0}, {"url": "a", "run": 9, "unit_price_usd": 1.0})
    got = sorted((r["step_no"], r["url"], r["change_type"]) for r in history.diff_steps(history.latest_per_day(df)).collect())
    assert got == [(2, "a", "dropped"), (2, "b", "new"), (3, "a", "new"), (3, "b", "dropped")]


def test_report_input_and_text_lines(spark, offer_rows):
    df = offer_rows({"url": "https://a.com/1", "run": 0, "unit_price_usd": 200.0}, {"url": "https://a.com/1", "run": 1, "unit_price_usd": 180.0}, {"url": "b", "run": 1, "unit_price_usd": 5.0})
    diff = history.diff_steps(history.latest_per_day(df), "run_ts")
    lines = sorted(r["line"] for r in display.diff_lines(diff).collect())
    assert lines == ["  - [serper_shopping](b) - $5.00: item 2", "  - [serper_shopping](https://a.com/1) - $200.00 -> $180.00 (-10.0%): item 1"]
    names = spark.createDataFrame([("p", "Thing")], "slug string, display_name string")
    docs = {r["run_ts"].day: r for r in runs.synthesis_payload(ranking.rank_for_report(df), diff, names).collect()}
    assert (docs[2]["new_count"], docs[2]["changed_count"], [x["rank"] for x in docs[2]["listings"]]) == (1, 1, [1, 2]) and docs[1]["new_count"] is None
    assert tuple(docs[1]["product"]) == ("p", "Thing", None, None)
    rated = display.report_table(offer_rows({"seller_rating_pct": None}, {"seller_rating_pct": 98.25}).withColumn("rank", c("pos")), ["rank", "seller_rating"])
    assert sorted((r.col_rank, r.col_seller_rating) for r in rated.collect()) == [("0", "unknown"), ("1", "98.3%")]
    calls = spark.createDataFrame([("ai_filter", "glm", "x", 1234, None, None)], "step string, provider string, model string, input_tokens bigint, output_tokens bigint, cost_usd double")
    assert display.cost_lines(calls).first()["line"] == "| ai_filter | glm/x | 1,234 | 0 | (unpriced) |"


def test_known_parts(spark, offer_rows):
    df = offer_rows({"mpn": " ABC "}, {"mpn": "x"}, {"mpn": None})
    known = spark.createDataFrame([("abc",), ("ABC",), ("",)], "mpn string")
    assert col(dimensions.annotate_known_parts(df, known), "qvl_status") == ["qvl", "unknown", "unknown"]


def test_badges(offer_rows):
    df = offer_rows({"flags": ["low_fb", "suspicious_listing", "low_fb", "odd"]})
    flag_rules = F.array(F.struct(F.lit("low_fb").alias("flag"), F.lit("low_seller_feedback").alias("rule")))
    got = [(b["key"], b["label"], b["severity"]) for b in df.select(dimensions.badges(c("flags"), flag_rules).alias("b")).first()["b"]]
    assert got == [("low_fb", "Limited reviews", "info"), ("suspicious_listing", "Suspicious listing", "danger"), ("odd", "odd", "info")]


def test_resolve_columns(spark, offer_rows):
    df = offer_rows({"seller_name": "x", "attrs": {"term": "1y", "flavor": " "}})
    profiles = spark.createDataFrame([("p", "Subscription ", ([],)), ], "slug string, product_type string, display struct<attrs:array<string>>")
    assert display.resolve_columns(df, profiles).first()["columns"] == ["price", "term", "seller"]
    custom = spark.createDataFrame([("p", None, (["flavor", "SELLER", "seller", "rating"],))], "slug string, product_type string, display struct<attrs:array<string>>")
    assert display.resolve_columns(df, custom).first()["columns"] == ["price", "seller"]


def test_rendered_table(offer_rows):
    df = offer_rows({"title": "a|b", "unit_price_usd": 5.0, "seller_name": "s"})
    md = display.rendered_table(ranking.rank_for_report(df)).first()["table_md"]
    assert md.endswith("| 1 | [serper_shopping](https://v0.com/x) | a\\|b | $5.00 | unknown | unknown | s | (no flags) |")


# --- exactness and plan shape under a hot key --------------------------------------------------------


def test_ordered_rank_and_median_on_a_hot_key(spark):
    rows = spark.range(5000).select(F.when(c("id") % 3 > 0, "hot").otherwise(c("id").cast("string")).alias("k"), (c("id") * 7919 % 1000 / 8).alias("v"), c("id"))
    ranked = skew.ordered_rank(rows, ["k"], [c("v"), c("id")]).where(c("k") == "hot").orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1))
    assert [(r["v"], r["id"]) for r in ranked] == sorted((r["v"], r["id"]) for r in ranked)
    got = {r["k"]: (r["m"], r["m_n"]) for r in skew.exact_median(rows, ["k"], "v", "m").collect()}
    want = {r["k"]: (r["m"], r["n"]) for r in rows.groupBy("k").agg(F.median("v").alias("m"), F.count(F.lit(1)).alias("n")).collect()}
    assert got == want


def test_row_limits_reach_the_map_side(offer_rows):
    df = offer_rows({"unit_price_usd": 1.0})
    plan = ranking.select_for_display(df, 20, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 3


def three_sources(offer_rows):
    """Three recalls whose positions repeat, with equal prices and blank URLs."""
    recalls = [
        offer_rows(*[{"source": s, "url": "" if p == 1 else f"https://{s}{p}.com/x", "title": f"{s} {p}", "unit_price_usd": 10.0, "seller_name": f"v{s}{p}", "pos": p} for p in range(3)])
        for s in ("serper_shopping", "ebay_search", "amazon_dataforseo")
    ]
    return dedup.union_recalls(recalls)


def test_positions_of_several_sources(offer_rows):
    union = three_sources(offer_rows)
    both = ["source_order", "pos"]
    want = [(s, p) for s in range(3) for p in range(3)]
    assert cols(dedup.distinct_offers(union), both, both) == want
    assert cols(schema.conform(union), both, both) == want
    assert cols(ranking.rank_for_report(union), [*both, "rank"], ["rank"]) == [(s, p, 3 * s + p + 1) for s, p in want]
    assert cols(ranking.select_for_display(union, 9, 9), both, ["rank"]) == want
    assert cols(ranking.rank_all(union), both, ["rank"]) == want
    assert cols(verdicts.batched(union, 4), [*both, "batch"], ["index"]) == [(s, p, (3 * s + p) // 4) for s, p in want]
    assert cols(ranking.shown_of_total(ranking.rank_for_report(union), union), ["shown", "total"], ["slug"]) == [(9, 9)]


def test_null_limits_take_the_default(offer_rows):
    df = offer_rows(*[{"seller_name": "one", "unit_price_usd": float(i + 1)} for i in range(5)])
    limited = df.withColumn("max_listings", F.lit(None).cast("int")).withColumn("per_vendor_cap", F.lit(None).cast("int"))
    assert col(ranking.select_for_display(limited, 20, 3), "pos") == [0, 1, 2]
    assert col(ranking.vendor_overflow(limited, ranking.select_for_display(limited, 20, 3), 3), "held_back", order="slug") == [2]
