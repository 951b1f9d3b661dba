import pytest
from pyspark.sql import functions as F

from offerloom.functions import envelopes, money, schedule as S, text, urls

c = F.col


def values(spark, rows, expr, ddl="a string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ddl)
    return [r[0] for r in df.select(expr).collect()]


def test_price_texts(spark):
    got = values(spark, ["$1,234.00", "67.2", "now $5 or 6", "call", None, "-3"], text.price_from_text(c("a")))
    assert got == [1234.0, 67.2, 5.0, None, None, -3.0]
    assert values(spark, ["$1,299.00", "a.5b", "x", ""], text.price_from_digits(c("a"))) == [1299.0, 0.5, None, None]
    assert values(spark, ["$1,299.00 ", "$1 to $2", ""], text.price_from_page(c("a"))) == [1299.0, None, None]


def test_conditions(spark):
    rows = ["Brand New", "Certified - Refurbished", "Excellent - Renewed", "Open box", "Pre-Owned new look"]
    assert values(spark, rows, text.condition_marketplace(c("a"))) == ["new", "refurbished", "new", "used", "new"]
    assert values(spark, rows, text.condition_page(c("a"))) == ["new", "refurbished", "new", "used", "used"]


def test_kit_capacity_speed(spark):
    rows = ["8x32GB DDR5-4800", "Lot 4-pack PC5-38400R", "kit of 2 5600MHz", "6 pcs", "32GB single", "1x16GB"]
    kit = text.kit(c("a"), F.lit(100.0))
    assert values(spark, rows, kit["kit_module_count"]) == [8, 4, 2, 6, 1, 1]
    assert values(spark, rows, kit["unit_price_usd"]) == [12.5, 25.0, 50.0, 16.67, 100.0, 100.0]
    assert values(spark, ["512 GB and 64GB", "64 gb", "x"], text.capacity_gb(c("a"), 8, 256)) == [None, 64, None]
    assert values(spark, rows, text.speed_marketplace(c("a"))) == [4800, 4800, 5600, None, None, None]
    assert values(spark, ["4800MHz", "4800 x"], text.speed_storefront(c("a"))) == [None, 4800]


def test_alias_boundaries(spark):
    aliases = F.array(F.lit("H14SSL-N"), F.lit("  "))
    rows = ["Board H14SSL-NT rev", "MBD-H14SSL-N-O", "h14ssl-n", "xH14SSL-N", "h14ssl-nt and H14SSL-N"]
    assert values(spark, rows, text.title_has_alias(c("a"), aliases)) == [False, True, True, False, True]
    assert values(spark, ["a.*b \\E c"], text.title_has_alias(c("a"), F.array(F.lit("a.*b \\E")))) == [True]


def test_brand_from_title(spark):
    cands = F.array(F.lit("Bose"), F.lit("JBL"))
    got = values(spark, [("boseheadphones", None), ("New BOSE set", None), ("jbl", ""), ("bose", "Sony")], text.brand_from_title(c("b"), c("a"), cands), "a string, b string")
    assert got == [None, "Bose", "JBL", "Sony"]


def test_hosts(spark):
    rows = [("https://WWW.Shop.com/a", None), ("http://x.com:8080/b?c", None), ("https://y.com", "www.Z.com"), ("", None), ("https://y.com", " ")]
    df = spark.createDataFrame(rows, "a string, h string")
    attrs = F.when(c("h").isNotNull(), F.create_map(F.lit("vendor_host"), c("h"))).otherwise(F.create_map().cast("map<string,string>"))
    assert [r[0] for r in df.select(urls.offer_host(c("a"), attrs)).collect()] == ["shop.com", "x.com:8080", "z.com", None, "y.com"]


def test_search_url_encoding(spark):
    got = values(spark, ["a b~c*d!e", "B&H (x)"], urls.search_url(F.lit("www.amazon.com"), c("a")))
    assert got == ["https://www.amazon.com/s?k=a+b~c%2Ad%21e", "https://www.amazon.com/s?k=B%26H+%28x%29"]
    assert values(spark, ["x"], urls.search_url(F.lit("nowhere.com"), c("a"))) == [None]


def test_merchant_host_squashes_only_spaces_and_hyphens(spark):
    got = values(spark, ["B&H Photo-Video", "eBay - x", "shop.net", ""], urls.merchant_host(F.lit("serper_shopping"), c("a"), F.lit("")))
    assert got == ["b&hphotovideo.com", "ebay.com", "shop.net", None]


@pytest.mark.parametrize("name,token", [("Sony WH-1000XM5", "1000xm5"), ("DJI Neo 2", None), ("ASRock ROMED8-2T board", "romed8"), ("", None)])
def test_model_token(spark, name, token):
    assert values(spark, [name], text.model_token(c("a"))) == [token]


def test_title_matches_name(spark):
    rows = [("DJI Neo 2 Drone", "DJI Neo 2 Motion"), ("DJI RC Transceiver", "DJI Neo 2 Motion"), ("anything", ""), ("Sony wh1000xm5 case", "Sony WH-1000XM5"), ("", "x y z")]
    got = values(spark, rows, text.title_matches_name(c("a"), c("b")), "a string, b string")
    assert got == [True, False, None, True, None]


def test_numbers(spark):
    assert sorted(values(spark, ["1.50 and 1.5, .5 3.0 007 .00"], text.numbers_in(c("a")))[0]) == sorted(["1.5", ".5", "3", "007", "0"])


def test_total_for_target_cases(spark):
    t = F.expr("named_struct('unit','gb','amount',256,'configurations',array(named_struct('module_count',8,'module_capacity_gb',32)))")
    rows = [(32, False, 1, None, 100.0, None), (32, True, 4, 380.0, 95.0, 2), (32, True, 4, 380.0, 95.0, 1), (32, True, 3, 300.0, 100.0, None), (16, False, 1, None, 10.0, None), (None, False, 1, None, 10.0, None)]
    total = money.total_for_target(t, c("cap"), c("k"), c("n"), c("kp"), c("up"), c("q"))
    got = values(spark, rows, total, "cap int, k boolean, n int, kp double, up double, q int")
    assert got == [800.0, 760.0, None, None, None, None]
    one = F.expr("named_struct('unit','count','amount',1,'configurations',cast(array() as array<struct<module_count:int,module_capacity_gb:int>>))")
    got = values(spark, [(None, True, 52, 179.0, 3.44, None), (None, False, 1, None, 5.0, 0)], money.total_for_target(one, c("cap"), c("k"), c("n"), c("kp"), c("up"), c("q")), "cap int, k boolean, n int, kp double, up double, q int")
    assert got == [179.0, None]


@pytest.mark.parametrize(
    "field,expected",
    [("*", list(range(0, 7))), ("*/3", [0, 3, 6]), ("1-5", [1, 2, 3, 4, 5]), ("1-5/2", [1, 3, 5]), ("2/2", [2, 4, 6]), ("1,1,3", [1, 3]), ("8", None), ("a", None), ("*/0", None), ("5-2", None), ("1,", None)],
)
def test_cron_fields(spark, field, expected):
    assert values(spark, [field], S.cron_values(c("a"), 0, 6)) == [expected]


def test_cron_day_rule_and_windows(spark):
    at = lambda t: F.lit(t).cast("timestamp")
    plan = S.cron_plan(c("a"))
    assert values(spark, ["0 6 13 * 5"], S.fires_at(plan, at("2026-02-13 06:00:00"))) == [True]
    assert values(spark, ["0 6 13 * 5"], S.fires_at(plan, at("2026-02-20 06:00:00"))) == [True]  # a Friday
    assert values(spark, ["0 6 13 * *"], S.fires_at(plan, at("2026-02-20 06:00:00"))) == [False]
    assert values(spark, ["0 6 * * 7"], S.fires_at(plan, at("2026-02-22 06:00:00"))) == [True]
    win = lambda a, b: S.fire_in_window(plan, at(a), at(b))
    assert values(spark, ["0 6 * * *"], win("2026-02-20 05:45:00", "2026-02-20 06:00:00")) == [True]
    assert values(spark, ["0 6 * * *"], win("2026-02-20 06:00:00", "2026-02-20 06:15:00")) == [False]
    assert values(spark, ["bad"], win("2026-02-20 06:00:00", "2026-02-20 06:15:00")) == [False]


def test_next_fire(spark):
    after = F.lit("2026-02-20 06:00:00").cast("timestamp")
    got = values(spark, ["0 6 * * *", "30 6 * * *", "0 0 29 2 *", "0 0 31 12 *"], F.date_format(S.next_fire(S.cron_plan(c("a")), after), "yyyy-MM-dd HH:mm"))
    assert got == ["2026-02-21 06:00", "2026-02-20 06:30", None, "2026-12-31 00:00"]


def test_find_envelope():
    find = envelopes.find_envelope
    assert find('{"evaluations": []}') == '{"evaluations": []}'
    assert find("```json\n[1, 2]\n```") == "[1, 2]"
    assert find('Sure {x}: {"indices": [1]} bye') == '{"indices": [1]}'
    assert find('{"evaluations": [{"index": 0, "pass": true}, {"ind') is None
    assert find('{"index": 0, "pass": true}') is None
    assert find(None) is None and find("no json") is None


def test_verdict_list_truthiness(spark):
    doc = '[{"index": "2", "pass": "false", "reason": null}, {"index": 1, "pass": 0}, 7, {"pass": true}, {"index": 3.0, "pass": {}, "extracted_features": {"a": true, "b": "", "c": 0, "d": "x "}}]'
    got = values(spark, [doc], envelopes.verdict_list(c("a"), F.lit(5)))[0]
    assert [(r["index"], r["pass"]) for r in got] == [(2, True), (1, False), (None, True), (3, False)]
    assert got[3]["features"] == {"a": "True", "d": "x"}


def test_blocks(spark):
    t = 'Hi\n<state>{"a": 1}</state>\n<draft>{"b"'
    assert values(spark, [t], envelopes.block(c("a"), "state")) == ['{"a": 1}']
    assert values(spark, [t], envelopes.without_blocks(c("a"))) == ["Hi"]
    assert values(spark, ["<state>[1]</state>"], envelopes.block_object(c("a"), "state").isNull()) == [True]
