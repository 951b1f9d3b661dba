"""Prefix scans, as-of joins, calendars, range frames, level totals and late runs against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from offerloom.operators import catalog, history, schedules, windows
from offerloom.operators.asof import asof_join
from offerloom.operators.skew import pieces
from offerloom.streaming import runs as streams

T0 = datetime(2026, 1, 1)


def test_history_of_one_url_is_cut_into_even_pieces(spark, offer_rows):
    rng = random.Random(1)
    prices = [float(rng.randrange(1, 40)) for _ in range(400)]
    rows = offer_rows(*[{"url": "https://one.com/x", "run": i // 4, "hour": i % 4, "unit_price_usd": p} for i, p in enumerate(prices)])
    got = sorted(history.price_history(rows).collect(), key=lambda r: (r.fetched_at, r.pos))
    for i, r in enumerate(got):
        seen = prices[: i + 1]
        want = (prices[i], prices[i - 1] if i else None, prices[0], min(seen, default=None), max(seen, default=None))
        assert (r.unit_price_usd, r.previous_price_usd, r.first_price_usd, r.lowest_price_usd, r.highest_price_usd) == want
    sizes = [r["count"] for r in pieces(rows, ["slug", "url"], [F.col("fetched_at"), F.col("pos")]).groupBy("_part").count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_rows_without_url_are_histories_of_their_own(offer_rows):
    rows = offer_rows({"url": "", "unit_price_usd": 5.0}, {"url": " ", "unit_price_usd": 3.0, "run": 1}, {"url": None, "unit_price_usd": 4.0, "run": 2})
    assert all(r.previous_price_usd is None and r.lowest_price_usd == r.unit_price_usd for r in history.price_history(rows).collect())


@pytest.mark.parametrize("inclusive", [False, True])
def test_asof_join(spark, inclusive):
    rng = random.Random(2)
    left = [(i, rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(60)])) for i in range(300)]
    right = [(rng.choice(["hot", "hot", "c", None]), rng.choice([None, *range(60)]), i) for i in range(200)]
    a = spark.createDataFrame(left, "id int, k string, t int")
    b = spark.createDataFrame(right, "k string, t int, no int")
    got = {r.id: r.match and r.match.no for r in asof_join(a, b, ["k"], "t", ["no"], inclusive).collect()}
    for i, k, t in left:
        before = [(rt, no) for rk, rt, no in right if rk == k and k is not None and None not in (t, rt) and (rt < t or inclusive and rt == t)]
        assert got[i] == (max(before)[1] if before else None)
    assert len(got) == len(left)
    assert {r.match for r in asof_join(a, b.limit(0), ["k"], "t").collect()} == {None}
    assert asof_join(a.limit(0), b, ["k"], "t").count() == 0


CRONS = ["*/20 * * * *", "0 0 * * *", "55 23 31 1 *", "5 0 1 2 *", "10 6 13 * 5", "0 12 * * 1-5", "59 23 * * *", "61 1 * * *", "7 * 28-31 * *"]


@pytest.mark.parametrize("minutes", [15, 60, 180])
def test_calendars_against_every_minute(spark, minutes):
    ticks = [datetime(2026, 1, 30) + timedelta(minutes=minutes * i) for i in range(4 * 1440 // minutes)] + [datetime(2026, 2, 1, 0, 5)]

    def fires(cron, t):
        minute, hour, dom, month, dow = cron.split()

        def has(field, value):
            for part in field.split(","):
                body, _, step = part.partition("/")
                low, _, high = body.partition("-")
                span = range(0, 60) if body == "*" else range(int(low), int(high or low) + 1)
                if value in span and (value - span.start) % int(step or 1) == 0:
                    return True
            return False

        day = [has(dom, t.day), has(dow, t.isoweekday() % 7)]
        on_day = any(day) if dom != "*" and dow != "*" else all(day)
        return has(minute, t.minute) and has(hour, t.hour) and has(month, t.month) and on_day

    want = {(c, t) for c in CRONS if not c.startswith("61") for t in ticks for m in range(minutes) if fires(c, t - timedelta(minutes=m))}
    spans = spark.createDataFrame([(t,) for t in ticks], "tick timestamp")
    got = [(r.slug, r.tick) for r in schedules.cron_due(spark.createDataFrame([(c, c) for c in CRONS], "slug string, cron string"), spans, minutes).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_named_runs_with_short_slugs_and_repeated_titles(spark):
    slugs = ["ab", "abcdef", "abcdef-long", "xyz", "", "nowhere-at-all"]
    log = [(1, "Search: abcdef-long", "n"), (2, "Search: abcdef-long", "n"), (3, None, "has ab"), (4, "x\nyz", None), (5, None, None), (6, "xyz", "xyz"), (7, "xy", "z")]
    rows = spark.createDataFrame(log, "run_id int, display_title string, name string")
    got = sorted((r.slug, r.run_id) for r in catalog.named_runs(spark.createDataFrame([(s,) for s in slugs], "slug string"), rows).collect())
    assert got == sorted((s, i) for s in slugs if s for i, *texts in log if any(s in (t or "") for t in texts))


def test_range_frame_over_buckets(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), T0 + timedelta(hours=rng.randrange(24 * 120)) if rng.random() > 0.02 else None, rng.choice([None, *range(50)]), i) for i in range(400)]
    got = {r.no: (r.low, r.high) for r in windows.recent_range(spark.createDataFrame(rows, "k string, t timestamp, v int, no int"), ["k"], "t", "v", 10).collect()}
    assert len(got) == len(rows)
    for k, t, _, no in rows:
        seen = [v for k2, t2, v, _ in rows if k2 == k and v is not None and None not in (t, t2) and timedelta(0) <= t - t2 <= timedelta(days=10)]
        assert got[no] == (min(seen, default=None), max(seen, default=None))


def test_late_runs_settle_to_the_order_of_time(spark):
    rng = random.Random(5)
    runs = [("p", k, f"f{k}", rng.choice(["is_below", "while_below"]) if k else "is_below", 20.0, T0 + timedelta(days=d), rng.choice([None, 10.0, 19.0, 20.0, 30.0])) for k in range(3) for d in range(20)]
    schema = "slug string, rule_pos int, fingerprint string, mode string, threshold_usd double, run_ts timestamp, price double"
    rows = spark.createDataFrame(runs, schema)

    def stream(order):
        out, last, below = [], {}, {}
        for slug, pos, fp, mode, limit, ts, price in order:
            if pos in last and ts <= last[pos]:
                out.append((slug, pos, fp, ts, price, False, not below[pos], True))
                continue
            now = price is not None and price < limit
            out.append((slug, pos, fp, ts, price, now and (mode == "while_below" or not below.get(pos, False)), not now, False))
            last[pos], below[pos] = ts, now
        return out

    ordered, shuffled = stream(runs), runs[:]
    rng.shuffle(shuffled)
    assert any(r[-1] for r in stream(shuffled))
    once = streams.settle_late(spark.createDataFrame(stream(shuffled), streams.PRICE_OUT), rows)
    assert {tuple(r) for r in once.collect()} == set(ordered)
    assert {tuple(r) for r in streams.settle_late(once, rows).collect()} == set(ordered)
