"""What a step writes, reads and repeats: the figures that grow with the input."""

import glob
import json
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from offerloom.llm.grammar import Decoder, compress
from offerloom.operators import history, schedules, skew, verdicts
from offerloom.plans import runs
from offerloom.queries import base
from offerloom.session import durable
from offerloom.sources import pages, tables
from offerloom.streaming import runs as streams

c = F.col


def test_grammar_counts_both_pairs_of_a_bucket():
    """(5, 7) and (2, 25830) have the same hash bucket; one round must replace both."""
    ids = np.array([x for i in range(20) for x in (5, 7, 100 + 2 * i, 2, 25830, 101 + 2 * i)], np.uint32)
    symbols, rules, lengths, first = compress(ids, rounds=1)
    assert {tuple(map(int, r)) for r in rules} == {(5, 7), (2, 25830)}
    assert len(symbols) == 80 and (Decoder(symbols, rules, lengths, first).read(0, len(ids)) == ids).all()


def test_due_runs_broadcast_the_calendar_not_the_schedules(spark, capsys):
    plans = spark.createDataFrame([("a", "5 6 * * *"), ("b", "*/20 6 * 1 *"), ("c", "0 0 1 1 3")], "slug string, cron string")
    spans = spark.sql("SELECT explode(sequence(timestamp'2024-01-01 06:00:00', timestamp'2024-01-02 07:00:00', interval 1 hour)) AS tick")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        due = schedules.cron_due(plans, spans, 15)
        due.explain()
        rows = sorted((r.slug, str(r.tick)) for r in due.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in capsys.readouterr().out
    assert rows == [("b", "2024-01-01 06:00:00"), ("b", "2024-01-02 06:00:00")]


def test_profiles_are_parsed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def parse(frames):
        for frame in tables._yaml_to_json(frames):
            seen.add(len(frame))
            yield frame

    text = "schema_version: 2\nslug: s\ndisplay_name: x\ntarget:\n  unit: count\n  amount: {}\nqueries:\n  - one\n"
    docs = spark.createDataFrame([(str(i), text.format(i)) for i in range(3)] + [("bad", "a: [1, 2\n")], "path string, document string")
    good, bad = tables.load_profiles(docs.mapInPandas(parse, "path string, document string, json string, error string"))
    assert good.count() == 2
    reasons = {r.path: r.reason for r in bad.collect()}
    assert reasons["0"] == "target.amount must be positive" and "expected ',' or ']'" in reasons["bad"]
    assert seen.value == 4


def test_more_rows_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(base, "ROWS_PER_TASK", 10, raising=False)
    assert base.spread(spark, spark.range(205), "id").rdd.getNumPartitions() == 21
    assert base.spread(spark, spark.range(5), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_rank_brings_the_size_of_its_key(spark):
    df = spark.range(100).select(F.when(c("id") < 90, "hot").otherwise("cold").alias("k"), "id")
    rows = skew.ordered_rank(df, ["k"], [c("id")], "no", "n").groupBy("k").agg(F.max("no").alias("no"), F.min("n").alias("a"), F.max("n").alias("b")).collect()
    assert sorted(tuple(r) for r in rows) == [("cold", 10, 10, 10), ("hot", 90, 90, 90)]


def test_a_diff_writes_what_it_reads(spark, offer_rows):
    df = offer_rows({"url": "a", "unit_price_usd": 10.0}, {"url": "a", "run": 1, "unit_price_usd": 5.0}, {"url": "b", "run": 1, "unit_price_usd": 7.0})
    diff, heads = runs.diff_latest(df)
    assert sorted(r.change_type for r in diff.collect()) == ["changed", "new"] and heads.first()["new_count"] == 1
    written = [n for f in diff.inputFiles() for n in spark.read.parquet(f).columns]
    assert "url" in written and not {"seller_name", "mpn", "fetched_at", "pos"} & set(written)


def test_batches_hold_each_offer_once(spark, offer_rows):
    df = offer_rows({"title": "x", "attrs": {"a": "1"}}, {"title": "y"})
    rows = verdicts.batch_rows(df.withColumn("aliases", F.array(F.lit("y"))))
    assert rows.schema["items"].dataType.elementType.names == ["local_index", "index", "offer"]
    shown = rows.select(F.from_json("payload", "array<struct<index:int,title:string,attrs:map<string,string>,model_name_in_title:boolean>>").alias("p")).first()["p"]
    assert [tuple(e) for e in shown] == [(0, "x", {"a": "1"}, False), (1, "y", {}, True)]


def test_waves_write_answers_not_offers(spark, offer_rows):
    df = offer_rows(*[{"title": f"t{i}"} for i in range(6)])

    def first(payload):
        if "t3" in payload:
            raise RuntimeError("down")
        return json.dumps([{"index": e["index"], "pass": True} for e in json.loads(payload)])

    chain = (verdicts.Judge("l", "first", first), verdicts.Judge("l", "second", verdicts.pass_all))
    answered, failed, calls = verdicts.run_chain(df, chain, size=1)
    assert [r.model for r in answered.orderBy("batch").collect()] == ["first"] * 3 + ["second"] * 3 and failed.count() == 0
    assert not {"payload", "items"} & {n for f in calls.inputFiles() for n in spark.read.parquet(f).columns}
    assert verdicts.verdict_rows(answered).where("pass").count() == 6


def test_replies_of_a_large_wave_come_in_few_files(spark, offer_rows, tmp_path):
    df = offer_rows(*[{"run": i} for i in range(6)])
    store = verdicts.ReplyStore(str(tmp_path / "r"), calls_per_task=1, most_tasks=2)
    assert verdicts.run_chain(df, size=1, store=store)[0].count() == 6
    assert len(glob.glob(str(tmp_path / "r/**/*.parquet"), recursive=True)) <= 2


def test_snapshot_files_are_compressed(spark, offer_rows, tmp_path):
    path = str(tmp_path / "s")
    tables.write_snapshot_csv(offer_rows({"title": 'a "b",\nc'}, {"title": "d", "run": 1}), path)
    files = glob.glob(f"{path}/**/part-*", recursive=True)
    assert files and all(f.endswith(".csv.gz") for f in files)
    assert sorted(r.title for r in tables.read_written_csv(spark, path).collect()) == ['a "b",\nc', "d"]


def test_a_failing_first_offer_still_keeps_its_url_out(spark, offer_rows):
    profile = {"schema_version": 2, "slug": "p", "display_name": "P", "target": {"unit": "count", "amount": 1}, "queries": ["p"], "match": {"title_excludes": ["rusty"]}}
    docs = spark.createDataFrame([("f", "x", json.dumps(profile), None)], "path string, document string, json string, error string")
    good, _ = tables.load_profiles(docs)
    df = offer_rows({"url": " a", "title": "rusty"}, {"url": "a", "title": "fine"}, {"url": "b", "title": "fine"}, {"url": "", "title": "fine"}, {"url": "", "title": "fine"})
    found = runs.candidates(df, good)
    assert sorted(r.pos for r in found.collect()) == [2, 3, 4]
    twice = runs.candidates(df, good.unionByName(good))
    assert sorted(r.pos for r in twice.collect()) == [2, 2, 3, 3, 4, 4]


def scanned(html):
    scanner = pages.ItemScanner()
    scanner.feed(html)
    scanner.close()
    return scanner.items


def test_result_pages_are_read_without_the_parser(monkeypatch):
    html = (
        '<!DOCTYPE html><head><title>r</title><script>if (a < b) x("</div>")</script><!-- <div class="s-item__wrapper"> --></head><body><ul><li>1 < 2'
        '<div class="s-item__wrapper x"><a class="s-item__link" href="u?a=1&amp;b=2"><div class="s-item__title"><span> One &amp; <b>two</b></span></div></a>'
        "<br/><span class='s-item__price'>$1,<!-- c -->0</span></div></li></ul></body>"
    )
    want = scanned(html)
    batch = pa.RecordBatch.from_pydict({"page_id": [7, 8], "slug": ["s", None], "run_ts": [None, None], "html": [html, None]})

    def refuse(*_):
        raise AssertionError("parsed")

    monkeypatch.setattr(pages.ItemScanner, "feed", refuse)
    [out] = pages.scan(iter([batch]))
    assert [r | {"run_ts": None} for r in out.to_pylist()] == [
        {"page_id": 7, "slug": "s", "run_ts": None, "item_no": 0, "title": "One & two", "link": "u?a=1&b=2", "price_text": "$1,0", "condition_text": "Used"}]
    assert pages.quick_items(html) == want


def test_odd_pages_have_the_items_of_the_parser():
    bits = [
        '<div class="s-item__wrapper">', "<div class='s-item__wrapper'/>", "</div>", '<div class="s-item__title">', "<span>", "</span>", "<span class=s-item__price>", '<a class="s-item__link" href="u&amp;v">',
        "<a href=http://x/ class='s-item__link SECONDARY_INFO'>", "</a>", '<a title="x>y" href="z" class="s-item__link">', "<img src=x class='s-item__price'/>", "t &amp; u", "&am", " < 3", "<", ">", "<!-- <b> -->", "<!-->",
        "<!-- a -- >", "<script>", "</script>", "</script >", "<title>", "</title>", "<?x?>", "</ div>", "</div x>", "<![CDATA[x]]>", "<input disabled/>", "<a b='\">", "<a b = c class>", '<img class="s-item__wrapper">', "</ul>", "<ul>",
    ]
    rng, quick = random.Random(5), 0
    for _ in range(4000):
        html = "".join(rng.choices(bits, k=rng.randint(1, 20)))
        quick += pages.quick_items(html) is not None
        assert pages.items_of(html) == scanned(html), html
    assert quick > 400


def test_a_run_shuffles_what_it_chooses_by(spark, offer_rows, monkeypatch):
    """Whole offers are written at their place and looked up at the end; no window or aggregate carries them."""
    written = []

    def record(df):
        written.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString()))
        return durable(df)

    durable = runs.durable
    monkeypatch.setattr(runs, "durable", record)
    profile = {"schema_version": 2, "slug": "p", "display_name": "P", "target": {"unit": "count", "amount": 1}, "queries": ["p"], "filters": {"condition_in": ["new"]}}
    docs = spark.createDataFrame([("f", "x", json.dumps(profile), None)], "path string, document string, json string, error string")
    good, _ = tables.load_profiles(docs)
    df = offer_rows(
        {"url": "a", "unit_price_usd": 5.0, "attrs": {"k": "v"}, "condition": "new"}, {"url": " a", "unit_price_usd": 4.0, "condition": "new"}, {"url": "b", "unit_price_usd": 3.0, "condition": "new", "brand": "B"},
        {"url": "c", "slug": "unknown"}, {"url": "c", "slug": "unknown"}, {"url": "d", "condition": "broken"},
    )
    run = runs.run_offers(df, good, judges=None)
    shown = {r["url"]: r for r in run["displayed"].collect()}
    assert shown["a"]["attrs"] == {"k": "v"} and shown["b"]["brand"] == "B" and [shown[u]["rank"] for u in "ba"] == [1, 2] and len(shown) == 2
    assert set(df.columns) <= set(run["survivors"].columns) and sorted(r["pos"] for r in run["survivors"].collect()) == [0, 2]
    assert not [cols for cols, plan in written if "attrs" in cols and ("Window" in plan or "Aggregate" in plan)]
    assert {r["slug"]: (r["recall_count"], r["survivor_count"]) for r in run["funnel"].collect()} == {"p": (3, 2), "unknown": (1, 0)}
    twice = runs.run_offers(df, good.unionByName(good), judges=None)["funnel"].where("slug = 'p'").collect()
    assert {(r["recall_count"], r["survivor_count"]) for r in twice} == {(3, 4)}


def test_a_diff_carries_the_details_asked_for(spark, offer_rows):
    df = offer_rows({"url": "a", "unit_price_usd": 5.0}, {"url": "a", "unit_price_usd": 9.0, "run": 1, "title": "t"}, {"url": "b", "run": 1})
    full, _ = runs.diff_latest(df)
    thin, heads = runs.diff_latest(df, details=())
    assert {"title", "source", "attrs"} <= set(full.columns) and not {"title", "source", "attrs"} & set(thin.columns)
    keys = ["slug", "url", "change_type", "old_price_usd", "new_price_usd"]
    assert sorted(map(str, thin.select(keys).collect())) == sorted(map(str, full.select(keys).collect())) and thin.count() == 2
    assert runs.change_rows(thin).count() == 2 and "title" in runs.change_rows(full).columns and heads.first()["new_count"] == 1


def test_payloads_of_parts_are_those_of_whole_batches(spark, offer_rows):
    df = offer_rows(*[{"slug": f"s{i % 3}", "title": f't{i} "x", y', "attrs": {"k": str(i)}} for i in range(40)], {"slug": None, "title": "no product"})
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        numbered = verdicts.batched(df, 5)
        made = verdicts.payloads(numbered, 5)
        rows = {(r["slug"], r["batch"]): (r["n"], r["payload"]) for r in made.collect()}
        waves = {(r["slug"], r["batch"]): r["_wave"] for r in made.collect()}
        want = {(r["slug"], r["batch"]): (r["n"], r["payload"]) for r in verdicts.batch_rows(df, 5).where("slug IS NOT NULL").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    assert rows == want and len(rows) == 9
    assert waves == {(f"s{i}", b): w for i in range(3) for b, w in enumerate((0, 1, 1))}
    # A wave reads files of its own, and no offers.
    files = made.where("_wave = 0").inputFiles()
    assert any("_wave=0" in f for f in files) and not any("items" in spark.read.parquet(f).columns for f in files)


def test_answers_are_never_broadcast(spark, offer_rows):
    """They are small in a file and large in memory."""
    df = offer_rows(*[{"title": f"t{i}"} for i in range(6)])
    answered, failed, _ = verdicts.run_chain(df, size=2)
    assert "strategy=merge" in answered._jdf.queryExecution().optimizedPlan().toString()
    asked = verdicts.ask(durable(verdicts.batch_rows(df, 2)), verdicts.DEFAULT_CHAIN[0])
    assert "Join" not in asked._jdf.queryExecution().optimizedPlan().toString()
    assert verdicts.verdict_rows(answered).where("pass").count() == 6 and failed.count() == 0


def test_a_run_with_all_its_answers_writes_none(spark, offer_rows, tmp_path):
    df, store = offer_rows(*[{"run": i} for i in range(3)]), verdicts.ReplyStore(str(tmp_path / "r"))
    verdicts.run_chain(df, size=1, store=store)
    files = sorted(glob.glob(str(tmp_path / "r/**/*.parquet"), recursive=True))
    assert verdicts.run_chain(df, size=1, store=store)[0].count() == 3
    assert files == sorted(glob.glob(str(tmp_path / "r/**/*.parquet"), recursive=True))


def shuffle_files(spark):
    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in root for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    spark.range(1000).repartition(3, "id").write.format("noop").mode("overwrite").save()
    kept = shuffle_files(spark)
    assert kept - before  # a plain write leaves them to the garbage collection
    df = durable(spark.range(1000).repartition(3, "id").groupBy((c("id") % 7).alias("k")).count())
    assert not shuffle_files(spark) - kept and df.count() == 7


def test_snapshots_of_many_rows_are_written_in_several_jobs(spark, offer_rows, tmp_path, monkeypatch):
    df = offer_rows(*[{"run": i % 4, "title": f"t{i}", "attrs": {"k": str(i)}} for i in range(12)], {"slug": None, "title": "none"})
    want = None
    for at_once in (100, 3):
        monkeypatch.setattr(tables, "ROWS_AT_ONCE", at_once, raising=False)
        path = str(tmp_path / str(at_once))
        for _ in range(2):
            tables.write_snapshot_csv(df, path)
        rows = sorted((r.title, str(r.run_ts), r.attrs.get("k")) for r in tables.read_written_csv(spark, path).collect())
        want = rows if want is None else want
        assert rows == want and len(rows) == 13


def test_latest_rows_are_shuffled_once(spark, offer_rows, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "ROWS_PER_PIECE", 2, raising=False)
    df = offer_rows(*[{"run": i % 2, "hour": i, "url": f"u{i % 5}"} for i in range(20)], {"url": None, "slug": None}, {"url": "x", "fetched_at": None})
    want = sorted(r.pos for r in history.latest_per_day(df).collect())
    path = str(tmp_path / "l")
    write = streams.latest_writer(path)
    write(df, 0)
    days = spark.read.parquet(path)
    assert sorted(r.pos for r in days.collect()) == want
    sizes = df.groupBy(F.to_date("fetched_at").alias("snapshot_date")).agg(F.count(F.lit(1)).alias("n"))
    plan = history.latest_per_day(durable(df), durable(sizes))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    write(df.where("pos < 6"), 1)  # a replay of older rows changes nothing
    write(offer_rows({"run": 1, "hour": 23, "url": "u1", "title": "newer"}), 2)
    after = {(r.url, r.snapshot_date): r.title for r in spark.read.parquet(path).collect()}
    assert len(after) == len(want) and [t for t in after.values() if t == "newer"] == ["newer"]
    # Many rows are rewritten some days at a time.
    monkeypatch.setattr(tables, "ROWS_AT_ONCE", 8, raising=False)
    again = streams.latest_writer(str(tmp_path / "m"))
    for _ in range(2):
        again(df, 0)
    assert sorted(r.pos for r in spark.read.parquet(str(tmp_path / "m")).collect()) == want
