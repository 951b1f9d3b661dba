"""Stored tables of the engine: snapshots, verdict log, reports, profiles, alert state, requests."""

from __future__ import annotations

import json
from collections.abc import Callable, Collection, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from offerloom import constants as K
from offerloom.functions import text
from offerloom.operators import history, validation
from offerloom.schema import PROFILE_DDL, SNAPSHOT_CSV_COLUMNS, VERDICT_LOG_DDL, conform
from offerloom.session import durable, shuffles_end

c = F.col
STAMP = "yyyy-MM-dd'T'HH-mm-ss'Z'"

# --- snapshots --------------------------------------------------------------------------------


def read_snapshot_csv(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot CSV files -> offers. Product and run come from the path `<slug>/data/<stamp>.csv`."""
    ddl = ", ".join(f"{n} string" for n in SNAPSHOT_CSV_COLUMNS)
    raw = spark.read.schema(ddl).option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "").csv(path)
    file = c("_metadata.file_path")
    raw = raw.select("*", text.hit(file, r"([^/]+)/data/[^/]+$", 1).alias("slug"), text.hit(F.url_decode(F.substring_index(file, "/", -1)), K.RUN_FILE_RE, 1).alias("_stamp"))
    return conform(decode_snapshot(raw).withColumn("run_ts", F.try_to_timestamp("_stamp", F.lit(STAMP))))


def decode_snapshot(raw: DataFrame) -> DataFrame:
    """Text columns of a snapshot row -> typed offer columns; blank means null where null means unknown."""
    blank = lambda n: F.nullif(n, F.lit(""))
    number = lambda n, t: blank(n).try_cast(t).alias(n)
    typed = [
        number("kit_module_count", "int"), number("unit_price_usd", "double"), number("kit_price_usd", "double"), number("quantity_available", "int"),
        number("seller_rating_pct", "double"), number("seller_feedback_count", "int"), number("total_for_target_usd", "double"),
        F.try_to_timestamp("fetched_at").alias("fetched_at"), *[blank(n).alias(n) for n in ("brand", "mpn", "ship_from_country", "qvl_status")],
        (c("is_kit") == "1").alias("is_kit"), F.from_json("attrs", "map<string,string>").alias("attrs"), F.from_json("flags", "array<string>").alias("flags"),
    ]
    done = {"kit_module_count", "unit_price_usd", "kit_price_usd", "quantity_available", "seller_rating_pct", "seller_feedback_count", "total_for_target_usd",
            "fetched_at", "brand", "mpn", "ship_from_country", "qvl_status", "is_kit", "attrs", "flags"}
    return raw.select(*[n for n in raw.columns if n not in done], *typed).withColumn("pos", F.coalesce(*([c("pos")] if "pos" in raw.columns else []), F.monotonically_increasing_id()))


def encode_snapshot(offers: DataFrame) -> DataFrame:
    """The 20 text columns of a snapshot row, plus slug and run stamp."""
    as_text = lambda n: F.coalesce(c(n).cast("string"), F.lit("")).alias(n)
    special = {
        "fetched_at": F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("fetched_at"),
        "attrs": F.to_json("attrs").alias("attrs"), "flags": F.to_json("flags").alias("flags"),
        "is_kit": F.when(c("is_kit"), "1").otherwise("0").alias("is_kit"),
    }
    return offers.select("slug", F.date_format("run_ts", STAMP).alias("run_stamp"), *[special.get(n, as_text(n)) for n in SNAPSHOT_CSV_COLUMNS])


ROWS_AT_ONCE = 120_000_000  # offers whose shuffle files, and whose old and new snapshot files, are on disk together


def write_snapshot_csv(offers: DataFrame, path: str) -> None:
    """One folder per product and run, so a replayed run replaces itself; big runs may hold several files.

    Files are gzipped: while a run is replaced its old and its new files are both there. More than *ROWS_AT_ONCE* offers
    are written run after run in several jobs, each of which ends its shuffle files. Offers are counted first, and
    read by each job, so they should be a stored table.
    """
    jobs = max(1, -(-offers.count() // ROWS_AT_ONCE))
    rows = offers.select("slug", "run_ts", *SNAPSHOT_CSV_COLUMNS)
    for job in range(jobs):
        some = rows if jobs == 1 else rows.where(F.pmod(F.xxhash64("slug", F.date_format("run_ts", STAMP)), F.lit(jobs)) == job)
        by_run = encode_snapshot(some.hint("rebalance", "slug", "run_ts"))  # typed rows are shorter than their texts
        with shuffles_end(offers.sparkSession):
            by_run.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug", "run_stamp").option("header", True).option("escape", '"').option("emptyValue", "").option("compression", "gzip").csv(path)


def read_written_csv(spark: SparkSession, path: str) -> DataFrame:
    ddl = ", ".join(f"{n} string" for n in SNAPSHOT_CSV_COLUMNS) + ", slug string, run_stamp string"
    raw = spark.read.schema(ddl).option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "").csv(path)
    return conform(decode_snapshot(raw).withColumn("run_ts", F.try_to_timestamp("run_stamp", F.lit(STAMP))))


def upsert_history(spark: SparkSession, incoming: DataFrame, path: str) -> None:
    """Replace-or-insert by (slug, url, fetched_at): only the days present in *incoming* are rewritten."""
    fresh = incoming.withColumn("snapshot_date", F.to_date("fetched_at"))
    replace_days(spark, fresh, path, lambda old, new, _: new if old is None else history.upsert(old, new))


def keep_latest(spark: SparkSession, incoming: DataFrame, path: str) -> None:
    """One row per (slug, url, day), what was seen last that day: only the days present in *incoming* are rewritten."""
    fresh = incoming.withColumn("snapshot_date", F.to_date("fetched_at"))
    replace_days(spark, fresh, path, lambda old, new, sizes: history.latest_per_day(new if old is None else old.unionByName(new), sizes), dealt=True)


def replace_days(
    spark: SparkSession, fresh: DataFrame, path: str, merge: Callable[[DataFrame | None, DataFrame, DataFrame], DataFrame], dealt: bool = False
) -> None:
    """Rewrite the days of *fresh* in the table at *path* as merge(stored rows of those days, fresh, rows per day).

    The days are a literal partition filter, so only their files are read. Any error of reading the stored
    rows rises before a file is touched: only a table that is not there counts as empty (None). Rows merged with stored
    ones are written aside first, as they come from the folder that is overwritten. The days of a batch are few; they
    are all that comes to the driver. More than *ROWS_AT_ONCE* rows are rewritten some days at a time, in jobs that each
    end their shuffle files. *dealt*: merge leaves few tasks with rows of a day, so they are not shuffled again.
    """
    fresh = durable(fresh)
    count = lambda df: {r.snapshot_date: r.n for r in df.groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = count(fresh)
    if not sizes:
        return
    stored = spark.read.schema(fresh.schema).parquet(path) if path_exists(spark, path) else None
    held = {} if stored is None else count(stored.where(of_days(sizes)))
    sizes = {d: n + held.get(d, 0) for d, n in sizes.items()}
    groups, room = [], 0
    for d in sorted(sizes, key=lambda d: (d is None, d)):
        if sizes[d] > room:
            groups.append([])
            room = ROWS_AT_ONCE
        groups[-1].append(d)
        room -= sizes[d]
    for days in groups:
        some = fresh if len(groups) == 1 else fresh.where(of_days(days))
        rows = spark.createDataFrame([(d, sizes[d]) for d in days], "snapshot_date date, n bigint")
        merged = merge(None if stored is None else stored.where(of_days(days)), some, rows)
        if stored is not None:
            merged = durable(merged)
        by_day = merged if dealt else merged.hint("rebalance", "snapshot_date")  # few files per day; a hot day is split
        with shuffles_end(spark):
            by_day.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def of_days(days: Collection) -> Column:
    known = [d for d in days if d is not None]
    same_day = c("snapshot_date").isin(known) if known else F.lit(False)
    return same_day | c("snapshot_date").isNull() if len(known) < len(days) else same_day


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder is there and holds something, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and len(fs.listStatus(at)) > 0


# --- verdict log ----------------------------------------------------------------------------------


def read_verdict_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VERDICT_LOG_DDL).json(path)


def write_verdict_log(rows: DataFrame, daily_path: str, latest_path: str) -> None:
    """rows: verdict-log columns. The daily log keeps every run once; the latest log one run per product.

    The daily log is partitioned by day, product and run, so a replayed run replaces itself.
    """
    dated = rows.withColumn("date", F.to_date("timestamp")).withColumn("slug", c("product")).withColumn("run_stamp", F.date_format("timestamp", STAMP))
    dated = dated.hint("rebalance", "slug", "run_stamp")
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "slug", "run_stamp").json(daily_path)
    rows.withColumn("slug", c("product")).hint("rebalance", "slug").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug").json(latest_path)


# --- reports ------------------------------------------------------------------------------------------


def write_reports(reports: DataFrame, path: str) -> None:
    reports.select("slug", "snapshot_date", F.to_json("payload").alias("value")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("slug", "snapshot_date").text(path)


def report_docs(raw: DataFrame, column: str = "value") -> DataFrame:
    """Report texts -> (slug, version, doc variant): only versions 1 and 2 with a listings array count."""
    doc = F.try_parse_json(column)
    keep = [n for n in raw.columns if n != column]
    rows = raw.withColumn("doc", doc).withColumn("schema_version", F.try_variant_get("doc", "$.schema_version", "int"))
    listings = F.try_variant_get(c("doc"), "$.listings", "array<variant>")
    return rows.where(c("schema_version").isin(1, 2) & listings.isNotNull()).select(*keep, "schema_version", "doc")


def report_cards(docs: DataFrame) -> DataFrame:
    """Flat card columns of both report versions."""
    get = lambda p, t: F.try_variant_get(c("doc"), p, t)
    first = c("schema_version") == 1
    steps = F.try_variant_get(c("doc"), "$.run_cost.steps", "array<struct<step:string,model:string>>")
    return docs.select(
        "slug", "schema_version", F.when(first, get("$.product.display_name", "string")).otherwise(get("$.display_name", "string")).alias("display_name"),
        get("$.snapshot_date", "string").cast("date").alias("snapshot_date"), F.try_to_timestamp(get("$.generated_at", "string")).alias("generated_at"),
        get("$.listings[0].price_usd", "double").alias("cheapest_usd"),
        F.when(first, get("$.listings_meta.total_passed", "bigint")).otherwise(get("$.survivor_count", "bigint")).alias("listing_count"),
        get("$.run_cost.total_usd", "double").alias("cost_usd"),
        F.get(F.filter(steps, lambda s: s["step"] == "ai_filter"), F.lit(0))["model"].alias("filter_model"),
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return report_docs(spark.read.text(path, wholetext=True))


# --- profiles ----------------------------------------------------------------------------------------------


def _yaml_to_json(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    quick = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def read(body: str) -> object:
        try:
            return yaml.load(body, Loader=quick)
        except yaml.YAMLError:
            return yaml.safe_load(body)  # the plain loader has the last word, and words its errors itself

    for frame in frames:
        out = []
        for path, body in zip(frame["path"], frame["document"]):
            doc, error = None, None
            try:
                loaded = read(body)
                doc, error = (json.dumps(loaded, default=str), None) if isinstance(loaded, dict) else (None, "not a mapping")
            except yaml.YAMLError as exc:
                error = str(exc)
            out.append((path, body, doc, error))
        yield pd.DataFrame(out, columns=["path", "document", "json", "error"])


def read_profile_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, document, json, error) per profile file; YAML is the one format Spark cannot read itself."""
    files = spark.read.text(path, wholetext=True).select(c("_metadata.file_path").alias("path"), c("value").alias("document"))
    return files.mapInPandas(_yaml_to_json, "path string, document string, json string, error string")


def load_profiles(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid v2 profiles, rejects with a reason). Version 1 documents are no rejects; they are left to the v1 path."""
    parsed = documents.withColumn("p", F.from_json("json", PROFILE_DDL)).withColumn(
        "version", F.when(c("json").isNotNull(), F.coalesce(F.get_json_object("json", "$.schema_version").try_cast("int"), F.lit(1)))
    )
    two = c("version") == 2
    problem = (
        F.when(c("json").isNull(), F.coalesce("error", F.lit("unreadable")))
        .when(two & (F.coalesce(c("p.slug"), F.lit("")) == ""), "slug is required")
        .when(two & (F.coalesce(c("p.display_name"), F.lit("")) == ""), "display_name is required")
        .when(two & (F.coalesce(F.size("p.queries"), F.lit(0)) <= 0), "queries is required")
        .when(two & F.exists("p.queries", lambda q: F.trim(q) == ""), "queries: blank entry")
        .when(two & F.exists("p.match.aliases", lambda a: ~text.alias_is_distinctive(a)), "match.aliases: too generic")
        .when(two & (F.coalesce(c("p.target.amount"), F.lit(0)) <= 0), "target.amount must be positive")
    )
    for violated, message in validation.bound_tests(lambda n: c(f"p.{n}")).values():
        problem = problem.when(two & violated, message)
    # Written once: both results read it, and filters above a parsed column would parse the document again per test.
    checked = durable(parsed.withColumn("problem", problem).select("path", "document", "p", "version", "problem"))
    two = c("version") == 2
    valid = checked.where(two & c("problem").isNull()).select("p.*", "document")
    return with_defaults(valid), checked.where(c("problem").isNotNull()).select("path", c("problem").alias("reason"))


def with_defaults(profiles: DataFrame) -> DataFrame:
    """Missing optional fields take their documented defaults."""
    texts = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    return (
        profiles.withColumn(
            "match",
            F.struct(texts(c("match.aliases")).alias("aliases"), texts(c("match.title_excludes")).alias("title_excludes"), F.coalesce("match.variant_strict", F.lit(True)).alias("variant_strict")),
        )
        .withColumn("filters", F.struct(c("filters.condition_in").alias("condition_in"), c("filters.in_stock").alias("in_stock"), c("filters.min_quantity").alias("min_quantity")))
        .withColumn(
            "sources",
            F.struct(
                F.struct(F.coalesce("sources.serper.enabled", F.lit(True)).alias("enabled"), F.coalesce("sources.serper.gl", F.lit("us")).alias("gl"), F.coalesce("sources.serper.num", F.lit(100)).alias("num")).alias("serper"),
                F.struct(F.coalesce("sources.ebay.enabled", F.lit(False)).alias("enabled")).alias("ebay"),
                F.struct(F.coalesce("sources.amazon.enabled", F.lit(False)).alias("enabled"), F.coalesce("sources.amazon.depth", F.lit(48)).alias("depth"), F.coalesce("sources.amazon.priority", F.lit("standard")).alias("priority")).alias("amazon"),
            ),
        )
        .withColumn("vendor_allowlist", texts(c("vendor_allowlist"))).withColumn("vendor_blocklist", texts(c("vendor_blocklist")))
        .withColumn("display", F.struct(F.coalesce("display.max_listings", F.lit(K.MAX_LISTINGS)).alias("max_listings"), F.coalesce("display.per_vendor_cap", F.lit(K.PER_VENDOR_CAP)).alias("per_vendor_cap"), texts(c("display.attrs")).alias("attrs")))
    )


# --- alert state and run calls -----------------------------------------------------------------------------------


def alert_state(documents: DataFrame) -> DataFrame:
    """(slug, document) -> (slug, fingerprint, armed); unreadable documents and non-boolean entries are skipped."""
    armed = F.try_variant_get(F.try_parse_json("document"), "$.armed", "map<string,variant>")
    rows = documents.select("slug", F.explode(armed).alias("fingerprint", "v"))
    return rows.where(F.schema_of_variant("v") == "BOOLEAN").select("slug", "fingerprint", F.try_variant_get("v", "$", "boolean").alias("armed"))


def alert_state_documents(state: DataFrame) -> DataFrame:
    """One document per product; bounded by the rules of a product."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("fingerprint", "armed"))))
    return state.groupBy("slug").agg(F.to_json(F.struct(entries.alias("armed"))).alias("document"))


def write_alert_state(state: DataFrame, path: str) -> None:
    alert_state_documents(state).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug").text(path)


# --- requests -------------------------------------------------------------------------------------------------------


def request_plan(profiles: DataFrame) -> DataFrame:
    """One request row per enabled source and query, with the source's own parameters."""
    pair = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    as_text = lambda x: x.cast("string")
    empty = F.create_map().cast("map<string,string>")
    source = lambda name, no, on, extra: F.when(on, F.struct(F.lit(no).alias("no"), F.lit(name).alias("source_id"), extra.alias("extra")))
    wanted = F.array_compact(
        F.array(
            source(K.SHOPPING, 0, c("sources.serper.enabled"), pair("gl", c("sources.serper.gl"), "num", as_text(c("sources.serper.num")))),
            source(K.MARKETPLACE, 1, c("sources.ebay.enabled"), empty),
            source(K.TASKS, 2, c("sources.amazon.enabled"), pair("depth", as_text(c("sources.amazon.depth")), "priority", c("sources.amazon.priority"))),
        )
    )
    rows = profiles.select("slug", "queries", F.explode(wanted).alias("s"))
    return rows.select("slug", c("s.no").alias("source_order"), c("s.source_id").alias("source_id"), c("s.extra").alias("extra"), F.posexplode("queries").alias("query_no", "query"))


def source_extra(known: list[str], entry: Column) -> Column:
    """Open extra keys of a v1 source entry: everything that is no standard key."""
    return F.map_filter(entry, lambda k, _: ~k.isin(known))


# --- benchmark payloads -------------------------------------------------------------------------------------------------


BENCH_DDL = """
snapshot_date string, product struct<slug:string,display_name:string>,
listings array<struct<url:string,title:string,source:string,unit_price_usd:double,total_for_target_usd:double,flags:array<string>>>,
diff struct<changed:array<struct<url:string,title:string,old_price_usd:double,new_price_usd:double,pct_change:double>>>
"""


def read_bench_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Fixture documents with their name and their own text (the number check reads the text)."""
    raw = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(c("_metadata.file_path"), r"([^/]+)\.json$", 1)
    return raw.select(name.alias("report_id"), c("value").alias("text"), F.from_json("value", BENCH_DDL).alias("p")).select("report_id", "text", "p.*")
