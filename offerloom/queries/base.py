"""Views over the driver tables: the same rows as Spark DataFrames and as DuckDB SQL.

`offers` maps line items to offers of a product (part type) in a monthly run; `profiles` derives one
v2 profile per part type; `event_runs` maps events to daily runs of a product (user).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from offerloom.schema import conform
from offerloom.session import prepare

c = F.col


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query function under *name* with its oracle SQL."""

    def add(fn):
        REGISTRY[name] = Query(lambda spark, sf: fn(prepare(spark), sf), sql)
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


ROWS_PER_TASK = 200_000  # wide offer rows that a task sorts in memory


def spread(spark: SparkSession, df: DataFrame, key: str) -> DataFrame:
    """The driver tables are one row group each; landed recall comes in many files. Rows are dealt to all cores,
    and to more tasks as the table grows, so that no task's share of the rows does. The count reads file footers only."""
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK)), key)


def day(col) -> F.Column:
    return F.date_format(col, "yyyy-MM-dd")


def big(col):
    return col.cast("bigint")


def offers(spark: SparkSession, sf: str) -> DataFrame:
    """Offer rows of every line item. The dimension sides carry no hint: their size decides at run time."""
    line = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"
    )
    line = spread(spark, line, "l_orderkey")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    j = (
        line.join(part, c("l_partkey") == c("p_partkey")).join(supplier, c("l_suppkey") == c("s_suppkey"))
        .join(nation, c("s_nationkey") == c("n_nationkey"))
    )
    txt = lambda x: x.cast("string")
    shop = F.concat(F.lit("shop"), txt(c("l_suppkey") % 40), F.lit(".example.com"))
    path = F.when(c("l_suppkey") % 10 == 3, "search?q=").otherwise("p/")
    run = F.date_trunc("month", c("l_shipdate").cast("timestamp"))
    kit = c("l_quantity") >= 25
    unit = c("l_extendedprice") / c("l_quantity")
    universal = c("l_suppkey") % 4 == 3
    key = c("l_partkey")
    attrs = F.map_filter(
        F.create_map(
            F.lit("capacity_gb"), txt(c("p_size")),
            F.lit("speed_mts"), F.when(key % 7 != 0, txt(4000 + (key % 5) * 400)),
            F.lit("form_factor"), F.when(key % 3 == 0, "RDIMM").when(key % 3 == 1, "UDIMM"),
            F.lit("ecc"), F.when(key % 4 == 0, "false").when(key % 4 == 1, "true"),
            F.lit("voltage_v"), F.when(key % 6 == 0, "1.2").when(key % 6 == 1, "1.1"),
            F.lit("vendor_host"), F.when(universal, F.concat(F.lit("www."), shop)),
            F.lit("source_url"), F.when(universal, F.concat(F.lit("https://"), shop, F.lit("/list/"), txt(c("l_suppkey") % 8))),
        ),
        lambda _, v: v.isNotNull(),
    )
    rows = j.select(
        c("p_type").alias("slug"), run.alias("run_ts"),
        ((c("l_orderkey") * 10 + c("l_linenumber")) * 1_000_000 + (c("l_partkey") * 1009 + c("l_suppkey")) % 1_000_000).alias("pos"),
        F.when(c("l_suppkey") % 4 == 0, "serper_shopping").when(c("l_suppkey") % 4 == 1, "ebay_search")
        .when(c("l_suppkey") % 4 == 2, "amazon_dataforseo").otherwise("universal_ai_search").alias("source"),
        F.concat(F.lit("https://www."), shop, F.lit("/"), path, c("s_name"), F.lit("/"), c("p_brand")).alias("url"),
        F.concat(c("p_name"), F.lit(" "), c("p_type"), F.lit(" "), txt(c("p_size")), F.lit("GB")).alias("title"),
        F.timestamp_add("HOUR", c("l_linenumber"), run).alias("fetched_at"),
        F.when(c("l_linenumber") != 7, c("p_brand")).alias("brand"),
        F.concat(c("p_brand"), F.lit("-"), txt(key), F.when(key % 5 == 0, "E").otherwise("")).alias("mpn"),
        attrs.alias("attrs"),
        F.when(c("l_returnflag") == "N", "new").when(c("l_returnflag") == "R", "used").otherwise("refurbished").alias("condition"),
        kit.alias("is_kit"), F.when(kit, 4).otherwise(1).alias("kit_module_count"), unit.alias("unit_price_usd"),
        F.when(kit, unit * 4).alias("kit_price_usd"),
        F.when(c("l_linenumber") != 1, c("l_quantity").cast("int")).alias("quantity_available"),
        F.when(c("l_suppkey") % 25 == 0, "").otherwise(c("s_name")).alias("seller_name"),
        F.when(c("s_acctbal") >= 0, 90 + c("s_acctbal") / 1000).alias("seller_rating_pct"),
        F.when(c("s_acctbal") >= 0, (key % 500).cast("int")).alias("seller_feedback_count"), c("n_name").alias("ship_from_country"),
    )
    return conform(rows)


OFFERS_SQL = """
offers AS (
  SELECT p_type AS slug, CAST(date_trunc('month', l_shipdate) AS DATE) AS run_date,
    strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS run_day,
    (l_orderkey * 10 + l_linenumber) * 1000000 + (l_partkey * 1009 + l_suppkey) % 1000000 AS pos,
    CASE l_suppkey % 4 WHEN 0 THEN 'serper_shopping' WHEN 1 THEN 'ebay_search' WHEN 2 THEN 'amazon_dataforseo'
      ELSE 'universal_ai_search' END AS source,
    'https://www.shop' || (l_suppkey % 40) || '.example.com/' || CASE WHEN l_suppkey % 10 = 3 THEN 'search?q=' ELSE 'p/' END
      || s_name || '/' || p_brand AS url,
    'shop' || (l_suppkey % 40) || '.example.com' AS host,
    p_name || ' ' || p_type || ' ' || p_size || 'GB' AS title, l_linenumber AS hour,
    CASE WHEN l_linenumber <> 7 THEN p_brand END AS brand,
    p_brand || '-' || l_partkey || CASE WHEN l_partkey % 5 = 0 THEN 'E' ELSE '' END AS mpn,
    CASE l_returnflag WHEN 'N' THEN 'new' WHEN 'R' THEN 'used' ELSE 'refurbished' END AS condition,
    l_quantity >= 25 AS is_kit, CASE WHEN l_quantity >= 25 THEN 4 ELSE 1 END AS kit_module_count,
    l_extendedprice / l_quantity AS unit_price_usd,
    CASE WHEN l_quantity >= 25 THEN l_extendedprice / l_quantity * 4 END AS kit_price_usd,
    CASE WHEN l_linenumber <> 1 THEN CAST(l_quantity AS INT) END AS quantity_available,
    CASE WHEN l_suppkey % 25 = 0 THEN '' ELSE s_name END AS seller_name,
    CASE WHEN l_suppkey % 25 = 0 THEN '(unknown vendor)' ELSE lower(s_name) END AS vendor,
    CASE WHEN s_acctbal >= 0 THEN 90 + s_acctbal / 1000 END AS seller_rating_pct,
    CASE WHEN s_acctbal >= 0 THEN CAST(l_partkey % 500 AS INT) END AS seller_feedback_count,
    n_name AS ship_from_country, p_size AS capacity_gb,
    CASE WHEN l_partkey % 7 <> 0 THEN 4000 + (l_partkey % 5) * 400 END AS speed_mts,
    CASE l_partkey % 3 WHEN 0 THEN 'RDIMM' WHEN 1 THEN 'UDIMM' END AS form_factor,
    CASE l_partkey % 4 WHEN 0 THEN 'false' WHEN 1 THEN 'true' END AS ecc,
    CASE l_partkey % 6 WHEN 0 THEN 1.2 WHEN 1 THEN 1.1 END AS voltage_v,
    CASE WHEN l_suppkey % 4 = 3 THEN 'https://shop' || (l_suppkey % 40) || '.example.com/list/' || (l_suppkey % 8) END AS source_url,
    l_suppkey, l_partkey
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""


def with_offers(body: str, *extra: str) -> str:
    return "WITH " + ",\n".join([OFFERS_SQL.strip(), *[e.strip() for e in extra]]) + "\n" + body.strip()


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """One v2 profile per part type: limits and lists depend on the type name."""
    types = table(spark, sf, "part").groupBy("p_type").agg(F.min("p_brand").alias("first_brand"))
    t = c("p_type")
    texts = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    return types.select(
        F.lit(2).alias("schema_version"), t.alias("slug"), F.concat(F.lit("Product "), F.initcap(F.lower(t))).alias("display_name"),
        F.lit("").alias("description"), F.when(t == "PROMO", "book").when(t == "LARGE", "electronics").alias("product_type"),
        F.expr("named_struct('unit','count','amount',1,'configurations',cast(array() as array<struct<module_count:int,module_capacity_gb:int>>))").alias("target"),
        F.array(F.lower(t), c("first_brand")).alias("queries"),
        F.struct(
            F.when(t == "SMALL", texts("red widget", "blue gear")).otherwise(texts("hot gear")).alias("aliases"),
            texts("rusty", " ANVIL "). alias("title_excludes"), (t == "SMALL").alias("variant_strict"),
        ).alias("match"),
        F.struct(
            F.when(t == "ECONOMY", texts("New", "refurbished ")).otherwise(texts()).alias("condition_in"), (t == "LARGE").alias("in_stock"),
            F.when(t == "MEDIUM", 2).alias("min_quantity"),
        ).alias("filters"),
        texts("low_seller_feedback").alias("flags"),
        F.struct(
            F.struct((t != "MEDIUM").alias("enabled"), F.lit("nation_7").alias("gl"), F.lit(100).alias("num")).alias("serper"),
            F.struct((t.isin("LARGE", "MEDIUM")).alias("enabled")).alias("ebay"),
            F.struct((t == "PROMO").alias("enabled"), F.lit(48).alias("depth"), F.lit("standard").alias("priority")).alias("amazon"),
        ).alias("sources"),
        F.when(t == "STANDARD", texts("Supplier#00000000", "ebay")).otherwise(texts()).alias("vendor_allowlist"),
        F.when(t == "PROMO", texts("amazon", " ", "#000000001")).otherwise(texts()).alias("vendor_blocklist"),
        F.struct(
            F.when(t == "LARGE", 8).otherwise(5).alias("max_listings"), F.when(t == "PROMO", 1).otherwise(2).alias("per_vendor_cap"),
            F.when(t == "ECONOMY", texts("Price", "brand", "rating", "speed_mts", "nothing")).otherwise(texts()).alias("attrs"),
        ).alias("display"),
        F.expr("cast(null as struct<cron:string,run_at:timestamp,timezone:string>)").alias("schedule"),
    )


# The run pipeline of the profiles above, step by step, in SQL.
CANDIDATES_SQL = """
distinct_offers AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug, run_day, trim(url) ORDER BY pos) AS url_no FROM offers) WHERE url_no = 1
),
candidates AS (
  SELECT * FROM distinct_offers o
  WHERE (slug <> 'STANDARD' OR contains(vendor, 'supplier#00000000') OR source = 'ebay_search')
    AND (slug <> 'PROMO' OR NOT (source = 'amazon_dataforseo' OR contains(vendor, '#000000001')))
    AND NOT (regexp_matches(lower(url), 'search\\?|sch\\?|/sch/') AND source <> 'serper_shopping')
    AND (slug <> 'ECONOMY' OR condition IN ('new', 'refurbished'))
    AND (slug <> 'LARGE' OR quantity_available IS NULL OR quantity_available > 0)
    AND NOT contains(lower(title), 'rusty') AND NOT contains(lower(title), 'anvil')
    AND (slug <> 'SMALL' OR regexp_matches(lower(title), '(^|[^\\p{L}\\p{N}])(red widget|blue gear)($|[^\\p{L}\\p{N}])'))
)"""

MEDIAN_SQL = """
{name} AS (
  SELECT slug, run_day, (max(CASE WHEN no = (n - 1) // 2 THEN v END) + max(CASE WHEN no = n // 2 THEN v END)) / 2 AS {name}_value, max(n) AS n
  FROM (SELECT slug, run_day, v, row_number() OVER (PARTITION BY slug, run_day ORDER BY v) - 1 AS no, count(*) OVER (PARTITION BY slug, run_day) AS n
        FROM ({source}))
  GROUP BY slug, run_day
)"""


def stats_sql(source: str) -> str:
    """median and mad CTEs over the priced rows of *source*."""
    med = MEDIAN_SQL.format(name="median", source=f"SELECT slug, run_day, unit_price_usd AS v FROM {source} WHERE unit_price_usd > 0")
    mad = MEDIAN_SQL.format(
        name="mad",
        source=f"SELECT s.slug, s.run_day, abs(unit_price_usd - median_value) AS v FROM {source} s JOIN median USING (slug, run_day) WHERE unit_price_usd > 0",
    )
    return med.strip() + ",\n" + mad.strip()


def flagged_sql(source: str, k: str = "3.5") -> str:
    """anomaly column ('low', 'high' or null) for the rows of *source*."""
    return stats_sql(source) + f""",
flagged AS (
  SELECT s.*, median_value, mad_value,
    CASE WHEN m.n >= 4 AND unit_price_usd > 0 AND unit_price_usd < median_value * 0.5 AND (mad_value = 0 OR median_value - unit_price_usd > {k} * mad_value) THEN 'low'
         WHEN m.n >= 4 AND unit_price_usd > 0 AND unit_price_usd > median_value * 3.0 AND (mad_value = 0 OR unit_price_usd - median_value > {k} * mad_value) THEN 'high' END AS anomaly
  FROM {source} s LEFT JOIN median m USING (slug, run_day) LEFT JOIN mad USING (slug, run_day)
)"""


DISPLAY_SQL = """
capped AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug, run_day, vendor ORDER BY anomaly IS NOT DISTINCT FROM 'low', unit_price_usd, pos) AS vendor_rank FROM flagged)
  WHERE vendor_rank <= CASE WHEN slug = 'PROMO' THEN 1 ELSE 2 END
),
displayed AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug, run_day ORDER BY anomaly IS NOT DISTINCT FROM 'low', unit_price_usd, pos) AS rank FROM capped)
  WHERE rank <= CASE WHEN slug = 'LARGE' THEN 8 ELSE 5 END
)"""

RUN_SQL = CANDIDATES_SQL.strip() + ",\n" + flagged_sql("candidates") + ",\n" + DISPLAY_SQL.strip()


def event_offers(spark: SparkSession, sf: str) -> DataFrame:
    """Events as offers: product = user, run = day, host = event type, price = value."""
    e = spread(spark, table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value"), "event_id")
    ts = c("ts").cast("timestamp")
    return conform(
        e.select(
            c("user_id").cast("string").alias("slug"), F.date_trunc("day", ts).alias("run_ts"), c("event_id").alias("pos"),
            F.lit("serper_shopping").alias("source"), F.concat(F.lit("https://www."), c("event_type"), F.lit(".example.com/"), c("event_id").cast("string")).alias("url"),
            ts.alias("fetched_at"), F.when(c("event_id") % 3 == 0, "new").when(c("event_id") % 3 == 1, "used").otherwise("refurbished").alias("condition"),
            (c("event_id") % 4 == 0).alias("is_kit"), F.when(c("event_id") % 4 == 0, c("value") * 2).alias("kit_price_usd"), c("value").alias("unit_price_usd"),
            c("event_type").alias("seller_name"),
        )
    )


EVENTS_SQL = """
ev AS (
  SELECT CAST(user_id AS VARCHAR) AS slug, strftime(ts, '%Y-%m-%d') AS run_day, event_id AS pos, event_type || '.example.com' AS host,
    CASE event_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'used' ELSE 'refurbished' END AS condition, value AS unit_price,
    CASE WHEN event_id % 4 = 0 THEN value * 2 ELSE value END AS sold_price, event_type
  FROM events
)"""
