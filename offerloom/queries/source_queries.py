"""Queries on landed payloads and stored tables. Payload documents are built from the driver tables by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions import text
from offerloom.operators import catalog, dedup, rules
from offerloom.queries.base import big, day, offers, profiles, query, spread, table, with_offers
from offerloom.sources import pages as page_source, payloads, tables

c = F.col

def run_day():
    return day(c("run_ts")).alias("run_day")



def line_parts(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand")
    return line.join(part, c("l_partkey") == c("p_partkey"))


LP_SQL = "FROM lineitem JOIN part ON l_partkey = p_partkey"


def documents_of(rows, item):
    """One payload document per (order, line number, part), so a document stays small whatever one order weighs.

    slug = order; `doc_no` orders the documents of an order by line number and part.
    """
    order = F.struct(c("l_suppkey"), c("l_extendedprice"))
    return rows.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("i")))), lambda x: x["i"]).alias("items")
    ).select(
        c("l_orderkey").cast("string").alias("slug"), F.lit("2024-01-01").cast("timestamp").alias("run_ts"),
        (c("l_linenumber").cast("bigint") * 100_000_000_000 + c("l_partkey")).alias("doc_no"), "items",
    )


ORDERED = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def shopping_docs(spark, sf):
    rows = line_parts(spark, sf)
    item = F.struct(
        F.when(c("l_partkey") % 9 == 0, "").otherwise(c("p_name")).alias("title"), F.concat(F.lit(" Shop "), (c("l_suppkey") % 5).cast("string")).alias("source"),
        F.concat(F.lit("https://google.com/search?q="), (c("l_partkey") % 3).cast("string")).alias("link"),
        F.when(c("l_partkey") % 6 == 0, "see site").otherwise(F.concat(F.lit("$"), F.format_string("%,.2f", c("l_extendedprice")), F.lit(" now"))).alias("price"),
        F.when(c("l_partkey") % 4 == 0, (c("p_size") / 10)).alias("rating"), F.when(c("l_partkey") % 4 == 0, c("p_size").cast("bigint")).alias("ratingCount"),
        F.when(c("l_partkey") % 2 == 0, (c("l_partkey") % 4).cast("string")).alias("productId"),
        F.when(c("l_partkey") % 5 == 0, "data:image/png;base64,x").otherwise("https://img/x").alias("imageUrl"), c("l_linenumber").alias("position"),
    )
    made = documents_of(rows, item).select("slug", "run_ts", "doc_no", F.to_json(F.struct(c("items").alias("shopping"))).alias("doc"))
    return payloads.parse_json(made, "doc", payloads.SHOPPING_DDL)


SHOP_KEY = "CASE WHEN l_partkey % 2 = 0 THEN CAST(l_partkey % 4 AS VARCHAR) ELSE 'https://google.com/search?q=' || (l_partkey % 3) END"


@query("shopping_scan", f"""
SELECT l_orderkey AS slug, title, unit_price_usd, seller_name, url, rating, rating_count, has_image FROM (
  SELECT l_orderkey, CASE WHEN l_partkey % 9 = 0 THEN '' ELSE p_name END AS title, CASE WHEN l_partkey % 6 = 0 THEN 0 ELSE CAST(printf('%.2f', l_extendedprice) AS DOUBLE) END AS unit_price_usd,
    ' Shop ' || (l_suppkey % 5) AS seller_name, 'https://google.com/search?q=' || (l_partkey % 3) AS url, CASE WHEN l_partkey % 4 = 0 THEN p_size / 10 END AS rating,
    CASE WHEN l_partkey % 4 = 0 THEN p_size END AS rating_count, l_partkey % 5 <> 0 AS has_image,
    row_number() OVER (PARTITION BY l_orderkey, {SHOP_KEY} {ORDERED}) AS no {LP_SQL}) WHERE no = 1""")
def shopping_scan(spark, sf):
    o = payloads.shopping_offers(shopping_docs(spark, sf))
    return o.select(c("slug").cast("bigint").alias("slug"), "title", "unit_price_usd", "seller_name", "url", "rating", "rating_count", c("image_url").isNotNull().alias("has_image"))


@query("shopping_preview", f"""
SELECT l_orderkey AS slug, title, price, merchant FROM (
  SELECT l_orderkey, p_name AS title, CASE WHEN l_partkey % 6 <> 0 THEN CAST(printf('%.2f', l_extendedprice) AS DOUBLE) END AS price, 'Shop ' || (l_suppkey % 5) AS merchant,
    row_number() OVER (PARTITION BY l_orderkey, {SHOP_KEY} {ORDERED}) AS no {LP_SQL} WHERE l_partkey % 9 <> 0) WHERE no = 1""")
def shopping_preview(spark, sf):
    p = payloads.shopping_preview(shopping_docs(spark, sf))
    return p.select(c("slug").cast("bigint").alias("slug"), "title", "price", "merchant")


@query("stable_links", f"""
SELECT CASE WHEN l_partkey % 2 = 0 THEN 'https://shopping.google.com/product/' || (l_partkey % 4) ELSE 'https://google.com/search?q=' || (l_partkey % 3) END AS url, count(*) AS offers {LP_SQL} GROUP BY 1""")
def stable_links(spark, sf):
    o = payloads.stable_links(payloads.shopping_offers(shopping_docs(spark, sf), distinct=False))
    return o.groupBy("url").agg(F.count(F.lit(1)).alias("offers"))


def market_docs(spark, sf):
    rows = line_parts(spark, sf)
    title = (
        F.when(c("l_partkey") % 8 == 0, F.concat(c("p_size").cast("string"), F.lit("x16GB DDR5-4800")))
        .when(c("l_partkey") % 8 == 1, F.concat(c("p_name"), F.lit(" "), c("p_size").cast("string"), F.lit(" pack PC5-38400R")))
        .when(c("l_partkey") % 8 == 2, F.concat(F.lit("Kit of "), c("p_size").cast("string"), F.lit(" 5600MHz")))
        .when(c("l_partkey") % 8 == 3, F.concat(c("p_size").cast("string"), F.lit("pcs 512 GB 64GB")))
        .otherwise(F.concat(c("p_name"), F.lit(" "), c("p_size").cast("string"), F.lit("GB")))
    )
    status = F.when(c("l_linenumber") % 3 == 0, "IN_STOCK").otherwise("OUT_OF_STOCK")
    avail = F.struct(status.alias("estimatedAvailabilityStatus"), c("l_quantity").cast("int").alias("estimatedAvailableQuantity"))
    item = F.struct(
        F.when(c("l_partkey") % 10 != 0, c("l_partkey").cast("string")).alias("itemId"), title.alias("title"), F.concat(F.lit("https://m/"), c("l_partkey").cast("string")).alias("itemWebUrl"),
        F.when(c("l_returnflag") == "N", "Brand New").when(c("l_returnflag") == "R", "Certified Good").otherwise("Pre-owned").alias("condition"),
        F.struct(c("l_extendedprice").cast("string").alias("value"), F.lit("USD").alias("currency")).alias("price"),
        F.struct(F.lit("u").alias("username"), (c("l_suppkey") % 3).cast("bigint").alias("feedbackScore"), F.lit("98.5").alias("feedbackPercentage")).alias("seller"),
        F.struct(F.lit("US").alias("country"), F.lit("1").alias("postalCode")).alias("itemLocation"),
        F.when(c("l_linenumber") != 2, F.array(avail)).alias("estimatedAvailabilities"), F.lit("").alias("mpn"), c("p_brand").alias("brand"),
    )
    made = documents_of(rows, item).select("slug", "run_ts", "doc_no", F.to_json(F.struct(c("items").alias("itemSummaries"))).alias("doc"))
    return payloads.parse_json(made, "doc", payloads.MARKET_DDL)


KIT_SQL = "(l_partkey % 8 IN (0, 1, 2, 3) AND p_size > 1)"


@query("market_scan", f"""
SELECT l_orderkey AS slug, condition, is_kit, kit_module_count, kit_price_usd, quantity_available, feedback, capacity_gb, speed_mts, unit_price FROM (
  SELECT l_orderkey, CASE l_returnflag WHEN 'N' THEN 'new' WHEN 'R' THEN 'refurbished' ELSE 'used' END AS condition, {KIT_SQL} AS is_kit,
    CASE WHEN {KIT_SQL} THEN p_size ELSE 1 END AS kit_module_count, CASE WHEN {KIT_SQL} THEN l_extendedprice END AS kit_price_usd,
    CASE WHEN l_linenumber <> 2 AND l_linenumber % 3 = 0 THEN CAST(l_quantity AS INT) END AS quantity_available, nullif(l_suppkey % 3, 0) AS feedback,
    CASE WHEN l_partkey % 8 = 0 THEN NULL WHEN l_partkey % 8 < 4 THEN NULL WHEN p_size BETWEEN 8 AND 256 THEN p_size END AS capacity_gb,
    CASE l_partkey % 8 WHEN 0 THEN 4800 WHEN 1 THEN 4800 WHEN 2 THEN 5600 END AS speed_mts, CASE WHEN NOT {KIT_SQL} THEN l_extendedprice END AS unit_price,
    row_number() OVER (PARTITION BY l_orderkey, CASE WHEN l_partkey % 10 <> 0 THEN l_partkey END {ORDERED}) AS no {LP_SQL}) WHERE no = 1""")
def market_scan(spark, sf):
    o = payloads.market_offers(market_docs(spark, sf), read_specs=True)
    spec = lambda k: F.try_element_at("attrs", F.lit(k)).cast("int").alias(k)
    return o.select(
        c("slug").cast("bigint").alias("slug"), "condition", "is_kit", "kit_module_count", "kit_price_usd", "quantity_available",
        big(c("seller_feedback_count")).alias("feedback"), spec("capacity_gb"), spec("speed_mts"), F.when(~c("is_kit"), c("unit_price_usd")).alias("unit_price"),
    )


def task_docs(spark, sf):
    rows = line_parts(spark, sf)
    item = F.struct(
        F.when(c("l_linenumber") == 5, "ads").when(c("l_linenumber") == 4, "amazon_paid").otherwise("amazon_serp").alias("type"), c("p_name").alias("title"),
        F.concat(F.lit("https://a/"), (c("l_partkey") % 5).cast("string")).alias("url"), F.when(c("l_partkey") % 7 != 0, c("l_extendedprice")).alias("price_from"),
        F.when(c("l_partkey") % 2 == 0, F.concat(F.lit("B0"), (c("l_partkey") % 6).cast("string"))).alias("data_asin"),
        F.when(c("l_partkey") % 3 == 0, "data:x").otherwise("https://i").alias("image_url"), F.when(c("l_suppkey") % 2 == 0, " ").otherwise(" Acme ").alias("seller"),
        F.struct((c("p_size") / 2).alias("value"), c("p_size").cast("bigint").alias("votes_count")).alias("rating"),
    )
    docs = documents_of(rows, item)
    k = c("slug").cast("bigint") % 10
    good = F.struct(F.lit(20000).alias("status_code"), F.lit("Ok.").alias("status_message"), F.array(F.struct(c("items"))).alias("result"))
    bad = F.struct(F.lit(40501).alias("status_code"), F.lit("Invalid Field").alias("status_message"), F.expr("null").alias("result"))
    tasks = F.when(k == 3, F.array(F.to_json(good), F.to_json(bad))).otherwise(F.array(F.to_json(good)))
    text_doc = F.concat(F.lit('{"status_code": 20000, "cost": '), (k * 2).cast("string"), F.lit(', "tasks": ['), F.array_join(tasks, ","), F.lit("]}"))
    return payloads.parse_json(docs.select("slug", "run_ts", "doc_no", text_doc.alias("doc")), "doc", payloads.TASK_DDL)


@query("task_scan", f"""
SELECT l_orderkey AS slug, title, unit_price_usd, seller_name, asin, url, rating, has_image FROM (
  SELECT l_orderkey, p_name AS title, CASE WHEN l_partkey % 7 <> 0 THEN l_extendedprice ELSE 0 END AS unit_price_usd, CASE WHEN l_suppkey % 2 = 0 THEN 'Amazon' ELSE 'Acme' END AS seller_name,
    CASE WHEN l_partkey % 2 = 0 THEN 'B0' || (l_partkey % 6) END AS asin, 'https://a/' || (l_partkey % 5) AS url, p_size / 2 AS rating, l_partkey % 3 <> 0 AS has_image,
    row_number() OVER (PARTITION BY l_orderkey, CASE WHEN l_partkey % 2 = 0 THEN 'B0' || (l_partkey % 6) ELSE 'https://a/' || (l_partkey % 5) END {ORDERED}) AS no
  {LP_SQL} WHERE l_linenumber <> 5 AND l_orderkey % 10 <> 3) WHERE no = 1""")
def task_scan(spark, sf):
    o = payloads.task_offers(task_docs(spark, sf))
    return o.select(
        c("slug").cast("bigint").alias("slug"), "title", "unit_price_usd", "seller_name", F.try_element_at("attrs", F.lit("asin")).alias("asin"), "url", "rating",
        c("image_url").isNotNull().alias("has_image"),
    )


@query("bad_tasks", "SELECT l_orderkey AS slug, 40501 AS status_code, 'task failed (40501): Invalid Field' AS error, 6 * count(DISTINCT (l_linenumber, l_partkey)) AS cost_usd FROM lineitem WHERE l_orderkey % 10 = 3 GROUP BY l_orderkey")
def bad_tasks(spark, sf):
    docs = task_docs(spark, sf)
    bad = payloads.bad_tasks(docs).select("slug", "run_ts", "status_code", "error").distinct().join(payloads.task_cost(docs), ["slug", "run_ts"])
    return bad.select(c("slug").cast("bigint").alias("slug"), "status_code", "error", big(c("cost_usd")).alias("cost_usd"))


def store_docs(spark, sf):
    rows = line_parts(spark, sf)
    variant = F.struct(
        F.when(c("l_partkey") % 6 == 0, "call us").otherwise(c("l_extendedprice").cast("string")).alias("price"), (c("l_linenumber") != 3).alias("available"),
        F.when(c("l_partkey") % 4 != 0, F.concat(F.lit("SKU"), c("l_partkey").cast("string"))).alias("sku"), c("l_quantity").cast("int").alias("inventory_quantity"),
    )
    product = F.struct(
        F.concat(c("p_name"), F.lit(" "), c("p_size").cast("string"), F.lit("GB 5200")).alias("title"), F.concat(F.lit("h"), c("l_partkey").cast("string")).alias("handle"),
        F.when(c("l_partkey") % 3 != 0, c("p_brand")).alias("vendor"), F.array(variant).alias("variants"),
    )
    made = documents_of(rows, product).select("slug", "run_ts", "doc_no", F.to_json(F.struct(c("items").alias("products"))).alias("doc"))
    return payloads.parse_json(made, "doc", payloads.STORE_DDL)


@query("storefront_scan", f"""
SELECT l_orderkey AS slug, p_name || ' ' || p_size || 'GB 5200' || CASE WHEN l_partkey % 4 <> 0 THEN ' (Variant: SKU' || l_partkey || ')' ELSE '' END AS title, 'https://s.example/products/h' || l_partkey AS url,
  CASE WHEN l_partkey % 3 <> 0 THEN p_brand ELSE 'NEMIX RAM' END AS brand, l_extendedprice AS unit_price_usd, CAST(l_quantity AS INT) AS quantity_available, p_size AS capacity_gb, 5200 AS speed_mts
{LP_SQL} WHERE l_linenumber <> 3 AND l_partkey % 6 <> 0""")
def storefront_scan(spark, sf):
    o = payloads.storefront_offers(store_docs(spark, sf), "https://s.example")
    spec = lambda k: F.try_element_at("attrs", F.lit(k)).cast("int").alias(k)
    return o.select(c("slug").cast("bigint").alias("slug"), "title", "url", "brand", "unit_price_usd", "quantity_available", spec("capacity_gb"), spec("speed_mts"))


@query("recall_errors", """
SELECT l_orderkey AS slug, bool_or(l_linenumber = 6) AS serper_error, false AS ebay_error, l_orderkey % 10 = 3 AS amazon_error FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_linenumber = 6) OR l_orderkey % 10 = 3""")
def recall_errors(spark, sf):
    line = table(spark, sf, "lineitem")
    failed = line.where(c("l_linenumber") == 6).select(c("l_orderkey").cast("string").alias("slug"), F.lit("2024-01-01").cast("timestamp").alias("run_ts"), F.lit("serper_shopping").alias("source")).distinct()
    e = payloads.recall_errors(payloads.bad_tasks(task_docs(spark, sf)), failed)
    return e.select(c("slug").cast("bigint").alias("slug"), "serper_error", "ebay_error", "amazon_error")


@query("page_listing_extract", f"""
SELECT l_orderkey AS slug, p_name || ' ' || p_size || 'GB 5600MHz' || CASE WHEN l_partkey % 5 = 0 THEN ' Generic Brand' ELSE '' END AS title, 'https://e/' || l_partkey AS url,
  CAST(printf('%.2f', l_extendedprice) AS DOUBLE) AS unit_price_usd, CASE l_returnflag WHEN 'N' THEN 'new' WHEN 'R' THEN 'used' ELSE 'refurbished' END AS condition, p_size AS capacity_gb,
  CASE WHEN l_partkey % 5 = 0 THEN 'generic_brand' ELSE '' END AS flags {LP_SQL} WHERE l_partkey % 7 <> 0 AND l_linenumber <> 4""")
def page_listing_extract(spark, sf):
    """Result pages built from line items; items without title or with a price range are skipped."""
    title = F.concat(c("p_name"), F.lit(" "), c("p_size").cast("string"), F.lit("GB 5600MHz"), F.when(c("l_partkey") % 5 == 0, " Generic Brand").otherwise(""))
    heading = F.when(c("l_linenumber") == 4, "").otherwise(F.concat(F.lit('<div class="s-item__title"><span role="heading"> '), title, F.lit(" </span></div>")))
    cond = F.when(c("l_returnflag") == "N", "Brand New").when(c("l_returnflag") == "R", "Pre-Owned &amp; new look").otherwise("Refurbished")
    price = F.when(c("l_partkey") % 7 == 0, "$1.00 to $2.00").otherwise(F.concat(F.lit("$"), F.format_string("%,.2f", c("l_extendedprice"))))
    item = F.concat(
        F.lit('<li><div class="s-item__wrapper clearfix"><img src=x><a class="s-item__link" href="https://e/'), c("l_partkey").cast("string"), F.lit('">'), heading,
        F.lit('</a><span class="SECONDARY_INFO">'), cond, F.lit('</span><br><span class="s-item__price">'), price, F.lit("</span></div></li>"),
    )
    docs = documents_of(line_parts(spark, sf), item)
    page_id = c("slug").cast("bigint") * 10 + F.floor(c("doc_no") / 100_000_000_000)
    html = docs.select(page_id.alias("page_id"), "slug", "run_ts", F.concat(F.lit("<html><body><ul>"), F.array_join("items", ""), F.lit("</ul></body></html>")).alias("html"))
    o = page_source.page_offers(html, "memstore_ebay")
    return o.select(c("slug").cast("bigint").alias("slug"), "title", "url", "unit_price_usd", "condition", rules.capacity().alias("capacity_gb"), F.array_join("flags", ",").alias("flags"))


@query("page_items_none", "SELECT count(*) FILTER (contains(html, 's-item__wrapper')) AS items, count(*) AS pages FROM pages")
def page_items_none(spark, sf):
    """The web pages table holds no result pages: the scan must find nothing in it."""
    p = table(spark, sf, "pages")
    found = page_source.page_items(p.select("page_id", "url", "html").withColumn("slug", F.lit("web")).withColumn("run_ts", F.lit("2024-01-01").cast("timestamp"))).agg(F.count(F.lit(1)).alias("items"))
    return found.join(F.broadcast(p.agg(F.count(F.lit(1)).alias("pages"))))


# --- stored tables -----------------------------------------------------------------------------------


@query("snapshot_csv_round_trip", with_offers(
    "SELECT pos, slug, run_day, title, brand, is_kit, unit_price_usd, kit_price_usd, quantity_available, seller_rating_pct, seller_feedback_count, capacity_gb, run_day || ' ' || lpad(CAST(hour AS VARCHAR), 2, '0') AS fetched FROM offers"))
def snapshot_csv_round_trip(spark, sf):
    """Offers encoded to the 20 text columns and decoded again (slug, run stamp and position ride along)."""
    o = offers(spark, sf)
    encoded = tables.encode_snapshot(o.withColumn("mpn", c("pos").cast("string"))).withColumn("pos", c("mpn").cast("bigint"))
    back = tables.decode_snapshot(encoded).withColumn("run_ts", F.try_to_timestamp("run_stamp", F.lit(tables.STAMP)))
    return back.select("pos", "slug", run_day(), "title", "brand", "is_kit", "unit_price_usd", "kit_price_usd", "quantity_available", "seller_rating_pct", "seller_feedback_count",
                       rules.capacity().alias("capacity_gb"), F.date_format("fetched_at", "yyyy-MM-dd HH").alias("fetched"))


@query("verdict_log_scan", "SELECT source AS product, count(*) AS rows, count(*) FILTER (n_chars % 2 = 0) AS passed, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def verdict_log_scan(spark, sf):
    """Verdict-log lines written as JSON text and parsed with the log schema."""
    from offerloom.schema import VERDICT_LOG_DDL

    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars", "lang")
    lines = d.select(F.to_json(F.struct(
        F.lit("2024-01-01T00:00:00Z").alias("timestamp"), c("source").alias("product"), c("doc_id").alias("index"), (c("n_chars") % 2 == 0).alias("pass"),
        c("lang").alias("reason"), c("n_chars").cast("double").alias("price"))).alias("line"))
    log = lines.select(F.from_json("line", VERDICT_LOG_DDL).alias("l")).select("l.*")
    return log.groupBy("product").agg(F.count(F.lit(1)).alias("rows"), F.count_if("pass").alias("passed"), big(F.sum("price")).alias("chars"))


def report_texts(spark, sf):
    """One report document per event: version 1, version 2, an unknown version, or broken."""
    e = table(spark, sf, "events")
    k = c("event_id") % 5
    d = day(c("ts").cast("timestamp"))
    price = F.format_string('{"price_usd": %s}', c("value").cast("string"))
    steps = F.lit('{"total_usd": 0.25, "steps": [{"step": "ai_filter", "model": "claude-haiku-4-5"}]}')
    v1 = F.concat(F.lit('{"schema_version": 1, "product": {"display_name": "P"}, "listings_meta": {"total_passed": 7}, "snapshot_date": "'), d, F.lit('", "listings": ['), price, F.lit('], "run_cost": '), steps, F.lit("}"))
    v2 = F.concat(F.lit('{"schema_version": 2, "display_name": "Q", "survivor_count": 9, "snapshot_date": "'), d, F.lit('", "generated_at": "'), F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z", "listings": ['), price, F.lit("]}"))
    doc = F.when(k == 0, v1).when(k == 1, v2).when(k == 2, F.lit('{"schema_version": 3, "listings": []}')).when(k == 3, F.lit('{"schema_version": 2, "listings": {}}')).otherwise('{"schema_version": 2, "lis')
    return e.select(c("user_id").cast("string").alias("slug"), "event_id", doc.alias("value"))


@query("report_versions", """
SELECT event_id, 1 + event_id % 5 AS schema_version, CASE event_id % 5 WHEN 0 THEN 'P' ELSE 'Q' END AS display_name, CASE event_id % 5 WHEN 0 THEN 7 ELSE 9 END AS listing_count, value AS cheapest_usd,
  CASE event_id % 5 WHEN 0 THEN 'Haiku 4.5' END AS filter_model, strftime(ts, '%Y-%m-%d') AS snapshot_day FROM events WHERE event_id % 5 IN (0, 1)""")
def report_versions(spark, sf):
    docs = tables.report_docs(report_texts(spark, sf))
    cards = tables.report_cards(docs.withColumn("slug", c("event_id").cast("string")))
    return cards.select(c("slug").cast("bigint").alias("event_id"), "schema_version", "display_name", "listing_count", "cheapest_usd", catalog.filter_model_label(c("filter_model")).alias("filter_model"), day(c("snapshot_date")).alias("snapshot_day"))


@query("run_catalogue", """
SELECT CAST(user_id AS VARCHAR) AS slug, count(DISTINCT date_trunc('second', ts)) AS runs, strftime(max(date_trunc('second', ts)), '%Y-%m-%d %H:%M:%S') AS last_run FROM events WHERE event_id % 3 <> 0 GROUP BY user_id""")
def run_catalogue(spark, sf):
    """Run files named by their stamp; other files in the folders are ignored."""
    e = table(spark, sf, "events")
    stamp = F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH-mm-ss'Z'")
    path = F.concat(F.lit("/reports/"), c("user_id").cast("string"), F.lit("/data/"), stamp, F.when(c("event_id") % 3 == 0, ".json").otherwise(".csv"))
    files = catalog.run_files(e.select(c("user_id").cast("string").alias("slug"), path.alias("path")))
    return files.groupBy("slug").agg(F.count_distinct("run_ts").alias("runs"), F.date_format(F.max("run_ts"), "yyyy-MM-dd HH:mm:ss").alias("last_run"))


@query("report_dates", "SELECT CAST(user_id AS VARCHAR) AS slug, strftime(max(ts), '%Y-%m-%d') AS newest, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS dates FROM events WHERE event_id % 5 IN (0, 1) GROUP BY user_id")
def report_dates(spark, sf):
    cards = tables.report_cards(tables.report_docs(report_texts(spark, sf)))
    newest = catalog.latest_reports(cards).select("slug", day(c("snapshot_date")).alias("newest"))
    return newest.join(cards.groupBy("slug").agg(F.count_distinct("snapshot_date").alias("dates")), "slug")


@query("alert_state_documents", "SELECT CAST(c_custkey AS VARCHAR) AS slug, 'price_below|' || c_nationkey AS fingerprint, c_acctbal > 0 AS armed FROM customer WHERE c_custkey % 4 < 2")
def alert_state_documents(spark, sf):
    """State documents per customer: readable, with a non-boolean entry, without the map, and broken."""
    u = table(spark, sf, "customer")
    k = c("c_custkey") % 4
    good = F.concat(F.lit('{"armed": {"price_below|'), c("c_nationkey").cast("string"), F.lit('": '), (c("c_acctbal") > 0).cast("string"), F.when(k == 1, ', "odd": "yes", "n": 1').otherwise(""), F.lit("}}"))
    doc = F.when(k < 2, good).when(k == 2, '{"armed": []}').otherwise('{"armed": {')
    docs = u.select(c("c_custkey").cast("string").alias("slug"), doc.alias("document"))
    back = tables.alert_state_documents(tables.alert_state(docs))
    return tables.alert_state(back)


@query("request_plan", """
WITH t AS (SELECT p_type, min(p_brand) AS b FROM part GROUP BY p_type),
s AS (SELECT p_type, b, 'serper_shopping' AS source_id, 'nation_7' AS gl, NULL AS depth FROM t WHERE p_type <> 'MEDIUM' UNION ALL SELECT p_type, b, 'ebay_search', NULL, NULL FROM t WHERE p_type IN ('LARGE', 'MEDIUM')
  UNION ALL SELECT p_type, b, 'amazon_dataforseo', NULL, '48' FROM t WHERE p_type = 'PROMO')
SELECT p_type AS slug, source_id, gl, depth, 0 AS query_no, lower(p_type) AS query FROM s UNION ALL SELECT p_type, source_id, gl, depth, 1, b FROM s""")
def request_plan(spark, sf):
    r = tables.request_plan(profiles(spark, sf))
    return r.select("slug", "source_id", F.try_element_at("extra", F.lit("gl")).alias("gl"), F.try_element_at("extra", F.lit("depth")).alias("depth"), "query_no", "query")


def profile_documents(spark, sf):
    """One YAML document per part: valid version 2, version 1, too generic alias, no queries, and broken YAML."""
    p = spread(spark, table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    k = c("p_partkey") % 5
    slug = F.concat(F.lit("part-"), c("p_partkey").cast("string"))
    body = F.concat(
        F.when(k == 1, "").otherwise("schema_version: 2\n"), F.lit("slug: "), slug, F.lit('\ndisplay_name: "'), c("p_name"), F.lit('"\ntarget:\n  unit: count\n  amount: '), c("p_size").cast("string"),
        F.when(k == 3, "").otherwise(F.concat(F.lit("\nqueries:\n  - "), c("p_name"), F.lit("\n  - two"))), F.lit("\nmatch:\n  aliases:\n    - "), F.when(k == 2, "generic").otherwise("model x1"),
        F.lit("\nschedule:\n  cron: '"), (c("p_partkey") % 60).cast("string"), F.lit(" 6 * * *'\n"), F.when(k == 4, "bad: [1, 2\n").otherwise(""),
    )
    return p.select(slug.alias("path"), body.alias("document"), "p_partkey")


@query("profile_load", """
SELECT 'part-' || p_partkey AS slug, p_name AS display_name, p_size AS amount, 2 AS queries, 20 AS max_listings, true AS variant_strict, '' AS problem FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT 'part-' || p_partkey, NULL, NULL, NULL, NULL, NULL, CASE p_partkey % 5 WHEN 2 THEN 'match.aliases: too generic' WHEN 3 THEN 'queries is required' ELSE 'unreadable' END FROM part WHERE p_partkey % 5 IN (2, 3, 4)""")
def profile_load(spark, sf):
    docs = profile_documents(spark, sf).select("path", "document").mapInPandas(tables._yaml_to_json, "path string, document string, json string, error string")
    good, bad = tables.load_profiles(docs)
    ok = good.select("slug", "display_name", c("target.amount").alias("amount"), F.size("queries").alias("queries"), c("display.max_listings").alias("max_listings"), c("match.variant_strict").alias("variant_strict"), F.lit("").alias("problem"))
    reason = F.when(c("reason").rlike("^(match|queries)"), c("reason")).otherwise("unreadable")
    return ok.unionByName(bad.select(c("path").alias("slug"), reason.alias("problem")), allowMissingColumns=True)


@query("profile_scalars", "SELECT 'part-' || p_partkey AS slug, p_name AS display_name, (p_partkey % 60) || ' 6 * * *' AS cron, CAST(NULL AS VARCHAR) AS run_at FROM part")
def profile_scalars(spark, sf):
    d = profile_documents(spark, sf)
    return d.select(c("path").alias("slug"), text.profile_scalar(c("document"), "display_name").alias("display_name"), text.schedule_scalar(c("document"), "cron").alias("cron"), text.schedule_scalar(c("document"), "run_at").alias("run_at"))


@query("bench_payload_scan", """
SELECT CAST(event_id // 50 AS VARCHAR) AS report_id, count(*) AS listings, min(value) AS lowest, count(*) FILTER (event_type = 'click') AS flagged FROM events GROUP BY event_id // 50""")
def bench_payload_scan(spark, sf):
    """Benchmark payload documents of 50 events each, parsed with the payload schema."""
    e = table(spark, sf, "events")
    item = F.struct(F.concat(F.lit("u"), c("event_id").cast("string")).alias("url"), c("value").alias("unit_price_usd"), F.when(c("event_type") == "click", F.array(F.lit("generic_brand"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    docs = e.groupBy(F.floor(c("event_id") / 50).alias("block")).agg(F.to_json(F.struct(F.collect_list(item).alias("listings"))).alias("text"))
    p = docs.select(c("block").cast("string").alias("report_id"), F.from_json("text", tables.BENCH_DDL).alias("p")).select("report_id", "p.listings")
    return p.select("report_id", big(F.size("listings")).alias("listings"), F.array_min(F.transform("listings", lambda x: x["unit_price_usd"])).alias("lowest"), big(F.size(F.filter("listings", lambda x: F.size(x["flags"]) > 0))).alias("flagged"))


@query("source_first_seen", f"""
SELECT l_orderkey AS slug, count(*) AS offers FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey, p_name {ORDERED}) AS no, p_name {LP_SQL} WHERE l_partkey % 9 <> 0) WHERE no = 1 GROUP BY l_orderkey""")
def source_first_seen(spark, sf):
    rows = payloads.shopping_offers(shopping_docs(spark, sf), distinct=False).where(c("title") != "")
    return dedup.first_seen(rows, ["slug"], c("title"), [c("pos")]).groupBy(c("slug").cast("bigint").alias("slug")).agg(F.count(F.lit(1)).alias("offers"))
