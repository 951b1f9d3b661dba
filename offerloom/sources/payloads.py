"""Landed source payloads -> offer rows.

Every mapper takes a DataFrame of parsed payload documents plus the run columns (slug, run_ts) and
explodes it; `read_json` lands the documents with an explicit schema. Positions come from the
payload order: document number, then item number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from offerloom import constants as K
from offerloom.functions import text, urls
from offerloom.operators import dedup
from offerloom.schema import conform

c = F.col

SHOPPING_ITEM = (
    "struct<title:string,source:string,link:string,price:string,rating:double,ratingCount:bigint,"
    "productId:string,imageUrl:string,position:int>"
)
SHOPPING_DDL = f"shopping array<{SHOPPING_ITEM}>"
MARKET_ITEM = (
    "struct<itemId:string,title:string,itemWebUrl:string,condition:string,price:struct<value:string,currency:string>,"
    "seller:struct<username:string,feedbackScore:bigint,feedbackPercentage:string>,"
    "itemLocation:struct<country:string,postalCode:string>,"
    "estimatedAvailabilities:array<struct<estimatedAvailabilityStatus:string,estimatedAvailableQuantity:int>>,"
    "mpn:string,brand:string>"
)
MARKET_DDL = f"total bigint, itemSummaries array<{MARKET_ITEM}>"
TASK_ITEM = (
    "struct<type:string,title:string,url:string,price_from:double,data_asin:string,image_url:string,seller:string,"
    "rating:struct<value:double,votes_count:bigint>>"
)
TASK_DDL = (
    "status_code int, cost double, "
    f"tasks array<struct<status_code:int,status_message:string,result:array<struct<items:array<{TASK_ITEM}>>>>>"
)
STORE_DDL = (
    "products array<struct<title:string,handle:string,vendor:string,"
    "variants:array<struct<price:string,available:boolean,sku:string,inventory_quantity:int>>>>"
)


def read_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """One document per file; a field of the wrong type is null, which the mappers treat as empty."""
    return spark.read.schema(ddl).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def parse_json(docs: DataFrame, column: str, ddl: str) -> DataFrame:
    """Documents held in a text column."""
    keep = [n for n in docs.columns if n != column]
    return docs.withColumn("_d", F.from_json(column, ddl)).select(*keep, "_d.*")


ITEM_BITS = 23  # a document's item list, one value of a row, is at most 2 GB: 8 million items of 256 bytes


def place_in_document(doc_no: Column, item_no: Column) -> Column:
    """One ascending number per (document, item). Numbers that would overlap fail instead of repeating."""
    doc = F.coalesce(doc_no, F.lit(0)).cast("bigint")
    fits = (item_no < 1 << ITEM_BITS) & (doc >= 0) & (doc < 1 << (63 - ITEM_BITS))
    return F.when(fits, F.shiftleft(doc, ITEM_BITS) + item_no).otherwise(F.raise_error(F.lit("document or item number too large for a position")).cast("bigint"))


def _position() -> Column:
    """Order of an item in its run: the document, then the place in the document's flat item list."""
    return place_in_document(c("doc_no"), c("item_no"))


def _base(docs: DataFrame) -> DataFrame:
    out = docs
    for name, default in (("doc_no", F.lit(0)), ("fetched_at", c("run_ts"))):
        if name not in out.columns:
            out = out.withColumn(name, default)
    return out


def _attrs(**pairs: Column) -> Column:
    made = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(made, lambda _, v: v.isNotNull())


RUN = ["slug", "run_ts", "doc_no", "fetched_at"]


def shopping_offers(docs: DataFrame, distinct: bool = True) -> DataFrame:
    """Shopping-index results. No specs, no condition, no stock; a missing price is 0."""
    items = _base(docs).select(*RUN, F.posexplode("shopping").alias("item_no", "i")).select(*RUN, "item_no", "i.*")
    link = F.coalesce("link", F.lit(""))
    offers = items.select(
        "slug", "run_ts", _position().alias("pos"), F.lit(K.SHOPPING).alias("source"), link.alias("url"),
        F.coalesce("title", F.lit("")).alias("title"), "fetched_at", _attrs(serper_product_id=c("productId")).alias("attrs"),
        F.lit("").alias("condition"), F.coalesce(text.price_from_text(c("price")), F.lit(0.0)).alias("unit_price_usd"),
        F.coalesce("source", F.lit("")).alias("seller_name"), link.alias("buy_url"),
        F.when(~c("imageUrl").startswith("data:"), c("imageUrl")).alias("image_url"), c("rating"), c("ratingCount").alias("rating_count"),
    )
    if distinct:
        key = dedup.shopping_key(F.try_element_at(c("attrs"), F.lit("serper_product_id")), c("url"))
        offers = dedup.first_seen(offers, ["slug", "run_ts"], key, [c("pos")])
    return conform(offers)


def shopping_preview(docs: DataFrame) -> DataFrame:
    """The compact preview mapping: untitled items dropped, text price kept, first seen by id, link or title."""
    items = _base(docs).select(*RUN, F.posexplode("shopping").alias("item_no", "i")).select(*RUN, "item_no", "i.*")
    price_text = text.nonblank(c("price"))
    rows = items.select(
        "slug", "run_ts", _position().alias("pos"), F.trim("title").alias("title"), text.nonblank(c("source")).alias("merchant"),
        F.trim(F.coalesce("link", F.lit(""))).alias("link"), text.price_from_digits(price_text).alias("price"), price_text.alias("price_text"),
        "rating", c("ratingCount").alias("rating_count"), text.nonblank(c("productId")).alias("product_id"), text.nonblank(c("imageUrl")).alias("image_url"),
    ).where(text.nonblank(c("title")).isNotNull())
    return dedup.first_seen(rows, ["slug", "run_ts"], dedup.preview_key(c("product_id"), c("link"), c("title")), [c("pos")])


def market_offers(docs: DataFrame, read_specs: bool = False, distinct: bool = True) -> DataFrame:
    """Marketplace items. Stock counts only when reported in stock; specs and kits are read off titles on request.

    A repeated item id is dropped, a blank id included (it counts as an id here).
    """
    items = _base(docs).select(*RUN, F.posexplode("itemSummaries").alias("item_no", "i")).select(*RUN, "item_no", "i.*")
    title, link = F.coalesce("title", F.lit("")), F.coalesce("itemWebUrl", F.lit(""))
    price = F.coalesce(c("price.value"), F.lit("0")).try_cast("double")
    first = F.get("estimatedAvailabilities", F.lit(0))
    plain = F.struct(F.lit(False).alias("is_kit"), F.lit(1).alias("kit_module_count"), price.alias("unit_price_usd"), F.lit(None).cast("double").alias("kit_price_usd"))
    kit = text.kit(title, price) if read_specs else plain
    attrs = _attrs(capacity_gb=text.capacity_gb(title, 8, 256), speed_mts=text.speed_marketplace(title)) if read_specs else F.create_map().cast("map<string,string>")
    offers = items.withColumn("_kit", kit).select(
        "slug", "run_ts", _position().alias("pos"), F.lit(K.MARKETPLACE).alias("source"), link.alias("url"), title.alias("title"),
        "fetched_at", F.nullif("brand", F.lit("")).alias("brand"), F.nullif("mpn", F.lit("")).alias("mpn"), attrs.alias("attrs"),
        text.condition_marketplace(F.coalesce("condition", F.lit("Used"))).alias("condition"), "_kit.*",
        F.when(first["estimatedAvailabilityStatus"] == "IN_STOCK", first["estimatedAvailableQuantity"]).alias("quantity_available"),
        F.coalesce("seller.username", F.lit("")).alias("seller_name"), F.nullif(c("seller.feedbackPercentage"), F.lit("")).try_cast("double").alias("seller_rating_pct"),
        F.nullif(c("seller.feedbackScore"), F.lit(0)).alias("seller_feedback_count"), F.nullif(c("itemLocation.country"), F.lit("")).alias("ship_from_country"),
        F.nullif(link, F.lit("")).alias("buy_url"), F.concat(F.lit("id:"), F.coalesce("itemId", F.lit(""))).alias("_id"),
    )
    if distinct:
        offers = dedup.first_seen(offers, ["slug", "run_ts"], c("_id"), [c("pos")])
    return conform(offers)


def task_rows(docs: DataFrame) -> DataFrame:
    return _base(docs).select(*RUN, "cost", F.posexplode("tasks").alias("task_no", "t"))


def bad_tasks(docs: DataFrame) -> DataFrame:
    """Tasks that failed although their envelope did not: these go to the quarantine table."""
    code = F.coalesce(c("t.status_code"), F.lit(-1))
    return task_rows(docs).where(code != K.TASK_OK).select(
        "slug", "run_ts", "doc_no", "task_no", c("t.status_code").alias("status_code"),
        F.format_string("task failed (%s): %s", F.coalesce(c("t.status_code").cast("string"), F.lit("None")), F.coalesce("t.status_message", F.lit("unknown error"))).alias("error"),
    )


def task_cost(docs: DataFrame) -> DataFrame:
    return docs.groupBy("slug", "run_ts").agg(F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost_usd"))


def task_offers(docs: DataFrame, strict: bool = False, distinct: bool = True) -> DataFrame:
    """Product rows of task results. A run with a failed task yields nothing (or, strict, raises)."""
    failed = lambda t: F.coalesce(t["status_code"], F.lit(-1)) != K.TASK_OK
    bad = F.filter("tasks", failed)
    based = _base(docs)
    if strict:
        message = F.concat(F.lit("task failed: "), F.coalesce(F.get(bad, F.lit(0))["status_message"], F.lit("unknown error")))
        based = based.where(F.when(F.size(bad) > 0, F.raise_error(message).cast("boolean")).otherwise(True))
    else:
        based = based.join(based.where(F.size(bad) > 0).select("slug", "run_ts").distinct(), ["slug", "run_ts"], "left_anti")
    none = F.array().cast(f"array<{TASK_ITEM}>")
    flat = F.flatten(F.transform("tasks", lambda t: F.coalesce(F.get(t["result"], F.lit(0))["items"], none)))
    rows = based.select(*RUN, F.posexplode(flat).alias("item_no", "i")).select(*RUN, "item_no", "i.*").where(c("type").isin(K.TASK_ITEM_TYPES))
    link = F.coalesce("url", F.lit(""))
    offers = rows.select(
        "slug", "run_ts", _position().alias("pos"), F.lit(K.TASKS).alias("source"), link.alias("url"),
        F.coalesce("title", F.lit("")).alias("title"), "fetched_at", _attrs(asin=F.nullif("data_asin", F.lit(""))).alias("attrs"), F.lit("").alias("condition"),
        F.coalesce("price_from", F.lit(0.0)).alias("unit_price_usd"), F.coalesce(text.nonblank(c("seller")), F.lit("Amazon")).alias("seller_name"),
        F.nullif(link, F.lit("")).alias("buy_url"), F.when(~c("image_url").startswith("data:"), c("image_url")).alias("image_url"),
        c("rating.value").alias("rating"), c("rating.votes_count").alias("rating_count"),
    )
    if distinct:
        offers = dedup.first_seen(offers, ["slug", "run_ts"], dedup.task_key(F.try_element_at(c("attrs"), F.lit("asin")), c("url")), [c("pos")])
    return conform(offers)


def storefront_offers(docs: DataFrame, base_url: str, seller: str = "NEMIX RAM") -> DataFrame:
    """One offer per available variant with a readable price."""
    pairs = lambda p: F.transform(p["variants"], lambda v: F.struct(p["title"].alias("title"), p["handle"].alias("handle"), p["vendor"].alias("vendor"), v.alias("v")))
    flat = F.flatten(F.filter(F.transform("products", pairs), lambda x: x.isNotNull()))
    rows = _base(docs).select(*RUN, F.posexplode(flat).alias("item_no", "i")).select(*RUN, "item_no", "i.*")
    title, price = F.coalesce("title", F.lit("")), F.coalesce("v.price", F.lit("0")).try_cast("double")
    sku = F.nullif("v.sku", F.lit(""))
    return conform(
        rows.where(F.coalesce("v.available", F.lit(False)) & price.isNotNull()).select(
            "slug", "run_ts", _position().alias("pos"), F.lit(K.STOREFRONT).alias("source"),
            F.concat(F.lit(base_url + "/products/" if base_url else ""), F.coalesce("handle", F.lit(""))).alias("url"),
            F.coalesce(F.concat(title, F.lit(" (Variant: "), sku, F.lit(")")), title).alias("title"), "fetched_at",
            F.coalesce("vendor", F.lit(seller)).alias("brand"), c("v.sku").alias("mpn"),
            _attrs(capacity_gb=text.capacity_gb(title), speed_mts=text.speed_storefront(title)).alias("attrs"), F.lit("new").alias("condition"),
            price.alias("unit_price_usd"), c("v.inventory_quantity").alias("quantity_available"), F.lit(seller).alias("seller_name"),
            F.lit(100.0).alias("seller_rating_pct"), F.lit("US").alias("ship_from_country"),
        )
    )


def recall_errors(quarantine: DataFrame, failed: DataFrame) -> DataFrame:
    """Per run, which sources failed: bad tasks and sources whose landing failed (slug, run_ts, source)."""
    both = failed.select("slug", "run_ts", "source").unionByName(quarantine.select("slug", "run_ts", F.lit(K.TASKS).alias("source")))
    return both.groupBy("slug", "run_ts").agg(
        F.bool_or(c("source") == K.SHOPPING).alias("serper_error"), F.bool_or(c("source") == K.MARKETPLACE).alias("ebay_error"),
        F.bool_or(c("source") == K.TASKS).alias("amazon_error"),
    )


def stable_links(offers: DataFrame) -> DataFrame:
    """Shopping redirects replaced by a stable product URL where the product id is known."""
    product = F.try_element_at(c("attrs"), F.lit("serper_product_id"))
    return offers.withColumn("url", F.when(c("source") == K.SHOPPING, urls.stable_product_url(product, c("url"))).otherwise(c("url")))
