"""What a report shows: columns, cells, listing structs and rendered texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from offerloom import constants as K
from offerloom.functions import money, text, urls
from offerloom.operators.dimensions import badges

c = F.col
RUN = ["slug", "run_ts"]


def attr(key: str) -> Column:
    return F.try_element_at(c("attrs"), F.lit(key))


def filled(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit(""))) != ""


# --- which columns a run shows ---------------------------------------------------------------

POPULATED: dict[str, Callable[[], Column]] = {
    "price": lambda: F.lit(True),
    "condition": lambda: filled(c("condition")) | filled(attr("condition")),
    "seller": lambda: filled(c("seller_name")),
    "seller_rating": lambda: c("seller_rating_pct").isNotNull(),
    "rating": lambda: c("rating").isNotNull(),
    "rating_count": lambda: c("rating_count").isNotNull(),
    "quantity": lambda: c("quantity_available").isNotNull(),
    "ship_from": lambda: filled(c("ship_from_country")),
    "brand": lambda: filled(c("brand")),
    "mpn": lambda: filled(c("mpn")),
    "term": lambda: filled(attr("term")),
}


def default_columns(product_type: Column) -> Column:
    kind = F.lower(F.trim(product_type))
    out = F
    for name, cols in K.TYPE_COLUMNS.items():
        out = out.when(kind == name, F.array(*[F.lit(x) for x in cols]))
    return out.otherwise(F.array(*[F.lit(x) for x in K.GENERIC_COLUMNS]))


def resolve_columns(displayed: DataFrame, profiles: DataFrame) -> DataFrame:
    """(slug, run_ts, columns): the profile's list or the type default, cut to columns some shown row fills."""
    known = [n for n in POPULATED if n != "price"]
    set_attrs = F.map_keys(F.map_filter("attrs", lambda _, v: filled(v)))
    per_row = F.concat(F.array_compact(F.array(*[F.when(POPULATED[n](), n) for n in known])), F.coalesce(F.array_except(set_attrs, F.array(*[F.lit(n) for n in POPULATED])), F.array().cast("array<string>")))
    full = displayed.select(*RUN, F.explode(per_row).alias("name")).distinct().groupBy(*RUN).agg(F.collect_set("name").alias("filled"))
    runs = displayed.select(*RUN).distinct().join(full, RUN, "left").join(profiles, "slug")
    asked = F.filter(c("display.attrs"), lambda a: a != "")
    base = F.when(F.coalesce(F.size(asked), F.lit(0)) > 0, asked).otherwise(default_columns(c("product_type")))
    keys = F.array_distinct(F.transform(base, lambda a: F.lower(F.trim(a))))
    kept = F.filter(keys, lambda k: (k == "price") | F.coalesce(F.array_contains("filled", k), F.lit(False)))
    return runs.select(*RUN, F.when(F.array_contains(kept, "price"), kept).otherwise(F.concat(F.array(F.lit("price")), kept)).alias("columns"))


def column_value(name: str, structured: Column | None = None) -> Column:
    """Structured field first, then the extracted attribute."""
    extracted = F.nullif(attr(name), F.lit(""))
    return extracted if structured is None else F.coalesce(F.nullif(structured.cast("string"), F.lit("")), extracted)


def is_extracted(name: str, structured: Column | None = None) -> Column:
    known = F.lit(False) if structured is None else filled(structured.cast("string"))
    return ~known & filled(attr(name))


# --- report table cells ------------------------------------------------------------------------


def _or_unknown(x: Column) -> Column:
    return F.coalesce(F.nullif(x.cast("string"), F.lit("")), F.lit("unknown"))


def _shown_price() -> Column:
    return F.when(c("is_kit"), c("kit_price_usd")).otherwise(c("unit_price_usd"))


CELLS: dict[str, Callable[[], Column]] = {
    "rank": lambda: c("rank").cast("string"),
    "source": lambda: F.concat(F.lit("["), text.escape_pipes(urls.source_label(c("source"), c("url"), c("attrs"))), F.lit("]("), c("url"), F.lit(")")),
    "title": lambda: text.escape_pipes(c("title")),
    "pack_size": lambda: c("kit_module_count").cast("string"),
    "price": lambda: money.money_text_fx(_shown_price(), attr("price_approx_fx")),
    "price_pack": lambda: money.money_text_fx(_shown_price(), attr("price_approx_fx")),
    "price_unit": lambda: money.money_text_fx(c("unit_price_usd"), attr("price_approx_fx")),
    "total_for_target": lambda: money.money_text_fx(c("total_for_target_usd"), attr("price_approx_fx")),
    "qty": lambda: _or_unknown(c("quantity_available")),
    "condition": lambda: _or_unknown(c("condition")),
    "brand": lambda: _or_unknown(text.escape_pipes(c("brand"))),
    "mpn": lambda: _or_unknown(text.escape_pipes(c("mpn"))),
    "seller": lambda: _or_unknown(text.escape_pipes(c("seller_name"))),
    "seller_rating": lambda: F.when(c("seller_rating_pct").isNotNull(), F.format_string("%.1f%%", c("seller_rating_pct"))).otherwise("unknown"),
    "ship_from": lambda: _or_unknown(c("ship_from_country")),
    "qvl_status": lambda: _or_unknown(c("qvl_status")),
    "flags": lambda: F.when(F.size("flags") > 0, F.array_join("flags", ", ")).otherwise("(no flags)"),
    "flavor": lambda: _or_unknown(text.escape_pipes(attr("flavor"))),
}


def report_table(ranked: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cells of the report table, one row per ranked offer."""
    names = columns or K.DEFAULT_REPORT_COLUMNS
    return ranked.select(*RUN, c("rank").alias("row_no"), *[CELLS[n]().alias(f"col_{n}") for n in names])


def rendered_table(ranked: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Table text per run. *ranked* holds at most the report cap of rows per run."""
    names = columns or K.DEFAULT_REPORT_COLUMNS
    head = "| " + " | ".join(K.REPORT_HEADERS[n] for n in names) + " |\n|" + "|".join(["---"] * len(names)) + "|\n"
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[CELLS[n]() for n in names]), F.lit(" |"))
    lines = ranked.select(*RUN, "rank", line.alias("line")).groupBy(*RUN).agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("_l"))
    return lines.select(*RUN, F.concat(F.lit("**Ranked listings.**\n\n" + head), F.array_join(F.transform("_l", lambda x: x["line"]), "\n")).alias("table_md"))


# --- listing structs --------------------------------------------------------------------------------


def listing_v2() -> Column:
    names = [
        "title", "total_for_target_usd", "condition", "seller_name", "is_kit", "kit_module_count", "seller_rating_pct",
        "seller_feedback_count", "rating", "rating_count", "ship_from_country", "quantity_available", "flags", "brand", "mpn", "attrs",
    ]
    return F.struct(
        c("rank"), c("source"), urls.merchant_host(c("source"), c("seller_name"), c("url")).alias("vendor_host"), c("url"),
        c("buy_url"), c("image_url"), c("unit_price_usd").alias("price_usd"), attr("price_approx_fx").alias("currency_approx_fx"),
        badges(c("flags")).alias("badges"), *[c(n) for n in names],
    )


def listing_v1(flag_rules: Column | None = None) -> Column:
    host = F.when(c("source") == K.UNIVERSAL, F.nullif(attr("vendor_host"), F.lit("")))
    names = ["url", "title", "total_for_target_usd", "condition", "seller_name", "is_kit", "kit_module_count"]
    return F.struct(
        c("rank"), urls.source_label(c("source"), c("url"), c("attrs")).alias("source"),
        F.coalesce(host, F.lower(urls.netloc(c("url")))).alias("vendor_host"), _shown_price().alias("price_usd"),
        attr("price_approx_fx").alias("currency_approx_fx"), badges(c("flags"), flag_rules).alias("badges"), *[c(n) for n in names],
    )


# --- texts ---------------------------------------------------------------------------------------------


def bottom_line_text(tops: DataFrame, names: DataFrame) -> DataFrame:
    """One sentence on the cheapest offer per run; *tops* comes from ranking.bottom_line."""
    t = tops.select(*RUN, "top.*").join(names.select("slug", "display_name"), "slug", "left")
    price = F.when(c("total_for_target_usd").isNotNull(), F.format_string("$%.2f total for target", c("total_for_target_usd"))).otherwise(F.format_string("$%.2f", c("unit_price_usd")))
    seller = F.when(filled(c("seller_name")), F.concat(F.lit(" from "), c("seller_name"))).otherwise("")
    cond = F.when(filled(c("condition")), F.concat(F.lit(" ("), c("condition"), F.lit(")"))).otherwise("")
    clip = F.when(F.length("title") <= 90, c("title")).otherwise(F.concat(F.substring("title", 1, 87), F.lit("…")))
    label = text.escape_pipes(urls.source_label(c("source"), c("url"), c("attrs")))
    return t.select(
        *RUN,
        F.concat(
            F.lit("**Bottom line.** Cheapest passing listing for "), text.escape_pipes(F.coalesce("display_name", "slug")), F.lit(": "), price, seller,
            F.lit(" via ["), label, F.lit("]("), c("url"), F.lit(") — "), text.escape_pipes(clip), cond, F.lit("."),
        ).alias("bottom_line"),
    )


def diff_lines(diff: DataFrame) -> DataFrame:
    """One text line per change row (source label, url, prices, title)."""
    label = urls.source_label(c("source"), c("url"), c("attrs"))
    plain = F.format_string("  - [%s](%s) - $%.2f: %s", label, c("url"), F.coalesce("new_price_usd", "old_price_usd"), c("title"))
    moved = F.format_string("  - [%s](%s) - $%.2f -> $%.2f (%+.1f%%): %s", label, c("url"), c("old_price_usd"), c("new_price_usd"), c("pct_change") * 100, c("title"))
    return diff.withColumn("line", F.when(c("change_type") == "changed", moved).otherwise(plain))


def cost_lines(priced: DataFrame) -> DataFrame:
    """Run-cost table lines."""
    number = lambda n: F.format_string("%,d", F.coalesce(n, F.lit(0)))
    return priced.withColumn(
        "line",
        F.concat(F.lit("| "), F.concat_ws(" | ", c("step"), F.concat_ws("/", "provider", "model"), number(c("input_tokens")), number(c("output_tokens")), money.cost_text(c("cost_usd"))), F.lit(" |")),
    )
