"""Readable summaries of profile rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from offerloom.functions.text import nonblank, pretty_key


def clean_list(items: Column) -> Column:
    return F.filter(F.transform(items, lambda s: F.trim(s)), lambda s: s != "")


def joined(items: Column, word: str) -> Column:
    """'a', 'a or b', 'a, b or c'."""
    n = F.size(items)
    return F.when(n <= 1, F.get(items, F.lit(0))).otherwise(
        F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(f" {word} "), F.try_element_at(items, F.lit(-1)))
    )


def filters_text(filters: Column) -> Column:
    """array of one-liners for the hard filters of a profile."""
    conditions = clean_list(filters["condition_in"])
    phrase = joined(F.transform(conditions, lambda c: F.lower(c)), "or")
    condition = F.when(F.size(conditions) == 1, F.concat(pretty_key(F.get(conditions, F.lit(0))), F.lit(" only"))).when(
        F.size(conditions) > 1, F.concat(F.upper(F.substring(phrase, 1, 1)), F.substring(phrase, F.lit(2), F.length(phrase)))
    )
    return F.array_compact(
        F.array(
            condition,
            F.when(filters["in_stock"], "In stock only"),
            F.when(filters["min_quantity"].isNotNull(), F.format_string("At least %d available", filters["min_quantity"])),
        )
    )


def flag_text(name: Column, params: Column) -> Column:
    """'Low seller feedback (rating pct below 98)'; *params* is map<string,string>."""
    bits = F.transform(
        F.map_entries(params), lambda e: F.concat_ws(" ", F.replace(e["key"], F.lit("_"), F.lit(" ")), e["value"])
    )
    return F.concat(
        pretty_key(name),
        F.when(F.coalesce(F.size(bits), F.lit(0)) > 0, F.concat(F.lit(" ("), F.array_join(bits, ", "), F.lit(")"))).otherwise(""),
    )


def target_text(target: Column) -> Column:
    unit = nonblank(target["unit"])
    amount = target["amount"]
    plural = F.when((amount == 1) | unit.rlike("(?i)s$"), unit).otherwise(F.concat(unit, F.lit("s")))
    return F.when(amount.isNull(), unit).otherwise(F.concat_ws(" ", amount.cast("string"), plural))


def sources_text(sources: Column) -> Column:
    """array<struct<label, enabled, detail>>: the shopping index defaults to on, the others to off."""
    shopping = F.coalesce(sources["serper"]["enabled"], F.lit(True))
    ebay = F.coalesce(sources["ebay"]["enabled"], F.lit(False))
    amazon = F.coalesce(sources["amazon"]["enabled"], F.lit(False))
    detail = F.concat_ws(
        " · ", F.upper(sources["serper"]["gl"]),
        F.when(sources["serper"]["num"].isNotNull(), F.format_string("%d results", sources["serper"]["num"])),
    )
    entry = lambda label, on, text: F.struct(F.lit(label).alias("label"), on.alias("enabled"), text.cast("string").alias("detail"))
    return F.array(
        entry("Google Shopping (Serper)", shopping, F.when(shopping, F.nullif(detail, F.lit("")))),
        entry("eBay", ebay, F.lit(None)),
        entry("Amazon", amazon, F.when(amazon, F.concat(sources["amazon"]["priority"], F.lit(" queue")))),
    )


def profile_summary(profiles):
    """One summary row per profile."""
    c = F.col
    return profiles.select(
        "slug", nonblank(c("display_name")).alias("display_name"), nonblank(c("product_type")).alias("product_type"),
        target_text(c("target")).alias("target"), clean_list(c("queries")).alias("queries"),
        clean_list(c("match.aliases")).alias("aliases"), clean_list(c("match.title_excludes")).alias("title_excludes"),
        c("match.variant_strict").alias("variant_strict"), filters_text(c("filters")).alias("filters"),
        sources_text(c("sources")).alias("sources"),
        F.transform(c("flags"), lambda f: pretty_key(f)).alias("flags"),
        c("display.max_listings").alias("max_listings"), c("display.per_vendor_cap").alias("per_vendor_cap"),
    )
