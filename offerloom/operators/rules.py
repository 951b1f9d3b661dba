"""Hard reject rules, soft flag rules, vendor and ship-from gates.

Rules are data. Every rule is one column expression over the offer columns, registered by name in
``REJECTS`` or ``FLAGS``; add an entry to extend the engine. A rule list can be fixed in code
(``first_reject``) or come with the row as an array of rule structs (``first_reject_from``), which
is how one job serves many products. Unknown offer values never reject.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from offerloom import constants as K
from offerloom.functions import money, text, urls

RULE_DDL = "struct<rule:string,values:array<string>,value:double>"
FLAG_DDL = "struct<rule:string,flag:string,values:array<string>,rating_pct_below:double,count_below:int,description:string>"

c = F.col


def attr(key: str) -> Column:
    return F.try_element_at(c("attrs"), F.lit(key))


def capacity() -> Column:
    return attr("capacity_gb").try_cast("int")


def list_text(values: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(values, "', '"), F.lit("']"))


# --- rejects: (values, value, target) -> reason or null -----------------------------------


def _form_factor(values, value, target):
    ff = attr("form_factor")
    return F.when(
        ff.isNotNull() & ~F.array_contains(values, ff),
        F.concat(F.lit("form_factor '"), ff, F.lit("' not in "), list_text(values)),
    )


def _speed(values, value, target):
    speed = attr("speed_mts").try_cast("int")
    return F.when(speed < value, F.format_string("speed %d MT/s is below minimum %d", speed, value.cast("int")))


def _ecc(values, value, target):
    return F.when(F.lower(attr("ecc")) == "false", "non-ECC memory")


def _voltage(values, value, target):
    v = attr("voltage_v").try_cast("double")
    return F.when(v != value, F.concat(F.lit("voltage "), v.cast("string"), F.lit("V != required "), value.cast("string"), F.lit("V")))


def _min_quantity(values, value, target):
    """Known capacity must match a configuration (also when there are none); known stock must reach it."""
    cap = capacity()
    modules = money.matched_configuration(target["configurations"], cap)["module_count"]
    stock = c("quantity_available") * c("kit_module_count")
    return F.when(
        cap.isNotNull() & modules.isNull(),
        F.format_string("module capacity %dGB not in allowed target configurations", cap),
    ).when(
        cap.isNotNull() & (stock < modules),
        F.format_string(
            "insufficient quantity: need %d modules for %dGB target, but only %d available", modules, target["amount"], stock
        ),
    )


def _in_stock(values, value, target):
    return F.when(c("quantity_available") <= 0, "out of stock")


def _single_sku(values, value, target):
    return F.when(
        F.lower(c("url")).rlike(K.SEARCH_URL_RE) & (c("source") != K.SHOPPING),
        "URL appears to be a search results page, not a single SKU",
    )


def _condition(values, value, target):
    allowed = F.array_sort(F.array_distinct(F.transform(values, lambda v: F.lower(F.trim(v)))))
    cond = F.lower(F.trim(c("condition")))
    return F.when(
        (F.size(allowed) > 0) & (cond != "") & ~F.array_contains(allowed, cond),
        F.concat(F.lit("condition '"), cond, F.lit("' not in "), list_text(allowed)),
    )


def _title_excludes(values, value, target):
    title = F.lower(c("title"))
    found = F.get(F.filter(values, lambda v: title.contains(F.lower(v))), F.lit(0))
    return F.when(found.isNotNull(), F.concat(F.lit("title contains excluded phrase '"), found, F.lit("'")))


REJECTS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "form_factor_in": _form_factor,
    "speed_mts_min": _speed,
    "ecc_required": _ecc,
    "voltage_eq": _voltage,
    "min_quantity_for_target": _min_quantity,
    "in_stock": _in_stock,
    "single_sku_url": _single_sku,
    "condition_in": _condition,
    "title_excludes": _title_excludes,
}


def target_literal(unit: str = "count", amount: int = 1, configurations: Sequence[tuple[int, int]] = ()) -> Column:
    pairs = ",".join(f"named_struct('module_count',{m},'module_capacity_gb',{g})" for m, g in configurations)
    return F.struct(
        F.lit(unit).alias("unit"), F.lit(amount).alias("amount"),
        F.expr(f"array({pairs})").cast("array<struct<module_count:int,module_capacity_gb:int>>").alias("configurations"),
    )


def rule_literal(rule: dict) -> Column:
    values = F.array(*[F.lit(str(v)) for v in rule.get("values", [])]).cast("array<string>")
    value = F.lit(rule.get("value")).cast("double")
    return F.struct(F.lit(rule["rule"]).alias("rule"), values.alias("values"), value.alias("value"))


def first_reject(rules: Sequence[dict], target: Column | None = None) -> Column:
    """Reason of the first rejecting rule as '[rule] reason', or null. Unknown rule names are skipped."""
    target = target_literal() if target is None else target
    reasons = [F.lit(None).cast("string")]
    for rule in rules:
        if rule["rule"] in REJECTS:
            lit = rule_literal(rule)
            reason = REJECTS[rule["rule"]](lit["values"], lit["value"], target)
            reasons.append(F.concat(F.lit(f"[{rule['rule']}] "), reason))
    return F.coalesce(*reasons)


def first_reject_from(rules: Column, target: Column) -> Column:
    """The same for rules that come with the row, in array order."""

    def reason(r: Column) -> Column:
        out = F
        for name, build in REJECTS.items():
            out = out.when(r["rule"] == name, F.concat(F.lit(f"[{name}] "), build(r["values"], r["value"], target)))
        return out

    return F.get(F.array_compact(F.transform(rules, reason)), F.lit(0))


def reject_log(offers: DataFrame, reason: Column) -> DataFrame:
    """Rejected offers in the verdict-log shape; `index` is the input position."""
    return offers.withColumn("reason", reason).where(c("reason").isNotNull()).select(
        "slug", "run_ts", c("pos").alias("index"), F.lit(False).alias("pass"), "reason", "title",
        c("unit_price_usd").alias("price"), "url", "source", attr("source_url").alias("source_url"),
    )


def profile_rules(profiles: DataFrame) -> DataFrame:
    """v2 profiles with their rule array: the fixed URL rule, then whatever the profile declares."""
    excludes = F.filter(F.transform(c("match.title_excludes"), lambda t: F.trim(t)), lambda t: t != "")
    entry = lambda name, values: F.struct(F.lit(name).alias("rule"), values.cast("array<string>").alias("values"), F.lit(None).cast("double").alias("value"))
    return profiles.withColumn(
        "rules",
        F.array_compact(
            F.array(
                entry("single_sku_url", F.array()),
                F.when(F.size(c("filters.condition_in")) > 0, entry("condition_in", c("filters.condition_in"))),
                F.when(c("filters.in_stock"), entry("in_stock", F.array())),
                F.when(F.size(excludes) > 0, entry("title_excludes", excludes)),
            )
        ),
    )


# --- flags: rule struct -> boolean -----------------------------------------------------------


def _any_in(values: Column, hay: Column) -> Column:
    return F.coalesce(F.exists(values, lambda v: F.lower(hay).contains(F.lower(v))), F.lit(False))


def _ship_from(r):
    return F.array_contains(F.transform(r["values"], lambda v: F.upper(v)), F.upper(F.nullif(c("ship_from_country"), F.lit(""))))


def _brand_in(r):
    return _any_in(r["values"], F.nullif(c("brand"), F.lit("")))


def _kingston(r):
    return F.lower(c("brand")).contains("kingston") & F.upper(c("mpn")).endswith("E")


def _mentions(r):
    return _any_in(r["values"], c("title"))


def _low_feedback(r):
    rating, count = c("seller_rating_pct"), c("seller_feedback_count")
    below = (rating < F.coalesce(r["rating_pct_below"], F.lit(0.0))) | (count < F.coalesce(r["count_below"], F.lit(0)))
    return rating.isNull() | count.isNull() | below


FLAGS: dict[str, Callable[[Column], Column]] = {
    "ship_from_country_in": _ship_from,
    "brand_in": _brand_in,
    "kingston_e_suffix": _kingston,
    "title_mentions_other_server": _mentions,
    "title_mentions": _mentions,
    "low_seller_feedback": _low_feedback,
}


def flag_literal(rule: dict) -> Column:
    return F.struct(
        F.lit(rule["rule"]).alias("rule"), F.lit(rule["flag"]).alias("flag"),
        F.array(*[F.lit(str(v)) for v in rule.get("values", [])]).cast("array<string>").alias("values"),
        F.lit(rule.get("rating_pct_below")).cast("double").alias("rating_pct_below"),
        F.lit(rule.get("count_below")).cast("int").alias("count_below"),
        F.lit(rule.get("description")).cast("string").alias("description"),
    )


def raised_flags(rules: Sequence[dict]) -> Column:
    raised = [F.when(FLAGS[r["rule"]](flag_literal(r)), F.lit(r["flag"])) for r in rules if r["rule"] in FLAGS]
    return F.array_compact(F.array(*raised).cast("array<string>"))


def raised_flags_from(rules: Column) -> Column:
    """The flags of a rule list that is a column (structs as `flag_literal` makes them), so that one job serves many profiles."""

    def raised(r: Column) -> Column:
        out = F
        for name, test in FLAGS.items():
            out = out.when((r["rule"] == name) & test(r), r["flag"])
        return out

    return F.array_compact(F.transform(rules, raised))


def with_flags(offers: DataFrame, raised: Column) -> DataFrame:
    """Append flags once each, keeping order."""
    return offers.withColumn("flags", F.array_union(c("flags"), raised))


def add_flag(flag: Column | str, when: Column) -> Column:
    """flags plus one conditional flag."""
    flag = F.lit(flag) if isinstance(flag, str) else flag
    return F.when(F.coalesce(when, F.lit(False)), F.array_union(c("flags"), F.array(flag))).otherwise(c("flags"))


def unknown_quantity(target: Column) -> Column:
    """The target needs more than one unit of this offer and its stock is unknown."""
    modules = money.matched_configuration(target["configurations"], capacity())["module_count"]
    has_configurations = F.coalesce(F.size(target["configurations"]), F.lit(0)) > 0
    need = F.when(has_configurations, modules).otherwise(target["amount"])
    units = F.floor(need / F.when(c("kit_module_count") > 0, c("kit_module_count")))
    return (units > 1) & c("quantity_available").isNull()


# --- gates -------------------------------------------------------------------------------------


def ship_from_gate(offers: DataFrame, allowed: Column, drop: bool = False) -> DataFrame:
    """Flag (and optionally drop) offers from a known country outside *allowed*; an empty list disables it."""
    codes = F.filter(F.transform(allowed, lambda a: F.upper(F.trim(a))), lambda a: a != "")
    country = F.upper(F.trim(c("ship_from_country")))
    outside = F.coalesce((F.size(allowed) > 0) & (country != "") & ~F.array_contains(codes, country), F.lit(False))
    out = offers.withColumn("_outside", outside).withColumn(
        "flags", add_flag(F.concat(F.lit("ship_from_"), F.lower(country)), c("_outside"))
    )
    return (out.where(~c("_outside")) if drop else out).drop("_outside")


def vendor_matches(entries: Column) -> Column:
    """An entry is a substring of the vendor key or of the marketplace label; blank entries do not count."""
    tokens = F.array_compact(F.array(urls.vendor_key(c("seller_name")), urls.marketplace_label(c("source"))))

    def entry_hits(raw: Column) -> Column:
        e = F.lower(F.trim(raw))
        return (e != "") & F.exists(tokens, lambda t: t.contains(e))

    return F.coalesce(F.exists(entries, entry_hits), F.lit(False))


def vendor_passes(allow: Column, block: Column) -> Column:
    size = lambda a: F.coalesce(F.size(a), F.lit(0))
    return ((size(allow) <= 0) | vendor_matches(allow)) & ((size(block) <= 0) | ~vendor_matches(block))


def vendor_filter(offers: DataFrame, allow: Column, block: Column) -> DataFrame:
    return offers.where(vendor_passes(allow, block))


def alias_passes(aliases: Column, strict: Column) -> Column:
    names = F.filter(F.transform(aliases, lambda a: F.trim(a)), lambda a: a != "")
    active = F.coalesce(strict & (F.size(names) > 0), F.lit(False))
    return ~active | text.title_has_alias(c("title"), names)


def alias_gate(offers: DataFrame, aliases: Column, strict: Column) -> DataFrame:
    """Exact-product asks keep only titles that carry an alias as its own token."""
    return offers.where(alias_passes(aliases, strict))
