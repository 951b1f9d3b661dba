"""Column functions over prices, totals, model costs and durations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from offerloom import constants as K


def priced(price: Column) -> Column:
    """The price when it is a real one: 0 and below mean unknown."""
    return F.when(price > 0, price)


def as_sold(is_kit: Column, kit_price: Column, unit_price: Column) -> Column:
    return F.when(is_kit & kit_price.isNotNull(), kit_price).otherwise(unit_price)


def basis_price(basis: Column, is_kit: Column, kit_price: Column, unit_price: Column) -> Column:
    return F.when(basis == "total", as_sold(is_kit, kit_price, unit_price)).otherwise(unit_price)


def matched_configuration(configurations: Column, capacity: Column) -> Column:
    """First configuration with the offer's capacity, or null."""
    return F.get(F.filter(configurations, lambda c: c["module_capacity_gb"] == capacity), F.lit(0))


def total_for_target(
    target: Column, capacity: Column, is_kit: Column, kit_count: Column,
    kit_price: Column, unit_price: Column, quantity: Column,
) -> Column:
    """What it costs to reach the target with this offer alone; null when it cannot."""
    cost = as_sold(is_kit, kit_price, unit_price)
    need = F.greatest(F.lit(1), target["amount"])
    modules = matched_configuration(target["configurations"], capacity)["module_count"]
    safe_kit = F.nullif(kit_count, F.lit(0))
    units = F.floor(modules / safe_kit).cast("int")
    enough = lambda n: quantity.isNull() | (quantity >= n)
    plain = F.when(enough(need), F.round(cost * need, 2))
    configured = F.when((modules % safe_kit == 0) & enough(units), F.round(cost * units, 2))
    return F.when(F.coalesce(F.size(target["configurations"]), F.lit(0)) <= 0, plain).otherwise(configured)


def token_cost(
    price_in: Column, price_out: Column, tokens_in: Column, tokens_out: Column,
    cache_read: Column, cache_write: Column,
) -> Column:
    z = lambda c: F.coalesce(c, F.lit(0))
    return (
        z(tokens_in) * price_in / 1_000_000
        + z(cache_write) * price_in * K.CACHE_WRITE_RATE / 1_000_000
        + z(cache_read) * price_in * K.CACHE_READ_RATE / 1_000_000
        + z(tokens_out) * price_out / 1_000_000
    )


def money_text(v: Column) -> Column:
    return F.when(v.isNotNull(), F.format_string("$%.2f", v)).otherwise("unknown")


def money_text_fx(v: Column, fx: Column) -> Column:
    """Money with the currency it was converted from, when known."""
    suffix = F.when(F.coalesce(fx, F.lit("")) == "", "").when(fx == "True", " (fx)").otherwise(
        F.concat(F.lit(" ("), fx, F.lit(")"))
    )
    return F.concat(money_text(v), suffix)


def cost_text(v: Column) -> Column:
    return F.when(v.isNull(), "(unpriced)").when(v < 0.0001, "<$0.0001").otherwise(F.format_string("$%.4f", v))


def card_cost_text(v: Column) -> Column:
    return (
        F.when(v == 0, "$0.00").when(v < 0.01, F.format_string("$%.4f", v)).when(v.isNotNull(), F.format_string("$%.2f", v))
    )


def grouped_money(v: Column) -> Column:
    return F.when(v.isNotNull(), F.format_string("$%,.2f", v))


def duration_text(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(
        F.format_string("%dm %02ds", F.floor(s / 60).cast("bigint"), s % 60)
    )
