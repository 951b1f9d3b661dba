"""Column functions over URLs and hosts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from offerloom import constants as K
from offerloom.functions.text import hit, nonblank


def canonical_host(raw: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim(raw)), r"^www\.", ""), F.lit(""))


def netloc(url: Column) -> Column:
    return hit(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def offer_host(url: Column, attrs: Column) -> Column:
    """Host an offer counts under: the recorded vendor host, else the host of its URL."""
    return F.coalesce(canonical_host(F.try_element_at(attrs, F.lit("vendor_host"))), canonical_host(netloc(url)))


def merchant_host(source: Column, seller: Column, url: Column) -> Column:
    """Shopping-index rows only name a merchant: map known fragments, else squash the name to a domain."""
    name = F.lower(seller)
    squashed = F.nullif(F.regexp_replace(name, "[ -]", ""), F.lit(""))
    guess = F
    for fragment, host in K.MERCHANT_HOSTS:
        guess = guess.when(name.contains(fragment), host)
    guess = guess.when(name.contains(".") & ~name.contains(" "), name).otherwise(F.concat(squashed, F.lit(".com")))
    return F.when(source == K.SHOPPING, guess).otherwise(F.lower(netloc(url)))


def source_label(source: Column, url: Column, attrs: Column) -> Column:
    """Display label: the vendor host for universal rows, the source id otherwise."""
    host = F.coalesce(F.nullif(F.try_element_at(attrs, F.lit("vendor_host")), F.lit("")), F.lower(netloc(url)))
    return F.when(
        source == K.UNIVERSAL,
        F.coalesce(F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit("")), source),
    ).otherwise(source)


def vendor_key(seller: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(seller)), F.lit("")), F.lit(K.UNKNOWN_VENDOR))


def marketplace_label(source: Column) -> Column:
    out = F
    for key, label in K.MARKETPLACE_LABELS.items():
        out = out.when(source == key, label)
    return out


def sku_tokens(url: Column) -> Column:
    """Product codes embedded in a URL, upper-cased."""
    found = F.array_compact(F.array(hit(url, K.ASIN_URL_RE, 1), hit(url, K.REG_URL_RE, 1)))
    return F.array_distinct(F.transform(found, lambda t: F.regexp_replace(F.upper(t), "[^A-Z0-9]+", "")))


def form_encode(c: Column) -> Column:
    """Form encoding that keeps '~' and escapes '*'."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def search_url(host: Column, query: Column) -> Column:
    """Search-results URL of a registered host, null for others."""
    template = F
    h = canonical_host(host)
    for name, text in K.SEARCH_URL_TEMPLATES.items():
        template = template.when(h == name, text)
    return F.replace(template, F.lit("{q}"), form_encode(F.trim(query)))


def stable_product_url(product_id: Column, link: Column) -> Column:
    return F.coalesce(F.concat(F.lit(K.STABLE_PRODUCT_URL), nonblank(product_id)), link)
