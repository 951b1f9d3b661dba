"""Model output texts -> verdict rows, and tagged blocks inside conversation texts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from offerloom.functions.text import hit

# --- finding the JSON envelope in a text -------------------------------------------------


def _single_verdict(value: object) -> bool:
    """One verdict on its own is a fragment of a cut-off answer, never the answer."""
    return (
        isinstance(value, dict) and "index" in value and "evaluations" not in value
        and ("pass" in value or "reason" in value)
    )


def find_envelope(text: str | None) -> str | None:
    """JSON text of the first usable object or array in *text*."""
    if text is None:
        return None
    body = text.strip()
    if body.startswith("```"):
        body = body.partition("\n")[2] if "\n" in body else body
        body = body[:-3].strip() if body.endswith("```") else body
    body = body.removeprefix("json").strip()
    try:
        whole = json.loads(body)
        if whole is not None and not _single_verdict(whole):
            return json.dumps(whole)
    except ValueError:
        pass
    decode = json.JSONDecoder().raw_decode
    for start in (i for i, ch in enumerate(body) if ch in "{["):
        try:
            found, _ = decode(body, start)
        except ValueError:
            continue
        if not _single_verdict(found):
            return json.dumps(found)
    return None


@F.pandas_udf(StringType())
def envelope_text(texts: pd.Series) -> pd.Series:
    """The one step SQL cannot express: decoding JSON that is followed by other text."""
    return texts.map(find_envelope)


# --- reading verdicts out of the envelope ---------------------------------------------------


def variant_kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def truthy(v: Column) -> Column:
    """Whether a JSON value counts as set: not null, false, 0, empty text or empty container."""
    kind = variant_kind(v)
    as_text = F.try_variant_get(v, "$", "string")
    return F.coalesce(
        F.when(v.isNull() | (kind == "VOID"), False)
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind == "STRING", as_text != "")
        .when(kind.rlike("^(ARRAY|OBJECT)"), ~F.to_json(v).isin("[]", "{}"))
        .otherwise(F.try_variant_get(v, "$", "double") != 0),
        F.lit(False),
    )


def value_text(v: Column) -> Column:
    kind = variant_kind(v)
    as_text = F.try_variant_get(v, "$", "string")
    return F.trim(
        F.when(kind == "BOOLEAN", F.initcap(as_text)).when(kind.rlike("^(ARRAY|OBJECT)"), F.to_json(v)).otherwise(as_text)
    )


def verdict_list(envelope: Column, n: Column) -> Column:
    """array<struct<index, pass, reason, features>> from any of the four accepted shapes; null when none fits."""
    doc = F.try_parse_json(envelope)
    listed = F.try_variant_get(doc, "$", "array<variant>")
    evaluations = F.coalesce(
        F.try_variant_get(doc, "$.evaluations", "array<variant>"),
        F.when(variant_kind(F.get(listed, F.lit(0))).startswith("OBJECT"), listed),
    )
    indices = F.coalesce(F.try_variant_get(doc, "$.indices", "array<variant>"), listed)

    def read(e: Column) -> Column:
        features = F.map_filter(
            F.try_variant_get(e, "$.extracted_features", "map<string,variant>"), lambda _, v: truthy(v)
        )
        return F.struct(
            F.try_variant_get(e, "$.index", "int").alias("index"),
            truthy(F.try_variant_get(e, "$.pass", "variant")).alias("pass"),
            F.trim(F.coalesce(F.try_variant_get(e, "$.reason", "string"), F.lit(""))).alias("reason"),
            F.map_filter(F.transform_values(features, lambda _, v: value_text(v)), lambda _, v: v != "").alias("features"),
        )

    passed = F.transform(indices, lambda i: F.try_variant_get(i, "$", "int"))
    expanded = F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)),
        lambda i: F.struct(
            i.cast("int").alias("index"),
            F.array_contains(passed, i.cast("int")).alias("pass"),
            F.lit("(legacy indices-only response)").alias("reason"),
            F.create_map().cast("map<string,string>").alias("features"),
        ),
    )
    read_rows = F.transform(F.filter(evaluations, lambda e: variant_kind(e).startswith("OBJECT")), read)
    return F.when(evaluations.isNotNull(), read_rows).when(indices.isNotNull(), expanded)


def merge_features(
    features: Column, attrs: Column, condition: Column, brand: Column, quantity: Column,
) -> Column:
    """attrs plus extracted features; structured fields and existing keys win (map policy LAST_WIN)."""
    known = (
        ((F.coalesce(condition, F.lit("")) != ""), "condition"),
        ((F.coalesce(brand, F.lit("")) != ""), "brand"),
        (quantity.isNotNull(), "quantity"),
    )

    def keep(key: Column, value: Column) -> Column:
        ok = F.trim(F.coalesce(value, F.lit(""))) != ""
        for is_known, name in known:
            ok = ok & ~((key == name) & is_known)
        return ok

    added = F.transform_values(F.map_filter(features, keep), lambda _, v: F.trim(v))
    return F.coalesce(F.map_concat(added, attrs), attrs)


# --- tagged blocks in conversation texts --------------------------------------------------------


def block(text: Column, tag: str) -> Column:
    """Inner text of the first complete <tag>...</tag>, trimmed; null when there is none."""
    return F.nullif(F.trim(hit(text, rf"(?is)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))


def block_object(text: Column, tag: str) -> Column:
    """The block as a variant when it holds one JSON object."""
    doc = F.try_parse_json(block(text, tag))
    return F.when(variant_kind(doc).startswith("OBJECT"), doc)


def without_blocks(text: Column) -> Column:
    """Visible reply: complete blocks removed, then everything from a still open tag on."""
    closed = F.regexp_replace(text, r"(?is)<state>.*?</state>|<draft>.*?</draft>", "")
    return F.regexp_replace(F.regexp_replace(closed, r"(?is)<(state|draft)>.*$", ""), r"\s+$", "")
