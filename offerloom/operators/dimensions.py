"""Lookups: known parts, badges, flag descriptions, model prices and run cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from offerloom import constants as K
from offerloom.functions import money

c = F.col
RUN = ["slug", "run_ts"]


def literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def annotate_known_parts(offers: DataFrame, known: DataFrame) -> DataFrame:
    """qvl_status by part number. Offers without a number never meet in one join group."""
    key = F.nullif(F.lower(F.trim("mpn")), F.lit(""))
    spread = F.coalesce(key, F.concat(F.lit("\x00"), c("pos").cast("string")))
    parts = known.select(F.lower(F.trim("mpn")).alias("_mpn")).where(c("_mpn") != "").distinct().withColumn("_known", F.lit(True))
    joined = offers.drop("qvl_status").withColumn("_mpn", spread).join(parts, "_mpn", "left")
    return joined.withColumn("qvl_status", F.when(c("_known"), "qvl").otherwise("unknown")).drop("_mpn", "_known")


def badge(flag: Column, rule: Column | None = None) -> Column:
    """Label and severity of a flag: by its id, else by the rule that raised it, else the bare id."""
    labels = literal_map({k: v[0] for k, v in K.FLAG_LABELS.items()})
    levels = literal_map({k: v[1] for k, v in K.FLAG_LABELS.items()})
    key = F.when(F.map_contains_key(labels, flag), flag)
    if rule is not None:
        key = F.coalesce(key, F.when(F.map_contains_key(labels, rule), rule))
    level = F.coalesce(F.try_element_at(levels, key), F.lit("info"))
    return F.struct(
        flag.alias("key"), F.coalesce(F.try_element_at(labels, key), flag).alias("label"),
        F.when(level.isin(K.SEVERITIES), level).otherwise("info").alias("severity"),
    )


def badges(flags: Column, flag_rules: Column | None = None) -> Column:
    """array<struct<key,label,severity>> of an offer: one per distinct flag, in order."""

    def one(flag: Column) -> Column:
        rule = None
        if flag_rules is not None:
            known = lambda r: (r["flag"] == flag) & r["rule"].isin(list(K.FLAG_LABELS))
            rule = F.coalesce(F.get(F.filter(flag_rules, known), F.lit(0))["rule"], F.lit(""))
        return badge(flag, rule)

    return F.transform(F.array_distinct(flags), one)


def flag_descriptions(offers: DataFrame, flag_rules: DataFrame) -> DataFrame:
    """Distinct flags per run with a description: the profile's, the built-in by flag, the built-in by rule, or none."""
    builtin = literal_map(K.FLAG_DESCRIPTIONS)
    seen = offers.select(*RUN, F.explode("flags").alias("flag")).distinct()
    rules = flag_rules.groupBy("slug", "flag").agg(
        F.min_by("description", F.when(F.coalesce(c("description"), F.lit("")) != "", c("pos"))).alias("own"),
        F.min_by("rule", "pos").alias("rule"),
    )
    joined = seen.join(rules, ["slug", "flag"], "left")
    return joined.select(
        *RUN, "flag",
        F.coalesce(F.nullif("own", F.lit("")), F.try_element_at(builtin, c("flag")), F.try_element_at(builtin, c("rule"))).alias("description"),
    )


def price_table(spark: SparkSession) -> DataFrame:
    """The built-in model price list: a handful of fixed rows, so it may be broadcast."""
    rows = [(p, m, i, o) for (p, m), (i, o) in K.MODEL_PRICES.items()]
    return spark.createDataFrame(rows, "provider string, model string, price_in double, price_out double")


def price_calls(calls: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """cost_usd per call: the explicit cost, 0 for the local provider, null when the model has no price."""
    table = F.broadcast(price_table(calls.sparkSession)) if prices is None else prices
    estimate = money.token_cost(
        c("price_in"), c("price_out"), c("input_tokens"), c("output_tokens"),
        c("cache_read_input_tokens"), c("cache_creation_input_tokens"),
    )
    cost = F.coalesce(c("cost_usd"), F.when(c("provider") == "local", 0.0), estimate)
    return calls.join(table, ["provider", "model"], "left").withColumn("cost_usd", cost).drop("price_in", "price_out")


TOKENS = ["input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"]
STEPS_TYPE = f"array<struct<step:string,provider:string,model:string,{','.join(t + ':bigint' for t in TOKENS)},cost_usd:double>>"


def run_cost(priced: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """Total cost, whether a call has no price, calls, and the steps: one entry per step and model.

    Calls are summed per step and model first, so the list stays short however many calls a run makes.
    """
    have = [n for n in ("step", "provider", "model") if n in priced.columns]
    sums = priced.groupBy(*keys, *have).agg(
        F.sum("cost_usd").alias("cost_usd"), F.bool_or(c("cost_usd").isNull()).alias("_unpriced"), F.count(F.lit(1)).alias("_calls"),
        *[F.sum(t).cast("bigint").alias(t) for t in TOKENS if t in priced.columns],
    )
    entry = [c(n) if n in sums.columns else F.lit(None).cast("bigint" if n in TOKENS else "string").alias(n) for n in ("step", "provider", "model", *TOKENS)]
    return sums.groupBy(*keys).agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_usd"), F.bool_or("_unpriced").alias("any_unpriced"), F.sum("_calls").alias("calls"),
        F.sort_array(F.collect_list(F.struct(*entry, F.when(~c("_unpriced"), c("cost_usd")).alias("cost_usd")))).cast(STEPS_TYPE).alias("steps"),
    )


def cache_effect(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Cost with cached input against the same tokens as fresh input."""
    sums = calls.groupBy(*keys, "provider", "model").agg(
        *[F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in
          ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")]
    )
    priced = sums.join(F.broadcast(price_table(calls.sparkSession)), ["provider", "model"], "left")
    fresh = c("input_tokens") + c("cache_read_input_tokens") + c("cache_creation_input_tokens")
    zero = F.lit(0)
    cached = money.token_cost(
        c("price_in"), c("price_out"), c("input_tokens"), c("output_tokens"),
        c("cache_read_input_tokens"), c("cache_creation_input_tokens"),
    )
    baseline = money.token_cost(c("price_in"), c("price_out"), fresh, c("output_tokens"), zero, zero)
    return priced.withColumn("cached_usd", cached).withColumn("baseline_usd", baseline).withColumn(
        "reduction", F.when(c("baseline_usd") > 0, 1 - c("cached_usd") / c("baseline_usd"))
    ).withColumn("engaged", c("cache_read_input_tokens") > 0).drop("price_in", "price_out")
