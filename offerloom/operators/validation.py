"""Checks over whole profile and rule tables; every check yields violations(slug, check, severity, message)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from offerloom import constants as K
from offerloom.functions import schedule as S, text, urls

c = F.col


def violations(df: DataFrame, check: str, bad: Column, message: Column | str, severity: str = "error") -> DataFrame:
    msg = F.lit(message) if isinstance(message, str) else message
    return df.where(F.coalesce(bad, F.lit(False))).select(
        "slug", F.lit(check).alias("check"), F.lit(severity).alias("severity"), msg.alias("message")
    )


def unknown_ids(items: DataFrame, kind: str, allowed: list[str]) -> DataFrame:
    """items(slug, id): ids outside the allow-list."""
    return violations(items, f"unknown_{kind}", ~c("id").isin(allowed), F.concat(F.lit(f"unknown {kind} "), c("id")))


def column_lists(profiles: DataFrame) -> DataFrame:
    """profiles(slug, report_columns): unknown, duplicate or empty column lists."""
    cols = c("report_columns")
    unknown = F.filter(cols, lambda x: ~x.isin(K.REPORT_COLUMNS))
    return reduce(
        DataFrame.unionByName,
        [
            violations(profiles, "columns_empty", F.size(cols) == 0, "report_columns is empty"),
            violations(profiles, "columns_duplicate", F.size(cols) != F.size(F.array_distinct(cols)), "report_columns has duplicates"),
            violations(profiles, "columns_unknown", F.size(unknown) > 0, F.concat(F.lit("unknown columns: "), F.array_join(F.array_sort(unknown), ", "))),
        ],
    )


def bound_tests(field: Callable[[str], Column] = c) -> dict[str, tuple[Column, str]]:
    """Numeric bounds and enum domains of a v2 profile: name -> (is violated, message). Absent values pass."""
    positive = {
        "target_amount": "target.amount", "min_quantity": "filters.min_quantity", "serper_num": "sources.serper.num", "amazon_depth": "sources.amazon.depth",
        "max_listings": "display.max_listings", "per_vendor_cap": "display.per_vendor_cap",
    }
    return {
        **{name: (field(at) <= 0, f"{at} must be positive") for name, at in positive.items()},
        "configuration": (
            F.exists(field("target.configurations"), lambda x: (x["module_count"] <= 0) | (x["module_capacity_gb"] <= 0)),
            "configuration values must be positive",
        ),
        "amazon_priority": (~field("sources.amazon.priority").isin(K.AMAZON_PRIORITIES), "sources.amazon.priority must be standard or live"),
    }


def bounds(profiles: DataFrame) -> DataFrame:
    tests = bound_tests()
    return reduce(DataFrame.unionByName, [violations(profiles, name, bad, msg) for name, (bad, msg) in tests.items()])


def schedules(rows: DataFrame) -> DataFrame:
    """rows(slug, cron, run_at): exactly one mode; five fields of allowed characters."""
    both, neither = c("cron").isNotNull() & c("run_at").isNotNull(), c("cron").isNull() & c("run_at").isNull()
    problem = S.cron_problem(c("cron"))
    return violations(rows, "schedule_mode", both | neither, "schedule must set exactly one of cron or run_at").unionByName(
        violations(rows, "schedule_cron", problem.isNotNull(), problem)
    )


def aliases(profiles: DataFrame) -> DataFrame:
    """profiles(slug, aliases): blank and too generic entries."""
    rows = profiles.select("slug", F.explode("aliases").alias("a"))
    blank = F.trim("a") == ""
    return violations(rows, "alias_blank", blank, "each alias must be non-empty").unionByName(
        violations(rows, "alias_generic", ~blank & ~text.alias_is_distinctive(c("a")), F.concat(F.lit("alias is too generic: "), c("a")))
    )


def v1_extras(profiles: DataFrame) -> DataFrame:
    """profiles(slug, qvl_file, brand_candidates): the part list must name the product, candidates must not be blank."""
    own_file = c("qvl_file").contains(c("slug"))
    blank = F.exists("brand_candidates", lambda b: F.trim(b) == "")
    return violations(profiles, "qvl_file", ~own_file, "qvl_file must contain the slug").unionByName(
        violations(profiles, "brand_blank", blank, "brand_candidates must be non-blank")
    )


def excludes_own_name(profiles: DataFrame) -> DataFrame:
    """profiles(slug, display_name, title_excludes): an exclude phrase that is part of the product's own name or slug."""
    norm = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    names = F.array_compact(F.array(norm(c("display_name")), norm(F.replace("slug", F.lit("-"), F.lit(" "))), F.lower("slug")))
    hit = F.filter("title_excludes", lambda v: (F.length(norm(v)) >= 2) & F.exists(names, lambda n: n.contains(norm(v))))
    quoted = F.array_join(F.array_distinct(F.transform(hit, lambda v: F.concat(F.lit('"'), F.trim(v), F.lit('"')))), "; ")
    return violations(profiles, "title_excludes", F.size(hit) > 0, F.concat(F.lit("title_excludes is part of the product name: "), quoted), "warning")


def missing_aliases(profiles: DataFrame) -> DataFrame:
    """Without aliases the model token of the name must do; without that token it is an error."""
    none = F.coalesce(F.size(F.filter("aliases", lambda a: F.trim(a) != "")), F.lit(0)) <= 0
    token = text.model_token(c("display_name"))
    return violations(profiles, "aliases_missing", none & token.isNull(), "no aliases and no model token in display_name").unionByName(
        violations(profiles, "aliases_from_name", none & token.isNotNull(), F.concat(F.lit("no aliases; matching relies on "), token), "warning")
    )


def alias_from_url(profiles: DataFrame, sources: DataFrame) -> DataFrame:
    """An alias that contains a product code taken from a source URL of the same profile."""
    codes = sources.where(c("id") == K.UNIVERSAL).select("slug", F.explode(urls.sku_tokens(c("url"))).alias("code")).distinct()
    names = profiles.select("slug", F.explode("aliases").alias("a")).select("slug", F.regexp_replace(F.upper("a"), "[^A-Z0-9]+", "").alias("norm"))
    hits = names.join(codes, "slug").where(c("norm").contains(c("code"))).select("slug", "code").distinct()
    return violations(hits, "alias_from_url", F.lit(True), F.concat(F.lit("alias contains a code from a source URL: "), c("code")))


def condition_drift(stated: DataFrame, rules: DataFrame) -> DataFrame:
    """stated(slug, line): a confirmed condition requirement without a rule that covers it."""
    covered = rules.where(
        ((c("rule") == "condition_in") & (F.size("values") > 0))
        | ((c("rule") == "title_excludes") & F.exists("values", lambda v: text.covers_condition(v)))
    ).select("slug").distinct()
    asked = stated.where(text.states_condition(c("line"))).join(covered, "slug", "left_anti")
    lines = asked.groupBy("slug").agg(F.array_join(F.array_sort(F.collect_set(F.trim("line"))), "; ").alias("lines"))
    return violations(lines, "condition_drift", F.lit(True), F.concat(F.lit("no condition filter for: "), c("lines")), "warning")


def host_coverage(sources: DataFrame, hosts: list[str]) -> DataFrame:
    """(slug, host) with search / detail presence, for hosts that need both kinds of URL."""
    host = urls.canonical_host(urls.netloc(F.trim("url")))
    rows = sources.where(c("id") == K.UNIVERSAL).select("slug", host.alias("host"), (F.coalesce("page_type", F.lit("")) == "detail").alias("detail"))
    return rows.where(c("host").isin(hosts)).groupBy("slug", "host").agg(F.bool_or(~c("detail")).alias("has_search"), F.bool_or("detail").alias("has_detail"))


def detail_backup(sources: DataFrame, hosts: list[str]) -> DataFrame:
    cover = host_coverage(sources, hosts)
    lacking = F.when(c("has_search") & ~c("has_detail"), "detail").when(c("has_detail") & ~c("has_search"), "search")
    return violations(cover, "host_coverage", lacking.isNotNull(), F.concat(c("host"), F.lit(": no "), lacking, F.lit(" URL")))


def prefers_detail(url: Column, page_type: Column, hosts: list[str]) -> Column:
    return F.coalesce((page_type == "detail") | urls.canonical_host(urls.netloc(url)).isin(hosts), F.lit(False))


def pending_without_url(pending: DataFrame, sources: DataFrame, hosts: list[str]) -> DataFrame:
    """URL-less universal entries in sources_pending; the host is read off the note text by known name fragments."""
    note = F.lower(F.coalesce("note", F.lit("")))
    host = F
    for name in hosts:
        for fragment in K.HOST_ALIASES.get(name, [name.removesuffix(".com")]):
            host = host.when(note.contains(fragment), name)
    host = host.otherwise(F.lit(None).cast("string"))
    open_rows = pending.where((c("id") == K.UNIVERSAL) & (F.trim(F.coalesce("url", F.lit(""))) == "")).withColumn("host", host)
    present = sources.where(c("id") == K.UNIVERSAL).select("slug", urls.canonical_host(urls.netloc(F.trim("url"))).alias("host")).distinct()
    rows = open_rows.where(c("host").isNull()).unionByName(open_rows.where(c("host").isNotNull()).join(present, ["slug", "host"], "left_anti").select(*open_rows.columns))
    return violations(rows, "pending_without_url", F.lit(True), F.concat(F.lit("pending entry without URL: "), F.coalesce("host", F.lit("unknown vendor"))), "warning")


def drafts(profiles: DataFrame) -> DataFrame:
    """v2 draft checks: version, slug, name, queries, at least one source, product type."""
    slug = F.trim(F.coalesce("slug", F.lit("")))
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    on = F.coalesce(c("sources.serper.enabled"), F.lit(True)) | F.coalesce(c("sources.ebay.enabled"), F.lit(False)) | F.coalesce(c("sources.amazon.enabled"), F.lit(False))
    none = F.coalesce(F.size("queries"), F.lit(0)) <= 0
    tests = [
        ("schema_version", c("schema_version") != 2, "schema_version must be 2", "error"),
        ("slug_missing", slug == "", "slug is required", "error"),
        ("slug_shape", (slug != "") & ~text.slug_is_valid(slug), "slug must be lowercase letters, digits, hyphens", "error"),
        ("display_name", blank(c("display_name")), "display_name is required", "error"),
        ("queries", none, "at least one query is required", "error"),
        ("queries_blank", ~none & F.exists("queries", lambda q: F.trim(q) == ""), "each query must be a non-empty string", "error"),
        ("sources", ~on, "at least one source must be enabled", "error"),
        ("product_type", blank(c("product_type")), "product_type is not set", "warning"),
    ]
    return reduce(DataFrame.unionByName, [violations(profiles, n, bad, msg, sev) for n, bad, msg, sev in tests])


def alert_problem() -> Column:
    """What is wrong with an alert rule row, or null."""
    optional = lambda name, allowed: c(name).isNotNull() & ~c(name).isin(allowed)
    price = (
        F.when(F.coalesce(c("threshold_usd"), F.lit(0.0)) <= 0, "threshold must be a positive number")
        .when(optional("condition", K.CONDITIONS), F.lit("condition must be one of " + ", ".join(K.CONDITIONS)))
        .when(optional("mode", K.ALERT_MODES), F.lit("mode must be one of " + ", ".join(K.ALERT_MODES)))
        .when(optional("price_basis", K.PRICE_BASES), F.lit("price_basis must be one of " + ", ".join(K.PRICE_BASES)))
    )
    host = F.trim(F.coalesce("host", F.lit("")))
    vendor = F.when(host == "", "host is required").when(~host.rlike(K.HOST_RE), "host must look like a domain (e.g. amazon.com)")
    return (
        F.when(c("kind") == "price_below", price).when(c("kind") == "vendor_seen", vendor)
        .when(c("kind") == "new_vendor_carries", F.lit(None).cast("string")).otherwise("unknown alert kind")
    )


def alert_rules(rules: DataFrame) -> DataFrame:
    return violations(rules, "alert_rule", alert_problem().isNotNull(), alert_problem())


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either registry the other lacks; both need the same columns."""
    return left.exceptAll(right).withColumn("only_in", F.lit("left")).unionByName(right.exceptAll(left).withColumn("only_in", F.lit("right")))
