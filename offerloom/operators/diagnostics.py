"""Source attribution and run / source outcome classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from offerloom import constants as K
from offerloom.functions import urls
from offerloom.operators.skew import top_rows

c = F.col
RUN = ["slug", "run_ts"]


def attr(key: str) -> Column:
    return F.try_element_at(c("attrs"), F.lit(key))


def passed_counts(offers: DataFrame) -> DataFrame:
    """Passed offers per (run, source, host, url): host and url only tell universal sources apart."""
    universal = c("source") == K.UNIVERSAL
    return offers.groupBy(
        *RUN, "source",
        F.when(universal, urls.canonical_host(attr("vendor_host"))).alias("match_host"),
        F.when(universal, F.nullif(attr("source_url"), F.lit(""))).alias("match_url"),
    ).agg(F.count(F.lit(1)).alias("passed"))


def attribute_passed(stats: DataFrame, counts: DataFrame) -> DataFrame:
    s, n = stats.alias("s"), counts.alias("n")
    on = (
        (c("s.slug") == c("n.slug")) & (c("s.run_ts") == c("n.run_ts")) & (c("s.source") == c("n.source"))
        & c("s.match_host").eqNullSafe(c("n.match_host")) & c("s.match_url").eqNullSafe(c("n.match_url"))
    )
    return s.join(n, on, "left").select("s.*", F.coalesce("n.passed", F.lit(0)).cast("bigint").alias("passed"))


def attribute_rejections(stats: DataFrame, log: DataFrame) -> DataFrame:
    """Rejected and relevance-rejected counts per source row: by its URL when it has one, else by source id.

    Two equi-joins on pre-aggregated counts instead of one OR join over the log.
    """
    relevance = F.count_if(F.lower("reason").contains("relevance_check"))
    rejected = log.where(~F.coalesce(c("pass"), F.lit(False)))
    count = lambda key, name: rejected.where(key.isNotNull()).groupBy(*RUN, key.alias(name)).agg(
        F.count(F.lit(1)).alias("rejected"), relevance.alias("relevance")
    )
    has_url = F.coalesce(c("match_url"), F.lit("")) != ""
    by_url = stats.where(has_url).join(count(c("source_url"), "match_url"), [*RUN, "match_url"], "left")
    by_source = stats.where(~has_url).join(count(c("source"), "source"), [*RUN, "source"], "left")
    out = by_url.unionByName(by_source)
    return out.fillna(0, ["rejected", "relevance"])


def dominant_rejection() -> Column:
    none_fetched = F.coalesce(c("fetched"), F.lit(0)) == 0
    all_rejected = (c("rejected") > 0) & (c("passed") == 0) & (c("rejected") >= c("fetched"))
    relevance = (c("rejected") > 0) & (c("relevance") >= c("rejected") * 0.5)
    return (
        F.when(none_fetched, "vendor_does_not_carry")
        .when(all_rejected, F.concat(F.lit("mis_scoped_url_"), c("rejected").cast("string")))
        .when(relevance, "relevance_check")
    )


def short_error(error: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(error, r"\s+", " ")), 1, 160)


def source_outcome() -> Column:
    """Struct (category, label, message): the first matching branch decides.

    Reads fetched, passed, error, skip_reason, diagnostics (map), known_blocker, dominant_rejection.
    """
    t = K.SOURCE_TEXTS
    fetched, passed = F.coalesce(c("fetched"), F.lit(0)), F.coalesce(c("passed"), F.lit(0))
    dominant, error, skip = c("dominant_rejection"), F.nullif("error", F.lit("")), F.nullif("skip_reason", F.lit(""))
    diag = lambda key: F.lower(F.coalesce(F.try_element_at(c("diagnostics"), F.lit(key)), F.lit("false"))) == "true"
    body = F.coalesce(F.try_element_at(c("diagnostics"), F.lit("body_len")).try_cast("int"), F.lit(0))
    noun = F.when(fetched == 1, "listing").otherwise("listings")
    found = fetched > 0
    mis_scoped = dominant.startswith("mis_scoped_url_")

    def made(category: str, message: Column | str, label: Column | str | None = None) -> Column:
        label = K.SOURCE_LABELS[category] if label is None else label
        as_col = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(F.lit(category).alias("category"), as_col(label).alias("label"), as_col(message).alias("message"))

    scoped_text = F.format_string(t["mis_scoped"], fetched.cast("string"), noun)
    return (
        F.when(passed > 0, made("ok", ""))
        .when(found & mis_scoped, made("no_match", scoped_text, F.format_string(K.LABEL_MIS_SCOPED, F.substring_index(dominant, "_", -1))))
        .when(found & (dominant == "relevance_check"), made("no_match", scoped_text))
        .when(found, made("no_match", F.format_string(t["no_match"], fetched.cast("string"), noun)))
        .when(skip.startswith(K.WATCH_PREFIX), made("watched", t["watched"]))
        .when(
            c("known_blocker").isNotNull(),
            made("permanent", F.rtrim(F.concat(F.lit(t["blocked"] + " "), F.trim(F.regexp_replace("known_blocker", r"\s+", " "))))),
        )
        .when(F.lower(error).rlike("quota|auth|429|401|403"), made("permanent", t["quota"]))
        .when(skip.isNotNull(), made("transient", F.format_string(t["skipped"], short_error(skip))))
        .when(diag("alterlab_pool_exhausted"), made("transient", t["pool"]))
        .when(diag("alterlab_degraded"), made("transient", t["degraded"]))
        .when(error.isNotNull(), made("transient", F.format_string(t["fetch_error"], short_error(error))))
        .when(body >= K.BODY_FULL, made("parser_gap", F.format_string(t["parser_gap"], body)))
        .when((body > 0) & (body < K.BODY_THIN), made("transient", F.format_string(t["thin"], body)))
        .when(dominant == "vendor_does_not_carry", made("no_match", t["not_carried"], K.LABEL_NOT_CARRIED))
        .otherwise(made("empty_page", t["empty"]))
    )


def zero_reason_callout(classified: DataFrame) -> DataFrame:
    """Per run: severity and ordered lines for sources that are not clean. Bounded by the sources of a profile."""
    bad = classified.where(c("outcome.category") != "ok")
    label = F.coalesce("display_source", "source", F.lit("?"))
    line = F.format_string("> - **%s** — _%s_: %s", label, c("outcome.label"), c("outcome.message"))
    return bad.groupBy(*RUN).agg(
        F.when(F.bool_or(c("outcome.category") == "permanent"), "warning").otherwise("note").alias("severity"),
        F.count(F.lit(1)).alias("sources"),
        F.array_sort(F.collect_list(F.struct(label.alias("source"), line.alias("line")))).alias("_l"),
    ).select(*RUN, "severity", "sources", F.transform("_l", lambda x: x["line"]).alias("lines"))


def rejection_diagnostic(log: DataFrame, first: int = 10) -> DataFrame:
    """The first rejections per run; runs with a call-level failure show only that."""
    bad = log.where(~F.coalesce(c("pass"), F.lit(False)))
    per_run = bad.groupBy(*RUN).agg(F.bool_or(c("index") == -1).alias("hard_failure"))
    sample = top_rows(bad, RUN, [c("index")], first, "row_no")
    cell = lambda name, n: F.substring(F.regexp_replace(F.replace(name, F.lit("|"), F.lit("\\|")), "\n", " "), 1, n)
    return sample.join(per_run, RUN).where(~c("hard_failure") | (c("index") == -1)).select(
        *RUN, "row_no", "index", cell("reason", 200).alias("reason"), cell("title", 80).alias("title"), "hard_failure"
    )


def run_outcome() -> Column:
    """Struct (class, message, notes) from recall_count, survivor_count and the error flags of a run."""
    flag = lambda name: F.coalesce(c(name), F.lit(False))
    none = F.coalesce(c("recall_count"), F.lit(0)) == 0
    no_survivors = F.coalesce(c("survivor_count"), F.lit(0)) == 0
    klass = (
        F.when(none & flag("serper_error"), "index_unavailable")
        .when(none, "no_recall")
        .when(no_survivors & flag("filter_error"), "filter_unavailable")
        .when(no_survivors, "all_filtered")
        .otherwise("ok")
    )
    message = F
    for name, words in K.OUTCOME_MESSAGES.items():
        message = message.when(klass == name, words)
    note = lambda name: F.struct(F.lit(name).alias("class"), F.lit(K.NOTE_MESSAGES[name]).alias("message"))
    notes = F.array_compact(
        F.array(
            F.when(flag("ebay_error"), note("ebay_unavailable")),
            F.when(flag("amazon_error"), note("amazon_unavailable")),
            F.when(flag("degraded_attrs"), note("degraded_attr")),
        )
    )
    return F.struct(klass.alias("class"), message.alias("message"), notes.alias("notes"))


def pending_labels(profiles: DataFrame) -> DataFrame:
    """Sources not yet wired: host for URL-bearing universal entries, the id for others, nothing for notes without URL."""
    rows = profiles.select("slug", F.posexplode("sources_pending").alias("pos", "p")).select("slug", "pos", "p.*")
    url = F.nullif("url", F.lit(""))
    universal = c("id") == K.UNIVERSAL
    label = F.when(universal, F.coalesce(urls.canonical_host(urls.netloc(url)), url)).otherwise(c("id"))
    return rows.select("slug", "pos", label.alias("label"), "url", "note").where(c("label").isNotNull())
