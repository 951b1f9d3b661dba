"""Queries on scalar functions, profile checks and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom import constants as K
from offerloom.functions import envelopes, money, profile_text, text, urls
from offerloom.operators import conversations, validation
from offerloom.queries.base import big, offers, profiles, query, table, with_offers

c = F.col


@query("page_host", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages")
def page_host(spark, sf):
    none = F.create_map().cast("map<string,string>")
    return table(spark, sf, "pages").select("page_id", urls.offer_host(c("url"), none).alias("host"))


@query("price_texts", """
SELECT o_orderkey, o_totalprice AS grouped, o_totalprice AS digits, o_totalprice AS page, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS maybe FROM orders""")
def price_texts(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.format_string("$%,.2f", "o_totalprice").alias("t"))
    maybe = F.when(c("o_orderkey") % 3 == 0, "call us").otherwise(F.concat(F.lit("now "), c("t"), F.lit(" only")))
    return o.select("o_orderkey", text.price_from_text(c("t")).alias("grouped"), text.price_from_digits(c("t")).alias("digits"), text.price_from_page(c("t")).alias("page"), text.price_from_text(maybe).alias("maybe"))


def named_parts(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand")
    model = F.concat(F.lit("WX-"), c("p_partkey").cast("string"), F.lit("ab/Q"), c("p_size").cast("string"))
    name = F.when(c("p_partkey") % 2 == 0, F.concat_ws(" ", F.lit("The"), "p_name", model)).otherwise(F.concat_ws(" ", F.lit("New"), "p_name", F.lower("p_type"), F.lit("kit")))
    return p.withColumn("name", name)


@query("name_tokens", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND length(CAST(p_partkey AS VARCHAR)) >= 3 THEN p_partkey || 'ab' END AS model,
  CASE WHEN p_partkey % 2 = 0 THEN 'wx' || p_partkey || 'abq' || p_size ELSE regexp_replace(replace(p_name, ' ', ','), '^new,', '') || CASE WHEN starts_with(p_name, lower(p_type) || ' ') THEN '' ELSE ',' || lower(p_type) END END AS tokens,
  CASE WHEN p_partkey % 2 = 0 THEN false ELSE true END AS matches FROM part""")
def name_tokens(spark, sf):
    p = named_parts(spark, sf)
    title = F.concat_ws(" ", F.lit("used"), "p_name", "p_type")
    model = F.when(c("p_partkey") % 2 == 0, text.model_token(F.concat(F.lit("Thing "), c("p_partkey").cast("string"), F.lit("ab-Q rev"))))
    tokens = text.name_tokens(c("name"))
    return p.select("p_partkey", model.alias("model"), F.array_join(tokens, ",").alias("tokens"), text.title_matches_name(title, c("name")).alias("matches"))


@query("sku_tokens", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'B0' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') WHEN 1 THEN CAST(1000000 + p_partkey AS VARCHAR) ELSE '' END AS tokens,
  CASE WHEN p_partkey % 3 = 0 THEN 'https://shopping.google.com/product/' || p_partkey ELSE 'link' END AS stable FROM part""")
def sku_tokens(spark, sf):
    p = table(spark, sf, "part")
    k, n = c("p_partkey") % 3, c("p_partkey").cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://www.amazon.com/x/dp/b0"), F.lpad(n, 8, "0"), F.lit("?a=1"))).when(
        k == 1, F.concat(F.lit("https://bh.com/c/"), (c("p_partkey") + 1_000_000).cast("string"), F.lit("-reg/z.html"))).otherwise("https://bh.com/c/12-REG")
    return p.select("p_partkey", F.array_join(urls.sku_tokens(url), ",").alias("tokens"), urls.stable_product_url(F.when(k == 0, n).otherwise(" "), F.lit("link")).alias("stable"))


@query("search_urls", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'https://www.amazon.com/s?k=' || replace(p_name, ' ', '+') || '+a%2Bb%2A~' WHEN 1 THEN 'https://www.biblio.com/search.php?title=' || replace(p_name, ' ', '+') || '+a%2Bb%2A~&author=&stage=1' END AS url FROM part""")
def search_urls(spark, sf):
    host = F.when(c("p_partkey") % 3 == 0, " WWW.Amazon.com").when(c("p_partkey") % 3 == 1, "biblio.com").otherwise("unknown.com")
    return table(spark, sf, "part").select("p_partkey", urls.search_url(host, F.concat(c("p_name"), F.lit(" a+b*~ "))).alias("url"))


@query("merchant_hosts", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'walmart.com' WHEN 1 THEN replace(lower(p_name), ' ', '') || 'co.com' WHEN 2 THEN 'shop' || p_partkey || '.net' ELSE 'www.v.com' END AS host FROM part""")
def merchant_hosts(spark, sf):
    k = c("p_partkey") % 4
    seller = F.when(k == 0, "Walmart - Acme").when(k == 1, F.concat(c("p_name"), F.lit("-Co"))).when(k == 2, F.concat(F.lit("Shop"), c("p_partkey").cast("string"), F.lit(".net")))
    source = F.when(k == 3, "ebay_search").otherwise(K.SHOPPING)
    return table(spark, sf, "part").select("p_partkey", urls.merchant_host(source, F.coalesce(seller, F.lit("")), F.lit("https://WWW.v.com/x")).alias("host"))


@query("alias_distinct", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS distinctive FROM part")
def alias_distinct(spark, sf):
    alias = F.when(c("p_partkey") % 3 == 0, F.concat(F.lit("x"), c("p_partkey").cast("string"))).when(c("p_partkey") % 3 == 1, c("p_name")).otherwise(F.concat(F.lit(" "), c("p_type")))
    return table(spark, sf, "part").select("p_partkey", text.alias_is_distinctive(alias).alias("distinctive"))


@query("title_tags", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'for_parts' WHEN p_partkey % 3 = 1 THEN 'replacement' END AS tag, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS states_condition FROM part""")
def title_tags(spark, sf):
    k = c("p_partkey") % 3
    title = F.concat(c("p_name"), F.when(k == 0, " FOR PARTS only").when(k == 1, " Replacement for X").otherwise(" forparts"))
    line = F.when(c("p_partkey") % 4 == 0, F.concat(c("p_name"), F.lit(": new only please"))).when(c("p_partkey") % 4 == 1, "no open box").when(c("p_partkey") % 4 == 2, "renewal fine").otherwise(c("p_name"))
    return table(spark, sf, "part").select("p_partkey", text.title_tag(title).alias("tag"), text.states_condition(line).alias("states_condition"))


@query("money_formats", """
SELECT o_orderkey, '$' || printf('%.2f', o_totalprice) AS money, CASE WHEN o_orderkey % 5 = 0 THEN '(unpriced)' WHEN o_orderkey % 5 = 1 THEN '<$0.0001' ELSE '$0.2500' END AS cost,
  CASE WHEN o_orderkey % 200 < 60 THEN (o_orderkey % 200) || 's' ELSE ((o_orderkey % 200) // 60) || 'm ' || lpad(CAST((o_orderkey % 200) % 60 AS VARCHAR), 2, '0') || 's' END AS duration,
  '$' || printf('%.2f', o_totalprice) || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' (fx)' ELSE ' (EUR)' END AS fx FROM orders""")
def money_formats(spark, sf):
    cost = F.when(c("o_orderkey") % 5 == 1, 0.00005).when(c("o_orderkey") % 5 != 0, 0.25)
    fx = F.when(c("o_orderkey") % 3 == 1, "True").when(c("o_orderkey") % 3 == 2, "EUR")
    return table(spark, sf, "orders").select(
        "o_orderkey", money.money_text(c("o_totalprice")).alias("money"), money.cost_text(cost).alias("cost"), money.duration_text(c("o_orderkey") % 200).alias("duration"),
        money.money_text_fx(c("o_totalprice"), fx).alias("fx"),
    )


@query("slug_helpers", """
SELECT p_partkey, upper(p_name[1]) || p_name[2:strpos(p_name, ' ')] || upper(p_name[strpos(p_name, ' ') + 1]) || p_name[strpos(p_name, ' ') + 2:] AS pretty, p_partkey % 3 <> 0 AS valid, 'Seller ' || p_name AS key FROM part""")
def slug_helpers(spark, sf):
    slug = F.replace("p_name", F.lit(" "), F.lit("-"))
    odd = F.when(c("p_partkey") % 3 == 0, F.concat(F.lit("-"), slug)).otherwise(slug)
    key = F.concat(F.lit("seller_"), F.replace("p_name", F.lit(" "), F.lit("-")))
    return table(spark, sf, "part").select("p_partkey", text.pretty_slug(slug).alias("pretty"), text.slug_is_valid(odd).alias("valid"), text.pretty_key(key).alias("key"))


@query("first_prose_line", """
SELECT doc_id, CASE WHEN line IS NULL THEN 'No summary available.' ELSE substr(line, 1, 150) || CASE WHEN length(line) > 150 THEN '...' ELSE '' END END AS summary
FROM (SELECT doc_id, list_filter(list_transform(string_split('# T' || chr(10) || '- x' || chr(10) || text, chr(10)), lambda s: trim(regexp_replace(s, '[*_`]', '', 'g'))), lambda s: s <> '' AND NOT regexp_matches(s, '^[#|\\-]'))[1] AS line FROM documents)""")
def first_prose_line(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.first_prose_line(F.concat(F.lit("# T\n- x\n"), c("text"))).alias("summary"))


@query("fenced_blocks", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'b: ' || n_chars || chr(10) WHEN doc_id % 3 = 1 THEN 'a: 1' || chr(10) END AS block FROM documents")
def fenced_blocks(spark, sf):
    first, second = F.lit("text\n```yaml\na: 1\n```\nmore\n"), F.concat(F.lit("```yaml\nb: "), c("n_chars").cast("string"), F.lit("\n```\n"))
    doc = F.when(c("doc_id") % 3 == 0, F.concat(first, second)).when(c("doc_id") % 3 == 1, first).otherwise("none")
    return table(spark, sf, "documents").select("doc_id", text.last_fenced_block(doc).alias("block"))


@query("document_numbers", """
SELECT doc_id, count(DISTINCT number) AS numbers FROM (SELECT doc_id, CASE WHEN NOT contains(n, '.') THEN n WHEN regexp_replace(regexp_replace(n, '0+$', ''), '\\.$', '') = '' THEN '0'
  ELSE regexp_replace(regexp_replace(n, '0+$', ''), '\\.$', '') END AS number FROM (SELECT doc_id, unnest(regexp_extract_all(text || ' 1.50 1.5 .00 7', '\\d+(?:\\.\\d+)?|\\.\\d+')) AS n FROM documents)) GROUP BY doc_id""")
def document_numbers(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", big(F.size(text.numbers_in(F.concat(c("text"), F.lit(" 1.50 1.5 .00 7"))))).alias("numbers"))


@query("report_table_rows", "SELECT o_orderkey, o_orderkey % 4 + 1 AS rows, o_orderstatus AS last_cell FROM orders")
def report_table_rows(spark, sf):
    line = F.concat(F.lit("| r | "), c("o_orderstatus"), F.lit(" |\n"))
    doc = F.concat(F.lit("intro | x\n\n| A | B |\n| --- | --- |\n"), F.repeat(line, (c("o_orderkey") % 4 + 1).cast("int")), F.lit("\nafter\n| z |"))
    rows = text.table_rows(doc)
    return table(spark, sf, "orders").select("o_orderkey", big(F.size(rows)).alias("rows"), F.get(F.try_element_at(rows, F.lit(-1))["cells"], F.lit(1)).alias("last_cell"))


@query("context_sections", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 0 ELSE o_orderkey % 5 + 1 END AS words FROM orders")
def context_sections(spark, sf):
    body = F.repeat(F.lit("word "), (c("o_orderkey") % 5 + 1).cast("int"))
    k = c("o_orderkey") % 3
    doc = F.when(k == 0, F.concat(F.lit("# R\n## Context\n"), body, F.lit("\n## Flags\nx y"))).when(k == 1, F.concat(F.lit("a b\n5. **Context.** "), body, F.lit("\n**Next** q"))).otherwise("no such part")
    return table(spark, sf, "orders").select("o_orderkey", big(text.word_count(text.context_section(doc))).alias("words"))


# --- conversations ---------------------------------------------------------------------------


def ledger_turns(spark, sf):
    """Conversation turns; every second assistant turn carries a state block."""
    t = table(spark, sf, "conversations")
    state = F.concat(F.lit("\n<STATE> {\"n\": "), c("turn").cast("string"), F.lit("} </state>"))
    has = (c("role") == "assistant") & (c("turn") % 4 == 1)
    return t.withColumn("text", F.when(has, F.concat(c("text"), state)).otherwise(c("text")))


@query("conversation_trim", """
WITH t AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN text || chr(10) || '<STATE> {"n": ' || turn || '} </state>' ELSE text END AS text,
    CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN '{"n": ' || turn || '}' END AS state, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS d,
    count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, role, text, CASE WHEN n > 5 AND a > 1 THEN 2 ELSE 0 END AS part FROM t WHERE n <= 5 OR a = 1 OR d <= 4
UNION ALL SELECT conv_id, min(turn) FILTER (a = 1), 'assistant', '[Earlier turns elided. Decisions confirmed so far:]' || chr(10) || '<state>' || coalesce(arg_max(state, turn) FILTER (a > 1 AND d > 4 AND state IS NOT NULL), arg_max(state, turn) FILTER (d <= 4 AND state IS NOT NULL)) || '</state>', 1
FROM t WHERE n > 5 GROUP BY conv_id HAVING bool_or(a > 1 AND state IS NOT NULL)""")
def conversation_trim(spark, sf):
    return conversations.trim(ledger_turns(spark, sf))


@query("state_blocks", """
SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN turn END AS n, length(regexp_replace(text, '\\s+$', '')) AS visible FROM conversations""")
def state_blocks(spark, sf):
    t = ledger_turns(spark, sf).withColumn("text", F.concat(c("text"), F.when(c("turn") % 3 == 0, "\n<draft>{\"open\": ").otherwise("")))
    n = F.try_variant_get(envelopes.block_object(c("text"), "state"), "$.n", "bigint")
    return t.select("conv_id", "turn", n.alias("n"), big(F.length(envelopes.without_blocks(c("text")))).alias("visible"))


# --- profiles ------------------------------------------------------------------------------------


@query("profile_summary", """
WITH t AS (SELECT p_type AS t, min(p_brand) AS b FROM part GROUP BY p_type)
SELECT t AS slug, '1 count' AS target, lower(t) || '|' || b AS queries, concat_ws('|', CASE WHEN t = 'ECONOMY' THEN 'New or refurbished' END, CASE WHEN t = 'LARGE' THEN 'In stock only' END, CASE WHEN t = 'MEDIUM' THEN 'At least 2 available' END) AS filters,
  'Google Shopping (Serper):' || (t <> 'MEDIUM') || ':' || CASE WHEN t <> 'MEDIUM' THEN 'NATION_7 · 100 results' ELSE '' END || '|eBay:' || (t IN ('LARGE', 'MEDIUM')) || ':|Amazon:' || (t = 'PROMO') || ':' || CASE WHEN t = 'PROMO' THEN 'standard queue' ELSE '' END AS sources,
  'Low seller feedback' AS flags FROM t""")
def profile_summary(spark, sf):
    s = profile_text.profile_summary(profiles(spark, sf))
    source = lambda x: F.concat(x["label"], F.lit(":"), x["enabled"].cast("string"), F.lit(":"), F.coalesce(x["detail"], F.lit("")))
    return s.select("slug", "target", F.array_join("queries", "|").alias("queries"), F.array_join("filters", "|").alias("filters"), F.array_join(F.transform("sources", source), "|").alias("sources"), F.array_join("flags", "|").alias("flags"))


def drafts(spark, sf):
    """One profile draft per part, with faults by part number."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand")
    k = lambda m, r: c("p_partkey") % m == r
    n = c("p_partkey").cast("string")
    texts = lambda *v: F.array(*[F.lit(x) if isinstance(x, str) else x for x in v]).cast("array<string>")
    slug = F.concat(F.lit("p-"), n, F.when(k(10, 1), "_x").otherwise(""))
    return p.select(
        "p_partkey", slug.alias("slug"), F.when(k(9, 0), 1).otherwise(2).alias("schema_version"), F.when(k(10, 2), " ").otherwise(F.concat(c("p_name"), F.when(k(2, 0), F.concat(F.lit(" ZX"), n, F.lit("99"))).otherwise(""))).alias("display_name"),
        F.when(k(3, 0), c("p_type")).alias("product_type"), F.when(k(10, 3), texts()).when(k(10, 4), texts("a", " ")).otherwise(texts("a")).alias("queries"),
        F.struct(F.lit("count").alias("unit"), F.when(k(10, 5), 0).otherwise(1).alias("amount"),
                 F.array(F.struct(F.when(k(10, 6), -1).otherwise(1).alias("module_count"), F.lit(8).alias("module_capacity_gb"))).alias("configurations")).alias("target"),
        F.struct(F.when(k(10, 7), 0).alias("min_quantity")).alias("filters"),
        F.struct(F.struct((~k(10, 8)).alias("enabled"), F.when(k(10, 9), 0).otherwise(100).alias("num")).alias("serper"), F.struct(F.lit(False).alias("enabled")).alias("ebay"),
                 F.struct(F.lit(False).alias("enabled"), F.when(k(11, 0), -1).otherwise(48).alias("depth"), F.when(k(11, 1), "rush").otherwise("live").alias("priority")).alias("amazon")).alias("sources"),
        F.struct(F.when(k(11, 2), 0).otherwise(20).alias("max_listings"), F.when(k(11, 3), 0).otherwise(3).alias("per_vendor_cap")).alias("display"),
        F.when(k(4, 0), texts()).when(k(4, 1), texts("x1", "generic", " ")).when(k(4, 2), texts(F.concat(F.lit("sku 100"), n))).otherwise(texts("two words")).alias("aliases"),
        F.when(k(5, 0), texts(F.concat(F.lit(" "), F.upper(F.substring("p_name", 1, 4))), "zzz")).otherwise(texts("a")).alias("title_excludes"),
        F.when(k(6, 0), texts("rank", "rank")).when(k(6, 1), texts()).when(k(6, 2), texts("rank", "speed")).otherwise(texts("rank", "price")).alias("report_columns"),
        F.when(k(7, 0), F.concat(F.lit("qvl/"), slug, F.lit(".yaml"))).when(k(7, 1), "qvl/other.yaml").alias("qvl_file"), F.when(k(7, 2), texts("Acme", " ")).otherwise(texts("Acme")).alias("brand_candidates"),
        F.when(k(8, 0), "0 6 * *").when(k(8, 1), "0 6 * * MON").when(k(8, 2), "").when(k(8, 3), None).otherwise("*/15 0-6 1,2 * 7").alias("cron"), F.when(k(8, 4), F.lit("2024-01-01").cast("timestamp")).alias("run_at"),
    )


DRAFT_SQL = """
d AS (SELECT p_partkey AS k, p_name, 'p-' || p_partkey || CASE WHEN p_partkey % 10 = 1 THEN '_x' ELSE '' END AS slug FROM part)"""


@query("draft_violations", "WITH " + DRAFT_SQL.strip() + """
SELECT slug, v AS "check" FROM (
  SELECT slug, unnest(list_filter([CASE WHEN k % 9 = 0 THEN 'schema_version' END, CASE WHEN k % 10 = 1 THEN 'slug_shape' END, CASE WHEN k % 10 = 2 THEN 'display_name' END, CASE WHEN k % 10 = 3 THEN 'queries' END,
    CASE WHEN k % 10 = 4 THEN 'queries_blank' END, CASE WHEN k % 10 = 8 THEN 'sources' END, CASE WHEN k % 3 <> 0 THEN 'product_type' END], lambda x: x IS NOT NULL)) AS v FROM d)""")
def draft_violations(spark, sf):
    return validation.drafts(drafts(spark, sf)).select("slug", "check")


@query("bound_violations", "WITH " + DRAFT_SQL.strip() + """
SELECT slug, v AS "check" FROM (
  SELECT slug, unnest(list_filter([CASE WHEN k % 10 = 5 THEN 'target_amount' END, CASE WHEN k % 10 = 6 THEN 'configuration' END, CASE WHEN k % 10 = 7 THEN 'min_quantity' END, CASE WHEN k % 10 = 9 THEN 'serper_num' END,
    CASE WHEN k % 11 = 0 THEN 'amazon_depth' END, CASE WHEN k % 11 = 1 THEN 'amazon_priority' END, CASE WHEN k % 11 = 2 THEN 'max_listings' END, CASE WHEN k % 11 = 3 THEN 'per_vendor_cap' END], lambda x: x IS NOT NULL)) AS v FROM d)""")
def bound_violations(spark, sf):
    return validation.bounds(drafts(spark, sf)).select("slug", "check")


@query("schedule_violations", "WITH " + DRAFT_SQL.strip() + """
SELECT slug, 'schedule_cron' AS "check", CASE k % 8 WHEN 0 THEN 'cron must have 5 space-separated fields, got 4' WHEN 1 THEN 'cron field contains invalid characters' ELSE 'cron expression is empty' END AS message FROM d WHERE k % 8 < 3
UNION ALL SELECT slug, 'schedule_mode', 'schedule must set exactly one of cron or run_at' FROM d WHERE k % 8 IN (3, 4)""")
def schedule_violations(spark, sf):
    return validation.schedules(drafts(spark, sf)).select("slug", "check", "message")


@query("alias_violations", "WITH " + DRAFT_SQL.strip() + """
SELECT slug, 'alias_blank' AS "check", 'error' AS severity FROM d WHERE k % 4 = 1 UNION ALL SELECT slug, 'alias_generic', 'error' FROM d WHERE k % 4 = 1
UNION ALL SELECT slug, 'aliases_from_name', 'warning' FROM d WHERE k % 4 = 0 AND k % 10 <> 2 UNION ALL SELECT slug, 'aliases_missing', 'error' FROM d WHERE k % 4 = 0 AND k % 10 = 2""")
def alias_violations(spark, sf):
    d = drafts(spark, sf)
    return validation.aliases(d).unionByName(validation.missing_aliases(d)).select("slug", "check", "severity")


@query("column_list_violations", "WITH " + DRAFT_SQL.strip() + """
SELECT slug, CASE k % 6 WHEN 0 THEN 'columns_duplicate' WHEN 1 THEN 'columns_empty' ELSE 'columns_unknown' END AS "check", CASE k % 6 WHEN 0 THEN 'report_columns has duplicates' WHEN 1 THEN 'report_columns is empty' ELSE 'unknown columns: speed' END AS message FROM d WHERE k % 6 < 3""")
def column_list_violations(spark, sf):
    return validation.column_lists(drafts(spark, sf)).select("slug", "check", "message")


@query("v1_extra_violations", "WITH " + DRAFT_SQL.strip() + """
SELECT slug, 'qvl_file' AS "check" FROM d WHERE k % 7 = 1 UNION ALL SELECT slug, 'brand_blank' FROM d WHERE k % 7 = 2""")
def v1_extra_violations(spark, sf):
    return validation.v1_extras(drafts(spark, sf)).select("slug", "check")


@query("exclude_name_violations", "WITH " + DRAFT_SQL.strip() + """
SELECT slug, 'title_excludes is part of the product name: "' || trim(upper(substr(p_name, 1, 4))) || '"' AS message FROM d WHERE k % 5 = 0 AND k % 10 <> 2""")
def exclude_name_violations(spark, sf):
    return validation.excludes_own_name(drafts(spark, sf)).select("slug", "message")


def draft_sources(spark, sf):
    """Two source entries per part: a search URL and, for some, a detail URL; a part number appears in it."""
    p = table(spark, sf, "part").select("p_partkey")
    n = c("p_partkey").cast("string")
    host = F.when(c("p_partkey") % 3 == 0, "www.target.com").when(c("p_partkey") % 3 == 1, "bhphotovideo.com").otherwise("other.com")
    slug = F.concat(F.lit("p-"), n, F.when(c("p_partkey") % 10 == 1, "_x").otherwise(""))
    entry = lambda on, path, kind: F.when(on, F.struct(F.lit(K.UNIVERSAL).alias("id"), F.concat(F.lit("https://"), host, F.lit(path), F.lpad(n, 6, "100000"), F.lit("-REG")).alias("url"), F.lit(kind).alias("page_type")))
    rows = F.array_compact(F.array(entry(c("p_partkey") % 2 == 0, "/s/", "search"), entry(c("p_partkey") % 5 != 0, "/c/", "detail")))
    return p.select(slug.alias("slug"), F.explode(rows).alias("r")).select("slug", "r.*")


@query("alias_from_url_violations", """
SELECT 'p-' || p_partkey || CASE WHEN p_partkey % 10 = 1 THEN '_x' ELSE '' END AS slug, 'alias contains a code from a source URL: ' || lpad(CAST(p_partkey AS VARCHAR), 6, '100000') AS message
FROM part WHERE p_partkey % 4 = 2 AND contains('SKU100' || p_partkey, lpad(CAST(p_partkey AS VARCHAR), 6, '100000'))""")
def alias_from_url_violations(spark, sf):
    return validation.alias_from_url(drafts(spark, sf), draft_sources(spark, sf)).select("slug", "message")


HOSTS = ["target.com", "bhphotovideo.com"]


@query("host_coverage", """
SELECT 'p-' || p_partkey || CASE WHEN p_partkey % 10 = 1 THEN '_x' ELSE '' END AS slug, CASE p_partkey % 3 WHEN 0 THEN 'target.com' ELSE 'bhphotovideo.com' END AS host, p_partkey % 2 = 0 AS has_search, p_partkey % 5 <> 0 AS has_detail
FROM part WHERE p_partkey % 3 <> 2 AND (p_partkey % 2 = 0 OR p_partkey % 5 <> 0)""")
def host_coverage(spark, sf):
    return validation.host_coverage(draft_sources(spark, sf), HOSTS)


@query("detail_backup_violations", """
SELECT 'p-' || p_partkey || CASE WHEN p_partkey % 10 = 1 THEN '_x' ELSE '' END AS slug, CASE p_partkey % 3 WHEN 0 THEN 'target.com' ELSE 'bhphotovideo.com' END || ': no ' || CASE WHEN p_partkey % 2 = 0 THEN 'detail' ELSE 'search' END || ' URL' AS message
FROM part WHERE p_partkey % 3 <> 2 AND (p_partkey % 2 = 0) <> (p_partkey % 5 <> 0)""")
def detail_backup_violations(spark, sf):
    return validation.detail_backup(draft_sources(spark, sf), HOSTS).select("slug", "message")


@query("pending_violations", """
SELECT p_partkey AS k, 'pending entry without URL: ' || CASE p_partkey % 4 WHEN 0 THEN 'bhphotovideo.com' WHEN 1 THEN 'target.com' ELSE 'unknown vendor' END AS message FROM part
WHERE p_partkey % 4 <> 3 AND NOT (p_partkey % 4 = 0 AND p_partkey % 3 = 1 AND (p_partkey % 2 = 0 OR p_partkey % 5 <> 0)) AND NOT (p_partkey % 4 = 1 AND p_partkey % 3 = 0 AND (p_partkey % 2 = 0 OR p_partkey % 5 <> 0))""")
def pending_violations(spark, sf):
    p = table(spark, sf, "part").select("p_partkey")
    k = c("p_partkey") % 4
    slug = F.concat(F.lit("p-"), c("p_partkey").cast("string"), F.when(c("p_partkey") % 10 == 1, "_x").otherwise(""))
    pending = p.select(slug.alias("slug"), F.lit(K.UNIVERSAL).alias("id"), F.when(k == 3, "https://x.com").otherwise("").alias("url"), F.when(k == 0, "B&H timed out").when(k == 1, "Target page").otherwise("someone").alias("note"))
    v = validation.pending_without_url(pending, draft_sources(spark, sf), HOSTS)
    return v.select(text.hit(c("slug"), r"\d+").cast("bigint").alias("k"), "message")


@query("detail_preference", """
SELECT CASE WHEN p_partkey % 3 <> 2 OR p_partkey % 2 <> 0 THEN 'yes' ELSE 'some' END AS kind, count(*) > 0 AS any_rows FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1""")
def detail_preference(spark, sf):
    s = draft_sources(spark, sf)
    per = s.groupBy("slug").agg(F.bool_or(c("page_type") == "detail").alias("d"), F.bool_and(validation.prefers_detail(c("url"), c("page_type"), HOSTS)).alias("all"))
    return per.where("d").groupBy(F.when(c("all"), "yes").otherwise("some").alias("kind")).agg((F.count(F.lit(1)) > 0).alias("any_rows"))


@query("condition_drift_violations", """
SELECT 'p-' || p_partkey AS slug, 'no condition filter for: ' || least('no used', p_name || ' new only') || '; ' || greatest('no used', p_name || ' new only') AS message FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0""")
def condition_drift_violations(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    slug = F.concat(F.lit("p-"), c("p_partkey").cast("string")).alias("slug")
    lines = F.when(c("p_partkey") % 2 == 0, F.array(F.concat(c("p_name"), F.lit(" new only")), F.lit("no used "), F.lit("blue"))).otherwise(F.array(F.lit("any condition")))
    stated = p.select(slug, F.explode(lines).alias("line"))
    rules = p.select(
        slug, F.when(c("p_partkey") % 3 == 0, "condition_in").when(c("p_partkey") % 5 == 0, "title_excludes").otherwise("in_stock").alias("rule"),
        F.when(c("p_partkey") % 3 == 0, F.array(F.lit("new"))).otherwise(F.array(F.lit("open-box"))).alias("values"),
    )
    return validation.condition_drift(stated, rules).select("slug", "message")


@query("alert_rule_violations", """
SELECT 'c-' || c_custkey AS slug, CASE c_custkey % 8 WHEN 0 THEN 'threshold must be a positive number' WHEN 1 THEN 'condition must be one of new, used, refurbished' WHEN 2 THEN 'mode must be one of drops_below, is_below, while_below'
  WHEN 3 THEN 'price_basis must be one of unit, total' WHEN 4 THEN 'host is required' WHEN 5 THEN 'host must look like a domain (e.g. amazon.com)' ELSE 'unknown alert kind' END AS message FROM customer WHERE c_custkey % 8 < 7""")
def alert_rule_violations(spark, sf):
    k = c("c_custkey") % 8
    rules = table(spark, sf, "customer").select(
        F.concat(F.lit("c-"), c("c_custkey").cast("string")).alias("slug"), F.when(k < 4, "price_below").when(k < 6, "vendor_seen").when(k == 6, "other").otherwise("new_vendor_carries").alias("kind"),
        F.when(k == 0, 0.0).otherwise(F.abs("c_acctbal") + 1).alias("threshold_usd"), F.when(k == 1, "mint").alias("condition"), F.when(k == 2, "later").alias("mode"), F.when(k == 3, "gross").alias("price_basis"),
        F.when(k == 4, " ").when(k == 5, "no host").alias("host"),
    )
    return validation.alert_rules(rules).select("slug", "message")


@query("unknown_rule_ids", "SELECT p_type AS id, count(*) AS profiles FROM part WHERE p_type NOT IN ('in_stock') GROUP BY p_type")
def unknown_rule_ids(spark, sf):
    p = table(spark, sf, "part").select(c("p_partkey").cast("string").alias("slug"), F.explode(F.array(c("p_type"), F.lit("in_stock"))).alias("id"))
    v = validation.unknown_ids(p, "rule", K.KNOWN_FILTER_RULES)
    return v.groupBy(F.regexp_replace("message", "^unknown rule ", "").alias("id")).agg(F.count(F.lit(1)).alias("profiles"))


@query("registry_parity", """
SELECT p_brand AS id, CASE WHEN c % 2 = 0 THEN 'left' ELSE 'right' END AS only_in FROM (SELECT p_brand, count(*) AS c FROM part GROUP BY p_brand)""")
def registry_parity(spark, sf):
    """Two registries of brands that share what has an even and an odd form only by accident: brands split by their count."""
    counts = table(spark, sf, "part").groupBy(c("p_brand").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return validation.parity(counts.where(c("n") % 2 == 0).select("id"), counts.where(c("n") % 2 == 1).select("id"))
