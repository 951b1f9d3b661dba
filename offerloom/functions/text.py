"""Column functions over titles, prices-as-text and names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from offerloom import constants as K


def nonblank(c: Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def hit(c: Column, pattern: str, group: int = 0) -> Column:
    """First regex match (or group) as null-able text: unlike regexp_extract, no match is null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def quoted(c: Column) -> Column:
    """Regex literal for the text in *c*."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def squeeze(c: Column) -> Column:
    """Lower-case with inner whitespace collapsed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


# --- prices ----------------------------------------------------------------------

def price_from_text(c: Column) -> Column:
    """'$1,234.00' or '67.2' -> double; null when there is no number."""
    return hit(F.replace(c.cast("string"), F.lit(","), F.lit("")), K.PRICE_RE).try_cast("double")


def price_from_digits(c: Column) -> Column:
    """Keep digits and dots, then read the leading number (the web mapper's rule)."""
    kept = F.regexp_replace(c.cast("string"), "[^0-9.]", "")
    return hit(kept, r"^(\d+\.?\d*|\.\d+)").try_cast("double")


def price_from_page(c: Column) -> Column:
    """Strip '$' and ',' and demand that the rest is one number."""
    return F.translate(F.trim(c), "$,", "").try_cast("double")


# --- conditions --------------------------------------------------------------------

def condition_marketplace(c: Column) -> Column:
    t = F.lower(c)
    return (
        F.when(t.contains("new"), "new")
        .when(t.rlike("refurb|certified|renew"), "refurbished")
        .otherwise("used")
    )


def condition_page(c: Column) -> Column:
    t = F.lower(c)
    return (
        F.when(t.contains("new") & ~t.contains("pre"), "new")
        .when(t.contains("refurb"), "refurbished")
        .otherwise("used")
    )


# --- specs in titles ------------------------------------------------------------------

def kit(title: Column, price: Column) -> Column:
    """Struct (is_kit, kit_module_count, unit_price_usd, kit_price_usd) read off a title."""
    count = F.coalesce(*[hit(title, K.KIT_RE, g) for g in (1, 3, 4, 5)]).try_cast("int")
    is_kit = F.coalesce(count > 1, F.lit(False))
    return F.struct(
        is_kit.alias("is_kit"),
        F.when(is_kit, count).otherwise(1).alias("kit_module_count"),
        F.when(is_kit, F.round(price / count, 2)).otherwise(price).alias("unit_price_usd"),
        F.when(is_kit, price).alias("kit_price_usd"),
    )


def capacity_gb(title: Column, low: int | None = None, high: int | None = None) -> Column:
    """First '<n> GB'; outside [low, high] the answer is null even if a later one would fit."""
    n = hit(title, K.CAPACITY_RE, 1).try_cast("int")
    return n if low is None else F.when(n.between(low, high), n)


def speed_marketplace(title: Column) -> Column:
    return F.coalesce(
        F.floor(hit(title, K.SPEED_PC5_RE, 1).try_cast("int") / 8).cast("int"),
        hit(title, K.SPEED_DDR5_RE, 1).try_cast("int"),
        hit(title, K.SPEED_BARE_UNIT_RE, 1).try_cast("int"),
    )


def speed_page(title: Column) -> Column:
    return hit(title, K.SPEED_BARE_UNIT_RE, 1).try_cast("int")


def speed_storefront(title: Column) -> Column:
    return hit(title, K.SPEED_BARE_RE, 1).try_cast("int")


def brand_from_title(brand: Column, title: Column, candidates: Column) -> Column:
    """Keep a known brand; else the first candidate that stands in the title as a whole word."""
    low = F.lower(title)

    def matches(c: Column) -> Column:
        token = F.lower(F.trim(c))
        return (token != "") & low.contains(token) & F.rlike(low, F.concat(F.lit("\\b"), quoted(token), F.lit("\\b")))

    return F.coalesce(F.nullif(brand, F.lit("")), F.get(F.filter(candidates, matches), F.lit(0)))


# --- aliases and names -------------------------------------------------------------------

LEFT_EDGE = r"(?<![\p{L}\p{N}])"
RIGHT_EDGE = r"(?![\p{L}\p{N}])"


def title_has_alias(title: Column, aliases: Column) -> Column:
    """True when an alias stands in the title as its own token.

    The plain substring test runs first, so the per-row pattern is compiled only for real hits.
    """
    hay = squeeze(title)

    def matches(a: Column) -> Column:
        needle = squeeze(a)
        bounded = F.concat(F.lit(LEFT_EDGE), quoted(needle), F.lit(RIGHT_EDGE))
        return (needle != "") & hay.contains(needle) & F.rlike(hay, bounded)

    return F.coalesce(F.exists(aliases, matches), F.lit(False))


def alias_is_distinctive(a: Column) -> Column:
    t = F.trim(a)
    return t.rlike("[0-9]") | (F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) >= 2)


def model_token(name: Column) -> Column:
    """The longest word with a letter and a digit, cut to its first digit-bearing segment; null under 5 chars."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w.rlike("[a-zA-Z]") & w.rlike("[0-9]"))
    longest = F.aggregate(words, F.lit(""), lambda acc, w: F.when(F.length(w) > F.length(acc), w).otherwise(acc))
    segment = F.coalesce(F.get(F.filter(F.split(longest, "[-/]"), lambda s: s.rlike("[0-9]")), F.lit(0)), longest)
    norm = F.regexp_replace(F.lower(segment), "[^a-z0-9]+", "")
    return F.when(F.length(norm) >= 5, norm)


def name_tokens(name: Column) -> Column:
    """Distinctive tokens of a product name: model-like words, else plain words minus stop words."""
    words = F.filter(F.split(F.lower(name), r"[\s,.()+]+"), lambda w: w != "")
    models = F.filter(
        F.transform(
            F.filter(words, lambda w: w.rlike("[a-z]") & w.rlike("[0-9]")),
            lambda w: F.regexp_replace(w, "[^a-z0-9]+", ""),
        ),
        lambda w: F.length(w) >= 4,
    )
    plain = F.filter(
        F.flatten(F.transform(words, lambda w: F.split(w, "[-/]"))),
        lambda w: (F.length(w) >= 3) & ~w.isin(K.NAME_STOP_WORDS),
    )
    return F.array_distinct(F.when(F.size(models) > 0, models).otherwise(plain))


def title_matches_name(title: Column, name: Column) -> Column:
    """Tri-state: null when no judgement is possible, else whether enough name tokens are in the title."""
    tokens = name_tokens(name)
    squashed = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "")
    found = F.size(F.filter(tokens, lambda t: squashed.contains(t)))
    return F.when(
        nonblank(title).isNotNull() & nonblank(name).isNotNull() & (F.size(tokens) > 0),
        found >= F.least(F.lit(2), F.size(tokens)),
    )


def title_tag(title: Column) -> Column:
    return F.when(title.rlike(K.FOR_PARTS_RE), "for_parts").when(title.rlike(K.REPLACEMENT_RE), "replacement")


def states_condition(line: Column) -> Column:
    return line.rlike(K.CONDITION_PHRASE_RE)


def covers_condition(phrase: Column) -> Column:
    return phrase.rlike(K.COVERING_EXCLUDE_RE)


# --- numbers in texts -----------------------------------------------------------------------

def plain_number(n: Column) -> Column:
    """'12.50' -> '12.5', '3.0' -> '3', '.00' -> '0'; whole numbers stay as written."""
    cut = F.regexp_replace(F.regexp_replace(n, "0+$", ""), r"\.$", "")
    return F.when(n.contains("."), F.when(cut == "", "0").otherwise(cut)).otherwise(n)


def numbers_in(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(K.NUMBER_RE), F.lit(0))
    return F.array_distinct(F.transform(found, plain_number))


# --- documents --------------------------------------------------------------------------------

def strip_markup(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[*_`]", ""))


def first_prose_line(text: Column) -> Column:
    """First line that is no heading, table row or list item, cut to 150 characters."""
    lines = F.filter(
        F.transform(F.split(text, "\n"), strip_markup), lambda s: (s != "") & ~s.rlike(r"^[#|\-]")
    )
    line = F.get(lines, F.lit(0))
    return F.when(line.isNull(), "No summary available.").otherwise(
        F.concat(F.substring(line, 1, 150), F.when(F.length(line) > 150, "...").otherwise(""))
    )


def table_rows(text: Column) -> Column:
    """Data lines of the first pipe table (header and separator dropped) as array<struct<pos, cells>>."""
    block = hit(
        F.concat(F.lit("\n"), text),
        r"\n[ \t]*\|[^\n]*\n[ \t]*\|?[ \t]*-{3,}[^\n]*((?:\n[ \t]*\|[^\n]*)*)", 1,
    )
    lines = F.filter(
        F.split(F.coalesce(block, F.lit("")), "\n"),
        lambda s: (F.trim(s) != "") & ~s.rlike(r"^\s*\|?[\s\-:|]+$"),
    )
    return F.transform(
        lines,
        lambda s, i: F.struct(
            i.alias("pos"),
            s.alias("line"),
            F.transform(
                F.split(F.regexp_replace(F.trim(s), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c)
            ).alias("cells"),
        ),
    )


def context_section(text: Column) -> Column:
    """Body under the 'Context' header, up to the next header."""
    body = F.regexp_extract(
        text,
        r"(?im)^[ \t]*(?:[\-*][ \t]*)?(?:\d+\.[ \t]*)?(?:#{1,6}[ \t]*)?\**[ \t]*context[ \t]*[.:*]*"
        r"([^\n]*(?:\n(?!#{1,6}\s|\*\*(?-i:[A-Z])|[\-*]\s+\*\*(?-i:[A-Z]))[^\n]*)*)",
        1,
    )
    return F.trim(body)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\b[\w'-]+\b"), F.lit(0)))


def last_fenced_block(text: Column, language: str = "yaml") -> Column:
    found = F.regexp_extract_all(text, F.lit(rf"(?s)```(?:{language})?[ \t]*\n(.*?)```"), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


def profile_scalar(doc: Column, key: str) -> Column:
    """One top-level scalar of a profile document, without parsing the whole document."""
    raw = hit(doc, rf"(?m)^{key}:[ \t]*(.+?)[ \t]*\r?$", 1)
    return nonblank(F.regexp_replace(raw, "^[\"']|[\"']$", ""))


def schedule_scalar(doc: Column, key: str) -> Column:
    """A scalar inside the `schedule:` block of a profile document."""
    block = hit(doc, r"(?m)^schedule:[ \t]*\r?\n((?:[ \t]+[^\r\n]*\r?\n?)+)", 1)
    raw = hit(block, rf"(?m)^[ \t]+{key}:[ \t]*(.+?)[ \t]*\r?$", 1)
    return nonblank(F.regexp_replace(raw, "^[\"']|[\"']$", ""))


def pretty_slug(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def slug_is_valid(slug: Column) -> Column:
    return slug.rlike(K.SLUG_RE)


def pretty_key(key: Column) -> Column:
    s = F.trim(F.regexp_replace(key, "[_-]+", " "))
    return F.when(s == "", key).otherwise(F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s))))


def escape_pipes(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))
