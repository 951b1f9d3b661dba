"""Result pages (HTML) -> offer rows, one row per item wrapper."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from offerloom import constants as K
from offerloom.functions import text
from offerloom.schema import conform
from offerloom.sources import payloads

c = F.col
ITEM_DDL = "page_id bigint, slug string, run_ts timestamp, item_no int, title string, link string, price_text string, condition_text string"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class ItemScanner(HTMLParser):
    """Collects the four fields of every element with class `s-item__wrapper`."""

    FIELDS = {"s-item__link": "link", "s-item__price": "price", "SECONDARY_INFO": "condition"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.open: list[tuple[str, str | None]] = []
        self.item: dict | None = None
        self.item_depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found = dict(attrs)
        classes = (found.get("class") or "").split()
        field = None
        if "s-item__wrapper" in classes and self.item is None:
            self.item, self.item_depth = {}, len(self.open)
        if self.item is not None:
            if tag == "span" and "title" not in self.item and any(f == "heading" for _, f in self.open):
                field = "title"
            elif "s-item__title" in classes:
                field = "heading"
            else:
                field = next((f for k, f in self.FIELDS.items() if k in classes and f not in self.item), None)
            if field == "link":
                self.item["href"] = found.get("href") or ""
            if field in ("title", "price", "condition", "link"):
                self.item[field] = ""
        if tag not in VOID:
            self.open.append((tag, field))

    def handle_data(self, data: str) -> None:
        if self.item is not None:
            for _, field in self.open[self.item_depth:]:
                if field in ("title", "price", "condition"):
                    self.item[field] += data

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        del self.open[at:]
        if self.item is not None and len(self.open) <= self.item_depth:
            self.items.append(self.item)
            self.item = None

    def close(self) -> None:
        super().close()
        if self.item is not None:
            self.items.append(self.item)
            self.item = None


START, BOTH, END, SKIP = range(4)
NO_TAG = (SKIP, "", None, "", False, False)
TEXT_FIELDS = ("title", "price", "condition")
RAW = {"script", "style"}  # what they hold is no markup
RAW_SOMETIMES = {"title", "textarea", "iframe", "noembed", "noframes", "xmp", "plaintext"}  # newer parsers read no markup in them either
UNLIKE = RAW | RAW_SOMETIMES
SPACE = r"[ \t\n\r\f]"
ATTRIBUTE = rf"""{SPACE}+([^\s"'<>/=&]+)(?:=(?:"([^"&]*)"|'([^'&]*)'|([^\s"'<>/=&`]+)))?"""
ATTRIBUTES = re.compile(ATTRIBUTE)
PLAIN_START = re.compile(rf"(?P<tag>[a-zA-Z][a-zA-Z0-9:_-]*)(?P<attrs>(?:{ATTRIBUTE})*+){SPACE}*+(?P<slash>/?)")
PLAIN_END = re.compile(rf"/([a-zA-Z][a-zA-Z0-9:_-]*){SPACE}*")
COMMENT_END = re.compile(r"--(?:!|\s*)>")
KNOWN_TAGS: dict[str, tuple] = {}
MOST_KNOWN = 5_000


class TagReader(HTMLParser):
    """What the parser makes of a single tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.seen: list[tuple] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.seen.append((START, tag, attrs))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.seen.append((BOTH, tag, attrs))

    def handle_endtag(self, tag: str) -> None:
        self.seen.append((END, tag, []))

    def handle_data(self, data: str) -> None:
        self.seen.append((None, data, []))


def read_tag(body: str) -> tuple | None:
    """(kind, name, marks, href, whether it is void, whether what follows may be no markup) of `<body>`, where *body* holds neither `<` nor `>`; None: only the page can tell.

    marks: whether the classes name a wrapper, whether they name a heading, the fields they name; None where none does.
    """
    known = KNOWN_TAGS.get(body)
    if known is not None:
        return known
    if ' href="' in body and "'" not in body:  # links differ, tags around them do not: their tag is known without the link
        before, _, rest = body.partition(' href="')
        link, quote, after = rest.partition('"')
        if link and quote and "&" not in link and before.count('"') % 2 == 0 and "href" not in after.lower():
            shape = read_tag(f'{before} href=""{after}')
            return shape and (*shape[:3], link, *shape[4:])
    known = parse_tag(body)
    if known is not None and len(body) <= 200:
        if len(KNOWN_TAGS) >= MOST_KNOWN:
            KNOWN_TAGS.clear()
        KNOWN_TAGS[body] = known
    return known


def parse_tag(body: str) -> tuple | None:
    if body[:1] in "!?":
        return NO_TAG if body[:1] == "?" or body[:8].lower() == "!doctype" else None
    if end := PLAIN_END.fullmatch(body):
        return END, end[1].lower(), None, "", False, False
    plain = PLAIN_START.fullmatch(body)
    if plain and not (plain["slash"] and plain["attrs"] and body[-2] not in "\"' \t\n\r\f"):
        kind, tag = BOTH if plain["slash"] else START, plain["tag"].lower()
        attrs = {name.lower(): a or b or v for name, a, b, v in ATTRIBUTES.findall(plain["attrs"])}
    else:
        if not body[:1].isascii() or not body[:1].isalpha() or body.count('"') % 2 or body.count("'") % 2:
            return None
        reader = TagReader()
        reader.feed(f"<{body}>")
        if reader.rawdata or len(reader.seen) != 1 or reader.seen[0][0] not in (START, BOTH):
            return None
        kind, tag, found = reader.seen[0]
        attrs = dict(found)
    classes = (attrs.get("class") or "").split()
    marks = ("s-item__wrapper" in classes, "s-item__title" in classes, tuple(f for k, f in ItemScanner.FIELDS.items() if k in classes))
    return kind, tag, marks if any(marks) else None, attrs.get("href") or "", tag in VOID, tag in UNLIKE


def quick_items(html: str) -> list[dict] | None:
    """The items that an ItemScanner finds, tag by tag without the parser; None where the page needs it.

    The page is cut at `<`. Most tags of a page were seen before, so their classes are looked up. Markup on which
    parsers differ (comments and end tags of odd form, unclosed tags, `<` inside a tag, scripts inside an item) is left to the parser.
    """
    cuts = [part.partition(">") for part in html.split("<")]
    items: list[dict] = []
    tags: list[str] = [""]
    fields: list[str | None] = [None]
    item, depth, at, n = None, 0, 1, len(cuts)
    while at < n:
        body, closed, data = cuts[at]
        at += 1
        known = KNOWN_TAGS.get(body)
        if known is None:
            if body[:3] == "!--":
                part = body + closed + data
                if part[3:4] == ">" or part[3:5] == "->":
                    return None
                found = COMMENT_END.search(part, 3)
                while found is None and at < n:
                    part = "".join(cuts[at])
                    at += 1
                    found = COMMENT_END.search(part)
                if found is None or found[0] != "-->":
                    return None
                known, closed, data = NO_TAG, ">", part[found.end():]
            elif not (body[:1].isascii() and body[:1].isalpha()) and body[:1] not in ("/", "!", "?"):
                known, closed, data = NO_TAG, ">", f"<{body}{closed}{data}"
            elif (known := read_tag(body)) is None:
                return None
        if not closed:
            return None
        kind, tag, marks, href, void, unlike = known
        if kind <= BOTH:
            field = None
            if item is not None or marks is not None:
                if item is None and marks[0]:
                    item, depth = {}, len(tags)
                if item is not None:
                    if tag == "span" and "title" not in item and "heading" in fields:
                        field = "title"
                    elif marks is not None:
                        field = "heading" if marks[1] else next((f for f in marks[2] if f not in item), None)
                    if field == "link":
                        item["href"] = href
                    if field is not None and field != "heading":
                        item[field] = ""
            if not void:
                tags.append(tag)
                fields.append(field)
            if unlike:
                if tag not in RAW:
                    if at == n or cuts[at][0].lower() != "/" + tag:
                        return None
                elif item is not None or kind == BOTH:
                    return None
                else:
                    while at < n and not (cuts[at][0][:1] == "/" and cuts[at][0][1:].lstrip()[: len(tag)].lower() == tag):
                        at += 1
                    if at == n:
                        return items
                    if cuts[at][0].rstrip(" \t\n\r\f").lower() != "/" + tag:
                        return None
        if kind == END or kind == BOTH:
            if tags[-1] == tag:
                tags.pop()
                fields.pop()
            elif tag in tags:
                last = len(tags) - 1 - tags[::-1].index(tag)
                del tags[last:], fields[last:]
            else:
                tag = None  # an end tag of nothing ends no item
            if item is not None and tag and len(tags) <= depth:
                items.append(item)
                item = None
        if data and item is not None:
            for field in fields[depth:]:
                if field in TEXT_FIELDS:
                    item[field] += unescape(data)
    if item is not None:
        items.append(item)
    return items


def items_of(html: str) -> list[dict]:
    items = quick_items(html)
    if items is None:
        scanner = ItemScanner()
        scanner.feed(html)
        scanner.close()
        items = scanner.items
    return items


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys are taken over by row number; only the HTML and the four texts become Python values."""
    for batch in batches:
        rows, numbers, titles, links, prices, conditions = [], [], [], [], [], []
        for row, html in enumerate(batch.column("html").to_pylist()):
            for n, item in enumerate(items_of(html or "")):
                if "title" in item:
                    rows.append(row)
                    numbers.append(n)
                    titles.append(item["title"].strip())
                    links.append(item.get("href", ""))
                    prices.append(item.get("price", "0"))
                    conditions.append(item.get("condition", "Used").strip())
        picked = pa.array(rows, pa.int64())
        keys = [batch.column(name).take(picked) for name in ("page_id", "slug", "run_ts")]
        texts = [pa.array(v, pa.string()) for v in (titles, links, prices, conditions)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(numbers, pa.int32()), *texts], ["page_id", "slug", "run_ts", "item_no", "title", "link", "price_text", "condition_text"])


def page_items(pages: DataFrame) -> DataFrame:
    """Raw item fields per page. Only the keys and the HTML cross to Python; pages without an item never do."""
    found = pages.where(c("html").contains("s-item__wrapper"))
    return found.select(c("page_id").cast("bigint"), c("slug").cast("string"), c("run_ts").cast("timestamp"), "html").mapInArrow(scan, ITEM_DDL)


def page_offers(pages: DataFrame, source: str) -> DataFrame:
    """pages: page_id, html, slug, run_ts. Items whose price is no number are skipped."""
    price = text.price_from_page(c("price_text"))
    rows = page_items(pages).withColumn("unit_price_usd", price).where(c("unit_price_usd").isNotNull())
    attrs = F.map_filter(
        F.create_map(F.lit("capacity_gb"), text.capacity_gb(c("title")).cast("string"), F.lit("speed_mts"), text.speed_page(c("title")).cast("string")),
        lambda _, v: v.isNotNull(),
    )
    generic = F.lit(source == "memstore_ebay") & c("title").contains("Generic Brand")
    return conform(
        rows.select(
            "slug", "run_ts", payloads.place_in_document(c("page_id"), c("item_no")).alias("pos"), F.lit(source).alias("source"), c("link").alias("url"), "title",
            c("run_ts").alias("fetched_at"), attrs.alias("attrs"), text.condition_page(c("condition_text")).alias("condition"), "unit_price_usd",
            F.lit(K.PAGE_SELLERS[source]).alias("seller_name"), F.lit("US").alias("ship_from_country"),
            F.when(generic, F.array(F.lit("generic_brand"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        )
    )
