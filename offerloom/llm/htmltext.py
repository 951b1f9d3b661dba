"""Main text of web pages with a site style tree.

The element trees of a host's pages are merged by path. For every branch of the merged tree, the entropy of
its presentation (sequence of child elements) and of its content over the pages tells how much it varies:
menus and notices that look and read the same everywhere have low importance and are cut from each page.
Importance is measured against that of the whole page or, inside an article or main element, of that element,
so that a site of copies is not cut away.

Elements that are no article text by their meaning (navigation, adverts, forms, reader comments ...) have
importance 0 whatever they hold. Inside an article or main element only containers with a name (class or id) are
branches that can be cut: a paragraph, heading or list item that several articles of a site share is article
text. An article element is a prior, no proof: it is the text of its page if the important text outside it is at
most OUTWEIGHS times as long, otherwise (a card or an embedded post beside the body) it is a branch like others;
likewise for main.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from offerloom.llm.common import query, small, table, written

THRESHOLD = 0.3  # importance below which a branch is cut
CONTENT_WEIGHT = 0.7  # of content against presentation
LEAST_PAGES = 4  # pages of a host that must have a branch before its entropy counts
OUTWEIGHS = 4  # important text outside an article or main element, in lengths of its own text, beyond which it is not the page's text
BROADCAST_PATHS = 200_000  # unimportant branches of all hosts together up to which their lists are broadcast (8 bytes each)
SALTS = 32  # parts that the pages of one host are dealt to beyond that

# HTML element kinds, and name parts of what is no article text.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "xmp", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "html", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
    "tr", "ul", "caption",
}
NO_TEXT = {"head", "nav", "aside", "footer", "form", "button", "select", "menu", "dialog", "option", "datalist", "audio", "video", "canvas", "map"}
NO_TEXT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "alertdialog", "toolbar"}
NO_TEXT_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "copyright",
    "disclaimer", "disqus", "footer", "gdpr", "legal", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager",
    "pagination", "popup", "promo", "promotion", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "teaser",
    "toolbar", "topbar", "widget", "widgets",
}
# Elements of running text, whose names are often made of their headings, and name parts that add nothing to others.
RUNNING = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "li", "dt", "dd", "td", "th", "tr", "blockquote", "pre", "figure", "figcaption", "caption", "table"}
NEUTRAL_NAMES = {"area", "bar", "block", "bottom", "box", "buttons", "container", "content", "form", "icons", "inner", "item", "items", "links", "list", "main", "page", "section", "site", "top", "wrap", "wrapper"}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"},
    "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPE = {"ul", "ol", "dl", "table", "select", "html", "body", "article", "section", "div", "td"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_NAMES = re.compile(r"""\b(class|id|role|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_DIGITS = re.compile(r"\d+")


def _attributes(raw: str) -> dict[str, str]:
    if "=" not in raw and "hidden" not in raw.lower():
        return {}
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMES.finditer(raw)}


def _names_no_text(name: str) -> bool:
    """Whether all words of a class or id are on the list or neutral, and one is on it: comment-list, not legal-history."""
    words = {w.lower() for w in _WORD.findall(name)}
    return bool(words & NO_TEXT_NAMES) and words <= NO_TEXT_NAMES | NEUTRAL_NAMES


def _meaningless(tag: str, attributes: dict[str, str], inside: int) -> bool:
    """Whether an element is no article text by its kind, role or name.

    Outside of articles one word of a container's class is enough; inside, and for ids, the whole name must say so.
    Names of running text count only outside, by class and as a whole; a teaser may be a lead.
    """
    if tag in NO_TEXT or attributes.get("role", "").lower() in NO_TEXT_ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if tag in ("body", "html", "main", "article"):
        return False
    classes = attributes.get("class", "")
    if tag in RUNNING:
        return not inside and any(_names_no_text(n) and n.lower() != "teaser" for n in classes.split())
    if any(_names_no_text(n) for n in [*classes.split(), attributes.get("id", "")]):
        return True
    return not inside and any(w.lower() in NO_TEXT_NAMES for w in _WORD.findall(classes))


class _Node:
    __slots__ = ("tag", "path", "cut", "inside", "root", "branch", "children", "first")

    def __init__(self, tag: str, path: int, cut: bool, inside: int, root: int, branch: bool, first: int) -> None:
        self.tag, self.path, self.cut, self.inside, self.root, self.branch, self.first = tag, path, cut, inside, root, branch, first
        self.children: list[str] = []


class Page:
    """blocks: (text, cut, inside, paths) in page order; inside: 2 in an article, 1 in a main element, else 0.

    branches: (path, root, presentation, content) of the page (path 0) and of every element whose importance
    counts, where asked for; root: path of the article or main element that holds it, else 0.
    """

    def __init__(self, text: str | None, with_branches: bool = False) -> None:
        self.blocks: list[tuple[str, bool, int, tuple[int, ...]]] = []
        self.branches: list[tuple[int, int, int, int]] = []
        self._with_branches = with_branches
        self._stack = [_Node("", 0, False, 0, 0, True, 0)]
        self._parts: list[str] = []
        self._read(text or "")

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(entities.unescape("".join(self._parts)).split())
            self._parts.clear()
            if text:
                top = self._stack[-1]
                paths = () if top.cut else tuple(n.path for n in self._stack[1:] if n.branch)
                self.blocks.append((text, top.cut, top.inside, paths))

    def _open(self, tag: str, raw: str) -> None:
        attributes = _attributes(raw)
        parent = self._stack[-1]
        name = f"{tag}.{attributes.get('class', '').split(' ')[0]}#{attributes.get('id', '')}"
        path = xxhash.xxh64_intdigest(f"{parent.path}>{_DIGITS.sub('', name)}") - (1 << 63)
        header = tag == "header" and parent.inside == 0
        cut = parent.cut or header or _meaningless(tag, attributes, parent.inside)
        inside, root = parent.inside, parent.root
        branch = tag in BLOCK and (not inside or tag not in RUNNING and not name.endswith(".#"))
        if not cut:
            landmark = 2 if tag == "article" or "articlebody" in raw.lower() else 1 if tag == "main" or attributes.get("role", "").lower() == "main" else 0
            if landmark > inside:
                inside, root, branch = landmark, path, True
        parent.children.append(name)
        self._stack.append(_Node(tag, path, cut, inside, root, branch, len(self.blocks)))

    def _close(self) -> None:
        node = self._stack.pop()
        if self._with_branches and node.branch and not (node.cut and node.inside):
            content = "\n".join(b[0] for b in self.blocks[node.first :] if node.cut or not b[1])
            shown = ">".join(c for i, c in enumerate(node.children) if not i or c != node.children[i - 1])
            root = 0 if node.root == node.path else node.root
            self.branches.append((node.path, root, xxhash.xxh64_intdigest(shown) - (1 << 63), xxhash.xxh64_intdigest(content.encode("utf-8", "surrogatepass")) - (1 << 63)))

    def _close_to(self, tags: set[str], scope: set[str]) -> None:
        """Close the nearest open element of *tags*, unless one of *scope* stands in between."""
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i].tag in tags:
                while len(self._stack) > i:
                    self._close()
                return
            if self._stack[i].tag in scope:
                return

    def _read(self, text: str) -> None:
        at, stop = 0, len(text)
        last = text.rfind(">") + 1  # behind it there is no tag
        while at < stop:
            m = _TOKEN.search(text, at) if at < last else None
            if not m:
                self._parts.append(text[at:])
                break
            if m.start() > at:
                self._parts.append(text[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing, raw = bool(m[1] or m[4]), m[3] or m[6] or ""
            if tag in RAW and not closing:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(text, at) if not raw.endswith("/") else m
                at = end.end() if end else stop
                continue
            if tag == "br":
                self._parts.append(" ")
                continue
            if tag in BLOCK or tag in NO_TEXT:
                self._flush()
            elif tag in VOID or not closing and raw.endswith("/"):
                continue
            if closing:
                self._close_to({tag}, set() if tag in BLOCK else BLOCK)
            elif tag in VOID:
                continue
            else:
                if tag in BLOCK:
                    self._close_to({"p"}, SCOPE | {"button"})
                while tag in CLOSES and self._closes(CLOSES[tag]):
                    pass
                self._open(tag, raw)
        self._flush()
        while self._stack:
            self._close()

    def _closes(self, tags: set[str]) -> bool:
        before = len(self._stack)
        self._close_to(tags, {"ul", "ol", "dl", "table", "select"})
        return len(self._stack) < before

    def main_text(self, low: set[int]) -> str:
        """Important blocks of the articles, of the main element or of the page: the narrowest that no text outside outweighs."""
        kept = [b for b in self.blocks if not b[1] and not low.intersection(b[3])]
        for inside in (2, 1):
            within = sum(len(b[0]) for b in kept if b[2] >= inside)
            if within and sum(len(b[0]) for b in kept if b[2] < inside) <= OUTWEIGHS * within:
                kept = [b for b in kept if b[2] >= inside]
                break
        return "\n\n".join(b[0] for b in kept)


def _branches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(host, *branch) for host, text in zip(pdf["host"], pdf["html"]) for branch in set(Page(text, True).branches)]
        yield pd.DataFrame(rows, columns=["host", "path", "root", "shown", "content"])


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, root, pages, importance) of every branch of (host, html); path 0 is the whole page.

    importance weighs the entropy of contents and that of presentations, each against that of all pages
    being different (0: the same on all pages, 1: on no two). Counts combine on the map side, so a host with
    a third of all pages is no hot key. root is the path of the article or main element around a branch, else 0.
    """
    rows = pages.select("host", "html").mapInPandas(_branches, "host string, path long, root long, shown long, content long")
    values = rows.select("host", "path", "root", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("shown").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("value")))).alias("v"))
    counts = values.groupBy("host", "path", "root", "v.kind", "v.value").agg(F.count(F.lit(1)).alias("n"))
    part = counts.groupBy("host", "path", "root", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(1.0)
    weight = F.when(F.col("kind") == 1, CONTENT_WEIGHT).otherwise(1 - CONTENT_WEIGHT)
    return part.groupBy("host", "path", "root").agg(F.max("m").alias("pages"), F.sum(entropy * weight).alias("importance"))


def unimportant(tree: DataFrame) -> DataFrame:
    """(host, path) of branches that vary less than THRESHOLD of what their root does, of those that LEAST_PAGES pages have.

    *tree* has one row per branch of a host's templates, so both sides of the join are small next to the pages.
    """
    roots = tree.groupBy("host", F.col("path").alias("root")).agg(F.max("importance").alias("whole"))
    measured = tree.where((F.col("path") != 0) & (F.col("pages") >= LEAST_PAGES)).join(roots, ["host", "root"])
    return measured.where(F.col("importance") < THRESHOLD * F.col("whole")).select("host", "path").distinct()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        page_id, url, html, low = batch.columns
        text = [Page(h).main_text(set(cut or ())) for h, cut in zip(html.to_pylist(), low.to_pylist())]
        yield pa.RecordBatch.from_arrays([page_id, url, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, broadcast_paths: int = BROADCAST_PATHS) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html).

    Character references are decoded, white space inside a block is one space, blocks are joined by two line
    feeds in page order. Null html is an empty page; pages without a readable host share the tree of the
    empty host. Rows that repeat are extracted each. An empty table gives an empty result. A host's list of
    unimportant branches is one value: it holds paths of its templates, with digits left out of names. All
    lists together are counted; up to *broadcast_paths* they are broadcast, beyond that each host's pages and
    list are dealt to SALTS parts, so a hot host is spread.
    """
    host = F.coalesce(F.regexp_extract(F.lower(F.col("url")), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))
    known = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host.alias("host"))
    low = unimportant(written(style_tree(known))).groupBy("host").agg(F.collect_list("path").alias("low"))
    low = written(low)
    if (low.agg(F.sum(F.size("low"))).first()[0] or 0) <= broadcast_paths:
        joined = known.join(F.broadcast(low), "host", "left")
    else:
        dealt = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = known.withColumn("salt", F.expr(f"int(pmod(xxhash64(page_id, url), {SALTS}))")).join(dealt, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "low").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


@query("op6_html_main_text")
def op6(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
