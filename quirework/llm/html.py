"""Main text of web pages by line-block distribution.

Mark-up is stripped to lines, one per block element. Scripts, styles, forms, menus, page headers and footers, sidebars,
adverts, notices and reader comments (by element or role, or by a class or id that is such a word or starts or ends with
one; never a heading or paragraph by its class or id, a section only by a whole name) go without a trace, so text goes on
behind them; outside an article lines that are mostly link text count as empty. Text lengths are summed over windows of
``SPAN`` lines; text starts where that sum surges, with the lines that lead up to it, and ends where it dives to nothing.
Inside an ``article`` (or ``main``) element any text is a surge; without one the sum must reach ``SURGE`` characters or
half the page's largest sum, whichever is less. All lines between a surge and its dive are kept. Articles of mostly link
text are announcements of others and count only where a page has nothing else.

White space inside a block is one space, blocks are trimmed and joined by a blank line. Null, empty and text-free pages
give the empty string; unclosed elements end with the page or where an article starts. Pages are read row by row, so
repeated rows, ties and further columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrow

SPAN = 3
SURGE = 80

# A tag ends at the first > outside quoted values; a quote counts directly behind = and if it is closed.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[a-z]+")

RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "svg", "math", "canvas", "object", "audio", "video", "menu", "dialog", "fieldset", "datalist", "label"}
ARTICLE = {"article", "main"}
BLOCKS = {"address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html",
          "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "caption"}
SPACED = {"br", "td", "th", "img", "wbr"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
BOILERPLATE = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice",
               "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "widget", "widgets", "footer", "masthead", "comment", "comments", "disqus", "replies", "respond", "share", "sharing",
               "social", "related", "recommended", "newsletter", "subscribe", "popup", "modal", "login", "signup", "pagination", "pager", "toolbar", "copyright", "teaser", "teasers"}


# Parts that make a name say something about the page around it, or about what is not there.
AROUND = {"has", "no", "not", "with", "without", "is", "hide", "layout", "page", "wrap", "wrapper", "container", "main", "grid", "template"}
# Headings and paragraphs get their ids from their own words; sections only count by a whole name.
PLAIN = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}


def _boilerplate(element: str, attributes: str, in_article: bool) -> bool:
    """Whether an element's attributes say that it is no main text: by whole class and id names, or their first or last part."""
    if _HIDDEN.search(attributes):
        return True
    if element in PLAIN:
        return False
    words = BOILERPLATE if in_article else BOILERPLATE | {"header"}
    for name, *values in _NAMES.findall(attributes):
        for token in "".join(values).lower().split():
            if name.lower() == "role":
                if token in ROLES:
                    return True
                continue
            parts = _WORD.findall(token)
            if token in words or element not in ("section", "article") and parts and {parts[0], parts[-1]} & words and not AROUND.intersection(parts):
                return True
    return False


def lines(page: str) -> list[tuple[str, int, int]]:
    """(text, the number of the outermost article it is in or 0, characters of link text) of each block, and empty lines
    where an article starts or ends."""
    out: list[tuple[str, int, int]] = []
    text: list[str] = []
    linked = article = articles = in_link = 0  # article: how many are open
    at, end = 0, len(page)

    def close() -> None:
        nonlocal text, linked
        whole = " ".join("".join(text).split())
        if whole:
            out.append((whole, articles if article else 0, linked))
        text, linked = [], 0

    def gap() -> None:
        close()
        out.extend([("", articles if article else 0, 0)] * SPAN)

    dropped, depth = "", 0  # the element being dropped, and how many of its name are open
    while at < end:
        m = _TAG.search(page, at)
        if not dropped and (upto := m.start() if m else end) > at:
            piece = unescape(page[at:upto])
            text.append(piece)
            linked += len(piece) if in_link else 0
        if not m:
            break
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW and not closing:
            stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if dropped:
            if name == dropped:
                depth += -1 if closing else 1
            if name in ARTICLE and not closing and dropped != name and not article or name in ("body", "html") and closing or dropped == "head" and name == "body":
                depth = 0
            if depth > 0:
                continue
            dropped = ""
            if name not in ARTICLE:
                continue
        if name in VOID:
            if name in SPACED:
                text.append(" ")
            elif name in BLOCKS:
                close()
            continue
        if not closing and not attributes.endswith("/") and name not in ("body", "html") and (
                name in DROPPED or name == "header" and not article or name != "main" and _boilerplate(name, attributes, article > 0)):
            close()
            dropped, depth = name, 1
            continue
        if name == "a":
            in_link = 0 if closing else 1
        if name in SPACED:
            text.append(" ")
        if name in BLOCKS:
            close()
            if name in ARTICLE:
                if not article and not closing:
                    gap()
                    articles += 1
                article = max(0, article + (-1 if closing else 1))
                if not article and closing:
                    out.extend([("", 0, 0)] * SPAN)
    close()
    return out


def main_text(page: str | None) -> str:
    rows = lines(page or "")
    # Articles of mostly link text announce others; they count only where there is nothing else.
    length, links = Counter(), Counter()
    for text, article, linked in rows:
        length[article] += len(text)
        links[article] += linked
    inside = {k for k in length if k and length[k]}
    inside = {k for k in inside if 2 * links[k] <= length[k]} or inside
    size = [0 if not text or (inside and article not in inside) or (not inside and 2 * linked > len(text)) else len(text) for text, article, linked in rows]
    sums = [sum(size[i : i + SPAN]) for i in range(len(size))]
    surge = 1 if inside else max(1, min(SURGE, max(sums, default=0) / 2))
    kept, on = [], False
    for i, total in enumerate(sums):
        if on and not total:
            on = False
        elif not on and total >= surge:
            on, first = True, i
            while first and size[first - 1]:
                first -= 1
            kept += [rows[j][0] for j in range(first, i)]
        if on and size[i]:
            kept.append(rows[i][0])
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return narrow(pages.select("page_id", "url", "html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
