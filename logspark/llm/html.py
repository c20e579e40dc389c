"""Main text of web pages by line-block distribution (operator 2).

Markup is stripped to lines, one for each block. Lines of menus, headers, footers, sidebars, notices, adverts, forms, scripts or comment
sections go by their elements and names; of the others, a line counts as many characters as it has letters and digits outside links.
Sums over windows of WINDOW lines give the distribution: text starts where the sum surges (a line with text of its own) and ends
where it dives to 0 (WINDOW lines in a row, or all that follow, are nothing but links: a menu). Between surge and dive all lines are kept, whatever
their length, lines that are one link too. Where a page marks its article only lines in it count, and the article's bounds count as text, so
a link at its very begin or end stays; elsewhere a line of several links and nothing else is a menu by itself. If only links are left, they are the text.

Cases: null and empty pages have empty text; tags that stay open end with their parent; an unfinished tag at the end is
dropped; very long pages and deep nesting take time in proportion to their length; null ids and repeated rows are rows like others; other columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import table

#: Lines of a window.
WINDOW = 3
# Elements without an end tag, elements that are blocks, elements that are never article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
NEVER = frozenset("nav header footer aside form script style noscript template head title iframe object svg button select textarea dialog menu".split())
RAW = frozenset(("script", "style", "textarea", "title"))
# Words in class, id or role that mark other things than the article.
OTHER = frozenset("ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies consent disqus footer header masthead menu modal nav navbar navigation newsletter notice notification outbrain pager pagination popup promo promotion related replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription taboola toolbar widget".split())
# Words that name a part of a page and say nothing of what is in it.
PARTS = frozenset("area article articles bar block body bottom box btn button buttons container content global group icons inner items left link links list main outer page panel posts primary right row secondary section site slot stories title top unit wrap wrapper".split())
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements that end an open one of their kind when they begin.
SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def names_other(token: str, article: bool) -> bool:
    """Whether a class, id or role is that of something else than the article: one of OTHER, or put together from those and PARTS only."""
    parts = [token] if token in OTHER else re.split(r"[-_]+", token)
    other = [x for x in parts if x in OTHER]
    if article and all(x == "header" for x in other):
        return False  # an article's own header
    return bool(other) and all(x in OTHER or x in PARTS for x in parts)


def marks_other(attrs: str, article: bool) -> bool:
    return any(names_other(token, article) for m in _ATTR.finditer(attrs) for token in (m[2] or m[3] or m[4] or "").lower().split())


class Line(NamedTuple):
    text: str
    #: letters and digits outside links, and links with text
    plain: int
    links: int
    #: in a marked article
    inside: bool


def lines(html: str) -> list[Line]:
    """Blocks of a page with text that may belong to the article."""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []  # element, never article text, in an article
    blocks: list[int] = []  # places of blocks in the stack
    count: Counter[str] = Counter()  # open elements by name
    parts: list[str] = []
    own: list[str] = []  # what stands outside links
    links = at = 0

    def flush() -> None:
        nonlocal links
        text = " ".join(unescape("".join(parts)).split())
        if text and not (stack and stack[-1][1]):
            out.append(Line(text, sum(map(str.isalnum, unescape("".join(own)))), links, bool(stack) and stack[-1][2]))
        parts.clear()
        own.clear()
        links = 0

    def pop() -> str:
        name = stack.pop()[0]
        count[name] -= 1
        if blocks and blocks[-1] == len(stack):
            blocks.pop()
        return name

    n = len(html)
    while at < n:
        m = _TAG.search(html, at)
        piece = html[at : m.start() if m else n]
        if piece:
            parts.append(piece)
            if not any(x[0] == "a" for x in stack[-3:]):
                own.append(piece)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>"))
                own.append(parts[-1])
            continue
        name, closing = m[2].lower(), bool(m[1])
        if closing:
            if count[name]:
                if name in BLOCK:
                    flush()
                while stack:
                    top = stack[-1][0]
                    if name not in BLOCK and top in BLOCK:
                        break  # an inline end tag doesn't close blocks
                    if pop() == name:
                        break
            continue
        if name == "br":
            parts.append(" ")
            own.append(" ")
            continue
        if name in BLOCK:
            flush()
            ends = SIBLINGS.get(name, {"p"} if name not in ("option", "tbody", "thead", "tfoot") else set())
            if blocks and stack[blocks[-1]][0] in ends:  # the nearest open sibling, not beyond another block
                for _ in range(len(stack) - blocks[-1]):
                    pop()
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if name not in VOID and not m[3].rstrip().endswith("/"):
            other, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            here = name in ("article", "main")
            never = (name in NEVER and not (name == "header" and article)) or (name not in ("html", "body", "article", "main") and marks_other(m[3], article))
            if name in BLOCK:
                blocks.append(len(stack))
            links += name == "a"
            count[name] += 1
            stack.append((name, other or never, (article or here) and not (other or never)))
    flush()
    return out


def main_text(html: str | None) -> str:
    found = lines(html or "")
    marked = any(x.inside for x in found)
    if marked:
        found = [x for x in found if x.inside]
    else:
        found = [x for x in found if x.plain or x.links < 2] or found
    # the bounds of a marked article count as text
    size = np.array([int(marked), *(x.plain for x in found), int(marked)])
    window = np.convolve(np.concatenate([size, np.zeros(WINDOW - 1, size.dtype)]), np.ones(WINDOW, size.dtype), "valid")
    live = np.zeros(len(size), bool)
    on = False
    for i in range(len(size)):
        on = size[i] > 0 or (on and window[i] > 0)  # surge, and dive
        live[i] = on
    kept = [x.text for x, keep in zip(found, live[1:-1].tolist(), strict=True) if keep]
    return "\n".join(kept or [x.text for x in found])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for pages with page_id, url and html."""
    ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
