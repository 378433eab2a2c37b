"""Main text of web pages: flat text blocks classified by a decision tree over words and link densities.

A page is cut into flat blocks at block-level tags (no tree of the document is built). A block knows its words, the
share of them inside links, the same of its neighbours, whether it is a heading, and where it stands: inside a
container that names itself an article, inside one that names itself something else (menu, footer, advert, form,
comments, ...), or neither. A small CART tree, trained on the labelled table below when the module is first used, says
which blocks are the article's. Their texts are joined in page order.

Scripts, styles, comments, form fields and the title are no blocks. Of elements whose content is not the page's text, only
script, style, textarea and title run to the end of the page if they do not end; the others (select, svg, object, ...)
are then read like any container. A head needs no rule: what may stand in it has no text but in such elements. Character references are decoded after cutting, so
an escaped tag stays text. White space of any kind inside a block becomes one space; ``br`` counts as white space.

Edge cases: null and empty pages, and pages without an article block, give an empty text; broken markup (tags without
an end, end tags without a start, pages cut off anywhere) is read as far as it goes; rows that repeat a page_id are
extracted each; an empty table gives no rows; other columns are ignored.
"""

import html
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title)\b[^>]*+(?:>.*?(?:</(?P=raw)\s*+>|\Z)|\Z)"
    r"|<(?P<nested>template|svg|math|object)\b[^>]*+>.*?</(?P=nested)\s*+>"
    r"|<(?P<flat>noscript|select|iframe|canvas)\b[^>]*+>(?:(?!<(?P=flat)\b).)*?</(?P=flat)\s*+>"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)"""
    r"|</?[a-z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([a-z][\w:-]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# HTML's elements by their role.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark meter nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset("article main".split())
OTHER = frozenset("nav aside footer form menu dialog button fieldset legend label".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form note".split())
# Words of class names and ids by which a container names itself something other than the article.
OTHER_NAMES = frozenset("""nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer foot masthead topbar banner ad ads adv advert adverts
    advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr privacy notice notices notification popup modal overlay newsletter
    subscribe subscription signup signin login register search share sharing social follow comment comments disqus reply replies respond responses discussion
    feedback related recommended recommendations trending popular pagination pager widget toolbar skip hidden copyright legal disclaimer form""".split())
# Words that make a name speak about a layout ("with-sidebar") and not about the container.
LAYOUT_WORDS = frozenset("has with no without".split())

FEATURES = ("place", "heading", "words", "links", "words_before", "links_before", "words_after", "links_after", "article_on_page")
# The labelled table: features as above (place: -1 other, 0 unnamed, 1 article), then 1 for article blocks.
LABELLED = [
    # blocks of named articles, long or short, whatever stands beside them
    (1, 0, 120, 0.0, 80, 0.0, 95, 0.0, 1, 1), (1, 0, 1, 0.0, 80, 0.0, 60, 0.0, 1, 1), (1, 1, 9, 0.0, 0, 0.0, 120, 0.0, 1, 1),
    (1, 0, 45, 0.1, 6, 0.0, 3, 0.0, 1, 1), (1, 0, 2, 0.0, 6, 1.0, 4, 1.0, 1, 1), (1, 0, 300, 0.02, 1, 1.0, 0, 0.0, 1, 1),
    (1, 0, 30, 0.5, 40, 0.0, 50, 0.0, 1, 1), (1, 0, 12, 0.3, 1, 0.0, 1, 0.0, 1, 1), (1, 1, 4, 1.0, 30, 0.0, 70, 0.0, 1, 1),
    (1, 0, 3, 0.0, 0, 0.0, 0, 0.0, 1, 1), (1, 0, 3, 1.0, 60, 0.0, 80, 0.0, 1, 1), (1, 0, 20, 0.9, 60, 0.0, 30, 0.0, 1, 1),
    # link lists inside named articles
    (1, 0, 2, 1.0, 2, 1.0, 2, 1.0, 1, 0), (1, 0, 1, 1.0, 1, 1.0, 3, 1.0, 1, 0), (1, 0, 4, 1.0, 5, 1.0, 2, 1.0, 1, 0),
    # named other: never, however long
    (-1, 0, 150, 0.0, 90, 0.0, 70, 0.0, 1, 0), (-1, 0, 8, 0.0, 1, 1.0, 9, 0.0, 1, 0), (-1, 1, 3, 0.0, 0, 0.0, 40, 0.0, 1, 0),
    (-1, 0, 1, 1.0, 1, 1.0, 1, 1.0, 1, 0), (-1, 0, 60, 0.1, 30, 0.0, 4, 0.5, 0, 0), (-1, 0, 200, 0.0, 200, 0.0, 0, 0.0, 0, 0),
    (-1, 1, 10, 0.0, 5, 1.0, 90, 0.0, 0, 0), (-1, 0, 25, 0.0, 120, 0.0, 6, 0.2, 1, 0), (-1, 0, 6, 0.2, 40, 0.0, 0, 0.0, 0, 0),
    # unnamed blocks beside a named article
    (0, 0, 12, 0.0, 1, 1.0, 9, 0.0, 1, 0), (0, 0, 5, 0.4, 60, 0.0, 0, 0.0, 1, 0), (0, 0, 40, 0.0, 2, 1.0, 8, 0.0, 1, 0),
    (0, 1, 6, 0.0, 3, 1.0, 12, 0.0, 1, 0), (0, 0, 70, 0.0, 70, 0.0, 70, 0.0, 1, 0), (0, 0, 2, 1.0, 2, 1.0, 2, 1.0, 1, 0),
    (0, 0, 150, 0.0, 90, 0.0, 0, 0.0, 1, 0), (0, 1, 5, 0.0, 0, 0.0, 200, 0.0, 1, 0), (0, 0, 28, 0.05, 35, 0.0, 40, 0.0, 1, 0),
    # unnamed blocks on pages without one
    (0, 0, 40, 0.0, 40, 0.0, 2, 0.0, 0, 1), (0, 0, 40, 0.0, 3, 0.0, 2, 1.0, 0, 1), (0, 0, 200, 0.0, 150, 0.0, 90, 0.0, 0, 1),
    (0, 0, 70, 0.0, 70, 0.0, 70, 0.0, 0, 1), (0, 0, 2, 0.0, 40, 0.0, 40, 0.0, 0, 1), (0, 1, 2, 0.0, 1, 1.0, 40, 0.0, 0, 1),
    (0, 0, 80, 0.0, 40, 0.0, 60, 0.0, 0, 1), (0, 0, 35, 0.05, 3, 0.0, 40, 0.0, 0, 1), (0, 1, 8, 0.0, 2, 1.0, 50, 0.0, 0, 1),
    (0, 0, 6, 0.0, 45, 0.0, 50, 0.0, 0, 1), (0, 0, 18, 0.0, 20, 0.0, 25, 0.0, 0, 1), (0, 0, 25, 0.2, 60, 0.0, 30, 0.1, 0, 1),
    (0, 0, 3, 0.0, 70, 0.0, 15, 0.0, 0, 1), (0, 0, 120, 0.1, 0, 0.0, 0, 0.0, 0, 1), (0, 0, 50, 0.0, 4, 1.0, 3, 1.0, 0, 1),
    (0, 0, 2, 1.0, 2, 1.0, 2, 1.0, 0, 0), (0, 0, 1, 1.0, 0, 0.0, 1, 1.0, 0, 0), (0, 0, 6, 0.9, 5, 1.0, 40, 0.0, 0, 0),
    (0, 0, 5, 0.0, 2, 1.0, 3, 1.0, 0, 0), (0, 0, 10, 0.6, 3, 0.5, 2, 1.0, 0, 0), (0, 0, 7, 0.3, 8, 0.6, 0, 0.0, 0, 0),
    (0, 0, 30, 0.7, 4, 1.0, 12, 0.8, 0, 0), (0, 0, 4, 0.0, 1, 1.0, 5, 0.7, 0, 0), (0, 0, 60, 0.8, 9, 0.9, 7, 1.0, 0, 0),
]
# Named places decide whatever the sizes are: rows over a grid of words, links and neighbours.
_BESIDE = ((0, 0.0), (2, 1.0), (60, 0.0))
LABELLED += [
    (place, 0, words, links, *before, *after, 1, label)
    for place, label in ((1, 1), (-1, 0))
    for words, links in ((1, 0.0), (6, 0.0), (30, 0.4), (150, 0.0))
    for before in _BESIDE
    for after in _BESIDE
]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """A CART tree by Gini impurity: (feature, threshold, low branch, high branch), or (share of ones,) as a leaf."""
    best = None
    if depth and 0 < y.sum() < len(y):
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[:-1] + values[1:]) / 2:
                low = x[:, f] <= t
                impurity = sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, float(t), low)
    if best is None:
        return (float(y.mean()),)
    _, f, t, low = best
    return f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@cache
def trained() -> tuple:
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1])


def is_article(tree: tuple, features: tuple) -> bool:
    while len(tree) > 1:
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree[0] >= 0.5


@lru_cache(maxsize=4096)
def _names_other(name: str) -> bool:
    """Whether a class name or id is that of something other than an article: by its first or last word."""
    words = [w.lower() for w in _NAME.findall(name)]
    return bool(words) and (words[0] in OTHER_NAMES or words[-1] in OTHER_NAMES) and not LAYOUT_WORDS.intersection(words)


def _place(tag: str, attributes: str, inside: int) -> int:
    """Where the content of a container stands, given where the container itself stands."""
    if inside < 0 or tag in ("html", "body"):
        return inside
    if tag in OTHER or (tag == "header" and inside == 0):
        return -1
    if not attributes.strip("/ \t\n"):
        return 1 if tag in ARTICLE else inside
    for k, a, b, c in _ATTRIBUTE.findall(attributes):
        k, v = k.lower(), a or b or c
        if k in ("class", "id") and tag != "main" and any(map(_names_other, v.split())):
            return -1
        if k == "role" and v.lower() in OTHER_ROLES or k == "hidden" or (k, v.lower()) == ("aria-hidden", "true") or k == "style" and "display:none" in v.replace(" ", "").lower():
            return -1
        if (k, v.lower()) == ("role", "main") or (k, v.lower()) == ("itemprop", "articlebody"):
            return 1
    return 1 if tag in ARTICLE else inside


def blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """Flat blocks: (text, words, words in links, place, heading)."""
    out: list[tuple[str, int, int, int, int]] = []
    pieces: list[tuple[str, bool]] = []
    stack: list[tuple[str, int]] = []  # open containers and the place of their content
    link, heading, place, at = False, 0, 0, 0

    def flush():
        if pieces:
            text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
            if text:
                linked = sum(len(html.unescape(p).split()) for p, inside in pieces if inside)
                words = text.count(" ") + 1
                out.append((text, words, min(linked, words), place, heading))
            pieces.clear()

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            pieces.append((page[at : m.start()], link))
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                link = not m["end"]
            elif tag == "br":
                pieces.append((" ", False))
            if m["end"] or not (attributes := m["attributes"]) or tag in VOID or _place("span", attributes, 0) == 0:
                if m["end"] and stack and stack[-1][0] == tag:
                    flush()
                    stack.pop()
                    place = stack[-1][1] if stack else 0
                continue
            # an inline element that names itself something else is a container of its own
        flush()
        if m["end"]:
            link = False
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            heading = 0
        elif tag in HEADINGS:
            heading = 1
        elif tag not in VOID:
            heading = 0
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                stack.pop()  # these end at their next
            place = stack[-1][1] if stack else 0
            stack.append((tag, _place(tag, m["attributes"], place)))
        place = stack[-1][1] if stack else 0
    if at < len(page):
        pieces.append((page[at:], link))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page: its blocks' texts joined by empty lines."""
    found = blocks(page or "")
    named = float(any(b[3] > 0 for b in found))
    tree, kept = trained(), []
    sizes = [(0, 0.0), *((b[1], b[2] / b[1]) for b in found), (0, 0.0)]
    for i, (text, _, _, place, heading) in enumerate(found, 1):
        if is_article(tree, (place, heading, *sizes[i], *sizes[i - 1], *sizes[i + 1], named)):
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.as_py()) for p in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(tidy(read), "page_id bigint, url string, text string, n_chars bigint")
