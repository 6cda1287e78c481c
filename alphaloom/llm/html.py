"""HTML extraction: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks. Each block has its word count and link density, those of its neighbours, whether
it is a heading or a paragraph, and whether it lies inside the container that holds most of the page's running text. That
container is found from words and links: from the page down, the child with four fifths of the unlinked words, as long as it
has several blocks; ``article`` and ``main`` end the way down. Elements that are no article by their meaning (menus, footers, forms) and class
names are two further features; both count only between the block and that container, so a name on or around the article
says nothing about its blocks. A named container is judged as a whole: one that holds four fifths of the main container's words and leaves no
running text beside it is the article itself, whatever its name; any other, such as a sidebar or a list of comments, lends its name to all of its blocks, long ones too, and
does not compete for the main container with a sibling of running text. A small CART tree, trained on the labelled table below, keeps or drops each block. Kept blocks are joined in
page order by line feeds.

Defined results: null or empty pages give an empty text; broken markup is read as browsers do (unclosed tags stay open, a
new link ends an open one, a stray ``<`` is text, an unfinished tag at the end is dropped); hidden elements have no text; repeated
rows get equal results; an empty table gives no rows. Pages are independent, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from alphaloom.llm.common import table

# fixed values: HTML element names by their part in a page
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video map datalist".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p li dt dd td th pre blockquote figcaption summary address".split())
BOILER = frozenset("nav footer aside menu dialog form fieldset button select option textarea label input".split())
ROLES = {"navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "form": -1, "alert": -1, "dialog": -1, "menu": -1, "menubar": -1, "note": 0}
BOILER_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
_WORD = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Share of the unlinked words below an element that one child must hold for the way to the main container to go on; the
#: second holds for an article or main element.
MOST, HALF = 0.8, 0.5
#: Unlinked words that make an element without a name running text.
RUNNING = 25

#: Labelled blocks. Columns: inside, element, name, kind (2 heading, 1 paragraph, 0 other), words, link density, words before,
#: link density before, words after, link density after, content.
LABELLED = """
1  0  0 1  60 0.00  55 0.00  70 0.00 1
1  0  0 2   8 0.00   0 0.00  60 0.00 1
1  0  0 2   5 0.00   4 1.00  40 0.00 1
1  0  0 2   4 1.00   9 0.00  50 0.00 1
1  0  0 1   5 0.00  12 1.00  40 0.00 1
1  0  0 1   1 0.00  30 0.00   1 0.00 1
1  0  0 1   2 0.00   5 0.00   0 0.00 1
1  0  0 1   5 0.00   2 0.00   3 0.00 1
1  0  0 1   2 0.50  80 0.00   9 0.00 1
1  0  0 1   6 1.00  40 0.00  50 0.00 1
1  0  0 0   9 1.00  60 0.00  45 0.00 1
1  0  0 1  25 0.20   9 0.00   0 0.00 1
1  0  0 0  15 0.00  12 0.00  20 0.00 1
1  0  0 0   3 0.00   3 0.00   3 0.00 1
1  0  0 0   7 0.30  30 0.00  10 0.00 1
1  0  0 1 400 0.05   7 0.00  10 0.10 1
1  0  0 1  12 0.00   4 1.00   8 0.00 1
1  0  0 2   3 0.00  25 0.00  30 0.00 1
1  0  0 0   7 1.00   0 0.00   8 0.00 0
1  0  0 0   7 1.00   5 0.00  60 0.00 0
1  0  0 0   3 1.00   2 1.00   4 1.00 0
1  0  0 0   1 1.00   1 1.00   1 1.00 0
1  0  0 0   2 1.00  60 0.00   3 1.00 0
1  0  0 0   4 1.00   5 1.00   0 0.00 0
1  0  0 1   5 1.00   6 1.00   7 1.00 0
1  0  0 1   8 1.00  70 0.00   0 0.00 0
1  0  0 0  12 0.80   9 0.90  10 0.80 0
1  0  0 1   9 0.90  70 0.00   6 1.00 0
1 -1  0 1  12 0.00   1 1.00   9 0.00 0
1 -1  0 1  40 0.00  60 0.00  30 0.00 0
1 -1  0 0   7 0.00  60 0.00   0 0.00 0
1 -1  0 0   3 1.00   2 1.00   4 1.00 0
1 -1  0 2   2 0.00  60 0.00   3 1.00 0
1 -1  0 0   1 0.00   2 0.00   1 0.00 0
1 -1 -1 1  90 0.10  20 0.00  15 0.00 0
1  0 -1 1   7 0.00  60 0.00  60 0.00 0
1  0 -1 0  12 0.00  60 0.00  75 0.00 0
1  0 -1 1  25 0.00  25 0.00  25 0.00 0
1  0 -1 0  40 0.00   6 0.00  30 0.00 0
1  0 -1 2   2 0.00  80 0.00  20 0.00 0
1  0 -1 1  35 0.00   2 0.00  30 0.00 0
1  0 -1 0  15 0.40  12 0.50  10 0.60 0
1  0 -1 0   2 0.50   0 0.00   3 1.00 0
1  0 -1 1  55 0.00  40 0.00  20 0.00 0
1  0 -1 1 110 0.00  90 0.00 120 0.00 0
1  0 -1 1 150 0.05  70 0.00  80 0.10 0
1  0 -1 0 200 0.00  75 0.00  90 0.00 0
0  0 -1 1  95 0.00  85 0.00   8 0.00 0
0  0 -1 1 140 0.00 120 0.00 130 0.00 0
0 -1  0 1 120 0.00  90 0.00  80 0.00 0
0  0  0 1  60 0.00  50 0.00  45 0.00 1
0  0  0 1  80 0.05   8 0.00  40 0.00 1
0  0  0 1 120 0.10  30 0.00   5 1.00 1
0  0  0 0  70 0.00  90 0.00  60 0.00 1
0  0  0 1  22 0.20  30 0.10  25 0.00 0
0  0  0 0  14 0.00   1 1.00   9 0.00 0
0  0  0 0  12 0.00   2 1.00  12 0.00 0
0  0  0 0   8 0.00  20 0.00   0 0.00 0
0  0  0 1   9 0.00  80 0.00   0 0.00 0
0  0  0 1  25 0.00  60 0.00   6 0.00 0
0  0  0 0   4 1.00   3 1.00   5 1.00 0
0  0  0 0   2 1.00   0 0.00   2 1.00 0
0  0  0 0  30 0.70  10 0.80  12 0.60 0
0  0  0 2   4 0.00   0 0.00   3 1.00 0
0  0  0 0  60 0.60   5 0.50   3 1.00 0
0  0 -1 0  12 0.00   4 1.00  10 0.00 0
0  0 -1 1  70 0.00  40 0.00  35 0.00 0
0  0 -1 1  30 0.00  60 0.00  25 0.00 0
0  0 -1 0   3 1.00   2 1.00   4 1.00 0
0 -1  0 0   1 1.00   1 1.00   1 1.00 0
0 -1  0 1  45 0.00   6 0.00  30 0.00 0
0 -1  0 0  12 0.00  60 0.00   0 0.00 0
0 -1 -1 0   6 0.50  50 0.00   3 1.00 0
1 -1  0 1   6 0.00  60 0.00  60 0.00 0
1 -1  0 1  30 0.00  50 0.00  80 0.00 0
1 -1  0 0  10 0.00  40 0.00  90 0.00 0
1 -1  0 1 100 0.00  90 0.00  70 0.00 0
1 -1  0 0   8 0.00  90 0.00 130 0.00 0
1  0 -1 1   7 0.00  40 0.00  45 0.00 0
1  0 -1 0  20 0.00  70 0.00 100 0.00 0
1  0 -1 0   4 0.00   0 0.00  60 0.00 0
1  0 -1 2   3 0.00  50 0.00  60 0.00 0
1  0 -1 1  50 0.00  90 0.00  90 0.00 0
0 -1  0 1  20 0.00  30 0.00  70 0.00 0
0  0  0 0   5 0.00   0 0.00  60 0.00 0
0  0  0 0  12 0.00   2 1.00  50 0.00 0
0  0  0 2   6 0.00   8 0.00  70 0.00 0
0  0  0 1  20 0.00  60 0.00  90 0.00 0
0  0  0 0   9 0.00   3 1.00 150 0.00 0
0  0 -1 1  30 0.00  60 0.00  80 0.00 0
0  0 -1 0  10 0.00   1 1.00  11 0.00 0
"""


class Element:
    """An open or closed element: its parent and what it says of its text."""

    __slots__ = ("tag", "parent", "element", "name", "hidden", "blocks", "weight", "plain", "children", "told")

    def __init__(self, tag: str, parent: Element | None, attrs: dict):
        self.tag, self.parent = tag, parent
        self.children: list[Element] = []
        self.blocks, self.weight, self.plain = 0, 0.0, 0
        role = (attrs.get("role") or "").strip().lower()
        self.told = tag in ("article", "main", "section") or bool(parent and parent.told)
        self.element = ROLES.get(role, -1 if tag in BOILER or (tag == "header" and not self.told) else 0)
        names = {w.lower() for value in (attrs.get("class"), attrs.get("id")) if value for w in _WORD.findall(_CAMEL.sub(" ", value))}
        self.name = -1 if names & BOILER_NAMES else 0
        unseen = "hidden" in attrs or (attrs.get("aria-hidden") or "").strip().lower() == "true" or _UNSEEN.search(attrs.get("style") or "")
        self.hidden = bool(unseen) or tag in HIDDEN or bool(parent and parent.hidden)
        if parent:
            parent.children.append(self)


class Page(HTMLParser):
    """Collects the text blocks of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html", None, {})
        self.open = [self.root]
        self.blocks: list[tuple[Element, str, int, int]] = []  # element, text, words, link words
        self.parts: list[tuple[str, bool]] = []
        self.links = 0

    def flush(self) -> None:
        words = [(w, link) for text, link in self.parts for w in text.split()]
        if words:
            text = " ".join("".join(t for t, _ in self.parts).split())
            linked = sum(link for _, link in words)
            self.blocks.append((self.open[-1], text, len(words), linked))
            at = self.open[-1]
            while at:
                at.blocks += 1
                at.plain += len(words) - linked
                at.weight += (len(words) - linked) * (1 if at.element == 0 else 0.25)
                at = at.parent
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append((" ", False))
        if tag in BLOCKS or tag in HIDDEN:
            self.flush()
        if tag == "body":  # a head that was never closed ends here
            self.open = [x for x in self.open if x.tag not in ("head", "title")]
        if tag in VOID:
            return
        if tag == "p":
            self._close("p", BLOCKS - {"p"})
        if tag == "li":
            self._close("li", frozenset(("ul", "ol", "menu")))
        if tag == "a":
            self._close("a", frozenset())
            self.links += 1
        self.open.append(Element(tag, self.open[-1], dict(attrs)))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS or tag in HIDDEN:
            self.flush()
        self._close(tag, frozenset())

    def handle_data(self, data):
        if not self.open[-1].hidden:
            self.parts.append((data, self.links > 0))

    def _close(self, tag: str, until: frozenset) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.links -= sum(x.tag == "a" for x in self.open[i:])
                if tag == "a":  # a link that is ended by the next one leaves the elements inside it open
                    del self.open[i]
                else:
                    del self.open[i:]
                return
            if self.open[i].tag in until:
                return


def blocks(html: str) -> tuple[list[tuple[Element, str, int, int]], Element]:
    """The blocks of a page and its main container."""
    page = Page()
    page.feed(html)
    page.close()
    page.flush()
    at = page.root
    while at.tag not in ("article", "main"):
        ways = at.children
        if any(not x.name and not x.element and x.plain >= RUNNING for x in ways):
            ways = [x for x in ways if not x.name]
        next_ = max(ways, key=lambda x: x.weight, default=None)
        total = at.weight - sum(x.weight for x in at.children) + sum(x.weight for x in ways)
        if next_ is None or next_.tag in LEAVES or next_.element or next_.blocks < 2 or next_.weight < (HALF if next_.tag in ("article", "main") else MOST) * total:
            break
        at = next_
    return page.blocks, at


def features(found: list[tuple[Element, str, int, int]], main: Element) -> np.ndarray:
    """The columns of the labelled table for each block."""
    own = np.array([(words, links / words) for _, _, words, links in found], float).reshape(-1, 2)
    around = np.vstack([np.zeros(2), own, np.zeros(2)])
    where, above, up = [], set(), main
    while up is not None:
        above.add(id(up))
        up = up.parent
    for at, *_ in found:
        element = name = kind = 0
        chain = []
        while at is not None and at is not main:
            chain.append(at)
            at = at.parent
        for x in chain:
            element = min(element, x.element)
            # a container around the main one, or beside which it has no running text, is no part beside the article
            if id(x) not in above and not (at is main and x.plain >= MOST * main.plain and main.plain - x.plain < RUNNING):
                name = min(name, x.name)
            if kind == 0 and x.tag in HEADINGS:
                kind = 2
            elif kind == 0 and x.tag == "p":
                kind = 1
        where.append((at is main, element, name, kind))
    return np.column_stack([np.array(where, float).reshape(-1, 4), own, around[:-2], around[2:]])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A CART tree by Gini impurity: a class at a leaf, else (feature, threshold, low, high)."""
    if depth == 0 or y.min() == y.max():
        return int(2 * y.sum() >= len(y))
    best = (1e-9, None, None)
    gini = lambda v: len(v) * 2 * v.mean() * (1 - v.mean())
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            gain = gini(y) - gini(y[low]) - gini(y[~low])
            if gain > best[0] + 1e-12:
                best = (gain, f, cut)
    if best[1] is None:
        return int(2 * y.sum() >= len(y))
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def classify(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), bool(tree))
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x), bool)
    out[low], out[~low] = classify(tree[2], x[low]), classify(tree[3], x[~low])
    return out


@lru_cache(1)
def trained():
    rows = np.array([line.split() for line in LABELLED.strip().splitlines()], float)
    return grow(rows[:, :-1], rows[:, -1])


def main_text(html: str | None) -> str:
    found, main = blocks(html) if html else ([], None)
    if not found:
        return ""
    return "\n".join(b[1] for b, keep in zip(found, classify(trained(), features(found, main)), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` without html, with ``text`` and ``n_chars``; other columns with these names give way."""
    keep = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=schema.names)

    return pages.select(*keep, "html").mapInArrow(run, schema)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
