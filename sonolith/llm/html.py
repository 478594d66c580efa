"""Main text of web pages by tag-path ratios.

Text nodes are grouped by their root-to-leaf tag path, in which blocks of nothing
but links, and regions with a doubtful name, are paths of their own. Text length,
punctuation and number of nodes are summed per path; both ratios are smoothed over
neighbouring paths in page order, fused as a geometric mean, and paths under a share
of the page's spread are dropped. Nodes in regions that are no article by their
markup (menus, footers, adverts, forms, scripts, comments ...) never count. Where a
page marks its article, nothing outside it counts, and within it the ratios decide on
links and regions of a doubtful name. The cost grows with the page, however deep
its elements stand in each other.

Defined results: null or empty html gives empty text; repeated rows give repeated
results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolith.llm.common import bounded_batches

#: A tag ends at the first > outside quotes, or where a quote stays open at the first > at all.
_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|$))""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[^\w\s]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp")}
#: Elements of RAW that may be empty, and whose end tag may be missing.
FOREIGN = frozenset("template iframe svg noscript".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Regions that hold no article text, by tag, role, or a word of class or id.
SKIP_TAGS = frozenset("head script style noscript template iframe svg nav footer aside form menu button select textarea dialog canvas audio video xmp".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
SKIP_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead comment comments disqus reply replies respond cookie cookies consent gdpr notice alert popup modal newsletter subscribe subscription signup login share sharing social related recommended widget pagination pager toolbar copyright disclaimer adsbygoogle".split())
#: Words that leave a region's name as telling as it is without them.
NEUTRAL = frozenset("area articles aside bar block body bottom box btn button buttons center col column component container content count desktop fixed float form global group icon icons id inner item items js law layout left line link links list main media message meta mobile module msg news outer overlay page panel part policy post posts primary reader readers right row secondary section site slot small space sticky stories tab text thread title top unit user users view widget wide wp wrap wrapper zone".split())
#: Words beside which a header is the article's own, and prefixes that only tell of a region elsewhere.
OWN_HEADER = frozenset("article post entry story content".split())
TELLING = re.compile(r"(?:^|[-_])(?:no|has|with|without|hide|show)[-_]|(?:^|[-_])(?:open|closed|enabled|disabled)$")
#: Words that tell even of an article that it is none of the page's own.
FOREIGN_ARTICLE = frozenset("ad ads advert adverts advertisement advertising sponsored promo comment comments disqus reply replies respond related recommended".split())
CLOSES = {"p": BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


#: How sure a name or element is that its region holds no article text.
NO, DOUBTFUL, YES = range(3)


def _named(name: str, inside: bool = False) -> int:
    """What one class or id tells of its region. A header inside an article holds its title."""
    words = set(re.split(r"[^a-z]+", name))
    found = words & SKIP_WORDS
    if not found or TELLING.search(name) or found <= {"header"} and (inside or words & OWN_HEADER):
        return NO
    return YES if words <= SKIP_WORDS | NEUTRAL | {""} else DOUBTFUL


def _skips(tag: str, attrs: str, inside: bool) -> int:
    """inside: within an article, whose own header holds its title."""
    if tag in SKIP_TAGS or tag == "header" and not inside:
        return YES
    if not attrs or tag in ("html", "body"):
        return NO
    own = tag in ("article", "main")
    sure = NO
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in SKIP_ROLES or name == "aria-hidden" and value == "true":
            return YES
        if name in ("class", "id") and own:
            words = [set(re.split(r"[^a-z]+", x)) for x in value.split() if not TELLING.search(x)]
            sure = max([sure, *(YES for w in words if w & FOREIGN_ARTICLE and w <= FOREIGN_ARTICLE | NEUTRAL | {""})])
        elif name in ("class", "id") and not (inside and tag == "header"):
            sure = max([sure, *(_named(x, inside) for x in value.split())])
        if name == "style" and "display:none" in value.replace(" ", ""):
            return YES
    if sure < YES and re.search(r"(?:^|\s)hidden(?:\s|$|/)", _ATTR.sub("", attrs)):
        return YES
    return sure


@dataclass
class Block:
    path: int  # number of its tag path
    text: str
    inside: bool  # in an article that the page marks
    linked: bool  # nothing but links
    doubtful: bool  # in a region of a doubtful name
    heading: bool


#: Elements that an open paragraph, item or cell doesn't reach beyond.
BARRIERS = frozenset("table ul ol dl div article section body button".split())


class Page:
    """Reads a page's blocks in order, outside skipped regions.

    A tag path is the number of a node in a tree of tags, so that neither paths nor
    the search for open elements grow with the depth of the page.
    """

    def __init__(self, html: str):
        self.html, self.blocks = html, []
        self.tags: list[str] = []
        self.state = [(0, "", "", 0, 0, 0)]  # node, its tag and its parent's, skipped, inside, doubtful
        self.paths: dict[tuple, int] = {}
        self.open: Counter[str] = Counter()
        self.marks: list[int] = []  # places of open elements that others may end, and of barriers
        self.parts: list[str] = []
        self.at_first, self.linked = self.state[0], True

    def node(self, *key) -> int:
        return self.paths.setdefault(key, len(self.paths) + 1)

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", unescape("".join(self.parts))).strip()
            node, tag, parent, _, inside, doubtful = self.at_first
            if text:
                heading = tag in HEADINGS or not self.linked and parent in HEADINGS
                self.blocks.append(Block(self.node(node, "a") if self.linked else node, text, inside > 0, self.linked, doubtful > 0, heading))
            self.parts.clear()
        self.linked = True

    def text(self, text: str) -> None:
        if not self.state[-1][3]:
            if not self.parts:
                self.at_first = self.state[-1]
            self.parts.append(text)
            self.linked = self.linked and (self.open["a"] > 0 or text.isspace())

    def pop(self) -> str:
        tag = self.tags.pop()
        self.state.pop()
        self.open[tag] -= 1
        if self.marks and self.marks[-1] == len(self.tags):
            self.marks.pop()
        return tag

    def push(self, tag: str, sure: int) -> None:
        node, last, parent, skipped, inside, doubtful = self.state[-1]
        if tag in BLOCK:
            node, last, parent = self.node(node, tag), tag, last
        if sure == DOUBTFUL:
            node = self.node(node, "?")
        if tag in CLOSES or tag in BARRIERS:
            self.marks.append(len(self.tags))
        self.tags.append(tag)
        self.open[tag] += 1
        self.state.append((node, last, parent, skipped + (sure == YES), inside + (tag in ("article", "main")), doubtful + (sure == DOUBTFUL)))

    def end(self, tag: str) -> None:
        if self.open[tag]:
            if tag in BLOCK:
                self.flush()
            while self.pop() != tag:
                pass
        elif tag in BLOCK:
            self.flush()

    def begin(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self.flush()
            # A block ends an open paragraph, and cells and items end their like.
            for at in reversed(self.marks):
                if tag in CLOSES.get(self.tags[at], ()):
                    while len(self.tags) > at:
                        self.pop()
                    break
                if self.tags[at] in BARRIERS:
                    break
        elif tag == "br" and self.parts:
            self.parts.append(" ")
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            return
        sure = _skips(tag, attrs, self.state[-1][4] > 0)
        if sure == DOUBTFUL:
            self.flush()
        self.push(tag, sure)

    def read(self) -> list[Block]:
        html, at, n = self.html, 0, len(self.html)
        no_end: set[str] = set()
        while at < n:
            m = _TOKEN.search(html, at)
            end = m.start() if m else n
            if end > at:
                self.text(html[at:end])
            if not m:
                break
            at, tag = m.end(), (m[2] or "").lower()
            attrs = (m[3] or "").removesuffix(">")
            if not tag:
                if m[0].startswith("<![CDATA["):
                    self.text(m[0][9:].removesuffix("]]>"))
            elif m[1]:
                self.end(tag)
            elif tag in RAW and not (attrs.endswith("/") and tag in FOREIGN):
                if tag in BLOCK:
                    self.flush()
                close = RAW[tag].search(html, at) if tag not in no_end else None
                if close:
                    at = close.end()
                elif tag in FOREIGN:
                    no_end.add(tag)  # an element that never ends is empty
                else:
                    at = n
            else:
                self.begin(tag, attrs)
        self.flush()
        return self.blocks


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order, outside skipped regions."""
    return Page(html).read()


def smooth(values: np.ndarray, own: float = 0.8) -> np.ndarray:
    if len(values) < 2:
        return values
    padded = np.pad(values, 1, mode="edge")
    return own * values + (1 - own) / 2 * (padded[:-2] + padded[2:])


def extract(html: str | None, factor: float = 0.5, article_factor: float = 0.1) -> str:
    """The page's main text. factor: the threshold, in standard deviations of the
    fused ratio. In an article that the page marks itself it holds for regions of a
    doubtful name, and article_factor for blocks of nothing but links; its other
    blocks stay, and then nothing outside it counts."""
    found = blocks(html or "")
    if not found:
        return ""
    marked = any(x.inside for x in found)
    order = list(dict.fromkeys(x.path for x in found))
    place = {p: k for k, p in enumerate(order)}
    chars, marks, nodes = np.zeros(len(order)), np.zeros(len(order)), np.zeros(len(order))
    for x in found:
        k = place[x.path]
        chars[k] += len(x.text)
        marks[k] += len(_PUNCT.findall(x.text))
        nodes[k] += 1
    fused = np.sqrt(smooth(chars / nodes) * smooth(marks / nodes + 1e-9))
    above = lambda f: fused >= min(f * fused.std(), fused.max())
    keep, keep_link = above(factor), above(article_factor)
    if marked:
        kept = [x.inside and bool(keep[place[x.path]] if x.doubtful else not x.linked or keep_link[place[x.path]]) for x in found]
    else:
        kept = [bool(keep[place[x.path]]) for x in found]
    # A heading stays if kept text follows it directly.
    for k in range(len(found) - 2, -1, -1):
        if found[k].heading and (found[k].inside or not marked):
            kept[k] = kept[k] or kept[k + 1]
    return "\n".join(x.text for x, ok in zip(found, kept, strict=True) if ok)


def main_text(pages: DataFrame, html: str = "html", factor: float = 0.5) -> DataFrame:
    """pages with main_text."""
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(x, factor) for x in batch], dtype=object)

    return pages.withColumn("main_text", run(html))


def report(pages: DataFrame) -> DataFrame:
    return main_text(pages.select("page_id", "url", "html")).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
