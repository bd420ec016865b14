"""Main text of web pages: parser events, text-to-tag ratio, Gaussian smoothing, threshold clusters.

A streaming pass of the standard library's parser cuts a page into lines (one a block element) and counts the
tags met on the way to each. The text-to-tag ratios are smoothed by a Gaussian; lines above a threshold
are content, and runs of them form clusters. The region is what holds most of the clustered text: articles side by
side, or a main element, else the deepest element around nearly all of it. Every line of the region that is not
in an excluded element belongs to the article, also the short ones between long paragraphs.

Elements know their parent by number, and open elements are counted by name, so that time and memory grow with the page, not
with its depth.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_lines, map_arrow, table

# Element names and the words of class, id and role that mark what is not the article.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg annotation annotation-xml canvas iframe object audio video map head title".split())
EXCLUDED = frozenset("nav header footer aside form button select textarea dialog menu".split())
CLOSES_P = BLOCKS - {"br", "body", "html", "option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
MARKED = re.compile(
    r"(?:^|(?<=[\s_-]))(ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|signup|paywall|nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|widget"
    r"|footer|header|masthead|topbar|toolbar|comments?|disqus|replies|respond|share|sharing|social|related|recommend\w*|teasers?|pagination|pager|copyright|complementary|contentinfo|search)(?=$|[\s_-])",
    re.I,
)
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|respond)(?:$|[\s_-])", re.I)
SAYS_LITTLE = ("has-", "no-", "with-", "without-", "is-", "not-")  # classes that tell of other elements
TOPIC = ("category-", "tag-", "type-", "status-", "format-")  # classes of articles that tell what they are about
TITLE = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.I)
SOFT = re.compile(r"^(?:related|recommend\w*|search|share|sharing|social|header|masthead|alert|notices?|banner|widget|copyright)$", re.I)  # words that an article's own sections may bear too
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption caption summary".split())
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
FIXED = frozenset("aside form footer dialog".split())  # elements that an article inside them doesn't leave
LINKED = 0.3  # share of linked text from which a softly marked section is no part of the article
SIGMA, REACH = 1.5, 4  # of the Gaussian, in lines
SENTENCE = re.compile(r"[.!?…。！？:：]\W*$")
THRESHOLD = 0.5  # of the standard deviation of the smoothed ratios
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Element:
    tag: str
    number: int
    out: bool  # excluded, itself or by an element around it
    silent: bool
    comment: bool
    marked: bool = False  # excluded by its own name or attributes
    fixed: bool = False  # in an element that is never taken for unclosed
    text: bool = False  # the nearest block holds running text


@dataclass
class Line:
    text: str
    tags: int
    element: int
    linked: int


class Ends(HTMLParser):
    """Which elements, numbered as they open, may lack their end tag: they or an element of their name around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.own: dict[str, list[int]] = {}  # open elements of each name
        self.closed: set[int] = set()
        self.around: dict[int, int] = {}
        self.n = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in VOID:
            return
        self.n += 1
        same = self.own.setdefault(tag, [])
        self.around[self.n] = same[-1] if same else 0
        same.append(self.n)
        self.open.append((tag, self.n))

    def handle_endtag(self, tag: str) -> None:
        if not self.own.get(tag):
            return
        self.closed.add(self.own[tag][-1])
        while True:
            name, _ = self.open.pop()
            self.own[name].pop()
            if name == tag:
                return

    def missing(self, number: int) -> int:
        """The innermost element without end tag that can have lent this one its own; 0 if none."""
        seen = []
        while number in self.closed:
            seen.append(number)
            number = self.around[number]
        for n in seen:  # closed elements stay closed: the next search starts further out
            self.around[n] = number
        return number


class PageLines(HTMLParser):
    """Lines of a page from parser events, with the element around each."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html, self.ends, self.sure = html, None, None
        self.stack: list[Element] = [Element("#page", 0, False, False, False)]
        self.counts: dict[str, int] = {}  # open elements by name
        self.names, self.parents = ["#page"], [0]
        self.soft: set[int] = set()
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.links = self.link_text = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        top = self.stack[-1]
        if text and not top.out and not top.silent:
            self.lines.append(Line(text, self.tags, top.number, self.link_text))
            self.tags = 0
        self.parts, self.link_text = [], 0

    def _inside(self) -> bool:
        return bool(self.counts.get("article") or self.counts.get("main"))

    def _marks(self, tag: str, attrs) -> tuple[bool, bool, bool]:
        """(excluded, reader comments, softly marked) by the element's own name and attributes."""
        own = {k: v or "" for k, v in attrs}
        hidden = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "")
        if tag in ("html", "body", "main"):
            return False, False, False
        if tag not in BLOCKS and (self.stack[-1].text or any(x and not x.isspace() for x in self.parts)):
            return hidden or tag in EXCLUDED, False, False  # words of a sentence, whatever their class
        said = " ".join(own.get(k, "") for k in ("class", "id", "role"))
        drop = SAYS_LITTLE + TOPIC if tag == "article" else SAYS_LITTLE
        said = " ".join(w for w in said.split() if not w.lower().startswith(drop))
        inside = self._inside()
        named = tag in EXCLUDED and not (tag == "header" and inside)
        if inside:  # an article's own header holds its title
            said = TITLE.sub(" ", said)
        marks = [m.group(1) for m in MARKED.finditer(said)] if said.strip() and not (inside and tag in HEADINGS) else []
        # Inside an article a compound name such as related-work may be a section's topic: its content decides.
        soft = inside and bool(marks) and not named and not hidden and tag in ("section", "div") and all(SOFT.match(m) for m in marks) and not any(MARKED.fullmatch(w) for w in said.split())
        return named or hidden or (bool(marks) and not soft), bool(COMMENT.search(said)), soft

    def _never_closed(self) -> bool:
        """Whether all marked elements around may lack their end tag; the page is read once more for that."""
        if self.sure and self.sure[0] < len(self.stack) and self.stack[self.sure[0]].number == self.sure[1]:
            return False
        if self.ends is None:
            self.ends = Ends()
            self.ends.feed(self.html)
            self.ends.close()
        lacking, k = set(), len(self.stack) - 1
        while self.stack[k].out:
            if self.stack[k].marked:
                lacking.add(self.ends.missing(self.stack[k].number))
                if 0 in lacking:
                    self.sure = (k, self.stack[k].number)  # closed, and stays so
                    return False
            k -= 1
        self.ends.closed |= lacking  # each missing end tag explains one place only
        return True

    def _pop(self) -> None:
        self.counts[self.stack.pop().tag] -= 1

    def _cut(self, tag: str) -> None:
        """Close elements up to the innermost of this name, which is open."""
        while self.stack[-1].tag != tag:
            self._pop()
        self._pop()

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if self.counts.get("head") and tag not in IN_HEAD and self.counts.get("svg", 0) + self.counts.get("template", 0) == 0:
            self._cut("head")  # its end tag may be left out
        if tag in CLOSES_P:
            self._close_open("p", {"article", "section", "div", "td", "th", "li", "blockquote", "main", "body", "aside", "nav", "footer", "header", "form"})
        if tag == "li":
            self._close_open("li", {"ul", "ol", "menu"})
        top = self.stack[-1]
        if tag in ("article", "main") and top.out and not top.comment and not top.fixed and self._never_closed():
            # An advert, menu or header that was never closed doesn't swallow the article.
            while self.stack[-1].out:
                self._pop()
        if tag in VOID:
            return
        out, comment, soft = self._marks(tag, attrs)
        top = self.stack[-1]
        number = len(self.names)
        self.names.append(tag)
        self.parents.append(top.number)
        if soft:
            self.soft.add(number)
        text = tag in TEXT_BLOCKS if tag in BLOCKS else top.text
        self.stack.append(Element(tag, number, out or top.out, top.silent or tag in SILENT, comment or top.comment, out, top.fixed or tag in FIXED, text))
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close_open(self, tag: str, within: set[str]) -> None:
        if not self.counts.get(tag):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self._cut(tag)
                return
            if self.stack[k].tag in within:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if self.counts.get(tag):
            self._cut(tag)

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if top.out or top.silent:
            return
        self.parts.append(data)
        if any(e.tag == "a" for e in self.stack[-3:]):
            self.link_text += len(data)


def content_lines(found: list[Line]) -> np.ndarray:
    """Which lines are content: smoothed text-to-tag ratio above a share of its standard deviation."""
    ratio = np.array([len(x.text) / max(1, x.tags) for x in found])
    offsets = np.arange(-REACH, REACH + 1)
    kernel = np.exp(-(offsets**2) / (2 * SIGMA**2))
    weight = np.convolve(np.ones(len(ratio)), kernel, "full")[REACH : REACH + len(ratio)]
    smooth = np.convolve(ratio, kernel, "full")[REACH : REACH + len(ratio)] / weight
    return smooth >= THRESHOLD * smooth.std()


def totals(found: list[Line], amount: list[int], parents: list[int]) -> list[int]:
    """For each element the sum of the amounts of all lines in it, at any depth: children have higher numbers."""
    out = [0] * len(parents)
    for line, n in zip(found, amount, strict=True):
        out[line.element] += n
    for e in range(len(parents) - 1, 0, -1):
        out[parents[e]] += out[e]
    return out


def under(chosen: set[int], parents: list[int]) -> list[bool]:
    """For each element whether it is one of the chosen or in one."""
    out = [0 in chosen] * len(parents)
    for e in range(1, len(parents)):
        out[e] = e in chosen or out[parents[e]]
    return out


def without_link_sections(page: PageLines) -> list[Line]:
    """The lines, less those of softly marked sections that are made of links, of no content, or of no sentence."""
    if not page.soft:
        return page.lines
    content = content_lines(page.lines)
    size = totals(page.lines, [len(x.text) for x in page.lines], page.parents)
    linked = totals(page.lines, [x.linked for x in page.lines], page.parents)
    good = totals(page.lines, [len(x.text) if c else 0 for x, c in zip(page.lines, content.tolist(), strict=True)], page.parents)
    said = totals(page.lines, [int(bool(SENTENCE.search(x.text))) for x in page.lines], page.parents)
    gone = under({e for e in page.soft if linked[e] >= LINKED * size[e] or 2 * good[e] < size[e] or not said[e]}, page.parents)
    return [x for x in page.lines if not gone[x.element]]


def region(found: list[Line], content: np.ndarray, names: list[str], parents: list[int]) -> list[int]:
    """The elements whose lines are the article: several only if they are articles side by side."""
    mass = totals(found, [len(x.text) if good else 0 for x, good in zip(found, content.tolist(), strict=True)], parents)
    if not mass[0]:
        return [0]
    beside: dict[int, list[int]] = {}
    for e, name in enumerate(names):
        if mass[e] and name == "article":
            beside.setdefault(parents[e], []).append(e)
    for groups in (list(beside.values()), [[e] for e, name in enumerate(names) if mass[e] and name == "main"]):
        best = max(groups, key=lambda g: (sum(mass[e] for e in g), -g[0]), default=[])
        if best and sum(mass[e] for e in best) >= 0.5 * mass[0]:
            return best
    # Elements are numbered as they open: the last is the deepest.
    return [max(e for e in range(len(names)) if mass[e] >= 0.9 * mass[0] and names[e] != "p")]


def headline(found: list[Line], chosen: set[int], names: list[str], parents: list[int]) -> set[int]:
    """The heading that stands just beside the chosen element, before it, where the element has none of its own."""
    first = min(chosen)
    inside = under(chosen, parents)
    if first == 0 or any(inside[x.element] and names[x.element] in ("h1", "h2") for x in found):
        return set()
    before = [x.element for x in found if names[x.element] == "h1" and x.element < first and parents[x.element] == parents[first]]
    return set(before) if len(set(before)) == 1 else set()


def main_text(html: str) -> str:
    """The article's text: blocks in page order, one space between them; empty if there is none."""
    page = PageLines(html)
    page.feed(html)
    page.close()
    page.flush()
    found = without_link_sections(page)
    if not found:
        return ""
    content = content_lines(found)
    chosen = set(region(found, content, page.names, page.parents))
    title = headline(found, chosen, page.names, page.parents)
    inside = under(chosen | title, page.parents)
    named = page.names[min(chosen)] in ("article", "main")
    # Without a named region, unmarked menus are lines that are links and little else, off the clusters.
    kept = [x for x, good in zip(found, content.tolist(), strict=True) if inside[x.element] and (named or good or x.linked < 0.8 * len(x.text))]
    return " ".join(x.text for x in kept)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages.

    Null html counts as empty and gives an empty text, as does a page without an article. Null ids, repeated rows and
    other columns do no harm; an empty table gives an empty result. Whole pages are read, without a shuffle.
    """

    def work(batch: pa.RecordBatch) -> tuple[None, list]:
        texts = [main_text(x.decode()) for x in arrow_lines(batch["html"])]
        return None, [texts, [len(t) for t in texts]]

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return map_arrow(rows, ["page_id", "url"], work, "text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
