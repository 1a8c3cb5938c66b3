"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to one line for each block element; lines of menus, adverts and
other furniture become empty lines. Lengths are summed over sliding windows of lines:
a region begins where the sum surges and ends where it dives. Regions are
where unlinked text is dense. In a page without article or main element all lines from
the first dense region to the last are kept, and the other lines of the smallest
container around them, except link-only ones of menus beside the text. Where there are articles, their lines decide: the largest one
is kept, and those in the same container where the sums surge.
"""

from __future__ import annotations

import html
import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import table
from ledgerloom.llm.registry import query

#: Lines of a window, and the sum of unlinked characters in a window that makes a surge outside article elements.
WINDOW = 3
SURGE = 80

# Element names of HTML, and words of class, id and role attributes that mark furniture.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "title", "textarea", "object", "canvas")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("head nav menu footer aside form button select option dialog audio video map".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner promo promotion sponsor sponsored nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices "
    "notification popup modal newsletter subscribe subscription signup login comment comments commentlist respond disqus "
    "discussion reply replies related recommended share sharing social widget toolbar pagination pager contentinfo "
    "complementary search dialog alert alertdialog copyright".split()
)
#: First parts of compound class names that only say what a container has.
ABOUT = frozenset("has with no without is".split())
#: Other parts of compound class names that end in a mark and are furniture (site-footer, main-nav, post-comments).
QUALIFIERS = frozenset(
    "site page main primary secondary top bottom left right upper lower header footer side global local post posts entry "
    "article blog user users email mobile desktop sticky fixed floating inline google dfp gpt text display wp block js the "
    "sub mega skip social share cookie newsletter ad nav menu comment".split()
)
#: Parts after a mark that leave it furniture (comment-list, share-buttons); any other word there is a topic.
FOLLOWERS = frozenset(
    "area bar block body box button buttons card container content feed form group holder icons inner item items label "
    "layer line link links list message module outer overlay panel posts row section slot space stories strip text title "
    "unit wrap wrapper zone".split()
)
#: Elements whose id is the target of a link to a part of the text, never a sign of furniture.
ANCHORED = frozenset("p a span li dt dd".split()) | HEADINGS
#: What the id of a section outside of articles may say: sections are linked to by topic.
THREADS = frozenset("comments commentlist respond disqus".split())
#: Marks of comment sections, which may hold more text than the page's article, and articles of their own.
COMMENTS = frozenset("comment comments commentlist respond disqus discussion reply replies".split())
#: Elements that hold blocks. One with a single line is a paragraph.
CONTAINERS = frozenset("html body main article section div center td".split())
#: Elements whose class says what surrounds the text, never that they are furniture.
ROOTS = frozenset("html body main".split())
#: Elements whose text does not count as text of the page.
UNCOUNTED = FURNITURE - {"form"} | {"header"}

# A tag that never ends reaches to the end of the page, as in browsers; no part of the page is read twice.
_DROPPED = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg\b[^>]*+(?<=/)>|<(" + "|".join(RAW) + r")\b[^>]*+(?:>.*?(?:</\1\s*+>|\Z)|\Z)|<[!?][^>]*+(?:>|\Z)", re.S | re.I
)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>")
_MARKED = re.compile(r"(?:^|[\s/])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)


def _tags(page: str):
    """The tags of a page; behind its last > none can end, and what looks like one is text."""
    return _TAG.finditer(page, 0, page.rfind(">") + 1)


def _mark(attributes: str, ids: frozenset[str]) -> str:
    """The mark in the class and role names of an element, or one of ``ids`` in its id, or an empty text; marks of comments go first.

    A name marks furniture if it is a mark with nothing but known parts around it.
    """
    found = ""
    for m in _MARKED.finditer(attributes):
        allowed = ids if m[1].lower() == "id" else MARKS
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
            at = next((i for i, x in enumerate(parts) if x in MARKS and x not in QUALIFIERS), None)
            at = next((i for i in reversed(range(len(parts))) if parts[i] in MARKS), None) if at is None else at
            if at is None or parts[at] not in allowed or parts[0] in ABOUT:
                continue
            before, after = parts[:at], parts[at + 1 :]
            if all(x in QUALIFIERS or x in MARKS or x.isdigit() for x in before) and all(x in FOLLOWERS or x in MARKS or x.isdigit() for x in after):
                found = parts[at] if not found or parts[at] in COMMENTS else found
    return found


def _furniture(page: str) -> set[int]:
    """Where the elements begin that are furniture by their names of class, id and role, forms, and articles in articles.

    Articles inside an article are comments on it, unless they hold as much text as the article does outside of them.
    Inside an article, and for elements that links lead to, an id says nothing.

    Not dropped are articles outside of articles, and what holds the main element, most of the
    unlinked text outside of comments, or the page's only articles and all but a few characters.
    """
    stack: list[tuple[str, int, bool]] = []  # name, its number in marked or -1, whether text in it does not count
    opened: dict[str, int] = {}
    marked: list[list] = []  # place, mark, then text, articles, mains and all articles before it and up to its end
    counts = [0, 0, 0, 0]
    at = links = 0
    outer: list[list[int]] = []  # of each outermost article: its text outside of inner articles
    inner: list[list[int]] = []  # of each article right inside one of these: place, number of the outer one, text

    def close(name: str) -> None:
        nonlocal links
        while opened.get(name):
            top, number, _ = stack.pop()
            opened[top] -= 1
            links -= top == "a"
            if number >= 0:
                marked[number] += counts
            if top == "article" and opened["article"] == 0:
                outer[-1][0] += counts[0]
            elif top == "article" and opened["article"] == 1:
                inner[-1][2] += counts[0]
                outer[-1][0] -= inner[-1][2]
            if top == name:
                break

    for m in _tags(page):
        void = bool(stack) and stack[-1][2]
        if m.start() > at and not links:
            counts[0] += 0 if void else len(page[at : m.start()].strip())
        at = m.end()
        name = (m[2] or "").lower()
        if not name or name in VOID:
            continue
        if m[1]:
            close(name)
            continue
        if name in BLOCKS:
            close("p")
        inside = opened.get("article", 0) > 0
        ids = frozenset() if inside or name in ANCHORED else THREADS if name == "section" else MARKS
        mark = "" if name in ROOTS else _mark(m[3] or "", ids)
        counts[3] += name == "article" and not inside and mark not in COMMENTS
        mark = "" if name == "article" and not inside else mark
        number = -1
        if mark or name == "form":
            number = len(marked)
            marked.append([m.start(), mark, *counts])
        in_comments = mark in COMMENTS and name != "article"
        counts[1] += name == "article" and not inside and not (void or in_comments)
        counts[2] += name == "main"
        if name == "article" and not inside:
            outer.append([-counts[0]])
        elif name == "article" and opened["article"] == 1:
            inner.append([m.start(), len(outer) - 1, -counts[0]])
        stack.append((name, number, void or in_comments or name in UNCOUNTED))
        opened[name] = opened.get(name, 0) + 1
        links += name == "a"
    if not links and not (stack and stack[-1][2]):
        counts[0] += len(page[at:].strip())
    while stack:
        close(stack[-1][0])
    dropped = set()
    for place, mark, *c in marked:
        text, articles, mains, every = (c[k + 4] - c[k] for k in range(4))
        rest = counts[0] - text
        if mark in COMMENTS:
            kept = mains or not rest or every and not counts[1] and rest < SURGE
        else:
            kept = mains or text > rest or articles == counts[1] > 0 and rest < SURGE
        if not kept:
            dropped.add(place)
    return dropped | {place for place, around, text in inner if text < outer[around][0]}


def _spaced(pieces: list[str]) -> str:
    return " ".join(html.unescape("".join(pieces)).split())


class _Lines:
    """One line for each block with text: text, unlinked length, number of the article (0: none) and of the container it is in."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.plain: list[int] = []
        self.article: list[int] = []
        self.container: list[int] = []
        self.beside: dict[int, int] = {}  # the container around each article
        self.boxes: list[list[int]] = [[0, -1, -1, 1]]  # of each container: first line, end, parent, whether a root
        self._pieces: list[str] = []
        self._plain: list[str] = []

    def add(self, piece: str, linked: bool) -> None:
        self._pieces.append(piece)
        if not linked:
            self._plain.append(piece)

    def end(self, article: int, container: int) -> None:
        text = _spaced(self._pieces)
        if text:
            self.text.append(text)
            self.plain.append(len(text) if len(self._plain) == len(self._pieces) else len(_spaced(self._plain)))
            self.article.append(article)
            self.container.append(container)
        self._pieces, self._plain = [], []

    def gap(self, container: int) -> None:
        """One empty line where furniture was left out."""
        self.text.append("")
        self.plain.append(0)
        self.article.append(0)
        self.container.append(container)

    def open_box(self, name: str, parent: int) -> int:
        self.boxes.append([len(self.text), -1, parent, name in ("html", "body")])
        return len(self.boxes) - 1

    def close_boxes(self) -> None:
        """Containers that were not closed end with the page."""
        for box in self.boxes:
            box[1] = len(self.text) if box[1] < 0 else box[1]


def lines_of(page: str) -> _Lines:
    """The lines of a page that have text, and an empty one for each piece of furniture."""
    page = _DROPPED.sub("", page)
    lines = _Lines()
    dropped = _furniture(page)
    stack: list[tuple[str, int, int, int]] = []  # name, and depth of furniture, article and container around it
    opened: dict[str, int] = {}
    skip = article = articles = links = box = 0
    has_article = re.search(r"<article\b", page, re.I) is not None
    at = 0

    def close(name: str) -> None:
        nonlocal skip, article, links, box
        while opened.get(name):
            top, skip_before, article_before, box_before = stack.pop()
            opened[top] -= 1
            links -= top == "a"
            if box != box_before:
                lines.boxes[box][1] = len(lines.text)
            skip, article, box = skip_before, article_before, box_before
            if top == name:
                break

    for m in _tags(page):
        if m.start() > at and not skip:
            lines.add(page[at : m.start()], links > 0)
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            lines.end(article, box)
        elif name in ("br", "td", "th", "option"):
            lines.add(" ", False)
        if m[1]:
            close(name)
            continue
        if name in VOID:
            continue
        if name in BLOCKS:
            close("p")
        stack.append((name, skip, article, box))
        opened[name] = opened.get(name, 0) + 1
        links += name == "a"
        inside = article > 0
        if name in CONTAINERS and not skip:
            box = lines.open_box(name, box)
        if name in FURNITURE and name != "form" or m.start() in dropped:
            if not skip:
                lines.end(article, box)
                lines.gap(box)
            skip += 1
        elif name == "header":
            skip += 1
        elif name in HEADINGS and inside and skip == 1 and any(x[0] == "header" and x[2] for x in stack[-8:-1]):
            skip = 0  # the headline in the header of an article
        elif (name == "article" or name == "main" and not has_article) and not inside and not skip:
            articles += 1
            article = articles
            lines.beside[article] = stack[-1][3]
    if at < len(page) and not skip:
        lines.add(page[at:], links > 0)
    lines.end(article, box)
    lines.close_boxes()
    return lines


def regions(lengths: list[int], surge: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """[start, end) from each surge of the windowed sums to its dive, without empty lines at the ends."""
    found, start, total, n = [], None, 0, len(lengths)
    for i in range(n + 1):
        # the sum over lines i to i + window - 1
        total = sum(lengths[0:window]) if i == 0 else total - lengths[i - 1] + (lengths[i + window - 1] if i + window - 1 < n else 0)
        if i < n and total >= surge and start is None:
            start = i
        elif start is not None and (i == n or total == 0):
            first, last = start, min(i, n)
            while first < last and not lengths[first]:
                first += 1
            found.append((first, last))
            start = None
    return found


def _dense_lines(lines: _Lines) -> list[int]:
    """The lines to keep of a page without article: from the first dense region to the last, and what is beside them."""
    spans = regions(lines.plain, SURGE)
    if not spans:
        return list(range(len(lines.text)))
    first, last = spans[0][0], spans[-1][1]
    texts = [0, *accumulate(bool(t) for t in lines.text)]

    def around(line: int, end: int) -> int:
        """The smallest container with the lines up to ``end`` that is not the paragraph of a single line."""
        box = lines.container[line]
        while box and (lines.boxes[box][1] < end or texts[lines.boxes[box][1]] - texts[lines.boxes[box][0]] <= 1):
            box = lines.boxes[box][2]
        return box

    dense = {around(i, i + 1) for i in range(first, last) if lines.plain[i]}
    start, stop, _, _ = lines.boxes[around(first, last)]

    def kept(i: int) -> bool:
        if first <= i < last or lines.plain[i]:
            return True
        box = around(i, i + 1)
        return box in dense and not lines.boxes[box][3]

    return [i for i in range(start, stop) if kept(i)]


def main_text(page: str | None) -> str:
    """The main text, blocks joined by an empty line; empty for null, empty and textless pages."""
    if not page:
        return ""
    lines = lines_of(page)
    inside = [len(t) if a else 0 for t, a in zip(lines.text, lines.article, strict=True)]
    if any(inside):
        sums: dict[int, int] = {}
        for a, n in zip(lines.article, inside, strict=True):
            sums[a] = sums.get(a, 0) + n
        largest = max((a for a in sums if a), key=lambda a: (sums[a], -a))
        own: dict[int, list[int]] = {}
        for a, n in zip(lines.article, lines.plain, strict=True):
            own.setdefault(a, []).append(n)
        beside = [a for a in sums if a and lines.beside[a] == lines.beside[largest]]
        chosen = {largest, *(a for a in beside if regions(own[a], SURGE))}
        kept = [i for i, a in enumerate(lines.article) if a in chosen]
    else:
        kept = _dense_lines(lines)
    return "\n\n".join(lines.text[i] for i in kept if lines.text[i])


@F.pandas_udf(T.StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pages.map(main_text, na_action=None)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with text and n_chars added (replacing such columns); the html column is left out.

    Null, empty and textless pages have an empty text of 0 characters.
    """
    keep = [f"`{c}`" for c in pages.columns if c.lower() not in ("text", "n_chars") and c != column]
    text: Column = _main_text(F.col(column))
    return pages.select(*keep, text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


@query()
def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, folder, "pages").select("page_id", "url", "html"))
