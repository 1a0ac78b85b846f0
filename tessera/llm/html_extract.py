"""Main text of web pages by tag-path ratios.

A page is a sequence of text nodes, each with its path of tags from the root.
Nodes of one path are one group: its length ratio is the characters per node,
its punctuation ratio the punctuation marks per node. Long, punctuated text
repeats under few paths, while menus and notices are many short nodes without
punctuation. Both ratios are smoothed along the page, so that a short paragraph
between long ones keeps the company it is in, fused into one score per path and
cut at a part of the best score. The deepest element that holds all selected
nodes is the article (an article or main element around it is a hint, and counts
in the score). Inside it, text stays but for blocks of links and elements named
as something else, which stay only if their path is selected; elements that are
surely something else (navigation, forms, comments...) are never read.

Pages are independent, so this is one pass over the table without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# ---- fixed values: HTML's elements by role, and names that mark what is not the article ----
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("head script style noscript template iframe object svg math canvas audio video map title".split())
ASIDE = frozenset("nav header footer aside form button select textarea menu dialog fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar "
                  "toolbar form".split())
NAMES = frozenset("nav navbar navigation menu menubar topnav subnav breadcrumb breadcrumbs header masthead topbar "
                  "footer colophon bottombar sidebar aside rail ad ads adv advert adverts advertisement "
                  "advertising adsense adsbygoogle adbox adslot adunit banner promo promotion sponsor sponsored cookie "
                  "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
                  "signup login copyright comment comments commentlist respond replies disqus discussion related "
                  "recommended recommendations share sharing social search pagination pager toolbar widget "
                  "widgets".split())
ALWAYS = frozenset("comment comments cookie cookies sidebar advert advertisement newsletter".split())
DOUBTFUL = frozenset("alert discussion header notice notices rail related replies respond search social".split())
MODIFIERS = frozenset("has with without no".split())
ARTICLE_NAMES = frozenset("post entry article content story".split())
CONTAINERS = frozenset("html body main article section div center table tbody thead tr td font".split())
CONTENT = frozenset("content article main body post entry story text page".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key closes an open element of these at once.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
KEEPS_OPEN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",),
              "th": ("table",), "option": ("select",)}
# ------------------------------------------------------------------------------------------------

NAME_PARTS = regex.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = regex.compile(r"[.,;:!?。，、；：！？…]")
#: A tag that the page ends in.
CUT_OFF = regex.compile(r"</?[a-zA-Z][^<>]*\Z")
#: Neighbours that a node's ratio is smoothed over, with weights of a bell curve.
KERNEL = np.exp(-0.5 * np.arange(-2, 3) ** 2)
#: A path is content from this part of the best score; a block is links if they are this part of its characters.
LEAST_SCORE = 0.6
MOST_OF_IT = 0.9
#: Text below an article or main element counts so many times; below a name that speaks against it so much.
ARTICLE_WEIGHT = 4.0
DOUBT_WEIGHT = 0.75


def _own_words(tag: str, attrs: dict[str, str | None]) -> str:
    """Whether the element says that it is not part of the article: "surely", "perhaps" (by a name alone) or ""."""
    if tag in ("html", "body", "article", "main") and "comment" not in (attrs.get("class") or "").lower():
        return ""
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("role") or "").lower() in ROLES:
        return "surely"
    if "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
        return "surely"
    named = [n for n in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split() if _names_an_aside(n)]
    parts = {x.lower() for n in named for x in NAME_PARTS.findall(n)}
    if not named:
        return ""
    return "surely" if NAMES.intersection(parts) - DOUBTFUL else "perhaps"


def _names_an_aside(name: str) -> bool:
    """True for class and id names like ``ad``, ``main-nav``, ``siteFooter`` or ``sidebar-2``.

    What a compound name names stands at its end ("post-comments") or its start ("footer-text");
    "has-sidebar" and "content-with-sidebar" name the page, "entry-header" the article's own head.
    """
    parts = [x.lower() for x in NAME_PARTS.findall(name)]
    if not NAMES.intersection(parts) or MODIFIERS.intersection(parts):
        return False
    if parts[-1] == "header" and ARTICLE_NAMES.intersection(parts):
        return False
    return bool(ALWAYS.intersection(parts)) or parts[0] in NAMES or parts[-1] not in CONTENT


class _Page(HTMLParser):
    """Text nodes of a page in order: (element, path, text, block). Elements and paths are numbered, each with its parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [0]  # open elements; 0 is the page
        self.tags, self.parent, self.last, self.path = [""], [0], [0], [0]  # last: the highest number below an element
        self.out, self.inside, self.doubt, self.linked = [False], [False], [False], [False]
        self.open_at: dict[str, list[int]] = {}  # places of a tag in the stack
        self.blocks_at: list[int] = []  # places of elements that are not inline
        self.paths: dict[tuple[int, str], int] = {}
        self.block = 0
        self.parts: list[str] = []
        self.nodes: list[tuple[int, str, int]] = []

    def updatepos(self, i, j):
        return j  # line numbers are not needed

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def _flush(self) -> None:
        if self.parts:
            text = "".join(self.parts)
            self.parts = []
            if text and not self.out[self.stack[-1]]:
                self.nodes.append((self.stack[-1], text, self.block))

    def _close(self, at: int) -> None:
        while len(self.stack) > at:
            element = self.stack.pop()
            self.last[element] = len(self.tags) - 1
            self.open_at[self.tags[element]].pop()
            if self.blocks_at and self.blocks_at[-1] == len(self.stack):
                self.blocks_at.pop()

    def _last_open(self, tags) -> int:
        return max((self.open_at[t][-1] for t in tags if self.open_at.get(t)), default=0)

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag not in INLINE:
            self.block += 1
            if tag not in VOID and tag not in ("button", "object") and self.blocks_at:
                if self.tags[self.stack[self.blocks_at[-1]]] == "p":
                    self._close(self.blocks_at[-1])
            for other in CLOSES.get(tag, ()):
                at = self._last_open((other,))
                if at and self._last_open(KEEPS_OPEN[tag]) < at:
                    self._close(at)
        if tag in VOID:
            return
        attrs, up = dict(attrs), self.stack[-1]
        inside = self.inside[up] or tag in ("article", "main")
        # the heading of an article may stand in a header of its own
        out = self.out[up] or (tag in ASIDE and not (tag == "header" and self.inside[up]))
        if self.tags[up] == "header" and tag in HEADINGS and not self.out[up]:
            out = False
        named = _own_words(tag, attrs)
        # inside an article a name is a hint only, unless it leaves no doubt
        unsure = named == "perhaps" and self.inside[up]
        out = out or tag in UNSEEN or (bool(named) and not unsure)
        path = self.path[up]
        if tag not in INLINE or tag == "a":
            name = tag + "".join("." + c for c in (attrs.get("class") or "").split()[:3])
            path = self.paths.setdefault((path, name), len(self.paths) + 1)
        self.stack.append(len(self.tags))
        self.open_at.setdefault(tag, []).append(len(self.stack) - 1)
        if tag not in INLINE:
            self.blocks_at.append(len(self.stack) - 1)
        for of_element, value in ((self.parent, up), (self.tags, tag), (self.last, 0), (self.path, path), (self.out, out),
                                  (self.inside, inside), (self.doubt, self.doubt[up] or unsure), (self.linked, self.linked[up] or tag == "a")):
            of_element.append(value)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("div", "p", "span", "a"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if tag not in INLINE:
            self.block += 1
        if self.open_at.get(tag):
            self._close(self.open_at[tag][-1])

    def handle_data(self, data):
        self.parts.append(data)

    def finish(self) -> None:
        self.close()
        self._flush()
        self._close(1)
        self.last[0] = len(self.tags) - 1


def _smooth(values: np.ndarray) -> np.ndarray:
    n = len(values)
    around = np.convolve(values, KERNEL)[2 : n + 2]
    return around / np.convolve(np.ones(n), KERNEL)[2 : n + 2]


def content_nodes(paths: np.ndarray, lengths: np.ndarray, marks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Which nodes are content: ratios per path, bare and smoothed along the page, fused per path and cut."""
    _, group = np.unique(paths, return_inverse=True)
    count = np.bincount(group)
    fused = np.ones(len(count))
    for amount, least in ((lengths, 0.0), (marks, 0.2)):
        ratio = np.bincount(group, amount) / count
        fused *= (ratio + least) * np.bincount(group, _smooth(ratio[group]) + least) / count
    score = fused**0.25 * (np.bincount(group, weights) / count)
    return (score >= LEAST_SCORE * score.max())[group]


def _container(page: _Page, elements: np.ndarray, chosen: np.ndarray) -> int:
    """The deepest element that holds all chosen nodes; the article or main element around it, if there is one."""
    low, high = int(elements[chosen].min()), int(elements[chosen].max())
    at = low
    while page.last[at] < high or (page.tags[at] not in CONTAINERS and at):
        at = page.parent[at]
    hint, up = at, at
    while up:
        if page.tags[up] in ("article", "main") and (page.tags[hint] != "article"):
            hint = up
        up = page.parent[up]
    return hint


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by one space; empty if there is none."""
    page = _Page()
    page.feed(CUT_OFF.sub("", html or ""))
    page.finish()
    texts = [" ".join(text.split()) for _, text, _ in page.nodes]
    seen = [i for i, t in enumerate(texts) if t]
    if not seen:
        return ""
    elements = np.array([page.nodes[i][0] for i in seen])
    lengths = np.array([len(texts[i]) for i in seen], float)
    marks = np.array([len(PUNCTUATION.findall(texts[i])) for i in seen], float)
    doubt, linked = (np.array(flags)[elements] for flags in (page.doubt, page.linked))
    weights = np.where(np.array(page.inside)[elements], ARTICLE_WEIGHT, 1.0) * np.where(doubt, DOUBT_WEIGHT, 1.0)
    paths = np.array(page.path)[elements]
    chosen = content_nodes(paths, lengths, marks, weights)
    box = _container(page, elements, chosen)
    kept = (elements >= box) & (elements <= page.last[box])
    # a block of nothing but links goes with its path's score; so does what its name speaks against
    block = np.array([page.nodes[i][2] for i in seen])
    _, group = np.unique(block, return_inverse=True)
    all_links = (np.bincount(group, lengths * linked) >= MOST_OF_IT * np.bincount(group, lengths))[group]
    kept &= chosen | ~(all_links | doubt)
    # the title before the element, if nothing but text stands between them
    first = int(np.flatnonzero(kept)[0])
    for k in range(first - 1, -1, -1):
        if all_links[k] or doubt[k] or not page.tags[box] or page.inside[elements[k]] != page.inside[elements[first]]:
            break
        up = int(elements[k])
        while page.tags[up] in INLINE:
            up = page.parent[up]
        if page.tags[up] == "h1":
            kept[k:first] = True
            break
    inside = {seen[k] for k in np.flatnonzero(kept)}
    blocks: list[list[str]] = []
    last = None
    for i, (_, text, number) in enumerate(page.nodes):
        if i in inside or (not texts[i] and last == number):
            if number != last:
                blocks.append([])
                last = number
            blocks[-1].append(text)
    return " ".join(w for b in blocks for w in "".join(b).split())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
            carry: Sequence[str] = ()) -> DataFrame:
    """(id, carried columns, text, n_chars) of every row: the article's text from the whole html.

    Character references are decoded, white space inside a block is one space. Null and empty html, and
    pages without an article, give the empty text; html without tags is its own text; broken markup is
    read as browsers do, as far as it matters here; repeated rows are extracted each; null ids are
    carried; columns not named in ``carry`` are not read, carried ones with the names of the two new columns
    are replaced; an empty table gives no rows. A page is held as its elements and text nodes, numbered, so
    its memory follows its length at any depth.
    """
    kept = [id_col, *[c for c in carry if c not in (id_col, "text", "n_chars")]]
    schema = pages.select(kept).schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return pages.select(*kept, html_col).mapInArrow(run, schema)
