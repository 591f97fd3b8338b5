"""Main text of web pages by two passes over their blocks.

A page is read as HTML is: names of tags end at white space, `/` or `>`; a new paragraph, list
item, row or cell ends the open one; an end tag ends what was left open inside. Blocks are the
texts between block-level tags.

Pass one decides what a block's own text shows: mostly links (link density): bad, but for headings and
whole sentences of an article; long and dense in stop words: good, unless it stands in a marked place.
Everything else is ambiguous: short blocks, and long ones of an unknown language. Pass two gives an ambiguous block the label of the
nearest decided block of its section; at equal distance a good one counts, and a heading takes that
of the next decided one. A section is an article (or the main part), a marked place, or the rest
of the page. Where a section has no decided block, its place decides: an article is good; a marked
place is bad, and so is the rest, but if nothing is good on a page without articles, the rest stays.

Marked places are elements whose tag or class, id or role is that of menus, headers, footers,
sidebars, notices, adverts, forms and reader comments. A name counts as a whole: each of its words must be
a mark or one that stands beside them (site-footer, ad-slot), so ad-free or recommended-reading is none. The
text may overrule a mark, but that of comments: one of layout (sidebar, search, header) if the element holds
most of the text that pass one finds good and no article stands outside marked places, any inside an
article if the element holds most good text and the article has none besides. An article or main part
inside a marked place, but comments, is not marked.

Text: character references decoded, white space to one space, blocks joined by one space.

Edge cases: null and empty pages give an empty text. Unclosed scripts, styles and comments run to
the end of the page, other unclosed elements to the end of what encloses them; a tag that the page
breaks off is dropped. Pages of any length are read once, from left to right, in one task each.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from postlake.llm.common import map_text, table

#: Limits of pass one: characters of a short block, link density, stop-word density.
SHORT = 70
MAX_LINKS = 0.5
MIN_STOPS = 0.2
#: Least share of a page's good text in an element whose layout mark is dropped.
MOST = 2 / 3

#: Names of HTML elements by their role.
TO_THE_END = frozenset("script style textarea title".split())
SKIPPED = TO_THE_END | frozenset("noscript template svg math iframe object select canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset(("article", "main"))
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that no end tag and no implied end reaches across.
SCOPE = frozenset("html body table td th caption".split())
#: What a start tag ends: the names it ends, and the elements that shield them.
_LIST, _CELLS = frozenset(("ul", "ol", "menu")), frozenset(("td", "th"))
ENDS = {
    "li": (frozenset(("li",)), _LIST),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "td": (_CELLS, frozenset(("tr", "table"))),
    "th": (_CELLS, frozenset(("tr", "table"))),
    **{t: (frozenset(("thead", "tbody", "tfoot")), frozenset(("table",))) for t in ("thead", "tbody", "tfoot")},
}
#: Elements that may stand in a paragraph, beside inline ones; all others end it.
IN_PARAGRAPH = frozenset(("button",))

#: Tags, and words of class, id and role, that mark what is not the article.
MARKED_TAGS = frozenset("nav footer aside button menu dialog".split())
LAYOUT_TAGS = frozenset("form fieldset header".split())
MARKS = frozenset(
    """ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion
    breadcrumb breadcrumbs cookie cookies consent gdpr notice popup modal overlay newsletter
    subscribe signup login discussion related recommended contentinfo pagination copyright""".split()
)
LAYOUT = frozenset("banner nav navbar navigation menu header masthead footer sidebar aside widget alert share sharing social search toolbar".split())
COMMENTS = frozenset("comment comments reply replies disqus respond commentlist".split())
_ANY = MARKS | LAYOUT | COMMENTS
#: Words that may stand beside marks in a name; any other word, as in ad-free or discussion-paper, makes a name of its own.
BESIDE = frozenset(
    """site page main global top bottom left right upper lower inner outer primary secondary sticky fixed mobile desktop post posts article
    articles entry reader readers user users box boxes section sections list lists area areas wrap wrapper container block bar strip slot
    unit zone panel pane group row col column content item items link links form text title heading body cell button buttons icon icons""".split()
)
#: Frequent words of English, German, French and Spanish.
STOPS = frozenset(
    """the of and to a in is it that for on was with as be at by this are from or an have not but he she they you we
    der die das und in zu den von mit ist des im nicht ein eine einer als auch es an auf für sich dem bei wird sie
    le la les de des et un une du en que qui dans pour pas au sur est par plus avec ce il elle ne se
    el los las y una por con para no su al lo como más pero sus del""".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_EMPTY = re.compile(r"""(?:^|[\s"'])/$""")
_WORD = re.compile(r"[^\W\d_]+")
_CLOSING = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in SKIPPED}


class Block(NamedTuple):
    """A text, its characters that are no white space, those in links, the section (number of the
    article or -1), the innermost marked place (or -1), and whether it is a heading (2: of rank one)."""

    text: str
    size: int
    links: int
    article: int
    place: int
    heading: int


class Place(NamedTuple):
    """A marked element: the marked one around it (or -1), whether its mark is one of layout, is of comments, and stands inside an article."""

    outer: int
    layout: bool
    comments: bool
    inside: bool

    @property
    def soft(self) -> bool:
        """Whether the page's text may overrule the mark."""
        return self.layout or (self.inside and not self.comments)


def marks(attrs: str) -> set[str]:
    """Marks among the names in the class, id and role attributes: names of which each word is a mark or may stand beside one, and a number ends them at most."""
    if "=" not in attrs:
        return set()
    out = set()
    for m in _NAMES.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = [w for w in re.split(r"[^a-z0-9]+", name) if not w.isdigit()]
            if all(w in _ANY or w in BESIDE or not w for w in words):
                out.update(w for w in words if w in _ANY)
    return out


def _solid(pieces: list[str]) -> int:
    return sum(map(len, "".join(pieces).split()))


class _Reader:
    """Reads a page from left to right; open elements are (name, article, place, heading)."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.places: list[Place] = []
        self.articles = 0
        self.open: list[tuple[str, int, int, int]] = []
        self.count: Counter = Counter()
        self.text: list[str] = []
        self.linked: list[str] = []

    def context(self) -> tuple[int, int, int]:
        return self.open[-1][1:] if self.open else (-1, -1, 0)

    def add(self, piece: str) -> None:
        piece = unescape(piece)
        self.text.append(piece)
        if self.count["a"]:
            self.linked.append(piece)

    def end_block(self) -> None:
        joined = " ".join("".join(self.text).split())
        if joined:
            self.blocks.append(Block(joined, _solid(self.text), _solid(self.linked), *self.context()))
        self.text, self.linked = [], []

    def pop_to(self, depth: int) -> None:
        if any(e[0] not in INLINE or e[2] != self.context()[1] for e in self.open[depth:]) or (depth and self.open[depth - 1][2] != self.context()[1]) or (not depth and self.context()[1] >= 0):
            self.end_block()
        for e in self.open[depth:]:
            self.count[e[0]] -= 1
        del self.open[depth:]

    def find(self, names: frozenset[str], shields: frozenset[str]) -> int:
        """Depth of the innermost open element of these names, -1 beyond a shield."""
        if any(self.count[n] for n in names):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in names:
                    return k
                if self.open[k][0] in shields:
                    break
        return -1

    def start(self, tag: str, attrs: str) -> None:
        inline = tag in INLINE or "-" in tag
        if tag in ENDS and (k := self.find(*ENDS[tag])) >= 0:
            self.pop_to(k)
        if not inline and tag not in IN_PARAGRAPH and (tag not in VOID or tag == "hr") and (k := self.find(frozenset(("p",)), SCOPE | {"button"})) >= 0:
            self.pop_to(k)
        if tag == "a" and (k := self.find(frozenset(("a",)), SCOPE)) >= 0:
            self.close("a")
        if tag in VOID or _EMPTY.search(attrs):
            self.add(" ") if tag == "br" else inline or tag in ("img", "input", "wbr", "embed") or self.end_block()
            return
        article, place, heading = self.context()
        got = marks(attrs) if tag not in ("html", "body") and tag not in ARTICLE else set()
        if article >= 0:
            got.discard("header")
        in_comments = place >= 0 and self.places[place].comments
        if got & COMMENTS or got & MARKS or tag in MARKED_TAGS:
            self.end_block()
            self.places.append(Place(place, False, in_comments or bool(got & COMMENTS), article >= 0))
            place = len(self.places) - 1
        elif got or tag in LAYOUT_TAGS and not (tag == "header" and article >= 0):
            self.end_block()
            self.places.append(Place(place, True, in_comments, article >= 0))
            place = len(self.places) - 1
        elif not inline:
            self.end_block()
        if tag in ARTICLE and not in_comments:
            if article < 0 or place >= 0:
                article = self.articles
                self.articles += 1
            place = -1
        if tag in HEADING:
            heading = 2 if tag == "h1" else 1
        self.open.append((tag, article, place, heading))
        self.count[tag] += 1

    def close(self, tag: str) -> None:
        k = self.find(frozenset((tag,)), SCOPE - {tag} if tag not in ("body", "html") else frozenset())
        if k < 0:
            if tag not in INLINE and "-" not in tag:
                self.end_block()
            return
        if tag in INLINE and any(e[0] not in INLINE for e in self.open[k + 1 :]):
            self.count[tag] -= 1  # it ends, and what was opened inside stays open
            del self.open[k]
            return
        self.pop_to(k)


def blocks(html: str) -> tuple[list[Block], list[Place]]:
    """The blocks of a page in order, and its marked places."""
    page = _Reader()
    at = 0
    while True:
        m = _TOKEN.search(html, at)
        if piece := html[at : m.start() if m else len(html)]:
            page.add(piece)
        if not m:
            break
        at = m.end()
        name = m["tag"] or m["tag2"]
        if not name or (m["tag2"] and not m[0].endswith(">")):
            continue
        tag, attrs = name.lower(), m["attrs"] or m["attrs2"] or ""
        if m["close"] or m["close2"]:
            page.close(tag)
        elif tag in SKIPPED:
            if tag in TO_THE_END or not _EMPTY.search(attrs):
                end = _CLOSING[tag].search(html, at)
                at = end.end() if end else len(html) if tag in TO_THE_END else at
            page.end_block()
        else:
            page.start(tag, attrs)
    page.end_block()
    return page.blocks, page.places


def by_text(block: Block) -> bool | None:
    """Pass one without places: what a block's own text shows."""
    words = _WORD.findall(block.text.lower()) if len(block.text) >= SHORT else []
    prose = bool(words) and sum(w in STOPS for w in words) >= MIN_STOPS * len(words)
    if block.links > MAX_LINKS * block.size:
        # of an article's links a heading and a whole sentence may be text of it: their neighbours decide
        return None if block.article >= 0 and (block.heading or prose) else False
    return True if prose else None


def marked(found: list[Block], places: list[Place], first: list[bool | None]) -> list[bool]:
    """Which places are marked, in the end: soft ones are not if they hold most good text."""
    firm = []  # a mark that can't be overruled, here or around
    for p in places:
        firm.append(not p.soft or (p.outer >= 0 and firm[p.outer]))
    inside = [0] * len(places)
    total = 0
    articles = texts = False  # outside marked places: any article, one with good text
    for b, good in zip(found, first, strict=True):
        articles |= b.place < 0 <= b.article
        texts |= b.place < 0 <= b.article and bool(good)
        if good and not (b.place >= 0 and firm[b.place]):
            total += b.size
            if b.place >= 0:
                inside[b.place] += b.size
    for k in range(len(places) - 1, -1, -1):
        if places[k].outer >= 0:
            inside[places[k].outer] += inside[k]
    out = []
    for p, n in zip(places, inside, strict=True):
        drop = p.soft and total and n >= MOST * total and not (texts if p.inside else articles)
        out.append(not drop or (p.outer >= 0 and out[p.outer]))
    return out


def classify(found: list[Block], places: list[Place]) -> list[bool]:
    """Which blocks are good."""
    first = [by_text(b) for b in found]
    bad = marked(found, places, first)
    place = [b.place if b.place >= 0 and bad[b.place] else -1 for b in found]
    first = [False if label and p >= 0 else label for label, p in zip(first, place, strict=True)]
    section = [(p, -1) if p >= 0 else (-1, b.article) for b, p in zip(found, place, strict=True)]
    before = _nearest(section, first)
    after = [x and (len(found) - 1 - x[0], x[1]) for x in _nearest(section[::-1], first[::-1])[::-1]]
    following: list[bool | None] = []  # label of the next decided block outside marked places
    label = None
    for k in range(len(found) - 1, -1, -1):
        following.append(label)
        if first[k] is not None and place[k] < 0:
            label = first[k]
    following.reverse()
    out = []
    for i, (b, label, a, z) in enumerate(zip(found, first, before, after, strict=True)):
        if label is None:
            if b.heading and place[i] < 0 and (z or (b.heading == 2 and following[i])):
                label = z[1] if z else True
                if b.heading == 2 and a is None and b.article >= 0:
                    label = True
            elif a is None or z is None:
                near = a or z
                label = near[1] if near else section[i][1] >= 0
            else:
                d, e = i - a[0], z[0] - i
                label = a[1] if d < e else z[1] if e < d else a[1] or z[1]
        out.append(label)
    if not any(out) and all(b.article < 0 for b in found):
        out = [label is None and p < 0 for label, p in zip(first, place, strict=True)]
    return out


def _nearest(section: list, first: list[bool | None]) -> list[tuple[int, bool] | None]:
    """For each block the number and label of the last decided one before it, in its section."""
    out: list[tuple[int, bool] | None] = []
    last: dict = {}
    for i, (s, label) in enumerate(zip(section, first, strict=True)):
        out.append(last.get(s))
        if label is not None:
            last[s] = (i, label)
    return out


def main_text(html: str | None) -> str:
    """Text of the good blocks of one page."""
    found, places = blocks(html or "")
    return " ".join(b.text for b, good in zip(found, classify(found, places), strict=True) if good)


def _extract(pages: list) -> list:
    texts = [main_text(x) for x in pages]
    return [texts, list(map(len, texts))]


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text and n_chars, its code points."""
    return map_text(pages, html, lambda: _extract, [(out, pa.string()), ("n_chars", pa.int64())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
