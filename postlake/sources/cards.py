"""Openings on companies' own career pages, by the tree of the page.

A page's links that may be openings are found in its tree, each with its card: the largest element around it that holds
no other such link. Title and place come from the card's parts. Cards under one parent with the same shape, the tags from
the card down to the link, are siblings of a list, and the largest list with addresses under a career path is the page's openings.
"""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.functions import keys
from postlake.functions.places import places
from postlake.sources.parsers import CAREER_PATH

#: Characters of a card, and of one in which a title is looked for; words of a title; levels up to it.
CARD, TITLE_CARD, TITLE_WORDS, LEVELS = 400, 800, 15, 3
#: Elements that may be cards, headings, places of menus, addresses of files.
CARD_TAGS = frozenset("li tr article div section p td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FILE = re.compile(r"(?i)\.(pdf|docx?|xlsx?|jpe?g|png|gif|zip)$")
#: Texts of menus, which are never an opening's title.
MENU = re.compile(
    r"kariera|careers?|jobs?|praca|pozicie|volne (pracovne )?(pozicie|miesta)|pracovne (ponuky|pozicie|miesta|prilezitosti)|ponuk[ay] prace|o nas|kontakty?|domov|home|viac|viac inf(o|ormacii)|detaily?|zobrazit( viac)?|citat( viac| cely clanok)?|cely clanok|read more|more|apply|uchadzat sa|prihlasit sa|reagovat|dalej|spat|back|next|previous|predchadzajuca|dalsia|english|slovensky|en|sk|de|\d+|viac o nas|dozvediet sa viac|learn more|zistit viac"
    r"|(zobrazit|pozriet|otvorit|zistit)( \S+){0,3}|(show|view|read|see) (more|details?|job|position|offer)( \S+){0,2}|(detaily?|viac)( \S+){0,2} (ponuky|pozicie|informacii|info)"
)
#: Texts of buttons; the opening behind one has its title elsewhere in the card.
BUTTON = re.compile(r"tpp|zivnost|dohoda|zum job|podat zadost|find out more|more info(rmation)?|details|mehr( erfahren)?|podrobnosti|go|>|apply now( >)?|detail (inzeratu|pozicie)( \S+)?|mam zaujem o tuto poziciu|viac o ponuke|dalsie informacie|citaj viac|(show|view|see|explore) (jobs|opportunities|positions|all jobs)")
#: A card's number before its title.
COUNTER = re.compile(r"^\d{1,3}\s+(?![xX×]\s)(?=[^\W\d_])")


def plain(text: str) -> str:
    """Lower case without marks, single spaces."""
    return " ".join("".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower().split())


class Tree(HTMLParser):
    """Elements in page order: tag, parent, class, address, and the ranges of elements and of text pieces inside."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.names, self.hrefs = ["html"], [-1], [""], [None]
        self.first, self.last, self.inside = [0], [0], [0]
        self.pieces: list[tuple[int, str]] = []
        self.open = [0]
        self.feed(html)
        self.close()
        self._end(0)

    def _end(self, depth: int) -> None:
        for k in self.open[depth:]:
            self.last[k], self.inside[k] = len(self.pieces), len(self.tags)
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.tags[self.open[-1]] == tag and tag in ("li", "p", "tr", "td", "option"):  # the open one ends
            self._end(len(self.open) - 1)
        own = dict(attrs)
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.names.append(own.get("class") or "")
        self.hrefs.append(own.get("href") if tag == "a" else None)
        self.first.append(len(self.pieces))
        self.last.append(len(self.pieces))
        self.inside.append(len(self.tags))
        if tag not in VOID:
            self.open.append(len(self.tags) - 1)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.tags[self.open[depth]] == tag:
                self._end(depth)
                break

    def handle_data(self, data: str) -> None:
        if self.tags[self.open[-1]] not in ("script", "style"):
            self.pieces.append((self.open[-1], data))

    def up(self, k: int):
        """The elements around one, from the inside."""
        while (k := self.parents[k]) >= 0:
            yield k

    def text(self, k: int, without: frozenset[str] = frozenset()) -> str:
        """Text of an element, but that in elements of some tags inside it."""
        out = []
        for at, piece in self.pieces[self.first[k] : self.last[k]]:
            while at != k and self.tags[at] not in without:
                at = self.parents[at]
            if at == k:
                out.append(piece)
        return " ".join(" ".join(out).split())


def _heading(tree: Tree, k: int) -> str | None:
    """The first heading inside an element, else what is named title or position there."""
    tests = (lambda x: tree.tags[x] in HEADINGS, lambda x: "title" in tree.names[x].lower(), lambda x: "position" in tree.names[x].lower())
    for test in tests:
        for x in range(k + 1, tree.inside[k]):
            if test(x) and (text := tree.text(x)) and not MENU.fullmatch(plain(text)) and not BUTTON.fullmatch(plain(text)):
                return text
    return None


def _title(tree: Tree, link: int, links: list[int]) -> str:
    """Title of the opening behind a link: the heading inside, its text, or, if that is a button, the card's heading."""
    own = tree.text(link)
    title = _heading(tree, link) or own
    if not title or MENU.fullmatch(plain(title)) or BUTTON.fullmatch(plain(title)):
        for _, around in zip(range(LEVELS), tree.up(link), strict=False):
            rivals = any(around < x < tree.inside[around] and tree.hrefs[x] != tree.hrefs[link] and tree.text(x) == own for x in links)
            if rivals or len(tree.text(around)) > TITLE_CARD:
                break
            if found := _heading(tree, around):
                title = found
                break
    return COUNTER.sub("", title)


def _menu(tree: Tree, link: int) -> bool:
    """Whether a link stands in a menu, the footer, or the header of the page."""
    around = [tree.tags[k] for k in tree.up(link)]
    if "nav" in around or "footer" in around:
        return True
    return "header" in around and not {"article", "main"} & set(around[around.index("header") :])


def cards(html: str | None, page: str | None = None) -> list[dict]:
    """Links of a page that may be openings: url, title, place, and the list (number of its element) and shape of their cards."""
    if not html:
        return []
    tree = Tree(html)
    links = [k for k, href in enumerate(tree.hrefs) if href]
    able: dict[int, tuple[str, str]] = {}
    for k in links:
        try:
            url = urldefrag(urljoin(page or "", tree.hrefs[k].strip()))[0]
            parts, own = urlsplit(url), urlsplit(page or url)
        except ValueError:
            continue
        site = lambda host: (host or "").lower().split(".")[-2:]
        if parts.scheme not in ("http", "https") or not parts.path or site(parts.hostname) != site(own.hostname) or FILE.search(parts.path) or url == urldefrag(page or "")[0] or _menu(tree, k):
            continue
        title = _title(tree, k, links)
        if 1 <= len(plain(title).split()) <= TITLE_WORDS and not MENU.fullmatch(plain(title)):
            able[k] = (url, title)
    out = []
    for k, (url, title) in able.items():
        card = k
        for around in tree.up(k):
            if tree.tags[around] not in CARD_TAGS or len(tree.text(around)) > CARD or any(around < x < tree.inside[around] and x != k for x in able):
                break
            card = around
        place = tree.text(card, HEADINGS | {"a"}) if card != k else ""
        shape = [tree.tags[k]]
        for around in tree.up(k) if card != k else ():
            shape.append(tree.tags[around])
            if around == card:
                break
        out.append({"url": url, "title": title, "place": place or None, "list": tree.parents[card], "shape": "/".join(reversed(shape))})
    return out


def career_cards(bodies: DataFrame) -> DataFrame:
    """(board, external_id, title, url, location, place_keys) of career pages (board, body, and page, its address, if known).

    Of a page's lists the one with most addresses under a career path counts, of equal ones that with most cards, then the first."""
    page = F.col("page") if "page" in bodies.columns else F.lit(None).cast("string")

    @F.pandas_udf("array<struct<url:string,title:string,place:string,list:int,shape:string>>")
    def read(html: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([cards(h, p) for h, p in zip(html, at, strict=True)], dtype=object)

    rows = bodies.select("board", F.posexplode(read("body", page)).alias("at", "c")).select("board", "at", "c.*")
    rows = rows.groupBy("board", "url").agg(F.min_by(F.struct("at", "title", "place", "list", "shape"), "at").alias("c")).select("board", "url", "c.*")
    best = rows.groupBy("board", "list", "shape").agg(F.count_if(F.col("url").rlike(CAREER_PATH)).alias("under"), F.count("*").alias("n")).where("under > 0")
    best = best.groupBy("board").agg(F.max_by(F.struct("list", "shape"), F.struct("under", "n", -F.col("list"), "shape")).alias("b")).select("board", "b.*")
    return rows.join(best, ["board", "list", "shape"]).select("board", keys.clean_address(F.col("url")).alias("external_id"), "title", "url", F.col("place").alias("location"), places(F.col("place")).alias("place_keys"))
