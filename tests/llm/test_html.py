"""HTML extraction: pages as they are written, a brute-force classifier, and what each feature decides."""

from __future__ import annotations

import random

import pytest

from postlake.llm import op10_html as html

LONG = "The text of a page that is the main part of it, and it is long enough to be decided by its words."
OTHER = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna aliqua."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<body><div class="page no-sidebar"><p>{LONG}</p></div></body>', LONG),
        (f'<body><div class="layout sidebar header search social alert"><p>{LONG}</p><p>Short.</p></div></body>', f"{LONG} Short."),
        (f"<p class=notice>Note<p>{LONG}<p>{LONG}", f"{LONG} {LONG}"),
        (f"<p>{LONG}</p><video-player src=x></video-player><p>{LONG}</p>", f"{LONG} {LONG}"),
        (f"<p>{LONG}</p><video src=x><p>{LONG}</p>", f"{LONG} {LONG}"),
        (f"<p><a href=x>{'&eacute;' * 10}</a> {LONG}</p>", f"{'é' * 10} {LONG}"),
        (f"<ul><li class=ad>Buy<li>{LONG}<li>Short.</ul>", f"{LONG} Short."),
        (f"<table><tr><td class=sidebar>{LONG}<td><article>{LONG}<p>Yes</article><tr><td class=ad>No</table>", f"{LONG} Yes"),
        (f"<article><h1>Head</h1><p><a href=x>By me</a><p>{LONG}<h2>Related</h2><ul><li><a href=x>one</a><li><a href=x>two</a></ul></article>", f"Head {LONG}"),
        (f"<h1>Head</h1><article><p>{LONG}</p></article><div>Out</div>", f"Head {LONG}"),
        (f"<article><p>{LONG}<section class=comments><article><p>{LONG} Indeed.</article></section></article>", LONG),
        (f'<div class="cookie">{LONG}</div><article><p>Tiny</p></article>', "Tiny"),
        (f"<form action=x><div><p>{LONG}</p></div></form><footer>{LONG}</footer>", LONG),
        (f"<p>{LONG}</p><script>var a='<p>'", LONG),
        (f"<p>{LONG}</p><p class='x", LONG),
        ("a &lt; b <3 c", ""),
        (f"<p>{LONG} &amp;lt; x&am<b>p;</b></p>", f"{LONG} &lt; x&amp;".replace("x&amp;", "x&amp;".replace("&amp;", "&am") + "p;")),
        (f"<b><div>{LONG}</b></div><i>Short</i>", f"{LONG} Short"),
        *((f"{begin}<p>{LONG}</p>", LONG) for begin in ('<div class="ad-free reading">', '<div class="single-ad-layout">', '<div id="discussion-paper">', '<div class="recommended-reading-list">', '<div class="post comments-open">', '<article><div class="cookie recipe">', "<article><dialog open>", '<main><div class="login-required">')),
        (f"<article><h1>Tea</h1><div class=notice><p>{LONG}</p></div></article>", f"Tea {LONG}"),
        (f"<article><p>{LONG}</p><div class=notice><p>{OTHER} of the a in</p></div></article>", LONG),
        (f"<article><p>{LONG}</p><div class='comments'>{LONG * 9}</div></article>", LONG),
        (f"<article><h2><a href=x>Linked head</a></h2><p>{LONG}</p><p><a href=x>{LONG}</a></p><p>{LONG}</p><p><a href=x>Go there</a></p></article>", f"Linked head {LONG} {LONG} {LONG}"),
        (f"<p>{LONG}</p><p><a href=x>{LONG}</a></p>", LONG),
        *((f"<article><p>{LONG}</p></article><div class='{name}'><p>{LONG}</p></div>", LONG) for name in ("site-footer", "ad-slot", "top-ad-2", "post-comments", "related-posts", "cookie-banner", "newsletter-signup", "ads_box", "comment-list")),
        *((f"<article><p>{LONG}</p></article><div class='{name}'><p>{LONG}</p></div>", f"{LONG} {LONG}") for name in ("no-ads", "has-sidebar", "promoter", "cookie-recipes", "menu-of-the-week")),
    ],
)
def test_pages_as_they_are_written(page, text):
    assert html.main_text(page) in (text, "a < b <3 c" if not text else text)


def random_page(rng: random.Random) -> tuple[str, list]:
    """A page and its blocks as (text, letters, letters in links, article, marked, heading)."""
    out, found = [], []
    article = -1

    def block(tag: str, where: int, marked: bool) -> None:
        kind = rng.choice(("short", "stops", "long", "other", "links", "half"))
        words = {"short": "Some words", "stops": "It is on the", "long": LONG, "other": OTHER, "links": "Go there", "half": "See all of it"}[kind] + f" {len(found)}."
        link = {"links": words, "half": words[:10]}.get(kind, "")
        inner = f"<a href='/x>y'>{link}</a>{words[len(link) :]}" if link else words.replace("of", "<b>of</b>", 1)
        out.append(f"<{tag}>{inner}" + ("" if tag in ("p", "li") and rng.random() < 0.5 else f"</{tag}>"))
        size = lambda s: len("".join(s.split()))
        found.append((words, size(words), size(link), where, marked, {"h1": 2, "h2": 1}.get(tag, 0)))

    def some(where: int, marked: bool) -> None:
        for _ in range(rng.randint(0, 5)):
            block(rng.choice(("p", "p", "p", "h1", "h2")), where, marked)

    for _ in range(rng.randint(1, 5)):
        kind = rng.choice(("nav", "div", "ad", "article", "article"))
        if kind == "article":
            article += 1
            out.append("<article>")
            some(article, False)
            out.append("</article>")
        elif kind == "div":
            out.append("<div class='text has-header'>")
            some(-1, False)
            out.append("</div>")
        else:
            out.append({"nav": "<nav>", "ad": "<div id=top-ad>"}[kind])
            some(-1, len(out))
            out.append({"nav": "</nav>", "ad": "</div>"}[kind])
    return "".join(out), found


def brute(found: list) -> str:
    """The docstring's rules, block by block, looking at all others each time."""
    n = len(found)
    section = [(b[3], b[4]) for b in found]

    def decided(i: int):
        words, size, links, _, marked, _ = found[i]
        if links > 0.5 * size:
            return None if found[i][3] >= 0 and found[i][5] else False
        if len(words) >= 70 and words.startswith("The text"):
            return not marked
        return None

    def nearest(i: int, step: int):
        j = i + step
        while 0 <= j < n and not (section[j] == section[i] and decided(j) is not None):
            j += step
        return (abs(j - i), decided(j)) if 0 <= j < n else None

    out = []
    for i, (_, _, _, article, marked, heading) in enumerate(found):
        label = decided(i)
        if label is None:
            a, z = nearest(i, -1), nearest(i, 1)
            after = next((decided(j) for j in range(i + 1, n) if not found[j][4] and decided(j) is not None), None)
            if heading and not marked and z:
                label = True if heading == 2 and article >= 0 and a is None else z[1]
            elif heading == 2 and not marked and after:
                label = True
            elif a and z:
                label = (a[0] <= z[0] and a[1]) or (z[0] <= a[0] and z[1])
            elif a or z:
                label = (a or z)[1]
            else:
                label = article >= 0
        out.append(label)
    if not any(out) and all(b[3] < 0 for b in found):
        out = [decided(i) is None and not found[i][4] for i in range(n)]
    return " ".join(b[0] for b, good in zip(found, out, strict=True) if good)


def pages(n: int) -> list[tuple[str, list]]:
    rng = random.Random(3)
    return [random_page(rng) for _ in range(n)]


def test_brute_force():
    for page, found in pages(3000):
        got, _ = html.blocks(page)
        assert [(b.text, b.size, b.links) for b in got] == [b[:3] for b in found], page
        assert html.main_text(page) == brute(found), page


@pytest.mark.parametrize("name", ["stop words", "length", "links", "neighbours", "places"])
def test_each_feature_decides_something(monkeypatch, name):
    made = [page for page, _ in pages(300)]
    whole = [html.main_text(p) for p in made]
    if name == "stop words":
        monkeypatch.setattr(html, "STOPS", frozenset())
    elif name == "length":
        monkeypatch.setattr(html, "SHORT", 0)
    elif name == "links":
        monkeypatch.setattr(html, "MAX_LINKS", 2)
    elif name == "neighbours":
        monkeypatch.setattr(html, "_nearest", lambda section, first: [None] * len(first))
    else:
        monkeypatch.setattr(html, "marked", lambda found, places, first: [False] * len(places))
    assert [html.main_text(p) for p in made] != whole


def test_time_in_proportion():
    for piece in ("<b>", "<div class=ad>", "<p>x", "<li>x", "</i><b>x", "<td>", "<a href='>", '<a "', "<!--", "<script>", "<ul><li>"):
        assert html.main_text(piece * 40_000) is not None
