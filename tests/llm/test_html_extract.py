"""Main text of pages of several layouts; the given pages against their article elements."""

import html
import re

import pytest

from tessera.llm import html_extract
from tessera.llm.queries import op2_html_extraction

P1 = "The first paragraph is long enough, it has commas, and it ends here. Then it goes on."
P2 = "A second paragraph follows; it also has some length, and punctuation! Does it not?"
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(9)) + "</ul>"

CASES = {
    "article": (f"<body><nav>{MENU}</nav><article><h1>Title</h1><p>{P1}</p><p>{P2}</p></article>"
                "<footer>&copy; site. All rights, reserved.</footer></body>", f"Title {P1} {P2}"),
    "one long paragraph and a title": (f"<article><h1>T</h1><p>{P1 * 9}</p></article>", f"T {P1 * 9}"),
    "no article element": (f'<body><div class="topnav">{MENU}</div><div id="content"><h2>Head</h2><p>{P1}</p><p>{P2}</p>'
                           f'<p>Short.</p></div><div class="sidebar"><p>{P1}</p></div></body>', f"Head {P1} {P2} Short."),
    "comments": (f'<main><article><p>{P1}</p></article><section id="comments"><article class="comment"><p>{P2}</p>'
                 f"</article></section></main>", P1),
    "inside the article": (f'<article><header><h1>T</h1><div class="share">Share it!</div></header><p>{P1}</p>'
                           f'<aside>{P2}</aside><div class="ad">Buy, now.</div><form><p>Name, please:</p></form><p>{P2}</p>'
                           "<footer>Tags: a, b.</footer></article>", f"T {P1} {P2}"),
    "notices": (f'<div class="cookie-notice"><p>{P2}</p></div><div role="dialog">{P2}</div><main><p>{P1}</p></main>'
                f'<div style="display: none">{P2}</div><div hidden>{P2}</div>', P1),
    "references and space": ("<article><p>a&nbsp;b &lt;c&gt; &#233;&#x41; &amp;amp; \n\t d</p><p>x<b>y</b>z<br>w</p></article>",
                             "a b <c> éA &amp; d xyz w"),
    "unclosed": (f"<article><p><b>{P1}<br><p>{P2}</p><ul><li>one<li>two</ul></article><footer>f</footer>", f"{P1} {P2} one two"),
    "script and style": ('<article><script>var a = "<p>no</p>";</script><style>p{margin:0}</style><!-- <p>no</p> --><p>yes</p>'
                         "<noscript>no</noscript></article>", "yes"),
    "table layout": (f"<table><tr><td>{MENU}</td><td><p>{P1}</p><p>{P2}</p></td></tr></table>", f"{P1} {P2}"),
    "plain text": ("just  some\ntext", "just some text"),
    "empty": ("", ""), "null": (None, ""), "only a menu": (f"<nav>{MENU}</nav>", ""), "tags only": ("<div><p></p></div>", ""),
    "list inside": (f"<article><p>{P1}</p><ul><li>a</li><li>b</li></ul><blockquote>q</blockquote></article>", f"{P1} a b q"),
    "split body": (f'<body><div>{MENU}</div><div><p>{P1 * 4}</p></div><div>{MENU}</div><div><p>{P2 * 4}</p></div><div>{MENU}</div></body>',
                   f"{P1 * 4} {P2 * 4}"),
    "title, lead and a long text": (f'<div>{MENU}</div><div id=content><h1>Title</h1><div class=lead><p>{P2}</p></div>'
                                    f"<div class=text>{f'<p>{P1}</p>' * 15}</div></div><div>{MENU}</div>",
                                    " ".join(["Title", P2, *[P1] * 15])),
    "names inside the article": (f'<article><p>{P1}</p><div class="discussion"><p>{P2}</p></div><section id="search"><p>{P1}</p></section>'
                                 f'<div class="share">Share it!</div><p>{P2}</p></article>', f"{P1} {P2} {P1} {P2}"),
    "broken": ("<p>x <![if y]> <3 & more</p", "x <3 & more"),
}


@pytest.mark.parametrize("name", CASES)
def test_layouts(name):
    page, want = CASES[name]
    assert html_extract.main_text(page) == want


@pytest.mark.parametrize("name,aside", [
    ("ad", True), ("main-nav", True), ("siteFooter", True), ("sidebar-2", True), ("post-comments", True),
    ("comment-body", True), ("page-header", True), ("cookie_notice", True), ("footer-text", True), ("top:menu", True),
    ("has-sidebar", False), ("content-with-sidebar", False), ("entry-header", False), ("article-body", False),
    ("page", False), ("main", False), ("lead", False), ("shadow", False), ("download", False), ("", False)])
def test_names_of_elements(name, aside):
    page = f'<body><div class="{name}"><p>inside, of it</p></div><div id="x"><p>{P1}</p><p>{P2}</p></div></body>'
    assert ("inside" not in html_extract.main_text(f"<main>{page}</main>")) == aside


def test_deep_and_long_pages():
    assert html_extract.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    text = "word, " * 200_000
    assert html_extract.main_text(f"<article><p>{text}</p></article>") == text.strip()


def test_content_paths_by_ratio():
    paths = ["a/li"] * 6 + ["a/p"] * 3 + ["a/div"]
    lengths = [5] * 6 + [300, 20, 400] + [30]
    marks = [0] * 6 + [9, 1, 11] + [0]
    import numpy as np

    chosen = html_extract.content_nodes(paths, np.array(lengths, float), np.array(marks, float), np.ones(10))
    assert chosen[6:9].all() and not chosen[:5].any()


def article(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (re.sub(r"</?b>", "", b) for b in re.split(r"<(?:/?(?:h1|p)|br)>", inside))
    return " ".join(" ".join(html.unescape(b).split()) for b in blocks if html.unescape(b).split())


def test_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = op2_html_extraction(spark, "/root/testdata/sf0.01")
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    by = {r["page_id"]: r for r in got.collect()}
    for r in rows:
        want = article(r["html"])
        assert tuple(by[r["page_id"]])[1:] == (r["url"], want, len(want))


def test_nulls_repeats_and_extra_columns(spark):
    df = spark.createDataFrame([(None, "<p>a</p>", "t"), (1, None, "t"), (2, "b", "t"), (2, "b", "t")],
                               "page_id long, html string, text string")
    assert html_extract.extract(df, carry=("text",)).columns == ["page_id", "text", "n_chars"]
    got = html_extract.extract(df)
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got.collect()) == [(0, "a", 1), (1, "", 0), (2, "b", 1), (2, "b", 1)]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_unclosed_tags_take_little_memory():
    import tracemalloc

    tracemalloc.start()
    assert html_extract.main_text("<div>word " * 20_000) == " ".join(["word"] * 20_000)
    assert html_extract.main_text("<div><b><i>word " * 5_000).count("word") == 5_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_selection_decides(spark, monkeypatch):
    """Pages without one telling name or element: the paths' scores find most articles exactly, a random choice few."""
    import numpy as np

    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    unnamed = [re.sub("<(/?)(?:article|nav|footer)>", r"<\1div>", p).replace(' class="ad"', "") for p in pages]
    wanted = [article(p) for p in pages]
    right = sum(html_extract.main_text(p) == w for p, w in zip(unnamed, wanted))
    rng = np.random.default_rng(1)
    monkeypatch.setattr(html_extract, "content_nodes", lambda paths, *_: rng.permutation(len(paths)) <= len(paths) // 2)
    by_chance = sum(html_extract.main_text(p) == w for p, w in zip(unnamed, wanted))
    assert right >= 0.6 * len(pages) and by_chance < 0.5 * right
