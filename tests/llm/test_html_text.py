import re
import time
from html import unescape

import pytest

from prosemill.llm.html_text import extract, extract_pages

P = "<p>" + "Some words of the article that go on for a while. " * 3 + "</p>"
T = " ".join(["Some words of the article that go on for a while."] * 3)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("<nav><a href=x>Menu</a></nav>", ""),
        ("plain &amp; simple", "plain & simple"),
        (f"<body><nav><ul><li><a>Home</a></li></ul></nav><article><h1>A&nbsp;title</h1>{P}</article><footer>foot</footer>", f"A title {T}"),
        (f"<div class=ad>Buy</div><article><p><b>Lead.<br>More\n text<p>Two</p>{P}</article>", f"Lead. More text Two {T}"),
        (f"<div id=sidebar>{P}</div><div class='content'>{P}<p>Short.</p></div><div class='comments'>{P}</div>", f"{T} Short."),
        (f"<main>{P}<form>send <input></form><div class='cookie-notice'>ok?</div><p>End</p></main>", f"{T} End"),
        (f"<script>var a='<p>x</p>';</script><style>p{{}}</style><div><p>1 &lt; 2 &#233;</p>{P}</div>", f"1 < 2 é {T}"),
        (f"<header>Site</header><article><header><h1>Own</h1></header>{P}</article>", f"Own {T}"),
        (f"<!-- c --><article>{P}<ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", f"{T} one two x y"),
        ("<p>unclosed <b>and <i>nested", "unclosed and nested"),
        ("<div><div></span></p></div>text</div></div>", "text"),
    ],
)
def test_cases(html, text):
    assert extract(html) == text


def article(html):
    """The test pages' article by the way they are made: tags out, references decoded."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)
    if not inner:
        return None
    blocks = re.split(r"</?(?:p|h1|ul|li)[^>]*>", inner[1])
    blocks = [" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?(?:b|a)\b[^>]*>", "", b))).split()) for b in blocks]
    return " ".join(b for b in blocks if b)


def test_table(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    rows = extract_pages(pages).collect()
    assert len(rows) == len(html)
    checked = 0
    for r in rows:
        assert r.n_chars == len(r.text)
        want = article(html[r.page_id])
        if want is not None:
            checked += 1
            assert r.text == want
    assert checked > len(rows) // 2


def test_edges(spark):
    rows = [(None, "u", None), (1, None, ""), (1, "v", "<p>x</p>"), (2, "w", "<div>" * 3000 + "deep" + "<p>word " * 20_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, HTML int")
    got = sorted((r.n_chars, r.text[:9]) for r in extract_pages(df).collect())
    assert got == [(0, ""), (0, ""), (1, "x"), (4 + 5 * 20_000, "deep word")]
    assert extract_pages(df.where("false")).count() == 0


L = "<p>" + "Long text of the body that goes on. " * 200 + "</p>"
B = " ".join(["Long text of the body that goes on."] * 200)
LINKS = "<ul><li><a href=a>Home</a><li><a href=b>About us</a><li><a href=c>Contact</a></ul>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body><h1>Title</h1><div>{L}</div></body>", f"Title {B}"),
        (f"<body><h1>Title</h1><p>A lead.</p><div>{L}{L}</div><p>The end.</p></body>", f"Title A lead. {B} {B} The end."),
        (f"<body>{LINKS}<h1>Title</h1><div><p>A lead of some more words.</p></div><div>{L}</div>{LINKS}</body>", f"Title A lead of some more words. {B}"),
        (f"<body>{LINKS}<h2>Title</h2><p><a>An Author</a></p><div>{L}{L}</div><footer>foot</footer></body>", f"Title An Author {B} {B}"),
        (f"<body><div><h1>Title</h1></div><div>{L}</div><div>{P}</div></body>", f"Title {B} {T}"),
    ],
)
def test_pages_without_article(html, text):
    assert extract(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body class=ads><div class='layout has-sidebar'><div class=sidebar>{LINKS}</div><article><h1>T</h1>{P}</article></div></body>", f"T {T}"),
        (f"<div class='page sidebar-right'>{LINKS}<div class=text>{P}{P}</div><div class=footer>foot</div></div>", f"{T} {T}"),
        (f"<form id=aspnetForm><div id=menu>{LINKS}</div><h1>T</h1>{P}{P}<form>x</form></form>", f"T {T} {T}"),
        (f"<main><h1>News</h1><article><h2>One</h2>{P}</article><article><h2>Two</h2>{P}</article><aside>{P}</aside></main>", f"News One {T} Two {T}"),
        (f"<article><h2>One</h2>{P}</article><article><h2>Two</h2>{P}</article>", f"One {T} Two {T}"),
        (f"<article><div class='article-header'><h1>T</h1></div>{P}<div class='article-footer'>f</div></article>", f"T {T}"),
        (f"<div class='post-header'><h1>T</h1></div><div class=body>{P}{P}</div><div id=comments>{P}{P}{P}{P}</div>", f"T {T} {T}"),
        (f"<h1>T</h1><article>{P}</article><div class=related><article>{P}</article></div>", f"T {T}"),
        (f"<article>{P}<p>A <span class=share>Share</span>b</p></article>", f"{T} A b"),
        (f"<table><tr><td>{LINKS}<td>{P}{P}</table>", f"{T} {T}"),
    ],
)
def test_wrappers(html, text):
    assert extract(html) == text


@pytest.mark.parametrize("open_", ["<b>", "<div>x", "<div>", "<p><b>", "<ul><li>y", "</p><i>", "<b><hr>z", "<span><a>w"])
def test_deep_nesting_takes_linear_time(open_):
    took = []
    for n in (5_000, 20_000):
        began = time.perf_counter()
        extract(open_ * n + "end" + P)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.2 and took[1] < 5
