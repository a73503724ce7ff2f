"""Main text of pages and exact top-k."""

import math

import numpy as np
import pytest

from apidrift.llm import html, topk

PAGE = """<html><head><title>T</title><style>p{x}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1><nav><a href=x>Home</a> <a>News</a></nav></header>
<div class="cookie-notice"><p>We use cookies to give you the best experience on this and on many other sites.</p></div>
<div class=sidebar><p>Some long text in the sidebar that goes on with many words so that it looks like content.</div>
<article class="post"><header><h1>Title &eacute; &amp; more</h1></header><p>First  paragraph &lt;b&gt;.<p>Second
<a href="a>b">linked</a> para<b>graph</b>.<br>Still.<!-- <p>no</p> --><div class="ad">Buy now!</div><p>A &nbsp; b.</p>
<ul><li>one<li>two</ul><form><input><p>Subscribe</p></form></article>
<section id="comments"><article><p>I think this is a good article and I have many words to say about it here.</p></article></section>
<footer>&copy; nobody</footer></body></html>"""


PAGE_TEXT = "Title é & more\nFirst paragraph <b>.\nSecond linked paragraph. Still.\nA b.\none\ntwo"


def test_page():
    assert html.main_text(PAGE, html.default_tree()) == PAGE_TEXT


def test_page_without_article():
    page = (
        '<div id=nav><a>a</a></div><div class="content"><h2>Head</h2><p>A short one.</p><p>This page has no article, but its text stands '
        'in a part called content.</p><blockquote><p>Quote</p></blockquote></div><div class="comment"><p>Reader words.</p></div><div class="footer">foo</div>'
    )
    assert html.main_text(page, html.default_tree()).split("\n") == ["Head", "A short one.", "This page has no article, but its text stands in a part called content.", "Quote"]


STORY = "<h1>Head</h1><p>This is the first paragraph of a story that goes on for some words.<p>And this is the second one, with a few words more."
STORY_TEXT = "Head\nThis is the first paragraph of a story that goes on for some words.\nAnd this is the second one, with a few words more."


@pytest.mark.parametrize(
    "opened,close",
    [
        ('<div class="layout no-sidebar">', "</div>"), ('<div id="page-with-sidebar">', "</div>"), ('<article class="post comments-open">', "</article>"),
        ('<div class="post has-comments"><article>', "</article></div>"), ('<div id="public-notice-of-2020">', "</div>"), ('<div class="dialog">', "</div>"),
        ('<article data-hidden="false">', "</article>"), ('<article data-x="hidden gem">', "</article>"), ('<article data-id="related-7">', "</article>"),
        ("<article title='class=ad'>", "</article>"), ('<div class="widget content">', "</div>"), ('<body class="login">', "</body>"),
    ],
)
def test_wrappers_hold_the_article(opened, close):
    page = f"<html><nav><a>Home</a> <a>News</a></nav>{opened}{STORY}{close}<footer>&copy; nobody</footer></html>"
    assert html.main_text(page, html.default_tree()) == STORY_TEXT


def test_side_parts_go():
    rest = (
        '<div id="comments" width="5"><p>I liked this story and have a lot of words to say about all of it here.</div><div class="sidebar"><p>Other stories that '
        "one may read as well, told in a good number of words.</div><div>© 2024 Some House. All rights reserved.</div>"
    )
    inline = STORY.replace("first", '<span class="ad">Buy <span>this</span> now</span>first').replace("second", '<b style="display: none">unseen</b>second')
    for page in (STORY + rest, inline + rest, f'<div class="wrap no-sidebar">{inline}{rest}</div>'):
        assert html.main_text(page, html.default_tree()) == STORY_TEXT
    assert html.main_text("<p>One <span hidden>two<p>three four five six seven eight nine ten.", html.default_tree()).endswith("three four five six seven eight nine ten.")


def test_broken_pages():
    tree = html.default_tree()
    assert html.main_text('<div class="ad"><p>left open<article><p>Real text.</p><p class="ad">Ad</p><p>More.</article>', tree) == "Real text.\nMore."
    for page in ("", None, "<", "<p", "</div></p>", "<!-- open", "<script>x", "&#0; &#x110000; &amp", "<a><a><p a='>" * 50):
        html.main_text(page, tree)
    assert html.main_text("<article><p>" + "word " * 300_000 + "</p></article>", tree).count("word") == 300_000


@pytest.mark.parametrize(
    "left_open",
    ["<svg class=a />", "<SVG/>", "<svg>", "<button>", "<object>", "<select>", "<template>", "<button-group>", "<title-bar>", "<button>Up</button><button>", "<button><button></button>"],
)
def test_unread_elements_left_open(left_open):
    text = "The article goes on for many words after an element that has no end tag on this page."
    for after in ("", "<title-bar></title-bar>"):
        assert html.main_text(f"<article><p>{text}</p>{left_open}<p>{text}</p></article>{after}", html.default_tree()) == f"{text}\n{text}"


def test_raw_elements_left_open():
    text = "The article goes on for many words."
    for name in ("script", "style", "title", "textarea", "iframe"):
        assert html.main_text(f"<article><p>{text}</p><{name} a=b><p>{text}</p></article>", html.default_tree()) == text
    assert html.main_text("<article><p>" + "<button><svg>" * 30_000 + f"{text}</p></article>", html.default_tree()) == text


def test_tree_agrees_with_its_table():
    rows, labels = html.labelled_table()
    assert ((html.default_tree().margin(rows) >= 0.5) == labels).mean() > 0.97


def test_pages_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = html.extract_text(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in found) == [(0, 0), (1, len(PAGE_TEXT)), (1, len(PAGE_TEXT)), (2, 0)]
    assert all(len(r.text) == r.n_chars for r in found)
    assert html.extract_text(pages.limit(0)).collect() == []


def plain_top(rows, k, every):
    good = [(n, i, np.floor(256 * np.array(v, float))) for n, (i, v) in enumerate(rows) if i is not None and v is not None and None not in v and all(math.isfinite(x) for x in v)]
    out = []
    for n, i, q in good:
        if i % every == 0:
            ranked = sorted((-sum(int(a) * int(b) for a, b in zip(q, c)), j, m) for m, j, c in good if m != n)
            out += [(i, rank, j, -s) for rank, (s, j, _) in enumerate(ranked[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["random", "ties", "odd", "few"])
def test_top_k(spark, monkeypatch, shape):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 60)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    monkeypatch.setattr(topk, "STRIP_ROWS", 3)
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.standard_normal(12).tolist()) for i in range(300)]
    if shape == "ties":
        rows = [(i, [1.0, 0.5, -0.25] if i % 3 else [0.1, 0.1, 0.1]) for i, _ in rows]
    if shape == "odd":
        rows += [(100, rows[100][1]), (100, rows[100][1]), (350, None), (400, [1.0, None]), (450, [float("nan")]), (500, [float("inf")]), (550, []), (600, [1.0]), (None, [1.0]), (-50, [3e4] * 12), (-100, [1e12, -1e12] * 6)]
    if shape == "few":
        rows = rows[:3] + [(50, [0.0] * 12)]
    table = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id bigint, embedding array<double>, at string, score string")
    found = topk.top_k(table)
    assert sorted(map(tuple, found.collect())) == plain_top(rows, 5, 50)
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []


def test_top_k_adds_up_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 400)
    rng = np.random.default_rng(7)
    middles = rng.standard_normal((40, 32)) * 2
    rows = [(int(i), (middles[i % 40] + 0.3 * rng.standard_normal(32)).tolist()) for i in range(2000)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    scored, _ = topk._scored(table, 50, 5, topk.SCALE, topk.GROUPS, "vec_id", "embedding")
    added_up = sum(r.n_resolved for r in scored.collect())
    assert 40 * 5 <= added_up < 0.25 * 40 * 2000
    assert sorted(map(tuple, topk.top_k(table).collect())) == plain_top(rows, 5, 50)
