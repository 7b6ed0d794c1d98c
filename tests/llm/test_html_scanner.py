"""The page scanner on broken and hostile pages, and the field on pages made by hand."""

from __future__ import annotations

import time

import pytest

from locusframe.llm import html_extract
from locusframe.llm.html_blocks import DEPTH, leaf_blocks

MB = 1 << 20


def texts(html):
    return [b.text for b in leaf_blocks(html)]


@pytest.mark.parametrize(
    "unit,kept",
    [("<a", "<a"), ("x<y ", "x<y "), ("<svg>t ", "t "), ("<video>t ", "t "), ("<div>a", "a"), ('<a "', '<a "'), ("<a \"'", "<a \"'"), ('<a "" "', '<a "" "'), ("<! ", "<! "), ("</svg ", "</svg "), ("&", "&"), ("<script>a", ""), ("<!-- ", "")],
)
def test_linear_and_lossless(unit, kept):
    n = MB // len(unit)
    start = time.perf_counter()
    blocks = leaf_blocks(unit * n)
    assert time.perf_counter() - start < 2
    assert sum(len(b.text.replace(" ", "")) for b in blocks) == n * len(kept.replace(" ", ""))


@pytest.mark.parametrize("tag", ["svg", "math", "video", "audio", "canvas", "object", "template", "noscript", "head"])
def test_unclosed_embedded_content_is_transparent(tag):
    page = f"<article><p>one</p><{tag} class=x><p>two</p></article><p>three</p>"
    assert texts(page) == ["one", "two", "three"]
    assert texts(page + f"</{tag} ><p>four") == ["one", "four"]


def test_broken_markup():
    assert texts("<p>a<script>x<p>y") == ["a"] and texts("<p>a<!-- x<p>y") == ["a"]
    assert texts("x<y and <p>z</p>") == ["x<y and", "z"] and texts("a <") == ["a <"]
    assert texts('<a title="a>b">l</a>') == ["l"] and texts('<p title="x>t</p><p>u</p>') == ["t", "u"]
    assert texts("<p>a<style>b{}</style >c<STYLE>d</style x>e") == ["ace"]
    assert texts("&#" + "0" * 5000 + "65;&#" + "9" * 5000 + ";&#x" + "0" * 9 + "41;&lt;") == ["A�A<"]


def test_depth_bounds_features_only():
    blocks = leaf_blocks("".join(f"<div class=c{i}>t{i}" for i in range(3 * DEPTH)) + "</div>" * 3 * DEPTH + "<p>end")
    assert [b.text for b in blocks] == [f"t{i}" for i in range(3 * DEPTH)] + ["end"]
    assert max(len(b.path) for b in blocks) == 2 * DEPTH and blocks[-1].path == ("t:p",)


PAGES = [
    (
        """<!doctype html><html><head><title>Baking at home</title><style>p{color:red}</style></head><body>
        <div id="masthead"><a href="/">Home</a> <a href="/about">About us</a> <a href="/shop">Shop</a></div>
        <div class="post-content"><h1>Bread for beginners</h1>
        <p>Mix the flour with water and leave it for an hour. The dough will look rough at first, and that is fine.</p>
        <p>Fold it twice, then shape a loaf &amp; let it rise overnight in a cool place.</p></div>
        <div class="sidebar"><h3>Popular</h3><ul><li><a href=1>Ten cakes</a></li><li><a href=2>Pies</a></li></ul></div>
        <div id="footer">© 2021 Baking at home. <a href=/terms>Terms</a></div></body></html>""",
        ["Bread for beginners", "Mix the flour with water and leave it for an hour. The dough will look rough at first, and that is fine.", "Fold it twice, then shape a loaf & let it rise overnight in a cool place."],
    ),
    (
        """<body><header><nav><ul><li><a href=/>Start</a><li><a href=/n>News</a></ul></nav></header><main>
        <h1>River level falls</h1><p>The river fell by two metres last week, the port authority said on Monday.
        <p>Ships of more than 80 metres still wait upstream. The authority expects rain by Friday.
        <blockquote>We have seen worse years, the harbour master said.</blockquote></main>
        <section class="comments"><h2>3 comments</h2><div class="comment"><p>First! Great story.</p></div></section>
        <aside class="ad-box"><p>Buy one, get one free!</p></aside><footer><p>All rights reserved.</p></footer>""",
        ["River level falls", "The river fell by two metres last week, the port authority said on Monday.", "Ships of more than 80 metres still wait upstream. The authority expects rain by Friday.", "We have seen worse years, the harbour master said."],
    ),
]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_pages_made_by_hand(k):
    page, want = PAGES[k]
    got = html_extract.main_text(page, html_extract.trained()).split("\n")
    assert got == want
