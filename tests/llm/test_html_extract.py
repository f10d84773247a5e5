"""HTML extraction: the ratios decide, no page raises or takes long, pages with known text with and without an article."""

import random
import re
import time

import numpy as np
import pytest

from krathong.llm import html_extract

SF = "/root/testdata/sf0.01"
PIECES = ["<p>", "a", "<![foo[bar]]>", "<![if x]>", "<a b='", '<a b="', "<![CDATA[", "<!", "<?php x", "</", ">", '"', "'", "<div>", "<article>", "</article>", "<nav>", "</b>", "text ", "&amp;", "&#xD800;", "&#99999999;", "<", "=", "<script>", "</script>", "<li>", "<ul>", "<a href=x>", "<title>", "<textarea>", "\x00", "<!DOCTYPE", "<!--", "-->", "<p/>", "<svg/>"]


def test_no_scrap_of_markup_raises():
    rng = random.Random(5)
    for _ in range(6000):
        html_extract.extract("".join(rng.choice(PIECES) for _ in range(8)))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a<![foo[bar]]></p>", "a"),
        ("<p>a<![CDATA[b]]>c</p>", "ac"),
        ("<p>one</p><a b='", "one"),
        ("<p>one</p><?php x", "one"),
        ("<p>one</p><!-- two", "one"),
        ("<p>x < y &lt; z</p>", "x < y < z"),
        ('<p title="a > b">one<a href="x>two</p>', "onetwo"),
        ("plain text", "plain text"),
        ("<nav>Menu</nav>", ""),
        ("<p>a<title>T</title>b<textarea><p>c</textarea></p>", "ab"),
    ],
)
def test_malformed_markup(page, want):
    assert html_extract.extract(page) == want


@pytest.mark.parametrize("page", ["<a " * 10_000, "<div>" * 20_000 + "</b>" * 20_000 + "x", "<div>" * 20_000 + "<p>x" * 20_000, "<ul><li><ul>" + "<b>" * 20_000 + "<li></li>x" * 20_000, '<i x=">" ' * 20_000, "<div>a " * 20_000, "<!--" * 20_000, "<" * 50_000, "<script>" * 20_000])
def test_linear_time(page):
    began = time.process_time()
    html_extract.extract(page)
    assert time.process_time() - began < 3


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect() if r.html]


@pytest.mark.parametrize("other", ["zeros", "random", "negative"])
def test_ratios_decide_on_every_page(pages, monkeypatch, other):
    true = html_extract.ratios
    want = [html_extract.extract(h) for h in pages]
    monkeypatch.setattr(html_extract, "ratios", {"zeros": lambda p: np.zeros(len(p.text)), "random": lambda p: np.random.default_rng(len(p.text)).random(len(p.text)), "negative": lambda p: -true(p)}[other])
    assert np.mean([html_extract.extract(h) != w for h, w in zip(pages, want)]) > 0.9


def known(html):
    """The words of the page's only article, by plain text work."""
    body = re.search(r"<article>(.*)</article>", html, re.S)[1]
    body = re.sub(r"<(section|div|aside|form)\b[^>]*(comment|ad|widget|share)[^>]*>.*?</\1>", " ", body, flags=re.S)
    import html as lib

    return lib.unescape(re.sub(r"<[^>]+>", " ", body)).split()


def share(got, want):
    from collections import Counter

    g, w = Counter(got), Counter(want)
    both = sum((g & w).values())
    return both / max(1, sum(g.values())), both / max(1, sum(w.values()))


ALTERED = {
    "as it is": lambda h: h,
    "no article": lambda h: h.replace("<article>", "<div>").replace("</article>", "</div>"),
    "a div for each p": lambda h: re.sub(r"<p>(.*?)(?=</p>|<p>|</article>)", r"<div><p>\1</p></div>", h.replace("<article>", "<div>"), flags=re.S).replace("</article>", "</div>"),
    "nothing marked": lambda h: re.sub(r"<(/?)(nav|footer)>", r"<\1div>", h.replace(' class="ad"', "")).replace("<article>", "<div>").replace("</article>", "</div>"),
}


@pytest.mark.parametrize(("name", "precision", "recall"), [("as it is", 0.999, 0.999), ("no article", 0.999, 0.999), ("a div for each p", 0.99, 0.98), ("nothing marked", 0.9, 0.98)])
def test_pages_with_known_text(pages, name, precision, recall):
    got = [share(html_extract.extract(ALTERED[name](h)).split(), known(h)) for h in pages]
    p, r = np.mean(got, axis=0)
    print(name, round(p, 4), round(r, 4))
    assert p >= precision and r >= recall
