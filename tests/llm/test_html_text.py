import html
import re
import time

import numpy as np
import pytest

from adlift.llm.html_text import LABELLED, PLAIN, blocks, extract_text, features, is_main, trained

SF = "/root/testdata/sf0.01"


def article(page):
    """Plain reading of the given pages: text of the one article element, tags replaced by spaces."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)
    return " ".join(html.unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", body[1]).replace("<b>", "").replace("</b>", "")).split())


def test_tree_fits_its_table():
    tree = trained()
    for page, labels in LABELLED:
        found = blocks(page)
        assert [int(is_main(tree, r)) for r in features(found)] == labels, [b[0] for b in found]


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    assert len(got) == len(want) and np.mean([got[i] == want[i] for i in want]) == 1.0


def test_unseen_layouts():
    tree = trained()

    def text(page):
        found = blocks(page)
        return " ".join(b[0] for b, r in zip(found, features(found), strict=True) if is_main(tree, r))
    assert text("<body class='page'><div class='cookie-banner'><p>We use cookies here, accept them all.</p></div><div class="
                "'post-content'><p>a &lt; b &amp;\n c &eacute;</p><script>if (a<b) x('</p>')</script><p>Two <b>bo</b>ld"
                "</p></div><div id='comments'><p>First! I like this page a lot and say so.</p></div>") == "a < b & c é Two bold"
    assert text("<article><p>1 < 2 and 3 > 2</p><!-- <p>no</p> --><nav>x y</nav><p>end") == "1 < 2 and 3 > 2 end"
    assert text("") == "" and text("<p") == text("<p") and text("<!-- open") == ""


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", ""), (2, "u", "<article>" + "<p>word word</p>" * 20_000)]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {"text": F.lit("x"), "n_chars": F.lit("x")})
    got = sorted(map(tuple, extract_text(df).select("page_id", "url", "text", "n_chars").collect()), key=str)
    assert got[:2] == [(1, None, "", 0)] * 2 and got[3] == (None, "u", "", 0)
    assert got[2][3] == 20_000 * 10 - 1
    assert extract_text(df.limit(0)).count() == 0


def main_text(page, tree=None):
    tree = tree or trained()
    found = blocks(page)
    return " ".join(b[0] for b, r in zip(found, features(found), strict=True) if is_main(tree, r))


@pytest.mark.parametrize(("page", "want"), [
    ("<div class='layout with-sidebar'><article><p>one two</p></article></div>", "one two"),
    ("<div class='layout sidebar-right'><div class=content><p>one two</p></div><div class=sidebar><div class=content>no</div></div></div>", "one two"),
    ("<article><p title=Bob's>first</p><p>second</p><p title=Ann's>third</p></article>", "first second third"),
    ("<article><div class=post-header><h1>Head</h1></div><p>x</p></article>", "Head x"),
    ("<article><div class=legal-analysis><p>kept words</p></div><div class=legal-notice>not kept</div></article>", "kept words"),
    ("<article><p>kept</p></article><ol class=commentlist><li>I say so much on this, and more</li></ol>", "kept"),
    ("<article><p>kept</p></article><div class=responses><p>I answer that with many words</p></div>", "kept"),
    ("<article><p>a</p><p><a>all of it linked</a></p><p>b</p></article>", "a all of it linked b"),
    ("<article><p>x <a href='q>r' title=\"s>t\">y</a> z</p></article>", "x y z"),
    ("<article><p>1 < 2 <b>x</b> &#99999999999999999999; &#0000000000000065;", "1 < 2 x \ufffd A"),
    ("<article><p>one</p></section></div></article><p>" + "<a>more</a> " * 5, "one")])
def test_marks_quotes_and_references(page, want):
    assert main_text(page) == want


def nodes(tree):
    return {tree[0]} | nodes(tree[2]) | nodes(tree[3]) if isinstance(tree, tuple) else set()


def test_tree_uses_words_links_and_neighbours():
    tree = trained()
    assert {1, 6} < nodes(tree) and nodes(tree) & {2, 3, 4, 5}
    for page in PLAIN:
        for mark in (-1, 0, 1):
            found = [("", n, k, mark) for n, k, _ in page]
            assert [int(is_main(tree, r)) for r in features(found)] == [(0, y, 1)[mark + 1] for _, _, y in page]


@pytest.mark.parametrize("seed", range(5))
def test_pages_without_marks(seed):
    """Random pages without any container name: menus and teasers of short linked blocks about headline and paragraphs."""
    rng, tree = np.random.default_rng(seed), trained()
    wrong = total = 0
    for _ in range(40):
        menu = [f"<p><a>{'go ' * rng.integers(1, 4)}</a></p>" for _ in range(rng.integers(2, 7))]
        links = [f"<p><a>{'read this ' * rng.integers(1, 4)}</a></p>" for _ in range(rng.integers(2, 5))]
        body = [f"<h2>{'head ' * rng.integers(5, 10)}</h2>"] + [
            f"<p>{'word ' * rng.integers(12, 90)}<a>{'link ' * rng.integers(0, 2)}</a></p>" for _ in range(rng.integers(2, 9))]
        page = menu + body + links + ["<p>some rights kept</p>"]
        found = blocks("".join(page))
        got = [int(is_main(tree, r)) for r in features(found)]
        want = [0] * len(menu) + [1] * len(body) + [0] * (len(links) + 1)
        wrong, total = wrong + sum(a != b for a, b in zip(got, want, strict=True)), total + len(want)
    assert wrong <= 0.05 * total


@pytest.mark.parametrize("part", ["<a ", "<a x=' ", "<a x='>' ", "<div>", "</div>", "<svg>", "</script", "<script></script", "<!", "<!--", "<p class=", "&#9"])
def test_a_long_broken_page_takes_time_by_its_length(part):
    def seconds(n):
        start = time.perf_counter()
        blocks(part * (n // len(part)))
        return time.perf_counter() - start
    seconds(1000)
    assert seconds(1_000_000) < 30
