"""Main text of web pages: flat text blocks classified by a decision tree.

A page becomes a flat list of blocks between block-level tags. A block's
features are its word count and link density, those of its two neighbours, and
what its nearest marked container says. A small decision tree, grown at start
from the labelled tables below, tells article blocks from the rest: by their
container where one is marked, by their own words and links and those around
them where none is. Pages are independent rows, so the work is one scan without
a shuffle, and the time for a page grows with its length, broken markup included.

Defined results: null or empty html gives an empty text. Null ids and urls and
repeated rows keep their rows; other columns are ignored. A quote opens an
attribute value only after an equals sign. From a tag on whose end is never
found, tags end at the next ">", and a "<" without any is text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlift.llm.common import map_rows, small_batches

# Element and attribute names of HTML.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select", "object", "canvas")
TEXT_ONLY = frozenset("script style title textarea".split())     # without an end tag they last to the end of the page
LEAVES = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol dl table section article main pre blockquote".split())   # cannot stand in svg or select
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav aside footer header form menu dialog button fieldset".split())
CONTENT = frozenset("article main".split())
# Words in class, id and role by which pages name their parts.
HINTS = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|popup|modal|sidebar|widgets?|menu|nav|navbar|navigation|"
                   r"breadcrumbs?|footer|masthead|comments?|commentlist|commentary|responses|replies|disqus|share|sharing|social|related|"
                   r"newsletter|subscribe|login|signup|complementary|contentinfo")
LAST_HINTS = re.compile(r"notices?|alert|side|header|reply|respond|discussion|search|copyright|legal")     # as the last part of a name
BODY = re.compile(r"article|content|post|entry|story|main|body|prose")
LAYOUT = re.compile(r"layout|page|container|wrapper|wrap|site|row|grid|columns?|with|has|no|without")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTES = re.compile(r"(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+")
_MARK = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_END = {k: re.compile(rf"</{k}(?![\w-])", re.I) for k in RAW}
_ZEROS = re.compile(r"&#([xX]?)0{8,}")
_HUGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")

# The labelled tables. First: pages whose blocks carry a label each, in page order (1: article).
LABELLED = [
    ("<title>T</title><header><a href=/>Home</a></header><nav><ul><li><a>One</a><li><a>Two</a><li>Three items</ul></nav>"
     "<article><h1>A headline of the page</h1><p>First words of a longer text that goes on for a while, as they do.</p>"
     "<p>Short.</p><p>More <a>linked</a> words of the text follow here.</p></article><footer>Some words on rights</footer>",
     [0, 0, 0, 0, 1, 1, 1, 1, 0]),
    ("<div class=ad>Buy the new thing now and save a lot of money today.</div><main><p>One.</p><p>The second block of the "
     "main text has a few more words in it.</p><ul><li>point one<li>point two</ul></main><aside><p>A longer box beside the "
     "text, which tells of other things one may read.</p></aside>", [0, 1, 1, 1, 1, 0]),
    ("<div id=cookie-notice>We use cookies to make this site better for you.</div><div class=menu><p>Start</p></div>"
     "<div class=content><h2>Title words</h2><p>Text of the body with quite a few words, one after the other, to read.</p>"
     "<p><a>All of it linked</a></p></div><div class=comments><p>Great text, thank you for this, I liked it very much.</p>"
     "<p>Me too.</p></div><form><label>Mail</label><p>Leave your address to get the news.</p></form>", [0, 0, 1, 1, 1, 0, 0, 0, 0]),
    ("<p>A page without any container has its words in plain blocks that are long enough to be read as text.</p>"
     "<p>Such blocks follow each other and hold hardly any link in their many words.</p><p><a>next page</a></p>"
     "<p><a>one</a> | <a>two</a> | <a>three</a></p>", [1, 1, 0, 0]),
    ("<article><header><h1>Headline</h1></header><p>The text begins here and has some words.</p><aside>Read this as well"
     "</aside><p>It ends here.</p><footer>Written by somebody</footer><section class=comments><p>I have read every word of "
     "this text and do not agree.</p></section></article><div class=sidebar><p>Many words in a box beside the article.</p>"
     "</div>", [1, 1, 0, 1, 0, 0, 0]),
]


# Second: pages without marked containers as the words, linked words and label of each block in page order: menus and
# teasers are runs of short linked blocks, headlines and captions are short but stand beside long blocks without links.
PLAIN = [
    [(2, 2, 0), (1, 1, 0), (3, 3, 0), (8, 0, 1), (45, 0, 1), (60, 2, 1), (4, 0, 1), (38, 0, 1), (72, 5, 1), (3, 3, 0), (2, 2, 0), (7, 1, 0)],
    [(14, 2, 0), (1, 1, 0), (1, 1, 0), (2, 2, 0), (6, 0, 1), (5, 0, 1), (90, 4, 1), (120, 0, 1), (9, 0, 1), (4, 4, 0), (6, 6, 0), (9, 0, 0)],
    [(3, 0, 0), (2, 2, 0), (4, 4, 0), (11, 0, 1), (12, 0, 1), (9, 0, 1), (14, 1, 1), (10, 0, 1), (13, 0, 1), (2, 2, 0), (5, 0, 0)],
    [(7, 0, 1), (30, 0, 1), (25, 3, 1), (41, 0, 1)],
    [(1, 1, 0), (12, 4, 0), (2, 2, 0), (15, 5, 0), (2, 2, 0), (10, 0, 1), (55, 6, 1), (7, 0, 1), (64, 0, 1), (8, 8, 0), (14, 4, 0), (6, 6, 0), (4, 0, 0)],
    [(5, 0, 1)],
    [(2, 2, 0), (2, 2, 0), (9, 0, 1), (3, 0, 1), (33, 10, 1), (28, 0, 1), (3, 0, 1), (48, 1, 1), (5, 0, 1), (80, 9, 1), (7, 7, 0), (7, 7, 0), (3, 1, 0), (11, 2, 0)],
    [(4, 4, 0), (3, 0, 0), (3, 3, 0), (5, 5, 0), (6, 0, 1), (150, 12, 1), (2, 2, 0), (2, 0, 0), (2, 2, 0), (8, 0, 0)],
    [(10, 9, 0), (30, 28, 0), (12, 0, 1), (70, 0, 1), (18, 0, 1), (40, 38, 0), (22, 20, 0), (9, 3, 0)],
    [(2, 2, 0), (24, 0, 1), (17, 2, 1), (20, 0, 1), (6, 0, 1), (21, 0, 1), (2, 2, 0), (2, 2, 0)],
]


def container(name: str, marks: list[str], inside: bool) -> int:
    """1 for a part that holds the article, -1 for one that is none of it, 0 for others. ``marks`` are the element's class,
    id and role names; ``inside`` tells whether an article part is open."""
    if name in CONTENT:
        return 1
    if name in RAW or name in ASIDE and not (name == "header" and inside):
        return -1
    if name in ("body", "html"):
        return 0
    parts = [re.split(r"[-_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m).strip("-_").lower()) for m in marks]
    body = any(BODY.fullmatch(p) for q in parts for p in q)
    layout = any(all(LAYOUT.fullmatch(p) for p in q) for q in parts)

    def aside(q: list[str]) -> bool:
        if len(q) > 1 and (LAYOUT.fullmatch(q[0]) or layout):      # "with-sidebar", "layout sidebar-right": how a part looks
            return False
        if any(HINTS.fullmatch(p) for p in q):
            return True
        return bool(LAST_HINTS.fullmatch(q[-1])) and not any(BODY.fullmatch(p) for p in q[:-1])
    return -1 if any(aside(q) for q in parts) else 1 if body else 0


def blocks(page: str) -> list[tuple[str, int, int, int]]:
    """(text, words, linked words, container: 1 article, -1 not, 0 unmarked) of each block with text."""
    out: list[tuple[str, int, int, int]] = []
    stack: list[tuple[str, int, bool, bool]] = []       # name, nearest mark, inside an article part, inside one that is none
    opened: Counter[str] = Counter()
    endless: set[str] = set()       # raw elements without a further end tag
    words: list[str] = []
    linked, in_link, at, strict = 0, 0, 0, True

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(words).split())
        if text:
            out.append((text, text.count(" ") + 1, linked, stack[-1][1] if stack else 0))
        words.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = plain(raw) if "&" in raw else raw
            words.append(text)
            if in_link:
                linked += len(text.split())

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = stop + 3 if stop >= 0 else len(page)
            continue
        end = page.startswith("/", start + 1)
        found = _NAME.match(page, start + 1 + end)
        if found is None and page[start + 1:start + 2] not in ("!", "?"):
            add("<")
            at = start + 1
            continue
        stop = _ATTRIBUTES.match(page, found.end()).end() if found and strict else page.find(">", start)
        if found and strict and stop == len(page):
            strict, stop = False, page.find(">", start)
        if stop < 0:
            add(page[start:])
            break
        at = stop + 1
        if found is None:
            continue
        name, given = found[0].lower(), page[found.end():stop]
        if name in RAW and not end:
            if name == "svg" and given.endswith("/"):
                continue
            last = None if name in endless else _END[name].search(page, at)
            stop = page.find(">", last.end()) if last else -1
            if stop < 0:
                endless.add(name)
            if stop >= 0 or name in TEXT_ONLY:
                at = stop + 1 if stop >= 0 else len(page)
                continue
        if name == "a":
            in_link = 0 if end else 1
            continue
        if name in INLINE:
            continue
        close()
        if name in LEAVES and not end and stack and stack[-1][0] in ("svg", "select"):
            pop()
        if name in VOID or name == "p":
            continue
        if end:
            if opened[name]:
                while pop() != name:
                    pass
                in_link = 0
            continue
        marks = [m for x in _MARK.findall(given) for m in x.strip("\"'").split()] if given else []
        _, near, inside, outside = stack[-1] if stack else ("", 0, False, False)
        mark = container(name, marks, inside)
        if mark == 1 and outside and name not in CONTENT:
            mark = 0
        if mark or name in ("div", "section", "ul", "ol", "table", "td"):
            stack.append((name, mark or near, inside or mark == 1, outside or mark == -1))
            opened[name] += 1
    close()
    return out


def plain(raw: str) -> str:
    """``raw`` with its character references decoded; a number beyond Unicode is the replacement character."""
    return entities.unescape(_HUGE.sub("\ufffd", _ZEROS.sub(r"&#\g<1>0", raw)) if "&#" in raw else raw)


def features(found: list[tuple[str, int, int, int]]) -> np.ndarray:
    """(blocks, 7): words and link density of the block, the one before and the one after; container."""
    own = np.array([[n, k / n, c] for _, n, k, c in found], dtype=np.float64).reshape(-1, 3)
    edge = np.zeros((1, 3))
    before, after = np.concatenate((edge, own[:-1])), np.concatenate((own[1:], edge))
    return np.column_stack((own[:, :2], before[:len(own), :2], after[:len(own), :2], own[:, 2]))


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A decision tree by Gini impurity: (feature, cut, left, right) or a leaf's class."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return int(2 * y.sum() > len(y))
    best = None
    for f in range(x.shape[1] - 1, -1, -1):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[left], y[~left]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut, left)
    if best is None:
        return int(2 * y.sum() > len(y))
    _, f, cut, left = best
    return f, float(cut), grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def trained():
    pages = [(blocks(page), labels) for page, labels in LABELLED]
    # the same blocks in a marked part are what the part is
    pages += [([("", n, k, mark) for n, k, _ in page], [(0, y, 1)[mark + 1] for _, _, y in page]) for page in PLAIN for mark in (-1, 0, 1)]
    x = np.concatenate([features(found) for found, _ in pages])
    return grow(x, np.concatenate([np.array(labels) for _, labels in pages]).astype(np.float64))


def is_main(tree, row: np.ndarray) -> bool:
    while isinstance(tree, tuple):
        f, cut, left, right = tree
        tree = left if row[f] <= cut else right
    return tree == 1


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (article blocks joined by a space), n_chars, n_blocks, n_main."""
    small_batches(pages.sparkSession, 512)
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         F.col(html_col).cast("string").alias("html"))

    def make():
        tree = trained()

        def work(rows: dict) -> dict:
            out: dict[str, list] = {"page_id": rows["page_id"], "url": rows["url"], "text": [], "n_chars": [],
                                    "n_blocks": [], "n_main": []}
            for page in rows["html"]:
                found = blocks(page or "")
                main = [b[0] for b, row in zip(found, features(found), strict=True) if is_main(tree, row)]
                text = " ".join(main)
                out["text"].append(text)
                out["n_chars"].append(len(text))
                out["n_blocks"].append(len(found))
                out["n_main"].append(len(main))
            return out
        return work

    return map_rows(pages, "page_id long, url string, text string, n_chars long, n_blocks int, n_main int", make)
