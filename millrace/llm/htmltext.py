"""Main text of web pages: flat text blocks, classified by a decision tree over shallow features.

A page is cut at block-level tags. A block's features are the word count and link density of
itself and of its neighbours, and one sign of its containers: -1 if one calls itself boilerplate
by element, role or whole class or id name, 1 if one calls itself the article, else 0. The tree is grown from
PAGES, a small labelled table of blocks in this module; its first questions are about words and
links, the sign is asked for below them. A sign of boilerplate is void on a container that holds most of
the page's words while nothing else says it is the article, as a wrapper of the whole page does.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose content is no text of the page; without an end tag they go on to the page's end, but for those of FOREIGN, which are then left open.
RAW, FOREIGN = "script|style|noscript|template|iframe|title|textarea|select|canvas", "svg"
TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<raw>{RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*[^>]*>|\Z)|<(?P<svg>{FOREIGN})(?=[\s/>])(?:[^>]*/>|[^>]*>.*?</(?P=svg)\s*>)"
    r"""|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-z][a-z0-9:-]*)(?P<attrs2>[^>]*)>""",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
BLOCKS = frozenset("address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul video audio".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Closed by the next block-level tag, or by the next of their kind.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6".split())
BOILER_TAGS = frozenset("nav header footer aside form button dialog menu head fieldset legend option".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Boilerplate also as inline elements.
AD_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adslot adunit adbox adsense adsbygoogle promo promoted promotion sponsor sponsored".split())
#: What never wraps an article.
FIRM_WORDS = AD_WORDS | frozenset("comment comments commentlist commentary-form consent cookie cookies disqus footer footnav nav navbar navigation breadcrumb breadcrumbs related replies reply respond responses newsletter gdpr".split())
BOILER_WORDS = FIRM_WORDS | frozenset("alert alerts announcement discussion megamenu sidenav snackbar subnav toast topnav banner copyright disclaimer dropdown header login masthead menu menus modal notice notices notification overlay pager pagination paywall popup privacy recommended recommendations search share sharing sidebar signin signup skip social subscribe subscription toolbar topbar widget widgets".split())
#: Parts of a name that change nothing: a name is a sign only if all its parts are known.
PLAIN_WORDS = frozenset("site page main top bottom left right global primary secondary sub mini my the box bar area block section container wrapper wrap inner outer holder list item items links link text content body panel pane form button buttons icon icons group row col column unit slot region header footer article post entry story module zone user reader 1 2 3 4 5 6 7 8 9 0".split())
#: Whole class or id names of what holds the article.
CONTENT = re.compile(r"(?:article|content|entry|main|post|story|main[-_]?content|(?:article|entry|page|post|story)[-_]?(?:body|content|text|header|title))")
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "sign")
#: The share of a page's words beyond which a container's sign can be void, and that of other containers that uphold it.
MOST, UPHELD = 0.5, 0.05


def _named(name: str, words: frozenset[str]) -> bool:
    """Whether a class or id name has a part among the words, and otherwise only plain parts."""
    parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
    return not words.isdisjoint(parts) and all(x in words or x in BOILER_WORDS or x in PLAIN_WORDS for x in parts)


def sign(tag: str, attrs: str) -> tuple[int, bool]:
    """What an element says it is: -1 boilerplate, 1 the article, 0 nothing; and whether it can't be a wrapper of the article."""
    if tag in ("html", "body"):
        return 0, False
    content, found, firm = tag in ("article", "main"), tag in BOILER_TAGS, tag in ("nav", "footer", "aside")
    for kind, *values in ATTRIBUTE.findall(attrs) if attrs else ():
        for name in "".join(values).lower().split():
            if kind.lower() == "role":
                content |= name in ("main", "article")
                found |= name in BOILER_ROLES
            elif CONTENT.fullmatch(name):
                content = True
            elif _named(name, BOILER_WORDS):
                found = True
                firm |= _named(name, FIRM_WORDS)
    return (-1 if found else int(content)), firm


def _advert(attrs: str) -> bool:
    return any(_named(name, AD_WORDS) for kind, *values in ATTRIBUTE.findall(attrs) if kind.lower() != "role" for name in "".join(values).lower().split())


class _Blocks:
    """Collects text blocks of one page, and the containers that they lie in."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = [("", 0)]  # element, number of the container
        self.containers: list[list] = [[-1, "", 0, False, 0]]  # container around it, element, sign, firm, words
        self.out: list[list] = []  # text, words, link density, container
        self.parts: list[str] = []
        self.link_parts: list[str] = []
        self.link = False
        self.skip: tuple[str, int] | None = None  # an inline advert that is open, and its depth

    def text(self, raw: str) -> None:
        if raw and self.skip is None:
            self.parts.append(raw)
            if self.link:
                self.link_parts.append(raw)

    def flush(self) -> None:
        if self.parts:
            words = html.unescape("".join(self.parts)).split()
            if words:
                linked = len(html.unescape(" ".join(self.link_parts)).split()) if self.link_parts else 0
                self.out.append([" ".join(words), len(words), min(1.0, linked / len(words)), self.stack[-1][1]])
            self.parts, self.link_parts = [], []

    def open(self, tag: str, attrs: str) -> None:
        stack = self.stack
        if stack[-1][0] in LEAVES:
            stack.pop()
        if tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ("ul", "ol", "dl", "table", "menu"):
                    break
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        around, (own, firm) = stack[-1][1], sign(tag, attrs)
        if own:
            self.containers.append([around, tag, own, firm, 0])
            around = len(self.containers) - 1
        stack.append((tag, around))

    def inline(self, tag: str, end: str, attrs: str) -> None:
        """Text of inline adverts is left out, to their end or that of their block."""
        if self.skip is not None:
            if tag == self.skip[0]:
                depth = self.skip[1] + (-1 if end else 1)
                self.skip = (tag, depth) if depth else None
        elif attrs and not end and tag not in VOID and _advert(attrs):
            self.skip = (tag, 1)

    def close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def signs(self) -> list[int]:
        """By container its sign, with those around it."""
        boxes = self.containers
        for _, words, _, at in self.out:
            boxes[at][4] += words
        for box in reversed(boxes[1:]):
            boxes[box[0]][4] += box[4]
        total, out = boxes[0][4], [0]
        for n, (around, tag, own, firm, words) in enumerate(boxes[1:], 1):
            if own < 0 and not firm and words > MOST * total and self._others(n) < UPHELD * total:
                own = 0
            outer = out[around]
            out.append(outer if outer < 0 or not own or tag == "header" and outer > 0 else own)
        return out

    def _others(self, n: int) -> int:
        """Words outside a container that lie in what calls itself the article."""
        boxes = self.containers
        around, at = set(), n
        while at >= 0:
            around.add(at)
            at = boxes[at][0]
        most = 0
        for m, (up, _, own, _, words) in enumerate(boxes[1:], 1):
            if own > 0 and m in around:
                most = max(most, words - boxes[n][4])
            elif own > 0:
                while up >= 0 and up != n and not (boxes[up][2] < 0 and up not in around):
                    up = boxes[up][0]
                if up < 0:
                    most = max(most, words)
        return most


def blocks(page: str | None) -> list[list]:
    """[text, words, link density, sign] of each text block of a whole page, in order."""
    page, at, b = page or "", 0, _Blocks()
    for m in TOKEN.finditer(page):
        if m.start() > at:
            b.text(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, end, attrs = tag.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if tag == "br":
            b.text(" ")
        elif tag not in BLOCKS:
            if tag == "a":
                b.link = not end
            b.inline(tag, end, attrs)
        else:
            b.flush()
            b.skip = None
            if end:
                b.close(tag)
                if tag in ("nav", "ul", "ol", "article", "footer"):
                    b.link = False
            elif tag not in VOID and not attrs.endswith("/"):
                b.open(tag, attrs)
    b.text(page[at:])
    b.flush()
    signs = b.signs()
    return [[*x[:3], signs[x[3]]] for x in b.out]


def features(found: list[list]) -> np.ndarray:
    """FEATURES of each block; beyond the ends neighbours have no words and no links."""
    own = np.array([x[1:] for x in found], float).reshape(-1, 3)
    pad = np.zeros((1, 2))
    return np.hstack([own[:, :2], np.vstack([pad, own[:-1, :2]])[: len(own)], np.vstack([own[1:, :2], pad])[: len(own)], own[:, 2:]])


# The labelled table: pages as rows of (label, markup), 1 for main text. Sentences are fillers of a given number of words.
def _w(n: int) -> str:
    return " ".join(["word"] * n)


def _links(*sizes: int) -> str:
    return "".join(f'<li><a href="/x">{_w(n)}</a></li>' for n in sizes)


PAGES: tuple[tuple[tuple[int, str], ...], ...] = (
    ((0, f"<header><div>{_w(2)}</div></header>"), (0, f"<nav><ul>{_links(1, 1, 2)}</ul></nav>"), (1, f"<article><h1>{_w(9)}</h1>"), (1, f"<p>{_w(60)}</p>"), (1, f"<p>{_w(2)}</p>"), (1, f"<p>{_w(28)} <a>{_w(3)}</a></p>"), (1, f"<ul><li>{_w(4)}</li><li><a>{_w(2)}</a></li></ul></article>"), (0, f"<footer>{_w(14)}</footer>")),
    ((0, f'<div class="cookie-notice">{_w(25)}</div>'), (0, f"<nav>{_links(1, 1)}</nav>"), (0, f'<div class="ad">{_w(18)}</div>'), (1, f"<article><h1>{_w(5)}</h1>"), (1, f"<p>{_w(1)}</p>"), (1, f"<p>{_w(140)}</p>"), (0, f'<div class="ad">{_w(45)}</div>'), (1, f"<p>{_w(12)}</p></article>"), (0, f'<section id="comments"><p>{_w(70)}</p><p>{_w(6)}</p></section>'), (0, f"<footer>{_w(3)}</footer>")),
    ((0, f'<div class="menu">{_links(2, 1, 1, 3)}</div>'), (1, f"<main><h2>{_w(6)}</h2>"), (1, f"<p>{_w(33)}</p>"), (0, f"<aside><p>{_w(40)}</p></aside>"), (1, f"<p>{_w(4)}</p>"), (0, f"<form><p>{_w(12)}</p></form>"), (1, f"<p><a>{_w(5)}</a></p></main>"), (0, f"<footer><p>{_w(22)}</p></footer>")),
    ((0, f"<div><a>{_w(2)}</a> <a>{_w(2)}</a></div>"), (0, f"<ul>{_links(1, 2, 1)}</ul>"), (1, f"<h1>{_w(8)}</h1>"), (1, f"<p>{_w(55)}</p>"), (1, f"<p>{_w(80)} <a>{_w(4)}</a></p>"), (1, f"<p>{_w(16)}</p>"), (1, f"<p>{_w(38)}</p>"), (0, f"<div><a>{_w(6)}</a></div>"), (0, f"<div>{_w(3)}</div>")),
    ((0, f"<div>{_w(2)}</div>"), (0, f"<ul>{_links(3, 3, 4, 2)}</ul>"), (1, f"<div>{_w(120)}</div>"), (1, f"<div>{_w(24)}</div>"), (1, f"<div>{_w(90)}</div>"), (0, f'<div class="sidebar"><p>{_w(50)}</p>{_links(5, 5)}</div>'), (0, f"<div>{_w(4)} <a>{_w(4)}</a></div>")),
    ((0, f'<div role="banner">{_w(6)}</div>'), (1, f"<h1>{_w(11)}</h1>"), (1, f"<p>{_w(45)}</p>"), (0, f'<p class="advert">{_w(30)}</p>'), (1, f"<p>{_w(66)}</p>"), (0, f'<div class="related"><h3>{_w(2)}</h3>{_links(8, 9, 7)}</div>'), (0, f'<div class="comment">{_w(44)}</div>'), (0, f'<div class="comment">{_w(9)}</div>')),
    ((0, f"<header>{_w(30)}</header>"), (0, f"<div>{_w(2)} <a>{_w(8)}</a></div>"), (1, f"<article><p>{_w(8)}</p>"), (0, f'<div class="share">{_w(5)}</div>'), (1, f"<p>{_w(20)}</p>"), (0, f'<p class="notice">{_w(35)}</p>'), (1, f"<p>{_w(3)}</p></article>"), (0, f"<div>{_w(4)}</div>"), (0, f'<div role="contentinfo">{_w(10)}</div>')),
    ((0, f"<nav>{_links(1, 1, 1)}</nav>"), (1, f"<article><h1>{_w(2)}</h1>"), (1, f"<p>{_w(2)}</p>"), (1, f"<p>{_w(31)}</p>"), (1, f"<p>{_w(1)}</p>"), (1, f"<p>{_w(3)}</p>"), (1, f"<p><a>{_w(4)}</a></p>"), (1, f"<p><a>{_w(1)}</a></p>"), (1, f"<p>{_w(200)}</p>"), (1, f"<p>{_w(5)}</p></article>"), (0, f"<footer>{_w(7)}</footer>")),
    ((1, f"<article><p>{_w(1)}</p>"), (1, f"<p>{_w(1)}</p>"), (1, f"<p><a>{_w(20)}</a></p>"), (1, f"<p>{_w(6)} <a>{_w(9)}</a></p>"), (1, f"<ul>{_links(1, 2, 6)}</ul>"), (1, f"<p>{_w(4)}</p>"), (0, f'<div class="ad">{_w(3)}</div>'), (1, f"<p>{_w(2)}</p></article>"), (0, f"<aside>{_w(60)}</aside>"), (0, f"<footer>{_w(3)}</footer>")),
    ((0, f"<div><a>{_w(16)}</a> <a>{_w(20)}</a></div>"), (0, f"<div><a>{_w(25)}</a></div>"), (1, f"<h1>{_w(4)}</h1>"), (1, f"<p>{_w(60)}</p>"), (1, f"<p>{_w(5)}</p>"), (1, f"<p>{_w(80)}</p>"), (1, f"<p>{_w(3)}</p>"), (1, f"<p>{_w(50)}</p>"), (1, f"<p>{_w(7)}</p>"), (1, f"<p>{_w(44)}</p>"), (0, f"<div><a>{_w(18)}</a> {_w(3)} <a>{_w(30)}</a></div>"), (0, f"<div>{_w(9)}</div>")),
    ((1, f"<h1>{_w(6)}</h1>"), (1, f"<p>{_w(30)}</p>"), (1, f"<p>{_w(70)}</p>")),
    ((1, f"<p>{_w(25)}</p>"), (1, f"<p>{_w(6)}</p>"), (1, f"<p>{_w(120)}</p>"), (0, f"<div>{_w(2)}</div>")),
    ((1, f"<h1>{_w(7)}</h1>"), (1, f"<p>{_w(60)}</p>"), (1, f"<p>{_w(52)}</p>"), (1, f"<p>{_w(45)}</p>")),
    ((1, f"<div>{_w(80)}</div>"), (1, f"<div>{_w(22)} <a>{_w(2)}</a></div>"), (1, f"<div>{_w(64)}</div>"), (0, f"<div>{_w(6)}</div>")),
    ((0, f"<div>{_w(3)}</div>"), (1, f"<h2>{_w(5)}</h2>"), (1, f"<p>{_w(110)}</p>"), (1, f"<p>{_w(18)}</p>")),
    ((0, f"<ul>{_links(2, 2, 1)}</ul>"), (1, f"<p>{_w(150)}</p>"), (1, f"<p>{_w(33)}</p>"), (0, f"<p>{_w(7)}</p>"), (0, f"<ul>{_links(1, 3)}</ul>")),
    ((1, f"<p>{_w(90)}</p>"), (1, f"<p>{_w(14)}</p>"), (1, f"<p>{_w(75)}</p>"), (1, f"<p>{_w(28)}</p>"), (0, f"<div>{_w(5)} <a>{_w(3)}</a></div>")),
    ((1, f"<p>{_w(40)}</p>"),),
    ((0, f"<header>{_w(1)}</header>"), (1, f"<main><h1>{_w(3)}</h1>"), (1, f"<p>{_w(1)} <a>{_w(2)}</a></p>"), (1, f"<h2>{_w(1)}</h2>"), (1, f"<p>{_w(2)}</p>"), (1, f"<h2><a>{_w(2)}</a></h2>"), (1, f"<p>{_w(9)}</p></main>")),
    ((0, f"<div><a>{_w(1)}</a></div>"), (0, f"<div>{_w(1)}</div>"), (1, f"<p>{_w(30)}</p>"), (0, f"<div><a>{_w(12)}</a></div>"), (0, f"<div><a>{_w(10)}</a></div>"), (0, f"<div>{_w(5)}</div>")),
)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of PAGES."""
    xs, ys = [], []
    for page in PAGES:
        marked = "".join(f"{part}<!--{n}-->" for n, (_, part) in enumerate(page))
        ends = [m.end() for m in re.finditer(r"<!--\d+-->", marked)]
        counts = [len(blocks(marked[:end])) for end in ends]
        ys += [label for (label, _), n, before in zip(page, counts, [0, *counts], strict=False) for _ in range(n - before)]
        xs.append(features(blocks(marked)))
    return np.vstack(xs), np.array(ys)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, shallow: int = 2) -> tuple | int:
    """A decision tree by Gini impurity: (feature, threshold, tree for at most it, tree for more), or a label.

    The first `shallow` levels ask about words and links only, not about the sign. Ties: the first feature, the least threshold.
    """
    if depth == 0 or len(set(y.tolist())) < 2:
        return int(2 * y.sum() > len(y))
    best = None
    for f in range(x.shape[1] - (shallow > 0)):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= t
            p, q = y[left].mean(), y[~left].mean()
            impurity = left.sum() * p * (1 - p) + (~left).sum() * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, float(t), left
    if best is None:
        return grow(x, y, depth, 0) if shallow > 0 else int(2 * y.sum() > len(y))
    _, f, t, left = best
    below, above = (grow(x[part], y[part], depth - 1, shallow - 1) for part in (left, ~left))
    return below if below == above and isinstance(below, int) else (f, t, below, above)


@lru_cache(1)
def tree() -> tuple | int:
    return grow(*labelled())


def classify(row: list[float], node: tuple | int) -> int:
    while not isinstance(node, int):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def main_text(page: str | None) -> str:
    """Main text of a whole page: kept blocks in order, joined by an empty line; empty if there is none."""
    found = blocks(page)
    if not found:
        return ""
    node = tree()
    return "\n\n".join(b[0] for b, row in zip(found, features(found).tolist(), strict=True) if classify(row, node))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, ...) -> (page_id, url, text, n_chars), a row per row, without a shuffle.

    White space inside a block (also no-break spaces and br) is one space. Null html is empty and
    has empty text. Nulls in page_id and url stay; repeated rows stay; other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
