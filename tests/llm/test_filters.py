"""URL filter, HTML extraction, packing and top-k against brute force."""

import math
import random
import zlib

import numpy as np
import pytest

from millrace.llm import htmltext, packing, topk, urlfilter

PAGE = "page_id long, url string, html string"


@pytest.mark.parametrize(
    "url, host, path",
    [
        (None, "", ""),
        ("", "", ""),
        ("no scheme/x", "", ""),
        ("http://", "", ""),
        ("http://HOST.Net", "host.net", ""),
        ("ftp://a.b:80/c?d#e", "a.b:80", "/c"),
        ("x://a#b/c", "a", ""),
        ("x://a?b://c/d", "a", ""),
        ("x://a/b://c/d#", "a", "/b://c/d"),
        ("x://ÀB.org/É", "Àb.org", "/É"),
    ],
)
def test_host_and_path(url, host, path):
    assert urlfilter.split_url(url) == (host, path)


@pytest.mark.parametrize(
    "host, path, rule",
    [
        ("net", "/", "net/"),
        ("a.b.net", "/x", "net/"),
        ("anet", "/", None),
        ("x.net", "", None),
        ("www.example.net", "/en/1", "example.net/en/"),
        ("notexample.net", "/en/1", "net/"),
        ("example.net", "/en", "net/"),
        ("m.example.com", "/de/", "example.com/de/"),
        ("example.com", "/fr/", None),
        ("example.org", "/fr/x", "org/fr/"),
        ("org", "/fr/x", "org/fr/"),
        ("org.", "/fr/x", None),
    ],
)
def test_longest_rule_that_fits(host, path, rule):
    found = urlfilter.fitting_rule(host, path)
    assert (found and found[0]) == rule


@pytest.mark.parametrize(
    "url, hits",
    [
        ("http://x.com/casino", (1, 0)),
        ("http://x.com/casinos", (0, 0)),
        ("http://CASINO.com/9xxx", (1, 0)),
        ("http://x.com/ads/track/ads", (0, 2)),
        ("http://ads-track.x.com", (1, 2)),
        ("http://x.com/loads", (0, 0)),
        (None, (0, 0)),
    ],
)
def test_terms_need_boundaries(url, hits):
    assert urlfilter.weigh(url) == hits


def test_terms_equal_a_plain_scan():
    import re

    rng = random.Random(0)
    parts = [*urlfilter.STRICT, *urlfilter.SOFT, "-", "/", ".", "a", "s", "0", "é", " "]
    for _ in range(500):
        url = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        plain = lambda w: len(re.findall(rf"(?<![a-z0-9])(?={re.escape(w)}(?![a-z0-9]))", url))
        assert urlfilter.weigh(url) == (sum(map(plain, urlfilter.STRICT)), sum(plain(w) > 0 for w in urlfilter.SOFT))


def test_judged_pages_equal_sql(spark):
    import duckdb
    import pandas as pd

    urls = [None, "", "x", "http://a.net", "http://a.net/", "https://Example.NET/en/x?casino", "http://a.com/casino", "http://a.com/free/win", "http://a.com/free", "http://a.com/freed/casinos#porn", "http://b.org/fr/porn", "http://example.com/de/1", "http://a.com/free", "a\nb://c.net/\n?x"]
    pages = spark.createDataFrame([(i if i else None, u, "h") for i, u in enumerate(urls)], PAGE).selectExpr("*", "1 AS host", "2 AS verdict")
    got = urlfilter.judge_urls(pages).drop("strict_hits", "soft_hits").toPandas()
    con = duckdb.connect()
    con.register("pages", pd.DataFrame({"page_id": [i if i else None for i in range(len(urls))], "url": urls}))
    want = con.execute(urlfilter.oracle()).df()
    rows = lambda t: sorted(map(repr, t.astype(object).where(t.notna(), None)[["host", "path", "rule", "verdict"]].values.tolist()))
    assert rows(got) == rows(want)
    assert urlfilter.judge_urls(pages.where("false")).count() == 0


ARTICLE = """<!doctype html><html class="no-sidebar"><head><title>Site &amp; page</title><style>p{}</style></head><body>
<div id="cookie-consent"><p>We use cookies to make this site work for you and our many partners.</p></div>
<header><a href="/">Site</a> motto</header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="layout sidebar-left"><article class="post"><h1>The  title&nbsp;here</h1>
<p>First <b>para</b>graph with <a href="x">a link</a>&hellip;<br>next line<p>Short.
<div class="ad">Buy this very good thing now, since it is cheap and it is good and it is now.</div>
<script>if (a < b) { document.write("<p>no</p>") }</script><!-- <p>hidden</p> -->
<ul><li>An item</li><li>Another</li></ul><form action="/s"><label>Mail</label><button>Send</button></form>
<pre>a   b
c</pre></article>
<aside><p>A long sidebar paragraph that talks about other things that are not in the article at all.</p></aside>
<section class="comments"><article class="comment"><p>What a great article, I really enjoyed to read it, thank you all very much.</p></article></section></div>
<footer>&copy; Site</footer></body></html>"""


def test_article_without_boilerplate():
    assert htmltext.main_text(ARTICLE) == "The title here\n\nFirst paragraph with a link… next line\n\nShort.\n\nAn item\n\nAnother\n\na b c"


def test_pages_without_an_article_are_judged_by_words_and_links():
    links = "".join(f"<li><a href='/{i}'>menu entry {i}</a></li>" for i in range(8))
    body = " ".join(["text"] * 40)
    page = f"<body><ul>{links}</ul><p>{body} one</p><p>{body} two</p><p>{body} three</p><div><a>a</a> <a>b</a></div></body>"
    assert htmltext.main_text(page) == f"{body} one\n\n{body} two\n\n{body} three"


def test_containers_are_told_by_their_names():
    page = '<body><div class="topnav">a b</div><div id="content"><h2>T</h2><p>Short.</p><p>x <span class="ad">buy <span>now</span></span> y</p><p class="byline">By me</p><div class="alert">no</div></div><div class="reader-comments">text text text</div></body>'
    assert htmltext.main_text(page) == "T\n\nShort.\n\nx y\n\nBy me"


@pytest.mark.parametrize("page", ["", None, "<", "<p", "<!--", "<script>", "</p></div>", "<p title='>x", "<<p>>", "&#x110000;&bogus;", "<![CDATA[", "\x00<p>\x00"])
def test_broken_markup_does_not_crash(page):
    assert isinstance(htmltext.main_text(page), str)


def test_tree_fits_its_table_and_holds_out():
    x, y = htmltext.labelled()
    assert np.mean([htmltext.classify(r, htmltext.tree()) == label for r, label in zip(x.tolist(), y.tolist())]) > 0.95
    right = 0
    for i in range(0, len(y), 5):
        rest = np.ones(len(y), bool)
        rest[i : i + 5] = False
        node = htmltext.grow(x[rest], y[rest])
        right += sum(htmltext.classify(r, node) == label for r, label in zip(x[~rest].tolist(), y[~rest].tolist()))
    assert right / len(y) > 0.85


def filler(n):
    return " ".join(f"word{i}" for i in range(n))


@pytest.mark.parametrize(
    "page, words",
    [
        (f'<div class="layout sidebar-left"><h1>Title here</h1><p>{filler(40)}</p></div>', 42),
        (f'<article class="post tag-cookies"><h1>T</h1><p>{filler(40)}</p></article>', 41),
        (f'<article class="topic-correlated"><p>{filler(40)}</p></article>', 40),
        (f'<body><form id="aspnetForm"><nav><a>x</a></nav><h1>Title</h1><p>{filler(40)}</p><p>{filler(30)}</p></form>', 70),
        (f"<article><p>before <math><mi>x</mi></math> after</p><svg width=1/><p>{filler(20)}</p><object><p>fallback text</p></object></article>", 25),
        (f'<div id="content"><p>{filler(50)}</p></div><div id="comments"><div class="comment"><article><p>{filler(400)}</p></article></div></div>', 50),
        (f'<main class="commentary"><p>{filler(30)}</p></main>', 30),
        (f'<div class="correspondent"><p>{filler(30)}</p><p>{filler(30)}</p></div><footer><p>{filler(30)}</p></footer>', 60),
        (f'<div class="sidebar"><p>{filler(100)}</p></div><article><p>{filler(40)}</p></article>', 40),
        (f"<article><p>{filler(300_000)}</p><p>{filler(2)}</p></article>", 300_002),
    ],
)
def test_names_don_t_decide_over_most_of_a_page(page, words):
    assert len(htmltext.main_text(page).split()) == words


def test_tree_splits_are_the_best_there_are():
    x, y = htmltext.labelled()

    def gini(ys):
        return sum(ys) * (len(ys) - sum(ys)) / len(ys) if ys else 0.0

    def check(node, rows, level):
        if isinstance(node, int):
            labels = [t for _, t in rows]
            assert node == int(2 * sum(labels) > len(labels))
            return
        f, t, below, above = node
        left, right = ([r for r in rows if (r[0][f] <= t) == side] for side in (True, False))
        cost = gini([b for _, b in left]) + gini([b for _, b in right])
        for g in range(len(htmltext.FEATURES) - (level < 2)):
            for edge in sorted({r[0][g] for r in rows})[:-1]:
                a, b = ([q for p, q in rows if (p[g] <= edge) == side] for side in (True, False))
                assert gini(a) + gini(b) >= cost - 1e-9
        check(below, left, level + 1)
        check(above, right, level + 1)

    rows = list(zip(x.tolist(), y.tolist()))
    check(htmltext.tree(), rows, 0)
    assert htmltext.FEATURES[htmltext.tree()[0]] != "sign"


def test_extracted_pages(spark):
    pages = spark.createDataFrame([(1, "u", ARTICLE), (2, None, None), (None, "v", ""), (1, "u", ARTICLE)], PAGE).selectExpr("*", "0 AS text", "1 AS n_chars")
    got = htmltext.extract(pages).collect()
    want = htmltext.main_text(ARTICLE)
    assert sorted((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in got) == [(0, "v", "", 0), (1, "u", want, len(want)), (1, "u", want, len(want)), (2, "", "", 0)]
    assert htmltext.extract(pages.where("false")).count() == 0


def test_sum_of_squares_by_hand():
    which, offset, bins = packing.sum_of_squares(np.array([6, 4, 10, 3, 7, 5, 5]), 10)
    assert bins == 4
    assert [which[i] for i in (0, 3, 5)] == [which[i] for i in (1, 4, 6)]


def test_sum_of_squares_equals_a_plain_search():
    rng = random.Random(1)
    for _ in range(20):
        cap = rng.choice([5, 17, 64])
        sizes = np.array([rng.randrange(1, cap + 1) for _ in range(60)])
        which, offset, bins = packing.sum_of_squares(sizes, cap)
        gaps, where = [], {}
        for i in np.argsort(-sizes, kind="stable").tolist():
            def total(g):
                open_ = [x for x in g if 0 < x < cap]
                return sum(open_.count(x) ** 2 for x in set(open_))

            tries = [(total(gaps[:b] + [g - sizes[i]] + gaps[b + 1 :]), g, 0, b) for b, g in enumerate(gaps) if g >= sizes[i]]
            tries.append((total([*gaps, cap - sizes[i]]), cap, 1, len(gaps)))
            _, _, _, b = min(tries)
            if b == len(gaps):
                gaps.append(cap)
            gaps[b] -= sizes[i]
            where[i] = b
        assert bins == len(gaps)
        assert sorted(np.bincount(which, sizes).tolist()) == sorted(cap - g for g in gaps)
        for b in range(bins):
            own = np.flatnonzero(which == b)
            own = own[np.argsort(offset[own])]
            assert offset[own].tolist() == (np.cumsum(sizes[own]) - sizes[own]).tolist()


TEXTS = ["", None, "Hello World", "it's 42 naïve cafés", "word " * 30, "<|endoftext|> x<|startoftext|>", "a b\x1cc\x85d e", "ΑΣ ΟΔΟΣ", "e\u0301 \u0301x", "日本 語" * 9, "z" * 3000, "\U0001f600!?--...\t\r\n'll"]


def test_packed_pieces_hold_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_file())
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(TEXTS)] + [(2, "Hello World")], "doc_id long, text string").selectExpr("*", "1 AS piece", "2 AS length")
    got = packing.pack(docs, length=16).collect()
    want = []
    for i, t in [*enumerate(TEXTS), (2, "Hello World")]:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, n, n * 16, len(ids[n * 16 : n * 16 + 16]), zlib.crc32(ids[n * 16 : n * 16 + 16].tobytes())) for n in range(-(-len(ids) // 16))]
    assert sorted((r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == (np.cumsum([n for _, n in own]) - [n for _, n in own]).tolist() and sum(n for _, n in own) <= 16
    assert len(places) <= math.ceil(sum(r["length"] for r in got) / 16) + 2
    assert packing.pack(docs.where("false")).count() == 0


def test_letters_that_are_normalised_with_a_mark_are_encoded_like_the_tokenizer():
    v = packing._WordIds(packing.tokenizer_file())
    odd = [c for c in map(chr, range(128, 0x30000)) if c.isalpha() and not packing._letters(c)]
    assert "\u0130" in odd and len(odd) > 50
    texts = ["\u0130stanbul and Ankara", "x\u0130. y\u0130", *(f"a{c}b {c} a{c}. plain" for c in odd)]
    assert [np.frombuffer(x, "<u4").tolist() for x in v.ids(texts)] == [v._encode(t) for t in texts]


def test_batches_with_other_ends_than_words_are_encoded_word_by_word(monkeypatch):
    monkeypatch.setattr(packing, "_letters", str.isalpha)
    v = packing._WordIds(packing.tokenizer_file())
    assert np.frombuffer(v.ids(["\u0130stanbul and Ankara"])[0], "<u4").tolist() == v._encode("\u0130stanbul and Ankara")


def plain_top(rows, k, every=100):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in {i: x for i, x in sorted(ok, key=lambda r: (r[0], [-y for y in r[1]])) if i % every == 0}.items():
        got = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q and len(x) == len(y))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(got)]
    return sorted(out)


@pytest.mark.parametrize("block, bins", [(2048, 2048), (2, 4)])
def test_top_k_equals_brute_force(spark, block, bins):
    rng = random.Random(block)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)]  # ties
    rows += [(2000, None), (2001, [None] * 8), (2100, [float("nan")] * 8), (2002, [float("inf")] * 8), (None, [0.1] * 8), (2200, [0.25, 0.5]), (2201, [1.0, 1.0]), (2300, []), (2301, [0.0] * 8), (-100, [0.5] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS rank").repartition(7)
    got = sorted(tuple(r) for r in topk.exact_top_k(table, 10, block=block, bins=bins).collect())
    assert [g for g in got if g[0] != 2300] == [w for w in plain_top(rows, 10) if w[0] != 2300]


def test_top_k_of_nothing(spark):
    assert topk.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert topk.exact_top_k(spark.createDataFrame([(100, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_ids_of_letters_with_marks_and_of_any_strings():
    import random
    import unicodedata

    v = packing._WordIds(packing.tokenizer_file())
    marks = [chr(c) for c in range(0x300, 0x36F)]
    letters = [chr(c) for c in range(0x41, 0x2000) if chr(c).isalpha() and unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt")]
    rng = random.Random(1)
    chars = [chr(c) for c in range(1, 0x3000) if unicodedata.category(chr(c))[0] != "C"] + list("\t\n\r\x0b\x0c\x85\xa0​ 　")
    texts = [a + m for a in letters for m in marks[::5]] + [f"X{a}{m}. Y" for a in letters[::7] for m in marks]
    texts += ["".join(rng.choice(chars if rng.random() < 0.3 else "abcXYZ .,É" + rng.choice(marks)) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    for i in range(0, len(texts), 5000):
        part = texts[i : i + 5000]
        want = v.tokenizer.encode_batch(part, add_special_tokens=False)
        assert [x for x, ids, w in zip(part, v.ids(part), want, strict=True) if np.frombuffer(ids, "<u4").tolist() != w.ids] == []


def test_top_k_of_vectors_of_any_finite_size(spark):
    import math
    import random

    rng = random.Random(3)
    size = lambda: rng.choice([1.0, 1.0, 1e3, 1e9, 1e18, 1e300])
    rows = [(k % 330, [rng.uniform(-1, 1) * s for _ in range(3)]) for k in range(340) for s in [size()]]
    rows += [(400, [1.7e308] * 3), (500, [0.5, 2.0]), (700, [float("inf"), 1.0, 1.0]), (800, None), (7, [1.0, None, 2.0]), (None, [1.0, 1.0, 1.0]), (41, [3e15, -3e15, 3e15]), (42, [3e15, -3e15, 3e15])]
    whole = lambda v: [int(x) * 1024 if abs(x) >= 2**53 else math.floor(x * 1024) for x in v]
    able = [(i, v, whole(v)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v))]
    asks = {i: min(v for j, v, _ in able if j == i) for i, _, _ in able if i % 100 == 0}
    want = []
    for i, v in asks.items():
        q = whole(v)
        scores = sorted((-min(max(sum(map(lambda a, b: a * b, q, x)), -(2**63)), 2**63 - 1), j) for j, w, x in able if j != i and len(w) == len(v))[:10]
        want += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for block in (2048, 2):
        assert sorted(map(tuple, topk.exact_top_k(table, 10, block=block).collect())) == sorted(want)
