"""Main text of pages: structure, suffix arrays and hosts dealt out in chunks."""

import random
import re
import time

import numpy as np
import pytest

from surety.llm import common
from surety.llm import html_text as H

PAGE = (
    '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href="/x">x</a></li></ul></nav>'
    '<!-- ad --><div class="ad">Buy</div><header>Site</header><article><header><h1>Head&amp;&am</h1></header><p><b>One  two&nbsp;three<br>four<p>Fi<i>v</i>e &lt;b&gt; &#233;</p>'
    '<div id="comments"><p>first!</p></div><form><p>mail</p></form><aside>side</aside><ul><li>a<li>b</ul></article><div class="cookie-notice">ok</div><footer>&copy; x</footer>'
)
TEXT = "Head&&am\nOne two three four\nFive <b> é\na\nb"


def texts(source):
    return "\n".join(t for k, t in H.blocks(source) if k != H.FURNISHED)


@pytest.mark.parametrize(
    "source, want",
    [(PAGE, TEXT), ("", ""), ("plain & text", "plain & text"), ("<p>a<p>b", "a\nb"), ("a < b <", "a < b <"), ("<div>x<span class=ad>no</span> y</div>", "x y"), ("<p title='>\">q</p", '">q'), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("<article>a<script>x", "a"), ("&am<b>p;</b>", "&amp;"), ("<nav>x</nav>" * 500 + "<p>y", "y")],
)
def test_blocks(source, want):
    assert texts(source) == want


def test_furniture_is_kept_apart():
    assert H.blocks("<p>a <span class=ad>buy</span> b</p><nav>m<br>n</nav>") == [(H.OPEN, "a b"), (H.FURNISHED, "buy"), (H.FURNISHED, "m n")]


@pytest.mark.parametrize(
    "source, want",
    [
        ('<div class="layout has-sidebar"><article><p>a b</p></article></div>', "a b"),
        ('<div class="search-results"><p>a b</p></div>', "a b"),
        ('<article><div class="share-story">a b</div></article>', "a b"),
        ('<div class="sidebar"><article>a b</article> menu</div>', "a b"),
        ('<form id="aspnet"><header>top</header><main><p>a b</p><form>mail</form></main> rest</form>', "a b"),
        ('<aside><article>teaser</article></aside><article>a b</article>', "a b"),
        ('<article>a b</article><ol class="comment-list"><li><article class="comment-body">first!</article></ol>', "a b"),
        ('<article>a b<article class="comment">first!</article></article>', "a b"),
        ('<div hidden>x</div><p class="hidden-gem">a b</p><div aria-hidden="true">y</div>', "a b"),
        ('<div class="siteHeader">x</div><div class="cookie-banner">y</div><p>a b', "a b"),
    ],
)
def test_articles_survive_what_arranges_them(source, want):
    assert texts(source) == want


def test_deep_nesting_takes_linear_time():
    n, start = 200_000, time.time()
    for source in ("<div>" * n + "x", "<div>" * n + "x" + "</div>" * n, "<ul>" * n + "</div>" * n + "x", "<p>" + "<b>" * n + "x", "<li>" * n + "x", "<p><b>" * n + "x", "<i>" * n + "</b>" * n + "x"):
        assert texts(source) == "x"
    assert time.time() - start < 60


def test_suffix_arrays_and_common_prefixes_match_sorted_suffixes():
    rng = random.Random(1)
    for longest in (4, 8, 1024):
        cuts = [rng.randint(0, 30) for _ in range(6)]
        t = np.array([rng.randint(0, 2) for _ in range(sum(cuts))], np.uint64)
        page = np.repeat(np.arange(6), cuts)
        ends = np.cumsum(cuts)[page]
        order, common = H.suffix_array(t, ends - np.arange(len(t)), longest)
        tail = [tuple(t[i : ends[i]].tolist()) for i in range(len(t))]
        assert [tail[i][:longest] for i in order] == sorted(x[:longest] for x in tail)

        def prefix(a, b):
            return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

        if longest == 1024:
            assert [prefix(tail[a], tail[b]) for a, b in zip(order, order[1:])] == common[1:].tolist()
            got = H.shared_lengths(order, common, page)
            assert got.tolist() == [max((prefix(tail[i], tail[j]) for j in range(len(t)) if page[j] != page[i]), default=0) for i in range(len(t))]


def brute(pages, depth):
    """Whether all of a block's tokens lie in runs of depth tokens that a different page has too."""
    flat = [[(b, w) for b, text in enumerate(page) for w in H.WORD.findall(text.lower())] for page in pages]
    seen = {}
    for p, row in enumerate(flat):
        for i in range(len(row) - depth + 1):
            seen.setdefault(tuple(w for _, w in row[i : i + depth]), set()).add("\0".join(pages[p]))
    out = []
    for page, row in zip(pages, flat):
        covered = [False] * len(row)
        for i in range(len(row) - depth + 1):
            if len(seen[tuple(w for _, w in row[i : i + depth])]) > 1:
                covered[i : i + depth] = [True] * depth
        of = [[c for (x, _), c in zip(row, covered) if x == b] for b in range(len(page))]
        out.append([bool(x) and all(x) for x in of])
    return out


def test_covered_blocks_match_brute_force():
    rng = random.Random(9)
    hits = 0
    for depth in (2, 3, 5):
        for _ in range(6):
            pages = [[" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 4))] for _ in range(12)]
            pages += pages[:2]
            got = H.repeated(pages, depth)
            assert got == brute(pages, depth)
            hits += sum(map(sum, got))
    assert hits > 20


def test_mirrored_pages_and_quotes_keep_their_text():
    same = [(H.OPEN, "one two three four five six seven eight nine ten eleven twelve thirteen")]
    assert H.clean([same, same]) == [same[0][1]] * 2
    # all of a page is somewhere else too: nothing unique is left to prefer
    assert H.clean([same, same + [(H.OPEN, "more")]]) == [same[0][1], "more"]
    quote = "a b c d e f g h i j k l"
    quoted = [[(H.OPEN, f"first page says {quote} and then goes on")], [(H.OPEN, f"the second quotes {quote} as well")]]
    assert H.clean(quoted) == [p[0][1] for p in quoted]


@pytest.mark.parametrize("chunk, rows_broadcast", [(250_000, 500_000), (400, 500_000), (3000, 0)])
def test_pages_match_a_plain_version(spark, monkeypatch, chunk, rows_broadcast):
    """Pages without articles, where the suffix array decides, over hosts of one chunk and of many."""
    monkeypatch.setattr(H, "CHUNK", chunk)
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows_broadcast)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    bars = [" ".join(word() for _ in range(9)) for _ in range(6)]
    rows = []
    for i in range(50):
        own = [" ".join(word() for _ in range(rng.randint(1, 25))) for _ in range(3)]
        mix = own + rng.sample(bars, 3)
        rng.shuffle(mix)
        rows.append((i, f"http://h{i % 2}.example/{i}", "".join(f"<div>{t}</div>" for t in [bars[0], bars[1], *mix])))
    rows += [(90, rows[3][1], rows[3][2]), (None, None, None), (91, None, "<p>x")]
    want = []
    for host in ("h0.", "h1.", None):
        mine = [r for r in rows if (host in r[1] if r[1] and host else r[1] is None and host is None)]
        parsed = [re.findall("<div>(.*?)</div>", r[2] or "") or re.findall("<p>(.*)", r[2] or "") for r in mine]
        for r, page, gone in zip(mine, parsed, brute(parsed, H.DEPTH)):
            left = [t for t, g in zip(page, gone) if not g]
            want.append((r[0], "\n".join(left or page)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = [(r.page_id, r.text) for r in H.extract(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    # without the suffix array the result is another one
    assert sum("\n".join(re.findall("<div>(.*?)</div>", r[2] or "")) != t for r in rows[:50] for k, t in got if k == r[0]) > 40


def test_keys_of_any_kind_and_long_pages(spark):
    long = "<p>" + "word " * 400_000 + "</p>"
    df = spark.createDataFrame([("a", "u", long), ("b", "u", "<p>q</p>" * 3000)], "page_id string, url string, html string")
    for kind in ("string", "binary"):
        got = {bytes(r[0], "ascii") if isinstance(r[0], str) else bytes(r[0]): r for r in H.extract(df.withColumn("page_id", df.page_id.cast(kind))).collect()}
        assert got[b"a"].n_chars == 5 * 400_000 - 1 and got[b"b"].text.count("q") == 3000


def test_open_boilerplate_goes_and_unique_runs_stay(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    common = " ".join(word() for _ in range(20))
    rows, want = [], {}
    for i in range(60):
        own = " ".join(word() for _ in range(30))
        rows.append((i, f"https://a.example/{i}", f"<div>Home</div><div>{common}</div><div>{own}</div><div>{common} {own[:20]}x</div>", "k"))
        want[i] = own + "\n" + common + " " + own[:20] + "x"
    art = "<article><p>" + common + "</p></article>"
    rows += [(100 + i, "https://b.example/", art, "k") for i in range(3)] + [(200, None, None, "k"), (201, None, "<p>x", "k"), (100, "https://b.example/", art, "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for size in (H.CHUNK, 3000):
        monkeypatch.setattr(H, "CHUNK", size)
        out = H.extract(df).collect()
        assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
        got = {r.page_id: r.text for r in out}
        assert {i: got[i] for i in want} == want
        assert got[100] == common and got[200] == "" and got[201] == "x"
    assert H.extract(df.limit(0)).count() == 0
