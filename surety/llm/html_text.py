"""Main text of web pages by a host's suffix array, with a check by structure.

A page is cut into blocks of visible text. The token streams of a host's pages (all blocks but those that the markup
itself declares to be an article) are concatenated with a separator after each; their suffixes are sorted, and the
longest common prefixes of neighbours give, for every token, the longest substring from there that a distinct page has
too. Substrings of DEPTH tokens and more are boilerplate: blocks that they cover to the last token are removed, runs of
other blocks are kept whole. Exact copies of a page count as one page, and a page without an article of which nothing
would be left keeps its blocks, so mirrored pages keep their text.

A check by structure follows: blocks inside menus, headers, footers, sidebars, notices, adverts, forms and reader
comments are removed even if they are unique to their page. They are known by element, or by a class, id or role one of
whose words names furniture as a whole (comment-list does, has-sidebar and share-story don't). What only arranges a page
(a form, a header, a class) never removes an article inside it.

A host is dealt out in chunks of about CHUNK characters (by a hash of the page), so a host with any share of the
pages spreads over many tasks and every task holds one chunk at a time. A substring of DEPTH tokens or more is the
union of its windows of DEPTH tokens, so what repeats across chunks follows from the fingerprints of these windows:
they are aggregated by host and joined back to the chunks that hold them, which gives the same blocks whatever the
chunks are.

Defined results: a null html gives an empty text; a page without visible content too; a null url is a host of its
own; repeated rows each give a row; a null key is a key like others. Texts and nesting may have any length.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from surety.llm.common import discard, map_batches, materialise, small_side

#: Tokens of a repeated substring; characters in a chunk; tokens that suffixes are sorted to, longer repeats being unions.
DEPTH, CHUNK, SORTED = 12, 250_000, 1024
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(?P<bad>/?)(?P<bname>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Elements by what they do. Fixed values of the HTML standard.
RAW = frozenset("script style textarea title noscript template iframe svg math canvas object noframes xmp noembed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav footer aside form head menu dialog button select input fieldset header".split())
MAIN = frozenset("article main".split())
#: Words of class, id and role values that mark page furniture; of these, those under which articles aren't the page's.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer cookie cookies consent notice notices alert popup modal newsletter subscribe subscription signup login form search comment comments commentlist reply replies respond disqus discussion share sharing social related recommended complementary contentinfo pagination pager skip toolbar widget".split()
)
FOREIGN = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion footer comment comments commentlist reply replies respond disqus discussion related recommended contentinfo".split())
#: Words that may stand beside them in a compound.
PLAIN_WORDS = frozenset("site main page top bottom left right primary secondary global box bar list section container wrapper wrap block inner outer item link links area body content post article text icon buttons button dialog overlay panel group col column row the user reader readers".split())
#: Elements whose start tag ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SPACE = re.compile(r"\s+")
#: Attributes that can say what an element is; the attribute without a value; quoted values.
TELLING = re.compile(r"class|id|role|hidden", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
WORD = re.compile(r"[^\W_]+|[^\w\s]")
#: Inside an article these belong to it.
TITLES = frozenset("header masthead".split())
#: Elements under which an article isn't the page's own.
APART = frozenset("nav footer aside".split())
OPEN, KEEP, FURNISHED = 0, 1, 2
#: How an element removes what is inside it: not, but for an article, altogether.
FREE, ARRANGED, GONE = 0, 1, 2
_P = np.uint64(0x9E3779B97F4A7C15)


def _named(value: str) -> set[str]:
    """The furniture words of a class, id or role value's names that consist of such and plain words alone."""
    out = set()
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
        found = FURNITURE.intersection(words)
        if found and all(w in FURNITURE or w in PLAIN_WORDS for w in words):
            out |= found
    return out


def _furniture(name: str, rest: str, main: bool) -> int:
    """FREE, ARRANGED or GONE for an element."""
    out = FREE
    if name in DROPPED and not (main and name in TITLES):
        out = GONE if main or name in APART else ARRANGED
    if not TELLING.search(rest):
        return out
    if HIDDEN.search(QUOTED.sub('""', rest)):
        return GONE
    for m in ATTRIBUTE.finditer(rest):
        key = m[1].lower()
        if key in ("class", "id", "role") and name not in ("html", "body"):
            found = _named(m[2] or m[3] or m[4] or "")
            if name in MAIN:
                found &= FOREIGN
            if found and not (main and TITLES.issuperset(found)):
                out = max(out, GONE if main or found & FOREIGN else ARRANGED)
        elif key == "aria-hidden" and "true" in m[0].lower():
            return GONE
    return out


class _Page:
    """The open elements and the blocks so far. A frame of the stack: (name, how it removes, in an article, the
    open paragraph that a block element would end or -1)."""

    def __init__(self):
        self.out, self.parts, self.aside, self.stack, self.where = [], [], [], [], {}

    def state(self):
        return self.stack[-1][1:] if self.stack else (FREE, False, -1)

    def add(self, text):
        (self.aside if self.state()[0] else self.parts).append(text)

    def flush(self):
        kept = KEEP if self.state()[1] else OPEN
        for held, kind in ((self.parts, kept), (self.aside, FURNISHED)):
            if held:
                text = SPACE.sub(" ", "".join(held)).strip()
                if text:
                    self.out.append((kind, text))
                held.clear()

    def push(self, name, rest):
        gone, main, p = self.state()
        inline = name in INLINE
        if not inline or rest:
            gone = max(gone, _furniture(name, rest, main))
            if name in MAIN and gone == ARRANGED:
                gone = FREE
            main = main or name in MAIN
        self.where.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, gone, main, len(self.stack) if name == "p" else p if inline else -1))

    def leave(self, depth):
        while len(self.stack) > depth:
            self.where[self.stack.pop()[0]].pop()

    def close(self, name):
        if name in INLINE:
            # an inline element ends only within its own block
            if self.stack and self.stack[-1][0] == name:
                self.leave(len(self.stack) - 1)
            return
        self.flush()
        if self.where.get(name):
            self.leave(self.where[name][-1])

    def open(self, name, rest):
        if name not in INLINE:
            self.flush()
            if name in ENDS_P and self.state()[2] >= 0:
                self.leave(self.state()[2])
            siblings = SELF_CLOSING.get(name)
            while siblings and self.stack and (self.stack[-1][0] in siblings or self.stack[-1][0] in INLINE or self.stack[-1][0] == "p"):
                self.leave(len(self.stack) - 1)
            if rest.rstrip().endswith("/") and name not in MAIN and name not in ("p", "div"):
                return
        self.push(name, rest)


def blocks(source: str) -> list[tuple[int, str]]:
    """(KEEP, OPEN or FURNISHED, text) of the visible blocks in page order; furniture inside a block is one of its own."""
    page, at, n = _Page(), 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            page.add(html.unescape(source[at:]))
            break
        if m.start() > at:
            page.add(html.unescape(source[at : m.start()]))
        at = m.end()
        name = m["name"] or m["bname"]
        if name is None:
            if m[0].startswith("<![CDATA["):
                page.add(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if m["close"] or m["bad"]:
            page.close(name)
        elif name in RAW:
            if name not in INLINE:
                page.flush()
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            at = end.end() if end else n
        elif name in VOID:
            if name == "br":
                page.add("\n")
            elif name not in INLINE:
                page.flush()
        else:
            page.open(name, m["rest"] or "")
    page.flush()
    return page.out


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the blocks in a row and the block of each token."""
    words, owner = [], []
    for i, t in enumerate(texts):
        found = WORD.findall(t.lower())
        words += found
        owner += [i] * len(found)
    memo = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    return np.array([memo[w] for w in words], np.uint64), np.array(owner, np.int64)


def suffix_array(tokens: np.ndarray, room: np.ndarray, longest: int = SORTED) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes, each ending after its room of tokens, and the common prefix of each with the one
    before it; both up to longest tokens (a power of 2). Prefix doubling: suffixes are sorted by pairs of ranks of
    half the length; the ranks of all lengths then add up the common prefixes from the longest down."""
    n = len(tokens)
    ranks, have = [np.unique(tokens, return_inverse=True)[1].astype(np.int32) + 1], 1
    while have < longest and (not n or ranks[-1].max() < n):
        rank, after = ranks[-1].astype(np.int64), np.zeros(n, np.int64)
        inside = np.flatnonzero(room > have)
        after[inside] = rank[inside + have]
        ranks.append(np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int32) + 1)
        have *= 2
    # suffixes that end early are equal only if they end alike
    order = np.argsort(ranks[-1], kind="stable")
    common = np.zeros(n, np.int64)
    left, right = order[:-1].copy(), order[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        size, rank = 1 << level, ranks[level]
        # windows of this length that both still have room for
        fits = (room[order[:-1]] - common[1:] >= size) & (room[order[1:]] - common[1:] >= size)
        at = np.flatnonzero(fits)
        same = at[rank[left[at]] == rank[right[at]]]
        common[1:][same] += size
        left[same] = np.minimum(left[same] + size, n - 1)
        right[same] = np.minimum(right[same] + size, n - 1)
    return order, common


def shared_lengths(order: np.ndarray, common: np.ndarray, page: np.ndarray) -> np.ndarray:
    """For each token the longest substring from there that a page of another number has too: the least common prefix
    up to the nearest neighbour of another page in the suffix array, on either side."""
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    own = page[order]
    run = np.cumsum(np.concatenate([[0], own[1:] != own[:-1]]))
    far = np.int64(1) << 40

    def reach(low, run):
        # least value since the run began: later runs are shifted below all earlier ones
        return np.minimum.accumulate(low - run * far) + run * far

    before = reach(common, run)
    before[run == 0] = 0
    down = np.append(common[1:], 0)[::-1]
    back = run[-1] - run[::-1]
    after = reach(down, back)
    after[back == 0] = 0
    out[order] = np.maximum(before, after[::-1])
    return out


def _pages(pages: list[list[str]]):
    """(tokens, block, page identity, room to the page's end) of the pages' streams in a row."""
    texts = [t for p in pages for t in p]
    tokens, owner = stream(texts)
    number = np.repeat(np.arange(len(pages)), [len(p) for p in pages])[owner] if len(owner) else owner
    ends = np.cumsum(np.bincount(number, minlength=len(pages)))
    same = np.array([xxhash.xxh64_intdigest("\0".join(p)) for p in pages], np.uint64)
    return tokens, owner, same[number], (ends[number] - np.arange(len(tokens)))


def windows(pages: list[list[str]], depth: int = DEPTH):
    """(tokens, block, page identity, room, code): code is the fingerprint of the depth tokens from there, if there are so many."""
    tokens, owner, page, room = _pages(pages)
    use = np.flatnonzero(room >= depth)
    code = np.zeros(len(tokens), np.uint64)
    for k in range(depth):
        mixed = (code[use] ^ tokens[use + k]) * _P
        code[use] = mixed ^ (mixed >> np.uint64(29))
    return tokens, owner, page, room, code


def repeated(pages: list[list[str]], depth: int = DEPTH, known: frozenset = frozenset()) -> list[list[bool]]:
    """For every block of every page, whether all its tokens lie in substrings of depth tokens or more that occur on
    another page, or whose windows' fingerprints are known. Blocks without tokens aren't covered."""
    tokens, owner, page, room, code = windows(pages, depth)
    n, blocks_ = len(tokens), sum(map(len, pages))
    length = np.zeros(n, np.int64)
    if n:
        order, common = suffix_array(tokens, room)
        length = shared_lengths(order, common, np.unique(page, return_inverse=True)[1])
        length[length < depth] = 0
    if known and n:
        hit = (room >= depth) & np.isin(code, np.fromiter(known, np.uint64, len(known)))
        length[hit] = np.maximum(length[hit], depth)
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(length)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + length[at], -1)
    covered = np.cumsum(cover)[:-1] > 0
    size, bare = np.bincount(owner, minlength=blocks_), np.bincount(owner[~covered], minlength=blocks_)
    found = iter(((size > 0) & (bare == 0)).tolist())
    return [[next(found) for _ in p] for p in pages]


def clean(parsed: list[list[tuple[int, str]]], known: frozenset = frozenset()) -> list[str]:
    """Texts of the pages of one host."""
    found = repeated([[t for k, t in p if k != KEEP] for p in parsed], known=known)
    out = []
    for page, hits in zip(parsed, found, strict=True):
        hit = iter(hits)
        marked = [(kind, text, kind != KEEP and next(hit)) for kind, text in page]
        lines = [text for kind, text, gone in marked if kind == KEEP or kind == OPEN and not gone]
        out.append("\n".join(lines or [text for kind, text, _ in marked if kind == OPEN]))
    return out


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))


def _groups(batches, names):
    """(rows of one host and chunk, its known fingerprints) from batches sorted by both, fingerprints first."""
    held, known, where = [], [], None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("_host", "_chunk", "_code", *names)), strict=True):
            if row[:2] != where:
                if held:
                    yield held, frozenset(known)
                held, known, where = [], [], row[:2]
            if row[2] is not None:
                known.append(row[2] % (1 << 64))
            else:
                held.append(row[3:])
    if held:
        yield held, frozenset(known)


def _windows(pages: DataFrame, source: str) -> DataFrame:
    """(_host, _chunk, _code, a, b): the fingerprints of each chunk's windows and the least and greatest page that has them."""

    def run(batches):
        for batch in batches:
            parsed = [[t for k, t in blocks(text or "") if k != KEEP] for text in batch.column(source).to_pylist()]
            row = np.repeat(np.arange(len(parsed)), [len(p) for p in parsed])
            _, owner, page, room, code = windows(parsed)
            at = np.flatnonzero(room >= DEPTH)
            at = at[np.lexsort((code[at], row[owner[at]]))]
            at = at[np.concatenate([[True], (code[at[1:]] != code[at[:-1]]) | (row[owner[at[1:]]] != row[owner[at[:-1]]])])[: len(at)]]
            rows = pa.array(row[owner[at]])
            yield pa.RecordBatch.from_arrays([batch.column("_host").take(rows), batch.column("_chunk").take(rows), pa.array(code[at].view(np.int64)), pa.array(page[at].view(np.int64))], names=["_host", "_chunk", "_code", "_page"])

    made = map_batches(pages.select("_host", "_chunk", source), run, "_host string, _chunk int, _code long, _page long")
    return made.groupBy("_host", "_chunk", "_code").agg(F.min("_page").alias("a"), F.max("_page").alias("b"))


def extract(df: DataFrame, source="html", url="url", key="page_id") -> DataFrame:
    """(key, url, text, n_chars), one row per page."""
    kinds = dict(df.dtypes)
    pages = df.select(key, url, source).withColumn("_host", host_of(F.col(url)))
    size = F.ceil(F.sum(F.length(source)) / CHUNK).cast("int")
    large = materialise(pages.groupBy("_host").agg(size.alias("_chunks")).where("_chunks > 1"), "large-hosts")
    dealt = pages.join(small_side(large), "_host", "left").withColumn("_chunk", F.pmod(F.xxhash64(key, url), F.coalesce("_chunks", F.lit(1))).cast("int"))
    held = materialise(_windows(dealt.where("_chunks > 1"), source), "host-windows")
    seen = held.groupBy("_host", "_code").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a != b").select("_host", "_code")
    # each chunk is told only of its own windows, and only of those that another chunk shares
    told = materialise(held.select("_host", "_chunk", "_code").join(seen, ["_host", "_code"]).select("_host", "_chunk", "_code"), "shared-windows")
    discard(held)
    rows = dealt.select("_host", "_chunk", F.lit(None).cast("long").alias("_code"), key, url, source).unionByName(told, allowMissingColumns=True)
    rows = rows.repartition("_host", "_chunk").sortWithinPartitions("_host", "_chunk", F.col("_code").asc_nulls_last(), key)
    names = [key, url, "text", "n_chars"]
    types = [f.type for f in to_arrow_schema(rows.select(key, url).schema)] + [pa.string(), pa.int64()]

    def run(batches):
        for group, known in _groups(batches, (key, url, source)):
            texts = clean([blocks(r[2] or "") for r in group], known)
            columns = [[r[0] for r in group], [r[1] for r in group], texts, [len(t) for t in texts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return map_batches(rows, run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long")
