"""Toxicity of texts that may be disguised: a noisy channel restores words, a logistic model scores them.

Disguises are read as a noisy channel's output. A plain word has one reading; a token with digits or signs among its
letters, letters repeated three times or more (or doubled in a row), or letters set apart by blanks or points, becomes a lattice: digits and signs
end a word or stand for letters they resemble, separators end a word or stand for nothing, a run of a letter is one or
two of it. The Viterbi path under a character language model (the last three letters, counted over all words
of all documents) is the restored text.

Features are whole words and proper beginnings of words of 3 to 8 letters. Those that more toxic documents hold than
chance allows are chosen by their likelihood ratio over the labelled rows that may be learned from; a logistic model of
the logarithms of their counts and of the text's length gives the score. Labels are learned from a sample of at most
FIT_ROWS rows (by a hash of their key); the language model and the scores cover all documents.

Defined results: a null text is empty and scores as a text without words. Rows with a null key are scored, aren't held
out and are never learned from, nor are labels other than 0 and 1 or keys whose labels contradict each other. Without labelled rows of both kinds
every score is 0. Repeated rows score alike; an empty table gives no rows. Only the kept columns and the results return.
"""

from __future__ import annotations

import array
import math
import re
import unicodedata
from collections import Counter
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.llm.common import map_batches, materialise

#: Labelled rows that the classifier is fitted on, at most; features that it chooses from and holds.
FIT_ROWS, CANDIDATES, CHOSEN = 20_000, 4_000, 256
THRESHOLD, FOLDS, HELD_OUT = 0.7, 3, 1
#: Signs and the letters they stand for. Fixed values.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "*": "aeiou", "€": "e", "£": "l", "¢": "c"}
#: Symbols of the language model: 0 ends a word, 1 to 26 are letters, then other letters.
OTHER, SYMBOLS = 27, 28
CONTEXTS = SYMBOLS**3
#: Costs (negative logarithms) of the channel: a letter drawn as a sign, a digit or sign meant as such, a separator between
#: words, one inside a word of a token, one inside a word of letters set apart, a letter repeated three times or more,
#: a letter doubled.
DRAWN, MEANT, PARTED, JOINED, SPREAD, REPEATED, DOUBLED = 3.0, 9.0, 1.0, 3.0, 0.3, 1.0, 4.0
#: Weight of the shorter context in the language model; prefixes that are features, those that stand for a word; penalty of
#: the logistic model.
BACKOFF, PREFIXES, STEM, PENALTY = 2.0, range(3, 9), 5, 0.01
#: Words whose features a task remembers, at most.
MEMO = 400_000

_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = re.escape("".join(s for s in LEET if not s.isdigit()))
_APART = r"[ ._\-~'’,/\\|*]{1,2}"
_SPACED = re.compile(rf"(?<![^\W_])(?:[^\W_]|[@$!+])(?:{_APART}(?:[^\W_]|[@$!+])(?![^\W_])){{2,}}")
#: A letter that is set apart from itself, twice or more.
_AGAIN = re.compile(rf"([^\W_])(?:{_APART}\1){{2,}}")
_ODD = re.compile(rf"[^\W\d_][{_SIGNS}._\-~'’/\\]+[^\W_]|[^\W\d_]\d|[\d@$€£¢!|+][^\W\d_]|([^\W\d_])\1\1|(?:([^\W\d_])\2){{3}}")
#: What stands around a token: no letter or digit, and no sign that may begin one.
_OUTSIDE = re.compile(r"^[^\w@$€£¢!|+]+|[^\w]+$")


def normal(text: str | None) -> str:
    """Compatible forms folded together, lower case, without invisible characters."""
    text = text or ""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = _INVISIBLE.sub("", text)
    return text.lower()


@cache
def base(letter: str) -> str:
    """A letter without its marks."""
    return unicodedata.normalize("NFD", letter)[0]


def folded(word: str) -> str:
    return word if word.isascii() else "".join(map(base, word))


@cache
def symbols() -> np.ndarray:
    """The language model's symbol of each code point below 2**16."""
    out = np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            b = base(c)
            out[i] = ord(b) - 96 if "a" <= b <= "z" else OTHER
    return out


def context_counts(texts: list[str]) -> np.ndarray:
    """How often each symbol follows three others of its word; ends of words count, what is before a word doesn't."""
    codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    s = symbols()[np.minimum(codes, (1 << 16) - 1)].astype(np.int64)
    s = s[(s != 0) | (np.roll(s, 1) != 0)]
    s = np.concatenate([np.zeros(3, np.int64), s])
    one = s[2:-1]
    two = np.where(one != 0, s[1:-2], 0)
    three = np.where(two != 0, s[:-3], 0)
    return np.bincount(((three * SYMBOLS + two) * SYMBOLS + one) * SYMBOLS + s[3:], minlength=CONTEXTS * SYMBOLS)


def count_contexts(df: DataFrame, text="text") -> np.ndarray:
    """Counts of four symbols over all texts: a table of fixed size, summed on the executors."""

    def run(batches):
        total = np.zeros(CONTEXTS * SYMBOLS, np.int64)
        for batch in batches:
            total += context_counts([normal(t) for t in batch.column(0).to_pylist()])
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["code", "n"])

    made = map_batches(df.select(text), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CONTEXTS * SYMBOLS)
    counts[made["code"].to_numpy(np.int64)] = made["n"]
    return counts


def costs(counts: np.ndarray) -> np.ndarray:
    """-ln P(symbol | three before), each order smoothed by the next shorter one."""
    c = counts.reshape((SYMBOLS,) * 4)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(4):
        n = c.sum(axis=tuple(range(3 - order)))
        p = (n + BACKOFF * p) / (n.sum(axis=-1, keepdims=True) + BACKOFF)
    return -np.log(p).reshape(-1).astype(np.float32)


class Decoder:
    """Restores tokens by the cheapest path through the lattice of their readings."""

    def __init__(self, cost: np.ndarray):
        self.cost = array.array("f", cost.tobytes())

    @staticmethod
    def _symbol(c: str) -> int:
        b = base(c)
        return ord(b) - 96 if "a" <= b <= "z" else OTHER

    def _readings(self, c: str, run: int, joined: float) -> list[tuple[str, tuple[int, ...], float]]:
        """(text, symbols, cost) of what a character, or a run of it, may stand for."""
        if c.isalpha():
            s = self._symbol(c)
            if run == 1:
                return [(c, (s,), 0.0)]
            if run == 2:
                return [(c * 2, (s, s), 0.0), (c, (s,), DOUBLED)]
            return [(c, (s,), REPEATED), (c * 2, (s, s), REPEATED)]
        out = []
        for x in LEET.get(c, ""):
            s = ord(x) - 96
            out += [(x, (s,), DRAWN + (REPEATED if run > 1 else 0.0))] + ([(x * 2, (s, s), DRAWN + REPEATED)] if run > 1 else [])
        if c.isdigit():
            return [*out, (" ", (0,), MEANT)]
        return [*out, (" ", (0,), MEANT / 2 if out else PARTED), ("", (), joined)]

    def decode(self, token: str, joined=JOINED) -> str:
        """The likeliest words, parted by blanks. Linear in the token's length."""
        cost = self.cost
        states = {0: (0.0, None)}
        i = 0
        while i < len(token):
            c, j = token[i], i + 1
            while j < len(token) and token[j] == c:
                j += 1
            following: dict[int, tuple] = {}
            for text, emitted, spent in self._readings(c, j - i, joined):
                for context, (total, path) in states.items():
                    total += spent
                    for s in emitted:
                        if s:
                            total += cost[context * SYMBOLS + s]
                            context = (context * SYMBOLS + s) % CONTEXTS
                        elif context:
                            total += cost[context * SYMBOLS]
                            context = 0
                    if context not in following or total < following[context][0]:
                        following[context] = (total, (path, text))
            states, i = following, j
        best = min(states.items(), key=lambda kv: kv[1][0] + (cost[kv[0] * SYMBOLS] if kv[0] else 0.0))
        path, parts = best[1][1], []
        while path is not None:
            path, text = path
            parts.append(text)
        return "".join(reversed(parts))

    def spaced(self, text: str) -> str:
        """The text with letters that were set apart joined to words, each marked by a leading NUL."""

        def join(m):
            return f" {self.marked(_AGAIN.sub(r'\1\1\1', m.group()), SPREAD)} " if _WORD.search(m.group()) else m.group()

        return _SPACED.sub(join, text)

    def marked(self, token: str, joined=JOINED) -> str:
        return " ".join("\0" + w for w in _WORD.findall(self.decode(token, joined)))

    def words(self, token: str) -> list[tuple[str, bool]]:
        """(word, whether it was restored) of a token without blanks."""
        if token.startswith("\0"):
            return [(token[1:], True)]
        inner = _OUTSIDE.sub("", token)
        if not _ODD.search(inner):
            return [(w, False) for w in _WORD.findall(token)]
        plain = set(_WORD.findall(inner))
        return [(w, w not in plain) for w in _WORD.findall(self.decode(inner))]


def features(word: str) -> list[str]:
    """The whole word, and its proper beginnings."""
    return [f"{word}$", *[word[:k] for k in PREFIXES if k < len(word)]]


class Reader:
    """Counts of words or of chosen features in texts."""

    def __init__(self, cost: np.ndarray, chosen: list[str] = (), stems: dict[str, str] | None = None):
        self.decoder, self.memo = Decoder(cost), {}
        self.at = {f: i for i, f in enumerate(chosen)}
        # restored words have lost the marks of their letters, and may have lost their ends
        self.bare: dict[str, int] = {}
        for f, i in [*self.at.items(), *((k, self.at[f]) for k, f in (stems or {}).items())]:
            self.bare.setdefault(folded(f), i)

    def tokens(self, text: str | None) -> Counter:
        return Counter(self.decoder.spaced(normal(text)).split())

    def _hits(self, token: str) -> tuple[int, tuple[int, ...]]:
        found = self.decoder.words(token)
        hits = []
        for word, restored in found:
            if restored:
                hits += sorted({i for i in map(self.bare.get, features(folded(word))) if i is not None} | {i for i in map(self.at.get, features(word)) if i is not None})
            else:
                hits += [i for i in map(self.at.get, features(word)) if i is not None]
        return len(found), tuple(hits)

    def counts(self, text: str | None) -> tuple[int, dict[int, int]]:
        """(number of words, count of each chosen feature that occurs)."""
        words, out = 0, {}
        for token, n in self.tokens(text).items():
            got = self.memo.get(token)
            if got is None:
                if len(self.memo) >= MEMO:
                    self.memo = {}
                got = self.memo[token] = self._hits(token)
            words += got[0] * n
            for i in got[1]:
                out[i] = out.get(i, 0) + n
        return words, out

    def all_features(self, text: str | None) -> set[str]:
        return {f for token in self.tokens(text) for word, restored in self.decoder.words(token) if not restored for f in features(word)}


class Model(NamedTuple):
    chosen: list[str]
    stems: dict[str, str]
    weight: np.ndarray
    bias: float

    def scores(self, rows: list[tuple[int, dict[int, int]]]) -> list[float]:
        z = inputs(rows, len(self.chosen)) @ self.weight + self.bias
        return (1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist()


def inputs(rows: list[tuple[int, dict[int, int]]], n: int) -> np.ndarray:
    """Logarithms of the counts by feature, and of the number of words."""
    x = np.zeros((len(rows), n + 1))
    for r, (words, found) in enumerate(rows):
        x[r, n] = math.log1p(words) / 10
        for i, k in found.items():
            x[r, i] = 0.5 + math.log(k)
    return x


def logistic(x: np.ndarray, y: np.ndarray, penalty=PENALTY, steps=50) -> tuple[np.ndarray, float]:
    """Weights and bias of a penalised logistic model (Newton's method, halving steps that don't help)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-9
    w = np.zeros(x.shape[1])

    def loss(w):
        z = x @ w
        return float(np.logaddexp(0, np.where(y == 1, -z, z)).sum() + (ridge * w * w).sum() / 2)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-10)[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w, before = w - size * step, now
        now = loss(w)
        if before - now < 1e-7 * max(now, 1):
            break
    return w[:-1], float(w[-1])


def held_out(key) -> F.Column:
    """Whether a key's rows are never learned from, but for null keys, which the labels leave out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def learnable(labels: DataFrame, key="doc_id", label="toxic", rows=FIT_ROWS) -> DataFrame:
    """(key, _toxic) of at most so many labelled rows outside the held-out fold, those with the least hashes."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
    one = known.groupBy(key).agg(F.min(label).alias("_toxic"), F.max(label).alias("_most")).where("_toxic = _most")
    return one.select(key, F.col("_toxic").cast("int").alias("_toxic")).orderBy(F.xxhash64(F.col(key)), key).limit(rows)


def _gather(df: DataFrame, text, cost, schema, make, *chosen) -> DataFrame:
    """What make(reader, batches) yields of df's texts and labels, task by task."""
    share = df.sparkSession.sparkContext.broadcast((cost, *chosen))

    def run(batches):
        yield from make(Reader(*share.value), batches)

    return map_batches(df.select(text, "_toxic"), run, schema)


def candidates(sample: DataFrame, cost: np.ndarray, toxic: int, clean: int, text="text") -> list[tuple[str, int, int]]:
    """(feature, toxic and clean documents with it) of the strongest signs of toxicity, best first."""

    def make(reader, batches):
        found: Counter = Counter()
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.update((f, y) for f in reader.all_features(t))
        names = [*dict.fromkeys(f for f, _ in found)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[f, 1] for f in names], pa.int64()), pa.array([found[f, 0] for f in names], pa.int64())], names=["feature", "a", "b"])

    counted = _gather(sample, text, cost, "feature string, a long, b long", make).groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b, n, m = F.col("a"), F.col("b"), toxic, clean
    part = lambda x, of: F.when(x > 0, x * F.ln(x * (n + m) / of)).otherwise(0.0)
    gain = part(a, (a + b) * n) + part(b, (a + b) * m) + part(n - a, (n + m - a - b) * n) + part(m - b, (n + m - a - b) * m)
    top = counted.where((a >= 3) & (a * m > 4 * b * n)).orderBy(F.desc(F.round(gain, 6)), "feature").limit(CANDIDATES)
    return [tuple(r) for r in top.collect()]


def choose(found: list[tuple[str, int, int]], most=CHOSEN) -> tuple[list[str], dict[str, str]]:
    """(the first features but for beginnings that occur in just the documents of a longer one, the feature that each
    such beginning of STEM letters or more stands for where a restored word has no better end)."""
    counts = {f: (a, b) for f, a, b in found}
    spare: dict[str, str] = {}
    for f, *n in found:
        word = f.rstrip("$")
        for k in PREFIXES:
            if k < len(word) and counts.get(word[:k]) == tuple(n) and len(f) > len(spare.get(word[:k], "")):
                spare[word[:k]] = f
    chosen = [f for f, *_ in found if f not in spare][:most]
    return chosen, {k: f for k, f in spare.items() if len(k) >= STEM and f in chosen}


def fit(documents: DataFrame, labels: DataFrame, cost: np.ndarray, text="text", key="doc_id", label="toxic") -> Model | None:
    """A model from a bounded sample of the labelled rows; None without rows of both kinds."""
    known = learnable(labels, key, label)
    sample = materialise(documents.select(key, text).join(F.broadcast(known), key).select(text, "_toxic"), "labelled")
    n = {r[0]: r[1] for r in sample.groupBy("_toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    chosen, stems = choose(candidates(sample, cost, n[1], n[0], text))

    def make(reader, batches):
        for batch in batches:
            rows = [reader.counts(t) for t in batch.column(0).to_pylist()]
            ids, counts = [[*f] for _, f in rows], [[*f.values()] for _, f in rows]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([w for w, _ in rows], pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], names=["toxic", "words", "ids", "counts"])

    # at most FIT_ROWS rows of at most CHOSEN numbers, ordered so that sums don't depend on partitions
    made = _gather(sample, text, cost, "toxic int, words long, ids array<long>, counts array<long>", make, chosen, stems)
    rows = sorted((r.toxic, r.words, sorted(zip(r.ids, r.counts))) for r in made.collect())
    weight, bias = logistic(inputs([(w, dict(f)) for _, w, f in rows], len(chosen)), np.array([t for t, *_ in rows]))
    return Model(chosen, stems, weight, bias)


def score(documents: DataFrame, labels: DataFrame, text="text", key="doc_id", label="toxic", keep=("doc_id",)) -> DataFrame:
    """The kept columns, held_out, score and predicted."""
    added = ("held_out", "score", "predicted")
    keep = [c for c in keep if c not in added]
    cost = costs(count_contexts(documents, text))
    model = fit(documents, labels, cost, text, key, label)
    share = documents.sparkSession.sparkContext.broadcast((cost, model))  # tables of fixed size
    schema = T.StructType([documents.schema[c] for c in dict.fromkeys([*keep, key])] + [T.StructField("score", T.DoubleType())])

    def run(batches):
        cost, model = share.value
        reader = Reader(cost, *model[:2]) if model else None
        for batch in batches:
            texts = batch.column(text).to_pylist()
            got = model.scores([reader.counts(t) for t in texts]) if model else [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in schema.names[:-1]] + [pa.array(got, pa.float64())], names=schema.names)

    scored = map_batches(documents.select(*dict.fromkeys([*keep, key, text])), run, schema)
    return scored.select(*keep, held_out(key).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
