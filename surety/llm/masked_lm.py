"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

The network sees the WINDOW words on either side of a masked word and predicts that word: one of the CODES - 1 commonest
words of the corpus or the unknown class, by a softmax in two levels of SIDE branches. A word of the unknown class
follows the counts of all such words in the corpus, a vocabulary that grows with it: p(word) = p(unknown) (1 - u) n(word)
/ n(unknown). Words that the corpus lacks share the rest u, the share of words counted once (Good-Turing), by the bigrams
of their bytes. A document's score is the sum, over all its words, of their conditional log-probabilities.

Fitting counts the words and byte bigrams of all texts. Training then masks one word in MASK of every distinct text
(which ones, the text's hash says) and deals the texts into shards of about SHARD masked words by their hash. In each of
ROUNDS rounds, shards start from the current weights, learn their masked words once in the order of the hashes, and their
copies are averaged as integers. So the number of steps and averagings follows from the data, and neither weights nor
scores depend on how rows are dealt to tasks; equal texts meet one shard once, however many there are. Only counts of the
commonest words and averaged weights, of fixed sizes, come to the driver.

In scoring, tasks hold the FREQUENT commonest words; the others are joined to the vocabulary by their 64-bit hashes,
which are not checked further.

Defined results: a null or blank text has no words, a sum of 0 and no mean; repeated rows score alike; an empty table
gives no rows (and an untrained network); texts may have any length; null keys pass through.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import chain, count, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.llm.common import discard, map_batches, materialise

WINDOW, SIDE, WIDTH, SEED = 2, 64, 16, 5
CODES = SIDE * SIDE
UNKNOWN, GAP_CODE = 0, CODES
#: Masked words: one in so many; in a shard; in a step. Rounds of averaging and the steps' rate.
MASK, SHARD, STEP, ROUNDS, RATE = 8, 500_000, 2048, 4, 0.1
#: Words remembered by a worker; positions handled together; rows of one product.
MEMO, HELD, ROWS = 600_000, 400_000, 16_384
#: Largest absolute logit.
LOGIT = 30.0
#: Weights are averaged as integers in units of 1 / SCALE, log-probabilities summed in units of 1 / UNIT.
SCALE, UNIT = float(1 << 24), 1e6
#: Commonest words held by scoring tasks, at most (all others are joined).
FREQUENT = 500_000
#: The byte that separates words (UTF-8 has none); what is added to each count of bigrams and of vocabulary words.
GAP, SMOOTH = 255, 0.1
#: Kinds of rows that counting sends.
WORD, BIGRAM = 0, 1
PLACES = [k for k in range(-WINDOW, WINDOW + 1) if k]
SHAPES = {"context": (len(PLACES), CODES + 1, WIDTH), "bias": (WIDTH,), "first": (WIDTH, SIDE), "first_bias": (SIDE,), "second": (SIDE, WIDTH, SIDE), "second_bias": (SIDE, SIDE)}


class Network:
    """Contexts are arrays of codes, one for each of PLACES; targets are codes below CODES."""

    def __init__(self, flat: np.ndarray):
        self.w, at = {}, 0
        for k, s in SHAPES.items():
            n = int(np.prod(s))
            self.w[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n
        self.seen = {k: np.full(s, 1e-2, np.float32) for k, s in SHAPES.items()}

    @staticmethod
    def start(counts: np.ndarray) -> np.ndarray:
        """Weights whose biases are the words' frequencies."""
        rng = np.random.default_rng(SEED)
        w = {k: rng.normal(0, 0.1, s) for k, s in SHAPES.items()}
        p = (counts + SMOOTH).reshape(SIDE, SIDE) / (counts + SMOOTH).sum()
        w["bias"][:] = 0
        w["first_bias"] = np.log(p.sum(1))
        w["second_bias"] = np.log(p / p.sum(1, keepdims=True))
        return np.concatenate([w[k].ravel() for k in SHAPES])

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in SHAPES])

    def _hidden(self, context):
        total = self.w["bias"] + self.w["context"][0][context[0]]
        for k in range(1, len(PLACES)):
            total = total + self.w["context"][k][context[k]]
        return np.tanh(total)

    @staticmethod
    def _classes(target):
        """(first digit, rows) of each first digit among the targets."""
        # 16 bits are sorted in linear time
        first = (target // SIDE).astype(np.int16)
        order = np.argsort(first, kind="stable")
        edges = np.flatnonzero(np.diff(first[order], prepend=-1))
        return [(int(first[order[a]]), order[a:b]) for a, b in zip(edges, [*edges[1:], len(order)], strict=True)]

    def _bounded(self, name, h, c=...):
        """Logits, kept where their exponentials stay finite; hidden units are at most 1."""
        weights, bias = self.w[name][c], self.w[f"{name}_bias"][c]
        logits = h @ weights
        logits += bias
        if (np.abs(weights).sum(0) + np.abs(bias)).max() > LOGIT:
            np.clip(logits, -LOGIT, LOGIT, out=logits)
        return logits

    def log_probability(self, context, target) -> np.ndarray:
        h = self._hidden(context)
        one = self._bounded("first", h)
        out = one[np.arange(len(target)), target // SIDE]
        out -= np.log(np.exp(one, out=one).sum(1))
        for c, at in self._classes(target):
            two = self._bounded("second", h[at], c)
            picked = two[np.arange(len(at)), target[at] % SIDE]
            out[at] += picked - np.log(np.exp(two, out=two).sum(1))
        return out

    def _move(self, name, at, gradient) -> None:
        """One Adagrad step on a part of the weights."""
        seen = self.seen[name][at] + gradient * gradient
        self.seen[name][at] = seen
        self.w[name][at] -= RATE * gradient / np.sqrt(seen)

    def step(self, context, target) -> None:
        """One Adagrad step on the mean negative log-probability."""
        n, rows = len(target), np.arange(len(target))
        h = self._hidden(context)
        d1 = np.exp(self._bounded("first", h))
        d1 /= d1.sum(1, keepdims=True)
        d1[rows, target // SIDE] -= 1
        d1 /= n
        dh = d1 @ self.w["first"].T
        moves = [("first", slice(None), h.T @ d1), ("first_bias", slice(None), d1.sum(0))]
        for c, at in self._classes(target):
            d2 = np.exp(self._bounded("second", h[at], c))
            d2 /= d2.sum(1, keepdims=True)
            d2[np.arange(len(at)), target[at] % SIDE] -= 1
            d2 /= n
            dh[at] += d2 @ self.w["second"][c].T
            moves += [("second", c, h[at].T @ d2), ("second_bias", c, d2.sum(0))]
        dh *= 1 - h * h
        moves.append(("bias", slice(None), dh.sum(0)))
        for k, codes in enumerate(context):
            order = np.argsort(codes.astype(np.int16), kind="stable")
            edges = np.flatnonzero(np.diff(codes[order], prepend=-1))
            moves.append(("context", (k, codes[order[edges]]), np.add.reduceat(dh[order], edges)))
        for name, at, gradient in moves:
            self._move(name, at, gradient)


class Model(NamedTuple):
    """Weights; (code, n) of every word; hashes, codes and log-shares of the commonest; the log-share of one occurrence
    of an unknown word; that of all unseen words; log-probabilities of byte bigrams."""

    flat: np.ndarray
    words: DataFrame
    hashes: np.ndarray
    codes: np.ndarray
    shares: np.ndarray
    lift: float
    unseen: float
    spelling: np.ndarray


def spell(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The byte bigrams of words, each between two gaps, and where each word's begin."""
    line = np.frombuffer(b"\xff" + b"".join(w.encode() + b"\xff" for w in words), np.uint8).astype(np.int64)
    return line[:-1] * 256 + line[1:], np.flatnonzero(line == GAP)[:-1]


class Words:
    """Numbers the distinct words of texts as they come; columns hold what is known of each."""

    def __init__(self, know):
        """know(words, hashes): the columns of new words."""
        self.know, self.memo, self.columns = know, defaultdict(count().__next__), None

    def __call__(self, words: list[str]) -> list[np.ndarray]:
        """The columns of words; the memo starts anew when it is full."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
            memo.default_factory = count().__next__
        low = len(memo)
        # words that the memo lacks get the next numbers
        at = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        high = len(memo)
        if high > low:
            new = list(islice(reversed(memo), high - low))[::-1]
            made = self.know(new, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new)))
            if self.columns is None or high > len(self.columns[0]):
                old = self.columns or [c[:0] for c in made]
                self.columns = [np.concatenate([c[:low], np.zeros(2 * high - min(low, len(c)), c.dtype)]) for c in old]
            for held, c in zip(self.columns, made, strict=True):
                held[low:high] = c
        return [c[at] for c in self.columns or self.know([], np.zeros(0, np.uint64))]


def _lookup(model: Model, score: bool):
    """Columns of words: code and, for scores, hash, log-share (NaN where the vocabulary must be asked) and spelling."""

    # codes alone need but the commonest words
    listed = slice(None) if score else model.codes != UNKNOWN
    held_hashes, held_codes = model.hashes[listed], model.codes[listed]

    def know(words, hashes):
        at = np.minimum(np.searchsorted(held_hashes, hashes), max(len(held_hashes) - 1, 0))
        here = held_hashes[at] == hashes if len(held_hashes) else np.zeros(len(hashes), bool)
        codes = np.full(len(hashes), UNKNOWN, np.int64)
        codes[here] = held_codes[at[here]]
        if not score:
            if "" in words:
                codes[words.index("")] = GAP_CODE  # no text has an empty word
            return (codes,)
        shares, spelled = np.full(len(hashes), np.nan), np.zeros(len(hashes))
        shares[here] = model.shares[at[here]]
        if not here.all():
            pairs, starts = spell([w for w, known in zip(words, here.tolist(), strict=True) if not known])
            spelled[~here] = np.add.reduceat(model.spelling[pairs], starts)
        return codes, hashes, shares, spelled

    return know


def windows(codes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Contexts (one array for each place in the window) of all positions of documents of those sizes in a row."""
    place = np.arange(len(codes)) + WINDOW * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    line = np.full(len(codes) + WINDOW * (len(sizes) + 1), GAP_CODE, np.int64)
    line[place] = codes
    return [line[place + k] for k in PLACES]


def _chunks(texts: list[str | None], numbered: Words):
    """(first document, sizes, columns of all words) for runs of documents of about HELD words; runs without words are left out."""
    low, words, sizes = 0, [], []
    for i, t in enumerate([*texts, None]):
        if i == len(texts) or len(words) >= HELD:
            if words:
                yield low, np.array(sizes), numbered(words)
            low, words, sizes = i, [], []
        own = (t or "").lower().split()
        words += own
        sizes.append(len(own))


def _count(df: DataFrame, text: str) -> DataFrame:
    """(kind, i, n): occurrences of word hashes and of byte bigrams."""

    def send(kind, i, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), kind, np.int32)), pa.array(i), pa.array(n)], names=["kind", "i", "n"])

    def run(batches):
        counts, pairs = Counter(), np.zeros(1 << 16, np.int64)

        def flush():
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, len(counts))
            return send(WORD, hashes.view(np.int64), np.fromiter(counts.values(), np.int64, len(counts)))

        for batch in batches:
            lines = []
            for t in batch.column(text).to_pylist():
                words = (t or "").lower().split()
                counts.update(words)
                lines.append(" ".join(words))
            # words between two gaps, as spell() sees them
            line = (" " + " ".join(x for x in lines if x) + " ").encode().replace(b" ", b"\xff")
            if len(line) > 2:
                line = np.frombuffer(line, np.uint8).astype(np.uint16)
                pairs += np.bincount(line[:-1] * np.uint16(256) + line[1:], minlength=1 << 16)
            if len(counts) > MEMO:
                yield flush()
                counts.clear()
        if counts:
            yield flush()
        at = np.flatnonzero(pairs)
        yield send(BIGRAM, at, pairs[at])

    return map_batches(df.select(text), run, "kind int, i long, n long")


def _vocabulary(df: DataFrame, text: str) -> tuple[DataFrame, dict]:
    """(code, n) of all words, and the parts of a Model that follow from counts."""
    counted = materialise(_count(df, text), "counted")
    words = materialise(counted.where(F.col("kind") == WORD).groupBy(F.col("i").alias("code")).agg(F.sum("n").alias("n")), "words")
    pairs = np.full((256, 256), SMOOTH)
    for r in counted.where(F.col("kind") == BIGRAM).groupBy("i").agg(F.sum("n").alias("n")).collect():  # at most 65,536
        pairs[r.i // 256, r.i % 256] += r.n
    discard(counted)
    # words by powers of 2 ** (1 / 8) of their counts, so that at most FREQUENT come to the driver
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = words.groupBy(level.alias("level")).agg(F.count("*").alias("c"), F.min("n").alias("least")).collect()
    least, have = None, 0
    for r in sorted(levels, key=lambda r: -r.level):
        have += r.c
        if have > FREQUENT:
            break
        least = r.least
    top = (words.where(F.col("n") >= least) if least is not None else words.limit(0)).toArrow().sort_by([("n", "descending"), ("code", "ascending")])
    hashes, n = top["code"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.int64)
    total, once = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0))).first()
    known = min(CODES - 1, len(n))
    rest = total - int(n[:known].sum())
    counts = np.zeros(CODES)
    counts[1 : known + 1], counts[UNKNOWN] = n[:known], rest
    # neither side is ever without a share
    unseen = min(0.5, (once + 0.5) / (rest + 1))
    lift = np.log1p(-unseen) - np.log(max(rest, 1))
    codes = np.where(np.arange(len(n)) < known, np.arange(1, len(n) + 1), UNKNOWN)
    shares = np.where(codes == UNKNOWN, lift + np.log(np.maximum(n, 1)), 0.0)
    order = np.argsort(hashes)
    return words, {"hashes": hashes[order], "codes": codes[order], "shares": shares[order], "lift": float(lift), "unseen": float(np.log(unseen)), "spelling": np.log(pairs / pairs.sum(1, keepdims=True)).ravel(), "counts": counts}


def _masked(df: DataFrame, text: str, model: Model, mask: int) -> DataFrame:
    """(hash, n, rows): the masked words of each distinct text with their windows."""
    share = df.sparkSession.sparkContext.broadcast(model._replace(words=None))  # of a fixed size

    def run(batches):
        numbered, gap = Words(_lookup(share.value, False)), [""] * WINDOW
        for batch in batches:
            texts = batch.column(text).to_pylist()
            marks = [xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            n, taken = [], [[] for _ in range(2 * WINDOW + 1)]
            for t, mark in zip(texts, marks, strict=True):
                own, first = (t or "").lower().split(), -mark % mask
                n.append(max(0, -(-(len(own) - first) // mask)))
                # only words in some window are looked up
                line = [*gap, *own, *gap]
                for k, part in enumerate(taken):
                    part += line[first + k : first + k + mask * n[-1] : mask]
            (codes,) = numbered(list(chain.from_iterable(taken)))
            codes = codes.reshape(len(taken), -1)
            rows = np.stack([codes[WINDOW + k] for k in PLACES] + [codes[WINDOW]], axis=1).astype(np.uint16)
            ends = np.cumsum(n)
            blobs = [rows[b - a : b].tobytes() for a, b in zip(n, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(marks, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(blobs, pa.binary())], names=["hash", "n", "rows"])

    return map_batches(df.select(text), run, "hash long, n long, rows binary").where("n > 0").dropDuplicates(["hash"])


def learn(flat: np.ndarray, shard: int, rows: np.ndarray, epochs: int) -> np.ndarray:
    """Weights after steps on a shard's masked words (windows and target), in an order that the shard's number fixes."""
    net, order = Network(flat), np.random.default_rng([SEED, shard])
    for _ in range(epochs):
        mixed = rows[order.permutation(len(rows))].astype(np.int64)
        for k in range(0, len(mixed), STEP):
            part = mixed[k : k + STEP]
            net.step([part[:, j] for j in range(len(PLACES))], part[:, -1])
    return net.flat()


def fit(df: DataFrame, text="text", mask=MASK, rounds=ROUNDS, epochs=1) -> Model:
    """Counts of all words and the averaged weights after all rounds."""
    words, known = _vocabulary(df, text)
    flat = Network.start(known.pop("counts"))
    model = Model(flat=flat, words=words, **known)
    examples = materialise(_masked(df, text, model, mask), "masked-words")
    shards = max(1, -(-(examples.agg(F.sum("n")).first()[0] or 0) // SHARD))
    dealt = examples.withColumn("shard", F.pmod("hash", F.lit(shards)).cast("int"))
    rounds = min(rounds, shards)
    for turn in range(rounds):
        share = df.sparkSession.sparkContext.broadcast(flat)

        def run(part: pa.Table) -> pa.Table:
            part = part.sort_by("hash")
            rows = np.frombuffer(b"".join(part.column("rows").to_pylist()), np.uint16).reshape(-1, len(PLACES) + 1)
            made = learn(share.value, part.column("shard")[0].as_py(), rows, epochs)
            return pa.table({"i": np.arange(len(made)), "v": np.rint(made.astype(np.float64) * SCALE).astype(np.int64)})

        copies = dealt.where(F.col("shard") % rounds == turn).groupBy("shard").applyInArrow(run, "i long, v long")
        mean = copies.groupBy("i").agg((F.sum("v").cast("double") / F.count("*") / SCALE).alias("v")).toArrow()  # a fixed number of weights
        if mean.num_rows:
            flat = mean.sort_by("i")["v"].to_numpy()
    discard(examples)
    return model._replace(flat=flat)


def score(df: DataFrame, model: Model, text="text", keep=("doc_id",)) -> DataFrame:
    """The kept columns with n_words, log_likelihood and mean_log_likelihood."""
    keep = [c for c in keep if c not in ("n_words", "log_likelihood", "mean_log_likelihood")]
    share = df.sparkSession.sparkContext.broadcast(model._replace(words=None))  # of a fixed size
    schema = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in keep)
    schema += ", n_words long, _row long, _sum long, _code long, _times long, _unseen double"
    names = [*keep, "n_words", "_row", "_sum", "_code", "_times", "_unseen"]

    def run(batches):
        model, row = share.value, TaskContext.get().partitionId() << 33
        net, numbered = Network(model.flat), Words(_lookup(model, True))
        for batch in batches:
            texts = batch.column(text).to_pylist()
            sums, sizes, rows = np.zeros(len(texts)), np.zeros(len(texts), np.int64), row + np.arange(len(texts))
            row += len(texts)
            for low, size, (target, hashes, shares, spelled) in _chunks(texts, numbered):
                sizes[low : low + len(size)] = size
                context, owner, held = windows(target, size), np.repeat(low + np.arange(len(size)), size), ~np.isnan(shares)
                got = np.concatenate([net.log_probability([c[k : k + ROWS] for c in context], target[k : k + ROWS]) for k in range(0, len(target), ROWS)]).astype(np.float64)
                sums += np.bincount(owner, got + np.where(held, shares, 0.0), len(texts))
                if not held.all():
                    yield rare(hashes[~held], owner[~held], spelled[~held] + model.unseen, rows, batch)
            blank = [pa.nulls(len(texts), t) for t in (pa.int64(), pa.int64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(sizes), pa.array(rows), pa.array(np.rint(sums * UNIT).astype(np.int64)), *blank], names=names)

    def rare(words, owner, unseen, rows, batch):
        """Rows of a document's words that are to be looked up, each word once."""
        order = np.lexsort((words, owner))
        words, owner, unseen = words[order], owner[order], unseen[order]
        start = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])]))
        times = np.diff(np.append(start, len(words)))
        blank = [pa.nulls(len(start), batch.column(c).type) for c in keep] + [pa.nulls(len(start), pa.int64())]
        values = [rows[owner[start]], np.zeros(len(start), np.int64), words[start].view(np.int64), times, times * unseen[start]]
        return pa.RecordBatch.from_arrays([*blank, *map(pa.array, values)], names=names)

    made = materialise(map_batches(df.select(*dict.fromkeys([*keep, text])), run, schema), "scored")
    found = made.where("_code is not null").select("_row", "_code", "_times", "_unseen").join(model.words.select(F.col("code").alias("_code"), F.col("n").alias("_n")), "_code", "left")
    value = F.coalesce(F.col("_times") * (F.log("_n") + F.lit(model.lift)), F.col("_unseen"))
    more = found.groupBy("_row").agg(F.sum(F.rint(value * UNIT).cast("long")).alias("_more"))
    out = made.where("_code is null").join(more, "_row", "left")
    total = F.round((F.col("_sum") + F.coalesce("_more", F.lit(0))) / UNIT, 3)
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_likelihood") / F.col("n_words"), 6))
    return out.withColumn("log_likelihood", total).withColumn("mean_log_likelihood", mean).select(*[F.col(f"`{c}`") for c in keep], "n_words", "log_likelihood", "mean_log_likelihood")
