"""Quality rules and an isolation forest on the rule statistics.

One pass over whole texts gives each document's counts. Base rules reject documents of fewer than 20 words or with
more than 30 % of their words in repeated 8-word windows. For the others, ratios of all counts (FEATURES) go to an
isolation forest: random splits isolate unusual documents on short paths. Every tree is grown on all rows, level by
level: a pass over the counts gives the exact number, minima and maxima of the rows in each node, of which there are at
most TREES * 2 ** LEVELS, and a node is split at a random place between them. Nothing depends on how rows are dealt out.

A document's score is 2 ** (-mean path / expected path); its reasons are the features whose splits took most other rows
away from it (at least SHARE of what the first of them took). Thresholds are calibrated on half of the labelled rows (by
a hash of the key), one for each reason: the score that separates the labelled bad rows best while losing at most LOSS
of all good ones, lowered halfway to the next good score. A document is rejected if it reaches the threshold of any of
its reasons. The other half of the labels is left for measuring.

Defined results: a null text has no words and fails the base rules; a reason without labelled bad rows rejects nothing,
and so does the forest without labelled rows of both kinds; rows with null keys or labels calibrate nothing; repeated
rows are treated alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.llm.common import discard, map_batches, materialise

SPACE = re.compile(r"[\x20\x09-\x0D]+")
SYMBOLS, WINDOW = "#*$%&|<>", 8
TREES, LEVELS, SEED = 50, 8, 11
#: Share of all labelled good rows that one reason may reject; bins of the score; rows that a task summarises at once.
LOSS, BINS, HELD = 0.002, 4000, 65_536
#: Share of its first reason's bits from which a feature is a reason too.
SHARE = 0.5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_alpha", "n_marks", "n_echoes", "n_lines")
FEATURES = ("word_length", "symbols", "same_lines", "repeats", "upper", "marks", "echoes")
_NOT_SYMBOL = re.compile(f"[^{re.escape(SYMBOLS)}]+")
_MARKS = re.compile("[!?]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside a window of that many words which occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(codes) == len(words):
        return 0
    ids = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = (h ^ ids[k : k + n]) * _MIX
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The values of STATS for one text."""
    text = text or ""
    bare = SPACE.sub("\n", text)
    words = [w for w in bare.split("\n") if w]
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    plain = text.isascii()
    upper = len(re.findall("[A-Z]", text)) if plain else sum(map(str.isupper, text))
    alpha = len(re.findall("[A-Za-z]", text)) if plain else sum(map(str.isalpha, text))
    return (
        len(words),
        sum(map(len, words)),
        len(_NOT_SYMBOL.sub("", text)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        upper,
        alpha,
        len(_MARKS.findall(text)),
        sum(map(str.__eq__, words, words[1:])),
        len(lines),
    )


def measure(df: DataFrame, text="text", keep=("doc_id",)) -> DataFrame:
    """The kept columns and STATS."""
    keep = [c for c in keep if c not in STATS]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in STATS])

    def run(batches):
        for batch in batches:
            rows = [statistics(t) for t in batch.column(text).to_pylist()]
            made = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((),) * len(STATS))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names=[*keep, *STATS])

    return map_batches(df.select(*dict.fromkeys([*keep, text])), run, schema)


def ratios(columns: dict[str, np.ndarray]) -> np.ndarray:
    """FEATURES by row from STATS."""
    words, of = np.maximum(columns["n_words"], 1), lambda c: columns[c].astype(np.float64)
    parts = [of("word_chars") / words, of("n_symbols") / words, of("n_dup_lines") / np.maximum(columns["n_lines"], 1), of("n_repeat_words") / words]
    parts += [of("n_upper") / np.maximum(columns["n_alpha"], 1), of("n_marks") / words, of("n_echoes") / words]
    return np.stack(parts, axis=1)


def mean_path(n: int) -> float:
    """Mean path of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def choose_split(tree: int, node: int, low: np.ndarray, high: np.ndarray) -> tuple[int, float]:
    """The feature and place at which a node whose rows lie between low and high is split; -1 where all are equal."""
    free = np.flatnonzero(high > low)
    if not len(free):
        return -1, 0.0
    rng = np.random.default_rng([SEED, tree, node])
    f = int(free[rng.integers(len(free))])
    return f, float(rng.uniform(low[f], high[f]))


class Forest:
    """Trees as heaps (the children of node v are 2 v + 1 and 2 v + 2): feature (-1: leaf), split, path length at
    leaves, and how many bits of the parent's rows a node leaves behind."""

    def __init__(self, trees=TREES, levels=LEVELS):
        shape = (trees, (2 << levels) - 1)
        self.levels, self.rows = levels, 0
        self.feature, self.split = np.full(shape, -1, np.int64), np.zeros(shape)
        self.path, self.bits, self.count = np.zeros(shape), np.zeros(shape), np.zeros(shape, np.int64)

    def grow(self, level: int, tree, node, count, low, high) -> None:
        """Add a level from its nodes' numbers of rows and bounds by feature."""
        for t, v, n, lows, highs in zip(tree, node, count, low, high, strict=True):
            self.count[t, v] = n
            if v == 0:
                self.rows = int(n)
            else:
                self.bits[t, v] = math.log2(self.count[t, (v - 1) // 2] / n)
            self.path[t, v] = level + mean_path(int(n))
            if level < self.levels and n > 1:
                self.feature[t, v], self.split[t, v] = choose_split(int(t), int(v), lows, highs)

    def nodes(self, tree: int, rows: np.ndarray, levels: int, credit: np.ndarray | None = None) -> np.ndarray:
        """The node that each row reaches within levels; credit gathers the bits by feature."""
        at, every = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for _ in range(levels):
            f = self.feature[tree][at]
            inner = f >= 0
            if not inner.any():
                break
            down = 2 * at + 1 + (rows[every, f] > self.split[tree][at])
            at = np.where(inner, down, at)
            if credit is not None:
                credit[every[inner], f[inner]] += self.bits[tree][at[inner]]
        return at

    def score(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(2 ** (-mean path / expected), near 1 for rows isolated at once; whether each feature is a reason)."""
        total, credit = np.zeros(len(rows)), np.zeros((len(rows), len(FEATURES)))
        for t in range(len(self.path)):
            total += self.path[t][self.nodes(t, rows, self.levels, credit)]
        return 2.0 ** (-total / len(self.path) / (mean_path(self.rows) or 1.0)), (credit > 0) & (credit >= SHARE * credit.max(1, keepdims=True))


def _columns(batch) -> dict[str, np.ndarray]:
    return {c: np.asarray(batch.column(c)) for c in STATS}


def fit(stats: DataFrame, trees=TREES, levels=LEVELS) -> Forest | None:
    """A forest on all rows that pass the base rules."""
    passing, forest = stats.where(~base_failed()).select(*STATS), Forest(trees, levels)
    sides = [f"{side}_{f}" for side in ("low", "high") for f in FEATURES]
    names = ["tree", "node", "n", *sides]

    def summary(share, level):
        def run(batches):
            now, held, size = share.value, [], 0
            for batch in batches:
                held.append(ratios(_columns(batch)))
                size += len(held[-1])
                if size >= HELD:
                    yield from summarise(now, np.concatenate(held))
                    held, size = [], 0
            if size:
                yield from summarise(now, np.concatenate(held))

        def summarise(now, rows):
            for t in range(trees):
                at = now.nodes(t, rows, level)
                # rows that stopped at a leaf above are done
                use = np.flatnonzero(at >= (1 << level) - 1)
                if not len(use):
                    continue
                use = use[np.argsort(at[use], kind="stable")]
                edge = np.flatnonzero(np.diff(at[use], prepend=-1))
                low, high = np.minimum.reduceat(rows[use], edge), np.maximum.reduceat(rows[use], edge)
                columns = [np.full(len(edge), t), at[use[edge]], np.diff(np.append(edge, len(use))), *low.T, *high.T]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        return run

    schema = "tree long, node long, n long, " + ", ".join(f"{c} double" for c in sides)
    bounds = [(F.min if c.startswith("low") else F.max)(c).alias(c) for c in sides]
    for level in range(levels + 1):
        share = stats.sparkSession.sparkContext.broadcast(forest)  # a fixed number of nodes
        made = map_batches(passing, summary(share, level), schema).groupBy("tree", "node").agg(F.sum("n").alias("n"), *bounds).toPandas()
        if not len(made):
            break
        made = made.sort_values(["tree", "node"])
        low, high = (made[sides[k : k + len(FEATURES)]].to_numpy() for k in (0, len(FEATURES)))
        forest.grow(level, made["tree"].to_numpy(), made["node"].to_numpy(), made["n"].to_numpy(), low, high)
    return forest if forest.rows > 1 else None


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """stats with anomaly, the score, and reasons, a bit for each feature."""
    names = stats.columns
    schema = T.StructType([*stats.schema.fields, T.StructField("anomaly", T.DoubleType()), T.StructField("reasons", T.LongType())])
    share = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            got, why = share.value.score(ratios(_columns(batch)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64()), pa.array(why @ (1 << np.arange(len(FEATURES))), pa.int64())], names=[*names, "anomaly", "reasons"])

    return map_batches(stats, run, schema)


def calibrating(key):
    """Whether a label calibrates; the others are held out."""
    return F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(2)) == 0


def calibrate(marked: DataFrame, labels: DataFrame, key="doc_id", loss=LOSS) -> list[float]:
    """The score from which rows are rejected, by reason, from the histogram of the calibrating labelled rows that pass
    the base rules."""
    known = labels.select(key, "quality").where(F.col("quality").isin(0, 1) & calibrating(key))
    joined = marked.where(~base_failed()).join(known, key)
    count = lambda q: F.sum((F.col("quality") == q).cast("long"))
    rows = joined.groupBy("reasons", F.floor(F.col("anomaly") * BINS).cast("int").alias("bin")).agg(count(1).alias("good"), count(0).alias("bad")).collect()
    good, bad = sum(r.good for r in rows), sum(r.bad for r in rows)

    def threshold(some):
        best, limit, lost, caught = 0.0, math.inf, 0, 0
        for bin_ in sorted({r.bin for r in some}, reverse=True):
            lost, caught = lost + sum(r.good for r in some if r.bin == bin_), caught + sum(r.bad for r in some if r.bin == bin_)
            if lost <= loss * good and caught / bad - lost / good > best:
                best, limit = caught / bad - lost / good, bin_
        # halfway to the next good score below
        below = [r.bin + 1 for r in some if r.good and r.bin < limit] or [r.bin + 1 for r in rows if r.good and r.bin < limit]
        return (limit + max(below, default=limit)) / 2 / BINS

    if not good or not bad:
        return [math.inf] * len(FEATURES)
    by = [[r for r in rows if r.reasons >> k & 1] for k in range(len(FEATURES))]
    return [threshold(some) if any(r.bad for r in some) else math.inf for some in by]


def _fitted(df, labels, text, key, keep) -> tuple[DataFrame, Forest | None, list[float]]:
    stats = materialise(measure(df, text, keep), "rule-statistics")
    forest = fit(stats)
    return stats, forest, calibrate(scored(stats, forest), labels, key) if forest else []


def keep_clean(df: DataFrame, labels: DataFrame, text="text", key="doc_id") -> DataFrame:
    """df without the rows that judge() rejects. A verdict follows from a row's own counts, so rows are filtered where
    they stand: the statistics are measured a second time instead of being joined back to the texts."""
    stats, forest, thresholds = _fitted(df, labels, text, key, [key])
    discard(stats)
    names, share = df.columns, df.sparkSession.sparkContext.broadcast((forest, np.array(thresholds)))

    def run(batches):
        forest, limits = share.value
        for batch in batches:
            rows = [statistics(t) for t in batch.column(text).to_pylist()]
            columns = {c: np.array([r[i] for r in rows], np.int64) for i, c in enumerate(STATS)}
            keep = ~((columns["n_words"] < 20) | (100 * columns["n_repeat_words"] > 30 * columns["n_words"]))
            if forest and len(rows):
                got, why = forest.score(ratios(columns))
                keep &= got < np.where(why, limits, math.inf).min(1)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns], names=names)

    return map_batches(df, run, df.schema)


def judge(df: DataFrame, labels: DataFrame, text="text", key="doc_id", keep=None) -> DataFrame:
    """The kept columns, STATS, anomaly, reasons, base_failed and kept."""
    stats, forest, thresholds = _fitted(df, labels, text, key, [key] if keep is None else list(keep))
    marked = scored(stats, forest) if forest else stats.withColumns({"anomaly": F.lit(0.0), "reasons": F.lit(0).cast("long")})
    limit = F.least(F.lit(math.inf), F.lit(math.inf), *[F.when(F.col("reasons").bitwiseAND(1 << k) != 0, F.lit(x)) for k, x in enumerate(thresholds)])
    failed = base_failed()
    return marked.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("anomaly") < limit))
