"""Importance resampling against a loop over words."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from surety.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain(documents, target):
    """doc_id, n_features, weight, score, rank of each row."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, t in documents for f in plain_features(t)[1])
    t = Counter(bucket(f) for x in target for f in plain_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for i, text in documents:
        words, found = plain_features(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def texts(seed):
    rng = random.Random(seed)
    bits = ["a", "B", "Zz", "0", "9", "é", "ÉCOLE", "ß", "日本", "𝒳", "the", "of", "x" * 47, "y" * 48, "z" * 49, "w" * 70_000]
    out = [None, "", " ", "...", "a", "A b", "a" * 300, "\x00a\x7fb@c`d{e/f:g", "word" + " word" * 50]
    for _ in range(250):
        n = rng.choice((3, 30, 60))
        out.append("".join(rng.choice(bits[:-1]) + rng.choice([" ", "  ", "\n", "-", "", ", "]) for _ in range(n)))
    return out + [bits[-1] + " a " + bits[-1]]


@pytest.mark.parametrize("sliced", [False, True])
def test_features_of_a_column(sliced):
    want = texts(1)
    column = pa.array(["junk words", *want, "more"]).slice(1, len(want)) if sliced else pa.array(want)
    words, of, crc = importance.features(column)
    for i, t in enumerate(want):
        w, f = plain_features(t)
        assert words[i] == len(w) and Counter(crc[of == i].tolist()) == Counter(zlib.crc32(x.encode()) for x in f)
    for none in (pa.array([], pa.string()), pa.array([None], pa.string()), pa.array(["", ""])):
        words, of, crc = importance.features(none)
        assert words.tolist() == [0] * len(none) and not len(of) and not len(crc)


def test_the_table_is_the_librarys():
    data = np.frombuffer(bytes(range(256)) * 2, np.uint8)
    state = importance.advance(np.full(1, 0xFFFFFFFF, np.uint32), data, np.array([0]), np.array([512]))
    assert int(state[0]) ^ 0xFFFFFFFF == zlib.crc32(data.tobytes())


@pytest.mark.parametrize("parts", [1, 5])
def test_equals_a_loop_over_words(spark, parts):
    documents = [*enumerate(texts(2)), (40, "x " * 25), (40, "x " * 25), (None, "of the " * 15), (None, None)]
    target = ["the of École", None, "", "a b 0 9 the the", "x" * 60]
    df = spark.createDataFrame([(i, t, 1, None, "w") for i, t in documents], "doc_id long, text string, rank int, score string, _down string").repartition(parts)
    goal = spark.createDataFrame([(i, t, 0) for i, t in enumerate(target)], "item_id long, text string, bucket int")
    got = importance.resample(df, goal).select("doc_id", "n_features", "weight", "score", "rank").collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain(documents, target), key=key)
    assert sum(r.rank is not None for r in got) > 30


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b " * 30), (2, "c d " * 30)], "doc_id long, text string")
    assert importance.resample(df.limit(0), df).count() == 0
    rows = importance.resample(df, df.limit(0)).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2] and all(r.rank is None for r in rows)
    want = plain([(1, "a b " * 30), (2, "c d " * 30)], [])
    assert sorted((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in rows) == sorted(want)
