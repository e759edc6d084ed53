"""Restored words against every path of the lattice; scores on planted texts."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from surety.llm import toxicity as tox

WORDS = "the of and river stone garden window table letter people morning water paper green".split()
BAD = "grumblefoot snarkwit dolthead".split()


def corpus(seed, n=400):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "ly"]) for _ in range(rng.choice((15, 60, 300)))]
        if i % 5 == 0:
            for _ in range(rng.randint(2, 4)):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    return rows, labels


def plain_counts(texts):
    out = Counter()
    for t in texts:
        word = []
        for c in tox.normal(t) + "\n":
            b = tox.base(c)
            s = (ord(b) - 96 if "a" <= b <= "z" else tox.OTHER) if c.isalpha() and ord(c) < 1 << 16 else 0
            if s or word:
                key = 0
                for x in ([0, 0, 0] + word)[-3:] + [s]:
                    key = key * tox.SYMBOLS + x
                out[key] += 1
            word = word + [s] if s else []
    return out


def test_contexts_of_odd_texts():
    texts = ["", None, "a", "Été à l'École", "x1y22  z", "日本語 ok", "\n\n", "ßtraße", "𝒳y", "a" * 50, " lead", "trail ", "\ud800 lone".encode("utf-8", "replace").decode()]
    got = tox.context_counts([tox.normal(t) for t in texts])
    want = plain_counts(texts)
    assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == dict(want)


@pytest.fixture(scope="module")
def cost():
    rows, _ = corpus(3)
    return tox.costs(tox.context_counts([t for _, t in rows]).astype(float))


def test_costs_are_probabilities(cost):
    p = np.exp(-cost.astype(float).reshape(-1, tox.SYMBOLS)).sum(axis=1)
    assert np.allclose(p, 1, atol=1e-4)


def every_path(decoder, token, joined):
    """The least cost over all combinations of readings."""
    runs = [(k, len([*g])) for k, g in itertools.groupby(token)]
    best = None
    for path in itertools.product(*[decoder._readings(c, n, joined) for c, n in runs]):
        total, word = sum(x[2] for x in path), []
        for s in (s for x in path for s in x[1]):
            if s or word:
                total += decoder.cost[int(np.ravel_multi_index(([0, 0, 0] + word)[-3:] + [s], (tox.SYMBOLS,) * 4))]
            word = word + [s] if s else []
        if word:
            total += decoder.cost[int(np.ravel_multi_index(([0, 0, 0] + word)[-3:] + [0], (tox.SYMBOLS,) * 4))]
        text = "".join(x[0] for x in path)
        if best is None or total < best[0] - 1e-9:
            best = (total, {text})
        elif abs(total - best[0]) <= 1e-9:
            best[1].add(text)
    return best[1]


def test_the_path_is_the_cheapest_of_all(cost):
    decoder, rng = tox.Decoder(cost), random.Random(2)
    for _ in range(120):
        token = "".join(rng.choice(["g", "r", "e", "n", "1", "0", "$", "3", ".", "t", "sss", "é"]) for _ in range(rng.randint(1, 8)))
        for joined in (tox.JOINED, tox.SPREAD):
            assert decoder.decode(token, joined) in every_path(decoder, token, joined)


@pytest.mark.parametrize("shown", ["snarkwit", "SnArKwIt", "5n4rkw1t", "s n a r k w i t", "s.n.a.r.k.w.i.t", "snaaaaarkwiiiiit", "sn@rkw1t!", "ｓｎａｒｋｗｉｔ", "s​n​arkwit", "S_N_A_R_K_W_I_T", "ssnnaarrkkwwiitt", "s n a a a a r k w w w i t", "5.n.4.r.k.w.!.t", "sssnnnaaarrrkkkwwwiiittt", "snar*wit"])
def test_disguises_are_read(cost, shown):
    reader = tox.Reader(cost, ["snarkwit$"])
    assert reader.counts(f"the river {shown}, of stone")[1] == ({0: 1} if shown != "snar*wit" else {})


def test_plain_texts_stay(cost):
    reader = tox.Reader(cost, ["the$", "river$"])
    text = "The river's end. The 3 rivers, the-river 1234 a.b #### ***"
    assert [w for t in reader.tokens("river, stone.").elements() for w in reader.decoder.words(t)] == [("river", False), ("stone", False)]
    assert reader.counts(text)[1][0] == 3
    for odd in ("a " * 5000, "ab1" * 20_000, "x" * 100_000, "1 2 3 4 5", "?!?!", "\0"):
        reader.counts(odd)


def test_features_and_choice():
    assert tox.features("abcde") == ["abcde$", "abc", "abcd"] and tox.features("ab") == ["ab$"]
    found = [("snarky$", 9, 0), ("sna", 9, 0), ("snark", 9, 0), ("snar", 9, 1), ("dol", 5, 1), ("dolts$", 4, 0)]
    assert tox.choose(found) == (["snarky$", "snar", "dol", "dolts$"], {"snark": "snarky$"}) and tox.choose(found, 0) == ([], {})


def test_a_restored_words_beginning_stands_for_it(cost):
    reader = tox.Reader(cost, ["snarkwitted$"], {"snarkw": "snarkwitted$"})
    assert reader.counts("sn4rkw1t")[1] == {0: 1} and reader.counts("snarkwit")[1] == {}


def tables(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, score double, toxic string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.mark.parametrize("parts", [1, 6])
def test_planted_texts(spark, parts):
    rows, labels = corpus(5)
    disguised = [(1000 + i, f"the green river {w} of morning water and {w}") for i, w in enumerate(["gr umblefoot".replace(" ", ""), "sn4rkw1t", "d o l t h e a d", "Grummmmblefoot", "d0lth3ad"])]
    rows += [*disguised, (2000, None), (2001, ""), (None, "snarkwit snarkwit dolthead the river"), (7, rows[7][1])]
    # labels that can't be learned: contradictions, other values, null keys, rows of other documents
    labels += [(1, 1), (1, 0), (2, None), (3, 5), (None, 1), (99_999, 1)]
    docs, known = tables(spark, rows, labels)
    got = tox.score(docs.repartition(parts), known).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    toxic = {i for i in range(400) if i % 5 == 0}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    assert all(by[i].predicted == int(i in toxic) for i in range(400) if by[i].held_out)
    assert all(by[i].predicted == 1 for i in [*(i for i, _ in disguised), None])
    assert by[2000].score == by[2001].score < 0.5
    assert [r.score for r in got if r.doc_id == 7] == [by[7].score] * 2


def test_scores_do_not_depend_on_partitions_or_held_out_labels(spark):
    rows, labels = corpus(8, 200)
    docs, known = tables(spark, rows, labels)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    runs = [tox.score(docs.repartition(n), t).collect() for n, t in ((1, known), (5, known), (3, tables(spark, rows, turned)[1]))]
    runs = [sorted((r.doc_id, r.score) for r in run) for run in runs]
    assert runs[0] == runs[1] == runs[2]


def test_nothing_to_learn(spark):
    docs, known = tables(spark, [(1, "a b"), (2, "c")], [(1, 1), (2, 1), (3, 1)])
    assert {r.score for r in tox.score(docs, known).collect()} == {0.0}
    assert {r.score for r in tox.score(docs, known.limit(0)).collect()} == {0.0}
    assert tox.score(docs.limit(0), known).count() == 0
