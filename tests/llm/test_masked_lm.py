"""The window network: gradients, a plain loop, held-out text, independence of partitions, odd rows."""

import math
import random

import numpy as np
import pytest
import xxhash

from surety.llm import masked_lm as M


def network(seed=0):
    rng = np.random.default_rng(seed)
    net = M.Network(M.Network.start(rng.integers(0, 50, M.CODES).astype(float)))
    net.w = {k: v.astype(np.float64) + rng.normal(0, 0.1, v.shape) for k, v in net.w.items()}
    net.seen = {k: v.astype(np.float64) for k, v in net.seen.items()}
    return net


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    context = [rng.integers(0, 40, 50) for _ in M.PLACES]
    target = rng.integers(0, M.CODES, 50)
    net = network()
    start = {k: v.copy() for k, v in net.w.items()}
    net.step(context, target)
    moved = {k: net.w[k] - start[k] for k in start}
    loss = lambda: -net.log_probability(context, target).mean()
    for name in M.SHAPES:
        for rank in (-1, -3):
            i = np.unravel_index(np.abs(moved[name]).ravel().argsort()[rank], moved[name].shape)
            net.w = {k: v.copy() for k, v in start.items()}
            net.w[name][i] += 1e-5
            up = loss()
            net.w[name][i] -= 2e-5
            slope = (up - loss()) / 2e-5
            assert abs(moved[name][i] + M.RATE * slope / math.sqrt(1e-2 + slope**2)) < 1e-5, name


def test_probabilities_sum_to_one():
    net = network(1)
    context = [np.full(M.CODES, 3) for _ in M.PLACES]
    assert abs(np.exp(net.log_probability(context, np.arange(M.CODES))).sum() - 1) < 1e-9


def sentences(n, seed):
    rng = random.Random(seed)
    who, what, where = ["the dog", "a cat", "my bird", "one fox"], ["runs over", "sits under", "looks at"], ["green hills", "old walls", "deep rivers"]
    return [" . ".join(f"{rng.choice(who)} {rng.choice(what)} {rng.choice(where)}" for _ in range(12)) for _ in range(n)]


def table(spark, texts, parts=3):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)


@pytest.fixture(scope="module")
def model(spark):
    return M.fit(table(spark, sentences(600, 1)), mask=2, epochs=4)


def plain_score(model, words, vocabulary):
    """A text's log-likelihood by a loop over positions, in plain Python. vocabulary: counts of all words."""
    w = {k: v.astype(float) for k, v in M.Network(model.flat).w.items()}
    number = {int(h): (int(c), float(s)) for h, c, s in zip(model.hashes, model.codes, model.shares)}
    code = lambda t: number.get(xxhash.xxh64_intdigest(t), (M.UNKNOWN, None))[0]
    total = 0.0
    for i, word in enumerate(words):
        h = w["bias"].copy()
        for k, place in enumerate(M.PLACES):
            j = i + place
            h += w["context"][k][code(words[j]) if 0 <= j < len(words) else M.GAP_CODE]
        h = [math.tanh(x) for x in h]
        c = code(word)
        for matrix, bias, digit in ((w["first"], w["first_bias"], c // M.SIDE), (w["second"][c // M.SIDE], w["second_bias"][c // M.SIDE], c % M.SIDE)):
            logits = [sum(h[a] * matrix[a][b] for a in range(M.WIDTH)) + bias[b] for b in range(M.SIDE)]
            total += logits[digit] - math.log(sum(map(math.exp, logits)))
        if c == M.UNKNOWN:
            if word in vocabulary:
                total += model.lift + math.log(vocabulary[word])
            else:
                raw = b"\xff" + word.encode() + b"\xff"
                total += model.unseen + sum(model.spelling[a * 256 + b] for a, b in zip(raw, raw[1:]))
    return total


def test_scores_match_a_loop_over_positions(spark, monkeypatch):
    rng = random.Random(2)
    base = sentences(150, 1)
    # more words than the vocabulary holds, so that some are in the unknown class
    texts = [t + " " + " ".join(f"w{rng.randrange(6000)}" for _ in range(60)) for t in base]
    made = M.fit(table(spark, texts))
    counts = {}
    for t in texts:
        for x in t.split():
            counts[x] = counts.get(x, 0) + 1
    assert {r.code % (1 << 64): r.n for r in made.words.collect()} == {xxhash.xxh64_intdigest(x): n for x, n in counts.items()}
    probe = ["the dog sits under green hills", "the dog sits w17 w4000 zzz", "é new w1", "one", texts[3]]
    df = table(spark, probe, 2)
    # with fewer words held by tasks, the others are joined to the vocabulary
    monkeypatch.setattr(M, "FREQUENT", 4200)
    joined = M.fit(table(spark, texts))
    assert len(joined.hashes) <= 4200 < len(counts) == len(made.hashes)
    for use in (made, joined):
        want = [plain_score(use, t.split(), counts) for t in probe]
        got = {r.doc_id: r.log_likelihood for r in M.score(df, use).collect()}
        assert all(abs(got[i] - x) < 0.01 for i, x in enumerate(want)), (got, want)


def test_held_out_text_beats_shuffled_text_and_an_even_guess(spark, model):
    rng, pairs = random.Random(3), []
    for t in sentences(60, 2):
        w = t.split()
        pairs += [t, " ".join(rng.sample(w, len(w)))]
    got = {r.doc_id: r for r in M.score(table(spark, pairs), model).collect()}
    assert sum(got[2 * i].log_likelihood > got[2 * i + 1].log_likelihood for i in range(60)) >= 57
    kinds = len({w for t in sentences(60, 2) for w in t.split()})
    mean = sum(got[2 * i].mean_log_likelihood for i in range(60)) / 60
    assert mean > -math.log(kinds) + 1
    assert abs(got[0].mean_log_likelihood - got[0].log_likelihood / got[0].n_words) < 1e-5


def test_neither_weights_nor_scores_depend_on_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD", 700)
    rng = random.Random(5)
    texts = sentences(120, 4) + [" ".join(f"v{rng.randrange(5000)}" for _ in range(80)) for _ in range(60)]
    texts += [texts[0]] * 300 + [None, "", "x"]
    found = []
    for parts in (1, 37):
        df = table(spark, texts, parts)
        made = M.fit(df)
        found.append((made.flat.tolist(), sorted((r.doc_id, r.log_likelihood) for r in M.score(df, made).collect())))
    assert found[0] == found[1]


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "one", "x"), (3, "one", "x"), (4, "w " * 500_000, "x"), (5, " \n", "x"), (None, "one two", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    model = M.fit(df)
    got = M.score(df, model).collect()
    assert [r.n_words for r in sorted(got, key=lambda r: r.doc_id or 9)] == [0, 0, 1, 1, 500_000, 0, 2]
    assert all((r.mean_log_likelihood is None) == (r.n_words == 0) for r in got)
    empty = df.limit(0)
    assert M.score(empty, M.fit(empty)).count() == 0
    assert M.score(df, M.fit(empty)).where("log_likelihood < 0").count() == 4


def test_words_are_numbered_and_gaps_are_told_from_words(monkeypatch):
    model = M.Model(None, None, np.array([], np.uint64), np.array([], np.int64), np.array([]), 0.0, -1.0, np.zeros(1 << 16))
    assert M._lookup(model, False)(["x", ""], np.zeros(2, np.uint64))[0].tolist() == [M.UNKNOWN, M.GAP_CODE]
    monkeypatch.setattr(M, "MEMO", 3)
    numbered = M.Words(lambda words, hashes: (np.array([len(w) for w in words], np.int64),))
    for words in (["a", "bb", "a"], ["ccc", "bb", "dddd"], [], ["eeeee", "a", "eeeee"]):
        assert numbered(words)[0].tolist() == [len(w) for w in words]
