"""The n-gram join against all pairs."""

import random
import re

import pytest

from surety.llm import common, components, ngram_join


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    k = min(words, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(s), least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed, n, edits=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    common = " ".join(word() for _ in range(25))
    bases = [[word() for _ in range(rng.choice((6, 40, 90, 300)))] for _ in range(max(1, n // 12))]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = word()
        t = " ".join(w)
        if i % 3 == 0:
            t = common + "\n" + t
        rows.append((i, t.upper() if i % 17 == 0 else t))
    return rows


@pytest.mark.parametrize("words, percent, block", [(4, 85, 256), (5, 80, 8)])
def test_components_match_all_pairs(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LONG", 40 * block)
    rows = corpus(3, 360) + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE\x0btwo"), (1005, "one two three"), (1006, "É é é é"), (1007, "é é é é"), (1008, "x " * 60_000), (1009, "x y z w " * 20_000)]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n_shingles string").repartition(5)
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(df, words=words, percent=percent).collect())
    assert got == brute(rows, words, percent)


def test_one_large_group_with_chains(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(8)
    base, rows = [f"w{i}" for i in range(80)], []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(80)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.jaccard_components(df).collect()) == brute(rows, 4, 85)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((repr(tuple(r)) for r in ngram_join.jaccard_components(df).collect()))
    assert got == sorted(["(1, 3, 1)", "(1, 3, 1)", "(2, 3, 1)", "(None, 3, 1)", "(None, 0, None)", "(3, 1, 3)"])
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0
    kept = sorted(repr((r.doc_id, r.text)) for r in ngram_join.keep_one(df).collect())
    assert kept == ["(1, 'a b c d e f')", "(3, 'z')", "(None, None)"]


@pytest.mark.parametrize("hot", [100_000, 8])
def test_components_of_random_graphs(spark, monkeypatch, hot):
    monkeypatch.setattr(components, "HOT", hot)
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(400, 460)] + [(900, i) for i in range(901, 1600)] + [(i, 2000) for i in range(1800, 2000)]
    parent = {x: x for e in edges for x in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    looped = {a for a, b in edges if a == b}
    assert all(got.get(x, x) == find(x) for x in parent) and set(parent) - set(got) <= looped


@pytest.mark.parametrize("rows_broadcast", [500_000, 0])
def test_rows_of_null_and_repeated_keys_are_told_apart(spark, monkeypatch, rows_broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows_broadcast)
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, None), (None, ""), (5, text("c")), (5, text("d")), (6, text("d") + " tail"), (2, text("e")), (7, text("e")), (7, text("f")), (8, None), (8, text("g"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = ngram_join.keep_one(df)
    assert found.columns == ["doc_id", "text"]
    kept = sorted(repr((r.doc_id, r.text)) for r in found.collect())
    want = [(None, text("a")), (None, text("b")), (None, None), (None, ""), (5, text("c")), (5, text("d")), (2, text("e")), (7, text("f")), (8, None), (8, text("g"))]
    assert kept == sorted(map(repr, want))


def test_small_fragments_and_no_broadcast_give_the_same(spark, monkeypatch):
    rows = corpus(5, 200)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    monkeypatch.setattr(ngram_join, "LEAST", 3)
    monkeypatch.setattr(ngram_join, "SEGMENT", 500)
    monkeypatch.setattr(ngram_join, "BATCH", 900)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(tuple(r) for r in ngram_join.jaccard_components(df).collect()) == brute(rows, 4, 85)


def test_a_common_passage_forms_no_group(spark, monkeypatch):
    """Texts of nine tenths one passage share less than 0.85 with each other; copies among them are still found."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    passage = " ".join(f"p{i}" for i in range(93))
    rows = [(i, passage + " " + " ".join(f"u{i}x{k}" for k in range(8 + i % 3))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = ngram_join.materialise(ngram_join.class_sets(df, "text", "doc_id", 4), "test")
    ordered = ngram_join._ordered(ngram_join._survivors(df, sets, "text", "doc_id", 4, 85), 85)
    assert ordered.count() == 120 and ngram_join._candidate_groups(ordered, 85).count() == 0
    rows += [(200 + i, rows[i][1] + " tail") for i in range(0, 40, 7)] + [(300, passage), (301, passage + " u0x0 u0x1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in ngram_join.jaccard_components(df).collect()) == brute(rows, 4, 85)
