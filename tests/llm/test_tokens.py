"""Token counts and packing against the library and brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from surety.llm import packing, tokens

WORD, BYTE, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
ODD = [
    None, "", "Plain words, isn't it? 42 ½ x² naïve Straße ÀÉ", "İstanbul ΣΣ é ﬁ", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>",
    "tabs\tand\x0bvertical\x1cgroup\x85next\xa0nbsp  em", "  lead\n\n  trail   \n", "🤦🏼‍♂️ 中文 한국어 العربية", "!!!???...''s 'S 'LL don't", "x" * 5000, "word " * 40000, "\x00\x7f\xad", "ǅ ŉ ſ K", "1234567890 ١٢٣",
]


def test_every_fast_character_counts_as_the_library_does():
    counter = tokens.WordCounter(WORD, tokens.whole_tokens(WORD))
    tok = Tokenizer.from_file(WORD)
    for c in map(chr, range(tokens.LATIN)):
        for t in (c, f"a{c}b", f"1{c} {c}{c}'{c}s"):
            assert counter.counts([t]) == [len(tok.encode(t, add_special_tokens=False).ids)], repr(t)


def test_pieces_around_odd_characters_count_as_the_library_does():
    counter, tok, rng = tokens.WordCounter(WORD, tokens.whole_tokens(WORD)), Tokenizer.from_file(WORD), random.Random(4)
    bits = ["the", "naïve", "don’t", "—", "“so”", "e\u0301", "\u0301", "Σας", "中文", " ", "\n", "\t", "\u2028", "\xa0", "\x85", "İ", "ǅ", "ﬁ", "'s", "42", "½", "ſ", "\u212a", "한", "\u1112\u1161", "\x00", "🤦🏼", ".", "a" * 40]
    for _ in range(3000):
        t = "".join(rng.choice(bits) + rng.choice(("", "", " ")) for _ in range(rng.randint(1, 9)))
        assert counter.counts([t]) == [len(tok.encode(t, add_special_tokens=False).ids)], repr(t)


def test_byte_ids_equal_the_library():
    enc, tok = tokens.ByteEncoder(BYTE, RANKS), Tokenizer.from_file(BYTE)
    for c in map(chr, range(tokens.LATIN)):
        t = f"a{c}b 1{c} {c}{c}'{c}s {c}"
        assert enc.ids(t) == tok.encode(t, add_special_tokens=False).ids, repr(t)
    for t in ODD:
        assert enc.ids(t or "") == tok.encode(t or "", add_special_tokens=False).ids


def test_whole_tokens_are_single():
    tok, proven = Tokenizer.from_file(WORD), tokens.whole_tokens(WORD)
    assert len(proven) > 20_000
    some = random.Random(1).sample(sorted(proven), 500)
    assert all(len(e.ids) == 1 for e in tok.encode_batch(some, add_special_tokens=False))


def test_counts_on_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens string")
    tok = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in tokens.count_tokens(df, WORD).collect()}
    for i, t in enumerate(ODD):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 2048)
    assert tokens.count_tokens(df.limit(0), WORD).count() == 0


def test_a_full_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 3)
    counter, tok = tokens.WordCounter(WORD, tokens.whole_tokens(WORD)), Tokenizer.from_file(WORD)
    texts = ["qzxv wqpk zzkqj", "qzxv bbqqz", "the qzxv wqpk mmzzq bbqqz"] * 3
    assert counter.counts(texts) == [len(tok.encode(t).ids) for t in texts]


def check_plan(counts, capacity):
    plan = packing.Plan(dict(counts), capacity)
    used, ranks = defaultdict(list), defaultdict(set)
    for length, rank, n, first, offset in plan.ranges:
        for k in range(n):
            assert rank + k not in ranks[length]
            ranks[length].add(rank + k)
            used[first + k].append((offset, length))
    assert {k: len(v) for k, v in ranks.items()} == {k: n for k, n in counts.items() if n}
    assert set(used) == set(range(plan.sequences))
    for items in used.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return plan


def optimum(items, capacity):
    best = len(items)
    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()
    go(0, [])
    return best


def test_plans_are_valid_and_near_the_optimum():
    rng = random.Random(3)
    worse = 0
    for _ in range(120):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = defaultdict(int)
        for x in items:
            counts[x] += 1
        plan = check_plan(counts, 20)
        best = optimum(items, 20)
        assert plan.sequences >= best
        worse += plan.sequences - best
    assert worse <= 2
    big = {k: rng.randint(0, 300) for k in range(1, 2049)}
    plan = check_plan(big, 2048)
    assert plan.sequences <= -(-sum(k * n for k, n in big.items()) // 2048) * 1.01 + 1
    check_plan({}, 2048), check_plan({2048: 5}, 2048), check_plan({1: 5000}, 2048), check_plan({1024: 3}, 2048)


def test_reduction_alone_is_optimal():
    """Where the reduction leaves nothing over, its result has no better."""
    rng = random.Random(5)
    for _ in range(200):
        items = [rng.randint(5, 20) for _ in range(rng.randint(1, 8))]
        counts = defaultdict(int)
        for x in items:
            counts[x] += 1
        plan = check_plan(counts, 20)
        if plan.fixed == plan.sequences:
            assert plan.sequences == optimum(sorted(items, reverse=True), 20)


def test_packed_documents_round_trip(spark):
    texts = [*ODD, "same", "same", "long text here " * 3000]
    df = spark.createDataFrame([(i // 2, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, piece string").repartition(3)
    rows = packing.pack_documents(df, BYTE, RANKS).collect()
    tok = Tokenizer.from_file(BYTE)
    want = []
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for p, (s, n) in enumerate(packing.cut(len(ids), 2048)):
            want.append((i // 2, p, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())))
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(df.limit(0), BYTE, RANKS).count() == 0
