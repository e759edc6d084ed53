"""TIFF round trips, rule statistics and the isolation forest."""

import hashlib
import math
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest

from surety.llm import quality, tiff


def samples():
    rng = random.Random(7)
    yield from (b"", b"a", b"ab" * 40, bytes(5000), bytes(range(256)) * 300, b"x" * 70000)
    for n in (63, 64, 65, 1000, 70000):
        yield bytes(rng.randrange(256) for _ in range(n))
        yield "".join(rng.choice("the of and ") for _ in range(n)).encode()


@pytest.mark.parametrize("data", [*samples()])
def test_codecs_round_trip(data):
    assert tiff.unpack_lzw(tiff.pack_lzw(data), len(data)) == data
    rows = np.frombuffer(data + bytes(-len(data) % 64), np.uint8).reshape(-1, 64)
    assert tiff.unpack_bits(tiff.pack_bits(rows), rows.size) == rows.tobytes()


def test_files_round_trip_in_every_layout():
    seen = set()
    for i in range(700):
        payload = tiff.payload_of(f"text {i} é " * (1 + i % 9 * (300 if i % 5 == 0 else 3)) * (1 + i % 4))
        data = tiff.write(payload)
        rows = list(tiff.read(data))
        assert b"".join(r[5] for r in rows) == payload and [r[0] for r in rows] == list(range(len(rows)))
        tags = next(tiff.directories(data))
        seen.add((data[:2], tags[tiff.COMPRESSION][0], tags[tiff.PREDICTOR][0], tiff.TILES in tags))
    assert len(seen) == 24


def test_rows_of_odd_files(spark):
    good = tiff.write(tiff.payload_of("x" * 200_000))
    loop = bytearray(tiff.write(tiff.payload_of("y")))
    files = [(1, good), (2, None), (3, b""), (4, b"II*\x00\xff\xff\xff\xff"), (5, good[:500]), (6, good)]
    df = spark.createDataFrame([(i, f, "z") for i, f in files], "doc_id long, media binary, page string")
    rows = tiff.tiff_pages(df).collect()
    by = {i: [r for r in rows if r.doc_id == i] for i, _ in files}
    assert len(by[1]) == len(by[6]) == 4 and all(r.error is None for r in by[1])
    assert all(len(by[i]) == 1 and by[i][0].page is None and by[i][0].error for i in (2, 3, 4, 5))
    assert tiff.digest_pages(tiff.tiff_pages(df), ["doc_id"]).where("feature = 'pages=0'").count() == 0
    order = "<" if loop[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", loop, 4)
    struct.pack_into(order + "I", loop, len(loop) - 4, at)
    assert "loop" in next(tiff.read(bytes(loop)))[-1]
    assert tiff.tiff_pages(df.limit(0)).count() == 0


def image(changes=(), pages=2, wide=4, high=6, drop=()):
    """A plain little-endian file of pages of two strips (or what changes say), each page with samples of its own number."""
    out = bytearray(b"II*\x00" + bytes(4))
    link = 4
    for p in range(pages):
        at = len(out)
        out += bytes([p + 1]) * (wide * high)
        tags = {256: [wide], 257: [high], 258: [8], 259: [1], 262: [1], 273: [at, at + wide * 3], 277: [1], 278: [3], 279: [wide * 3] * 2}
        if p == 1:
            tags.update(dict(changes))
            tags = {k: v for k, v in tags.items() if k not in drop}
        fields = b""
        for tag in sorted(tags):
            body = struct.pack(f"<{len(tags[tag])}I", *tags[tag])
            if len(body) > 4:
                out += body
                body = struct.pack("<I", len(out) - len(body))
            fields += struct.pack("<HHI", tag, 4, len(tags[tag])) + body.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + fields
        link = len(out)
        out += bytes(4)
    return bytes(out)


@pytest.mark.parametrize(
    "changes, drop",
    [({278: [0]}, ()), ({273: [8], 279: [12]}, ()), ({256: [0]}, ()), ({257: [0]}, ()), ({322: [0], 323: [0], 324: [8], 325: [1]}, ()), ({322: [1 << 31], 323: [1 << 31], 324: [8], 325: [1]}, ()), ({258: [4]}, ()), ({284: [2]}, ()), ({259: [99]}, ()), ({277: [0]}, ()), ({256: [1 << 31], 257: [1 << 31]}, ()), ({273: [1 << 30, 1 << 30]}, ()), ({}, (273,)), ({}, (256,)), ({}, (279,)), ({259: [5]}, ()), ({259: [8]}, ()), ({259: [32773]}, ())],
)
def test_a_bad_page_is_an_error_of_its_own(changes, drop):
    rows = list(tiff.read(image(changes.items(), drop=drop)))
    assert [(r[0], r[1]) for r in rows] == [(0, 2), (1, 2)]
    assert rows[0][5] == b"\x01" * 24 and rows[0][6] is None
    assert rows[1][5] is None and rows[1][6]


def links(data):
    """Where the places of the directories of a plain little-endian file are written."""
    out, at = [4], struct.unpack_from("<I", data, 4)[0]
    while at:
        (n,) = struct.unpack_from("<H", data, at)
        out.append(at + 2 + 12 * n)
        (at,) = struct.unpack_from("<I", data, out[-1])
    return out


@pytest.mark.parametrize("kept", [1, 2])
@pytest.mark.parametrize("damage", ["beyond", "loop", "cut", "torn"])
def test_pages_before_a_damaged_directory_are_read(kept, damage):
    data = bytearray(image(pages=3))
    where = links(data)[kept]
    (at,) = struct.unpack_from("<I", data, where)
    if damage == "cut":
        data = data[: at + 1]
    elif damage == "torn":
        struct.pack_into("<H", data, at, 60_000)
    else:
        struct.pack_into("<I", data, where, len(data) + 5 if damage == "beyond" else struct.unpack_from("<I", data, 4)[0])
    rows = list(tiff.read(bytes(data)))
    assert rows[0][0] is None and rows[0][1] == kept and rows[0][-1]
    assert [(r[0], r[5], r[6]) for r in rows[1:]] == [(p, bytes([p + 1]) * 24, None) for p in range(kept)]


def lzw(*codes):
    """Codes of nine bits as bytes."""
    bits = "".join(f"{c:09b}" for c in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_codes_beyond_the_table_are_errors():
    assert tiff.unpack_lzw(lzw(256, 65, 258, 257), 3) == b"AAA"
    for codes in ((256, 65, 500, 501), (256, 65, 259), (256, 65, 66, 260), (256, 258)):
        with pytest.raises(tiff.BAD):
            tiff.unpack_lzw(lzw(*codes), 100)
    page = image({259: [5], 273: [8, 8], 279: [6, 6]}.items())
    broken = bytearray(page)
    broken[8:14] = lzw(256, 65, 500, 501).ljust(6, b"\0")
    assert [r[6] is None for r in tiff.read(bytes(broken))] == [True, False]


def test_pages_of_hand_made_files():
    assert [r[2:6] for r in tiff.read(image(pages=3))] == [(4, 6, 1, bytes([p]) * 24) for p in (1, 2, 3)]
    rng = random.Random(5)
    whole = image()
    for _ in range(300):
        broken = bytearray(whole)
        for _ in range(rng.randint(1, 4)):
            broken[rng.randrange(len(broken))] = rng.choice((0, 1, 255, rng.randrange(256)))
        rows = list(tiff.read(bytes(broken)))
        assert rows and all((r[5] is None) != (r[6] is None) for r in rows)


def test_digests_of_stored_texts(spark):
    texts = [None, "", "é", "a" * 64, "b" * 200_000, "b" * 200_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in tiff.digest_pages(tiff.tiff_pages(tiff.store(df)), ["doc_id", "n_bytes"]).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        raw += bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_statistics_match_brute_force():
    rng = random.Random(2)
    texts = [None, "", " \t\n\x0b\x0c\r ", "a\x1cb \x85 c\xa0d", "one\n\none\none \r\n", "# * |<>& $%"]
    texts += [" ".join(rng.choice("abc\n") for _ in range(rng.randint(0, 120))) for _ in range(60)]
    texts += ["a b c d e f g h " * 5 + "x y z", "w " * 30]
    for t in texts:
        assert quality.statistics(t)[:5] == brute(t), repr(t)


def plain_path(rows, tree, node, row, level, levels, bits):
    """The path of one row through a tree grown on rows, in plain Python; bits by feature."""
    low, high = np.array([min(c) for c in zip(*rows)]), np.array([max(c) for c in zip(*rows)])
    f, split = quality.choose_split(tree, node, low, high)
    if level == levels or len(rows) < 2 or f < 0:
        return level + quality.mean_path(len(rows))
    right = row[f] > split
    part = [r for r in rows if (r[f] > split) == right]
    bits[f] += math.log2(len(rows) / len(part))
    return plain_path(part, tree, 2 * node + 1 + right, row, level + 1, levels, bits)


def forest_table(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.randint(20, 300)
        rows.append((i, words, words * 5 + rng.randint(0, 40), rng.choice((0, 0, 1, words)), rng.choice((0, 0, 2)), rng.choice((0, 0, 9)), rng.randint(0, 9), words * 4, rng.choice((0, 1)), rng.choice((0, 0, 3)), rng.randint(2, 9)))
    return spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} long" for c in quality.STATS)), rows


def test_forest_matches_plain_trees_however_rows_are_dealt(spark, monkeypatch):
    df, rows = forest_table(spark)
    vectors = [tuple(v) for v in quality.ratios({c: np.array([r[i + 1] for r in rows]) for i, c in enumerate(quality.STATS)}).tolist()]
    passing = [v for v, r in zip(vectors, rows) if 100 * r[5] <= 30 * r[1]]
    monkeypatch.setattr(quality, "HELD", 7)
    made = [quality.fit(df.repartition(k), trees=6, levels=4) for k in (1, 5)]
    for forest in made:
        score, why = forest.score(np.array(passing))
        for v, got, reason in list(zip(passing, score, why))[::7]:
            bits = [0.0] * len(quality.FEATURES)
            path = sum(plain_path(passing, t, 0, v, 0, 4, bits) for t in range(6)) / 6
            assert abs(got - 2 ** (-path / quality.mean_path(len(passing)))) < 1e-12
            assert all(r == (b > 0 and b >= 0.5 * max(bits)) for r, b in zip(reason, bits) if abs(b - 0.5 * max(bits)) > 1e-6)
    assert all((getattr(made[0], x) == getattr(made[1], x)).all() for x in ("feature", "split", "path", "bits", "count"))


def test_held_out_labels_of_the_sample_are_told_apart(spark):
    root = "/root/testdata/sf0.01"
    if not os.path.isdir(root):
        pytest.skip("sample tables are absent")
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    out = [quality.judge(docs.repartition(k), labels).join(labels, "doc_id").where("not base_failed").where(~quality.calibrating("doc_id")).collect() for k in (1, 9)]
    assert {(r.doc_id, r.anomaly, r.kept) for r in out[0]} == {(r.doc_id, r.anomaly, r.kept) for r in out[1]}
    good, bad = ([r for r in out[0] if r.quality == q] for q in (1, 0))
    assert sum(r.kept for r in good) >= 0.95 * len(good) and sum(not r.kept for r in bad) >= 0.7 * len(bad)
    assert len({round(r.anomaly, 4) for r in good}) > 20


def test_verdicts(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, labels = [], []
    for i in range(300):
        words = [word() for _ in range(60)]
        bad = i % 5 == 0
        rows.append((i, " ".join(w + "***" if bad else w for w in words), "n"))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(1000, None, "n"), (1001, "", "n"), (1002, "short text", "n"), (1003, "same words again and again here now so " * 20, "n"), (2, rows[2][1], "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    lab = spark.createDataFrame([*labels, (None, None, None)], "doc_id long, quality int, toxic int")
    out = quality.judge(df, lab).collect()
    assert len(out) == len(rows)
    for r in out:
        want = r.doc_id < 1000 and r.doc_id % 5 != 0
        assert r.kept == want and r.base_failed == (r.doc_id >= 1000)
    free = quality.judge(df, lab.limit(0)).where("not base_failed")
    assert free.where("kept").count() == free.count() == 301
    assert quality.judge(df.limit(0), lab).count() == 0


def test_rare_junk_is_in_the_trees(spark):
    clean, echo = (60, 300, 0, 0, 0, 0, 300, 0, 0, 3), (60, 300, 0, 0, 0, 0, 300, 0, 40, 3)
    rows = [(i, *(echo if i == 17_777 else clean)) for i in range(20_000)]
    stats = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} long" for c in quality.STATS))
    (a, b), (_, why) = quality.fit(stats, trees=10).score(quality.ratios({c: np.array([clean[i], echo[i]]) for i, c in enumerate(quality.STATS)}))
    assert b > a and why.tolist() == [f == "echoes" for f in quality.FEATURES]
    assert quality.fit(stats.limit(0)) is None and quality.fit(stats.limit(1)) is None
