"""The pipeline on a small planted table against a plain version of each stage's decision."""

import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from surety.llm import quality


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(6))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(120):
        words = [word(rng) for _ in range(80)]
        if i % 10 == 3:
            words = [w + "***" for w in words]
        if i % 7 == 0:
            words[5] = f"user{i}@mail.example.com"
        rows.append((i, " ".join(words), "en", f"src{i % 3}"))
        labels.append((i, 0 if i % 10 == 3 else 1, 0))
    rows += [(200 + k, rows[k][1] + " tail", "en", "src0") for k in (1, 2, 4)] + [(300, rows[5][1], "en", "src1"), (300, rows[5][1], "en", "src1"), (301, "too short", "en", "src0"), (302, None, "en", None)]
    root = tmp_path_factory.mktemp("sf")
    rows = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), rows


def test_stages_decide_as_planted(spark, planted):
    root, rows = planted
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, root)
    want = sorted(r[0] for r in rows if r[1] and len(r[1].split()) >= 20 and "***" not in r[1])
    assert sorted(r.doc_id for r in kept.collect()) == want
    single = corpus_pipeline.near_duplicates(spark, kept, root)
    want = sorted(set(want) - {201, 202, 204, 200 + 1, 300})
    assert sorted(r.doc_id for r in single.collect()) == want
    private = corpus_pipeline.personal_data(spark, single, root).collect()
    assert all("@mail.example.com" not in r.text and r.n_chars == len(r.text) for r in private)
    assert sum(len(re.findall(r"u[0-9a-f]{16}@m[0-9a-f]{8}\.invalid", r.text)) for r in private) == sum(i % 7 == 0 for i in want)
    assert all(d.columns == corpus_pipeline.COLUMNS for d in (kept, single, corpus_pipeline.source_mix(spark, single, root)))


def test_whole_run_packs_every_token(spark, planted):
    root, _ = planted
    rows = corpus_pipeline.run(spark, root).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 2048
    assert rows and {n for n, _ in corpus_pipeline.STAGES} == {"quality", "near_duplicates", "pii", "mix", "packing"}


def test_keep_clean_agrees_with_judge(spark, planted):
    root, _ = planted
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    a = sorted(r.doc_id for r in quality.judge(docs, labels).where("kept").collect())
    assert a == sorted(r.doc_id for r in quality.keep_clean(docs, labels).collect())
