"""Passages in texts against a nested loop, and common words that may not make hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from surety.operators import containment
from surety.operators.containment import containment as contain


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def brute(docs, items):
    return sorted({(d, i) for d, t in docs for i, p in items if t is not None and p is not None and p.lower() in t.lower()})


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_cut_words_at_every_length(spark, seed, limit):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abC") for _ in range(rng.choice((1, 2, 3, 5, 7))))
    docs = [(i, rng.choice([" ", "  ", "\n"]).join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)]
    items = []
    for i in range(150):
        text = rng.choice(docs)[1]
        a = rng.randrange(len(text) + 1)
        items.append((i, text[a : a + rng.choice((0, 2, 6, 12, 25, 60))]))
    items += [(i, " ".join(word() for _ in range(rng.randint(1, 9)))) for i in range(150, 220)] + [(500, None), (501, ""), (502, " \n"), (1, items[1][1])]
    docs += [(900, None), (901, ""), (3, docs[3][1])]
    d, p = frames(spark, docs, items)
    assert pairs(contain(d, p, item="item_id", limit=limit)) == brute(docs, items)


def test_a_passage_is_looked_up_under_its_rarest_run(spark):
    common = "of the and in the end of the day"
    docs = [(i, f"{common} {common} text{i} stop now") for i in range(200)]
    items = [(i, f"day of the and in text{i} the end of the") for i in range(40)] + [(100, "the and in the end of"), (101, f"day {common} text7 stop")]
    d, p = frames(spark, docs, items)
    long_ones = p.withColumn("w", containment.words(F.col("text"))).withColumn("n", F.size("w"))
    own = d.withColumn("own", containment.words(F.col("text")))
    found = containment._by_keys(own, long_ones, 1 << 20)
    # passages with a run that no text has make no candidates, the one with a rare run makes one
    by = {r.item_id: r["count"] for r in found.groupBy("item_id").count().collect()}
    assert by == {100: 200, 101: 1}
    assert pairs(contain(d, p, item="item_id")) == brute(docs, items) == sorted([(i, 100) for i in range(200)] + [(7, 101)])


def test_three_word_passages_with_common_middles_make_no_hot_key(spark):
    """Many passages share their middle word, which every text has; the words around it tell them apart."""
    n = 20_000
    items = spark.range(n).select(F.col("id").alias("item_id"), F.concat(F.lit("lead"), F.col("id") * 7, F.lit(" the tail"), F.col("id") * 11).alias("text"))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some of the words"), F.concat(F.lit("xlead"), F.col("id") * 7, F.lit(" the tail"), F.col("id") * 11, F.lit("y")), F.lit("in the middle of the text")).alias("text"))
    keys = containment.candidate_keys(items.withColumn("w", containment.words(F.col("text"))).withColumn("n", F.size("w")))
    assert keys.groupBy("key").count().agg(F.max("count")).first()[0] < n / 500
    found = contain(docs, items, item="item_id", limit=0)
    # the tail's number may go on: tail11 is the beginning of tail110
    want = docs.alias("d").join(items.alias("i"), F.expr("d.doc_id = i.item_id")).count()
    assert found.where("doc_id = item_id").count() == want and found.join(docs, "doc_id").join(items.withColumnRenamed("text", "p"), "item_id").where("NOT contains(text, p)").count() == 0
    small = items.where("item_id < 400")
    d, p = [tuple(r) for r in docs.collect()], [tuple(r) for r in small.collect()]
    assert pairs(contain(docs, small, item="item_id")) == brute(d, p)


def test_empty_tables(spark):
    d, p = frames(spark, [(1, "a b c d e f")], [(1, "b c d e f"), (2, "c")])
    for a, b in ((d.limit(0), p), (d, p.limit(0)), (d.limit(0), p.limit(0))):
        assert contain(a, b, item="item_id").count() == 0
    assert pairs(contain(d.withColumnRenamed("doc_id", "key"), p, doc="key", item="item_id")) == [(1, 1), (1, 2)]
