"""The index permutation: a bijection for every size, its inverse, and its evenness."""

import pytest
from pyspark.sql import functions as F

from surety.operators import permute, tensor
from surety.sources.corpora import numbered
from surety.sources.shared import once


def test_every_size_up_to_2000_is_permuted(spark):
    rows = spark.range(1, 2001).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.col("id") - 1)).alias("i"))
    made = once(rows.withColumn("p", permute.place("i", F.col("n"), 9, F.col("n") % 7))).withColumn("back", permute.row_at("p", F.col("n"), 9, F.col("n") % 7))
    by = made.groupBy("n").agg(F.countDistinct("p").alias("d"), F.min("p").alias("low"), F.max("p").alias("high"), F.sum((F.col("back") != F.col("i")).cast("int")).alias("off"))
    assert by.count() == 2000 and by.where("d != n or low != 0 or high != n - 1 or off != 0").count() == 0


@pytest.mark.parametrize("n", [100_003, 10**12 + 39, 2**61])
def test_large_sizes_and_their_inverse(spark, n):
    rows = once(spark.range(0, n, max(1, n // 5000)).withColumn("p", permute.place("id", n, 1, 4)))
    made = once(rows.withColumn("back", permute.row_at("p", n, 1, 4)))
    assert made.where("back != id").count() == 0 and made.where((F.col("p") < 0) | (F.col("p") >= n)).count() == 0
    assert made.select("p").distinct().count() == made.count()


def test_places_are_even_and_epochs_differ(spark):
    n, epochs = 1009, 300
    rows = once(spark.range(n).withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("p", permute.place("id", n, 3, F.col("e"))))
    # each row's places over the epochs: chi-squared over ten equal parts has nine degrees of freedom
    parts = rows.groupBy("id", F.floor(F.col("p") * 10 / n).alias("part")).count()
    chi = parts.groupBy("id").agg((F.sum(F.col("count") * F.col("count")) * 10 / epochs - epochs).alias("x")).agg(F.avg("x"), F.max("x")).first()
    assert 8.3 < chi[0] < 9.7 and chi[1] < 40
    # neighbours are as far apart as chance has it: a third of the rows on average
    near = rows.alias("a").join(rows.alias("b"), F.expr("a.e = b.e and a.id + 1 = b.id")).select(F.avg(F.abs(F.col("a.p") - F.col("b.p"))) / n, F.sum((F.col("b.p") == F.col("a.p") + 1).cast("int"))).first()
    assert abs(near[0] - 1 / 3) < 0.01 and 200 < near[1] < 400
    # places in one epoch say nothing about the next
    same = rows.alias("a").join(rows.alias("b"), F.expr("a.e + 1 = b.e and a.id = b.id")).select(F.corr("a.p", "b.p"), F.sum((F.col("b.p") == F.col("a.p")).cast("int"))).first()
    assert abs(same[0]) < 0.02 and 200 < same[1] < 400


def test_a_loader_goes_through_every_epoch(spark):
    rows = tensor.loader_batches(spark, 103, 10, 7, 0, 32).collect()
    assert len(rows) == 309
    for e in range(3):
        assert sorted(r.idx for r in rows if r.iteration // 11 == e) == list(range(103))
    assert {sum(r.iteration == i for r in rows) for i in (10, 21, 32)} == {3}
    df = spark.range(50, 153).withColumnRenamed("id", "key")
    batches = tensor.epoch_batches(df, "key", 10, 3, 7).collect()
    want = sorted((r.idx + 50, r.iteration // 11, r.iteration % 11) for r in rows)
    assert sorted((r.key, r.epoch, r.batch) for r in batches) == want
    part = tensor.loader_batches(spark, 103, 10, 7, 12, 13).collect()
    assert sorted(map(tuple, part)) == sorted(tuple(r) for r in rows if 12 <= r.iteration <= 13)


def test_an_epoch_costs_no_sort(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    count = lambda df: [plan(df).count(x) for x in ("Exchange", "Sort", "Window", "Union")]
    # what numbers the rows, a row a partition, is all there is
    assert count(tensor.epoch_batches(spark.range(20), "id", 4, 300, 1)) == count(numbered(spark.range(20), "id"))
    assert tensor.epoch_batches(spark.range(0), "id", 4, 3, 1).count() == 0 and tensor.epoch_batches(spark.range(9), "id", 4, 0, 1).count() == 0
