"""Sketches, named state and the metric log of streams, against batches."""

import random

import pytest
from pyspark.sql import functions as F

from surety.operators import metrics, tensor
from surety.sources import sinks
from surety.sources.shared import once
from surety.streaming import runs, sketches


def trials(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k, c = rng.choice("abc"), rng.randint(0, 1)
        score = {"a": rng.gauss(c, 1), "b": float(rng.randint(0, 5) + c), "c": 3.0}[k]
        rows.append((k, c, score))
    rows += [("none", 1, 0.5), ("none", 1, 0.7), ("a", None, 1.0), ("a", 1, None), ("a", 0, float("nan")), ("b", 7, 1.0)]
    return spark.createDataFrame(rows, "k string, correct int, score double")


@pytest.mark.parametrize("accuracy, points", [(64, 100), (sketches.ACCURACY, sketches.POINTS)])
def test_the_area_is_within_its_bound(spark, accuracy, points):
    rows = trials(spark, 40_000, accuracy)
    usable = rows.where("correct in (0, 1) and score is not null and not isnan(score)")
    exact = {r.k: r.type2_auroc for r in metrics.auroc_continuous(usable, ["k"]).collect()}
    halves = [sketches.score_sketches(rows.where(F.pmod(F.xxhash64("score", "k"), F.lit(2)) == h), ["k", F.lit(h).alias("h")], accuracy=accuracy) for h in (0, 1)]
    both = sketches.merged(halves[0].unionByName(halves[1]), ["k"])
    for made in (sketches.score_sketches(rows, ["k"], accuracy=accuracy), both):
        made = once(made)
        got = made.join(sketches.areas(made, ["k"], points), "k").select("k", "area", F.length("right_scores").alias("size")).collect()
        assert {r.k for r in got} == set(exact)
        for r in got:
            assert abs(r.area - exact[r.k]) <= sketches.error_bound(accuracy, points)
            assert r.size < 40 * accuracy
        assert {r.k: r.area for r in got}["none"] == 0.5 and abs({r.k: r.area for r in got}["c"] - 0.5) < 1e-9


def test_sketches_stay_small_as_a_stream_grows(spark):
    size = lambda n: spark.range(n).select(F.lit("x").alias("k"), (F.col("id") % 2).cast("int").alias("correct"), F.rand(1).alias("score"))
    a, b = (sketches.score_sketches(size(n), ["k"], accuracy=200).select(F.length("right_scores")).first()[0] for n in (20_000, 2_000_000))
    assert b < 1.5 * a


def drained(query):
    query.awaitTermination()


@pytest.mark.parametrize("files", [1, 2, 5])
def test_best_so_far_in_any_number_of_batches_and_after_restarts(spark, tmp_path, files):
    rng = random.Random(files)
    rows = [(rng.choice(["p", "q", None]), i, float(rng.choice([1, 2, 3, rng.random() * 9]))) for i in range(1, 120)]
    df = spark.createDataFrame(rows, "run string, iteration long, loss double")
    out = f"{tmp_path}/out"
    with runs.named_state(spark):
        for f in range(files):
            part = [r for r in rows if r[1] % 120 * files // 120 == f]
            # rows of earlier files come again, and rows that lack something
            part += rows[: 10 * f] + [("p", None, 1.0), ("q", 500, None)]
            spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            if f % 2 == 0 or f == files - 1:
                stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
                drained(runs.running_best(stream, 7).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start())
    want = df.select("run", "iteration", "loss", tensor.running_best("iteration", "loss", ["run"]).alias("best"), (F.col("iteration") % 7 == 0).alias("due"))
    key = lambda r: (r.iteration, str(r.run))
    assert sorted(spark.read.parquet(out).select(want.columns).collect(), key=key) == sorted(want.collect(), key=key)


def test_many_short_runs_with_state_in_few_parts(spark, tmp_path):
    rng = random.Random(8)
    rows = [(run, i, float(rng.randint(1, 9))) for i in range(1, 13) for run in range(600)]
    # a long run, and iterations that come twice in a trigger: the lesser loss counts
    rows += [(-1, i, 1e9 / i if i % 3 else float("inf")) for i in range(1, 4000)] + [(None, i, 5.0 - i % 2) for i in range(1, 13)]
    df = spark.createDataFrame(rows, "run long, iteration long, loss double")
    for part in (df.where("iteration < 5"), df.where("iteration >= 5")):
        part.unionByName(part.where("run % 7 = 0").withColumn("loss", F.col("loss") + 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    was = spark.conf.get(runs.PARTS)
    spark.conf.set(runs.PARTS, "50")
    try:
        with runs.named_state(spark, len(rows)):
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            query = runs.running_best(stream, 7).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
            drained(query)
        assert spark.conf.get(runs.PARTS) == "50"
    finally:
        spark.conf.set(runs.PARTS, was)
    assert {p["stateOperators"][0]["numShufflePartitions"] for p in query.recentProgress} == {spark.sparkContext.defaultParallelism}
    want = df.select("run", "iteration", "loss", tensor.running_best("iteration", "loss", ["run"]).alias("best"), (F.col("iteration") % 7 == 0).alias("due"))
    key = lambda r: (str(r.run), r.iteration)
    assert sorted(spark.read.parquet(f"{tmp_path}/out").select(want.columns).collect(), key=key) == sorted(want.collect(), key=key)
    with runs.named_state(spark, 10 * runs.PART_ROWS + 1):
        assert spark.conf.get(runs.PARTS) == "11"


def test_a_replayed_batch_is_logged_once(spark, tmp_path):
    log = f"{tmp_path}/log"
    df = spark.range(3).withColumn("iteration", F.lit(1))
    for _ in range(3):
        sinks.append_metrics(df, log, "a-1")
    sinks.append_metrics(df.withColumn("loss", F.lit(0.5)), log, "007")
    for _ in range(2):
        sinks.append_metrics(df, log)
    rows = sinks.read_metrics(spark, log).collect()
    assert len(rows) == 12 and {r.commit for r in rows} >= {"a-1", "007"} and sum(r.loss is not None for r in rows) == 3
    for bad in ("a/b", "x=1", " "):
        with pytest.raises(ValueError):
            sinks.append_metrics(df, log, bad)


def test_a_stream_that_fails_after_its_sink_repeats_nothing(spark, tmp_path):
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    failing = {"left": 1}

    def once_bad(batch):
        return batch.withColumn("twice", F.col("id") * 2)

    def start(make):
        return runs.log_metrics(stream, f"{tmp_path}/log", f"{tmp_path}/c", "run", make)

    real = sinks.append_metrics

    def broken(df, path, commit):
        real(df, path, commit)
        if commit == "run-1" and failing["left"]:
            failing["left"] -= 1
            raise RuntimeError("lost after the write")

    sinks.append_metrics = broken
    try:
        with pytest.raises(Exception, match="lost after the write"):
            start(once_bad).awaitTermination()
        start(once_bad).awaitTermination()
    finally:
        sinks.append_metrics = real
    rows = sinks.read_metrics(spark, f"{tmp_path}/log").collect()
    assert sorted((r.id, r.twice) for r in rows) == [(i, 2 * i) for i in range(30)]
