"""Token batches, weights, populations, comparisons, costs and the model boundary."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from surety.operators import compare, cost, evolve, generate, tensor
from surety.plans import schema


def test_batches(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], [5], [6, 7]), (1, [4], [5, 5, 5], [8]), (2, [9, 9], [], [1])], "idx int, ids array<int>, no_ids array<int>, yes_ids array<int>")
    df = df.withColumn("batch", tensor.mini_batch("idx", 2))
    left = {r.idx: r for r in tensor.left_pad(df, "batch").collect()}
    assert (left[0].ids, left[0].mask, left[1].ids, left[1].mask, left[2].ids) == ([1, 2, 3], [1, 1, 1], [0, 0, 4], [0, 0, 1], [9, 9])
    tuned = {r.idx: r for r in tensor.tuning_batch(df, "batch", pad=9).collect()}
    assert tuned[1].labels == [-100, -100, 4] and tuned[2].labels == [9, 9]
    paired = tensor.paired_batch(df, "batch", pad=0)
    ids, labels = tensor.select_meta("meta", F.lit(1), 0)
    got = {r[0]: (r[1], r[2]) for r in paired.select("idx", ids, labels).collect()}
    assert got[0] == ([0, 6, 7], [-100, 6, 7]) and got[2] == ([1], [1])
    assert tensor.batch_rows(df, "batch").orderBy("batch").first().ids == [[1, 2, 3], [4]]
    assert df.orderBy("idx").select(tensor.truncate("ids", 2)).first()[0] == [1, 2]


def test_shifted_matches_and_losses(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [-100, 1, 9, 3], 0.5, 3)], "p array<int>, t array<int>, loss double, tokens int")
    m, n = tensor.shifted_matches("p", "t")
    assert tuple(df.select(m, n, tensor.valid_labels("t")).first()) == (2, 3, 3)
    out = tensor.weighted_loss(df.withColumn("matches", m), []).first()
    assert (out.loss, out.accuracy) == (0.5, 2 / 3) and abs(out.perplexity - math.exp(0.5)) < 1e-12
    none = tensor.weighted_loss(df.withColumns({"matches": F.lit(0), "tokens": F.lit(0)}), []).first()
    assert (none.loss, none.perplexity, none.accuracy) == (0, 1, 0)


def table(spark, rows):
    return spark.createDataFrame(rows, schema.WEIGHTS)


def test_weights(spark):
    rng = random.Random(1)
    base = [(f"p{i % 3}", i, rng.random()) for i in range(60)]
    tuned = [(n, i, v + rng.choice((-1, 1)) * rng.choice((0.1, 0.2, rng.random()))) for n, i, v in base]
    delta = tensor.weight_delta(table(spark, tuned), table(spark, base))
    want = {(n, i): b - a for (n, i, a), (_, _, b) in zip(base, tuned, strict=True)}
    assert {(r.name, r.pos): r.value for r in delta.collect()} == want
    for ratio in (0.0, 0.3, 0.77, 0.999):
        k = max(1, int(60 * (1 - ratio)))
        cut = sorted(map(abs, want.values()))[k - 1]
        for buckets, small in ((2, 1), (5, 8), (4096, 100)):
            assert tensor.kth_magnitude(delta, ratio, buckets, small).first()[0] == cut
        for bottom in (False, True):
            got = {(r.name, r.pos): r.value for r in tensor.magnitude_filter(delta, ratio, bottom, "p1").collect()}
            assert got == {key: 0.0 if (abs(v) < cut) != bottom else v for key, v in want.items() if key[0] != "p1"}
    assert tensor.magnitude_filter(delta).count() == 60
    applied = {(r.name, r.pos): r.value for r in tensor.apply_delta(table(spark, base), tensor.magnitude_filter(delta, exclude_prefix="p1")).collect()}
    assert all(abs(applied[n, i] - (v if n == "p1" else v + want[n, i])) < 1e-15 for n, i, v in base)
    assert spark.createDataFrame([([1.0, 2.0], [0.5, 1.0])], "a array<double>, b array<double>").select(tensor.array_delta("a", "b")).first()[0] == [0.5, 1.0]
    zeros = table(spark, [("a", 0, 0.0), ("a", 1, 0.0)])
    assert tensor.kth_magnitude(zeros, 0.5).first()[0] == 0


def test_orders_and_schedules(spark):
    df = spark.range(12).select(F.col("id").alias("step"))
    rate = [r[0] for r in df.orderBy("step").select(tensor.warmup_schedule("step", 10, 2, 2, 0.4)).collect()]
    assert rate[:5] == [0, 0.25, 0.5, 0.75, 1.0] and rate[9] == pytest.approx(1 / 6) and rate[10] == rate[11] == 0
    assert [r[0] for r in df.orderBy("step").select(tensor.cyclic("step", 5)).collect()][4:7] == [4, 0, 1]
    losses = spark.createDataFrame(list(enumerate([3.0, 3.0, 2.0, 4.0, 1.0])), "step int, loss double")
    assert [r[0] for r in losses.select("*", tensor.running_best("step", "loss").alias("b")).orderBy("step").select("b").collect()] == [True, False, True, False, True]
    a, b = ([r.step for r in tensor.shuffled(df, "step", s).collect()] for s in (1, 2))
    assert a != b and sorted(a) == sorted(b) == list(range(12))


def test_population(spark):
    trials = spark.createDataFrame([(1, s, c, y) for s, c, y in ((7, 1, 1), (7, 1, 0), (8, 0, 1), (9, 0, 0))] + [(2, 7, 1, 1)], "iteration int, seed long, correct int, yes int")
    rows = {(r.iteration, r.seed): r for r in evolve.standard_scores(evolve.seed_rewards(trials, "combined")).collect()}
    rewards = [1.5, 0.0, 1.0]
    assert [rows[1, s].reward for s in (7, 8, 9)] == rewards
    assert abs(rows[1, 7].z - (1.5 - statistics.mean(rewards)) / (statistics.stdev(rewards) + 1e-8)) < 1e-9 and rows[2, 7].z is None
    w = table(spark, [("p", i, 1.0) for i in range(4000)])
    pop = spark.createDataFrame([(1, 0.5), (2, -1.0)], "seed long, z double")
    moved = evolve.apply_evolution(w, pop, 0.1)
    steps = [r.value - 1 for r in moved.collect()]
    want = 0.1 / 2 * math.sqrt(0.5**2 + 1)
    assert abs(statistics.stdev(steps) / want - 1) < 0.1 and abs(statistics.mean(steps)) < 4 * want / math.sqrt(4000)
    back = evolve.apply_evolution(moved, pop, 0.1, reverse=True)
    assert max(abs(r.value - 1) for r in back.collect()) < 1e-12


def test_comparison_and_cost(spark):
    wide = spark.createDataFrame([("a", "d", "fok", 0.5, 2), ("b", "d", "fok", 0.75, 1)], "model string, dataset string, meta_type string, accuracy double, n int")
    long = compare.to_long(wide)
    assert long.columns == [*compare.DIMENSIONS, "metric", "value"] and long.count() == 4
    got = {r.metric: (r.delta, r.arrow) for r in compare.baseline_delta(long, "a", "b").collect()}
    assert got == {"accuracy": (0.25, "↑"), "n": (-1.0, "↓")}
    use = spark.createDataFrame([("gpt-5.2-2025-12-11", 1_000_000, 2, 3), ("gemini-3-flash-preview-x", 2_000_000, 0, 0), ("other", 1, 1, 2)], "model string, prompt_tokens long, completion_tokens long, total_tokens long")
    rows = {r.model: r for r in cost.with_cost(cost.usage_totals(use, ["model"]), cost.price_table(spark)).collect()}
    assert rows["gpt-5.2-2025-12-11"].input_cost == 1.75 and rows["gemini-3-flash-preview-x"].total_cost == 1.0 and rows["other"].total_cost is None


def test_model_boundary(spark):
    df = spark.createDataFrame([("1", "ask", "sure?"), ("2", "boom", "sure?")], "question_id string, direct_prompt string, meta_prompt string")
    assert [r.prediction for r in generate.generate(df, lambda: lambda ps: [p.upper() for p in ps]).orderBy("question_id").collect()] == ["ASK", "BOOM"]
    assert generate.first_token_logits(df, lambda: lambda ps: [[1, 2]] * len(ps)).first().logits == [1.0, 2.0]
    assert generate.tokenise(df, lambda: lambda ps: [[len(p)] * 5 for p in ps], "direct_prompt", max_length=2).orderBy("question_id").first().ids == [3, 3]

    def make():
        def call(prompt):
            if prompt == "boom":
                raise RuntimeError("down")
            return {"text": prompt + "!", "prompt_tokens": 2, "completion_tokens": None}

        return call

    rows = generate.remote_chat(df, make).orderBy("question_id").collect()
    assert [(r.prediction, r.meta_answer, r.prompt_tokens, r.total_tokens) for r in rows] == [("ask!", "sure?!", 4, 4), ("", "sure?!", 2, 2)]


def test_thresholds_of_odd_magnitudes(spark):
    inf, nan = float("inf"), float("nan")

    def found(values, ratio, small=2):
        df = spark.createDataFrame([("w", i, v) for i, v in enumerate(values)], "name string, pos long, value double")
        return tensor.kth_magnitude(df, ratio, buckets=4, small=small).first().threshold

    values = [0.5, -1.0, 2.0, -3.0, 1e308, -1e308, 5e-324, inf, -inf, nan, None]
    order = sorted((abs(v) for v in values if v is not None and v == v)) + [nan]
    for ratio in (0.0, 0.1, 0.25, 0.5, 0.77, 0.95):
        for small in (2, 100):
            want = order[max(1, int(10 * (1 - ratio))) - 1]
            got = found(values, ratio, small)
            assert got == want or got != got and want != want
    assert found([3.0] * 50, 0.5) == 3.0 and found([None], 0.5) is None and found([inf] * 9, 0.5) == inf
    # one outlier beside many values: the histograms still end
    assert found([*map(float, range(200)), 1e300], 0.5) == 99.0


def test_shuffles_differ_by_turn(spark):
    df = spark.range(64).withColumnRenamed("id", "k")
    rows = tensor.epoch_batches(df, "k", 10, 3, 5).collect()
    by = [[{r.k for r in rows if (r.epoch, r.batch) == (e, b)} for b in range(7)] for e in range(3)]
    assert all(sorted(map(len, e)) == [4, 10, 10, 10, 10, 10, 10] and set().union(*e) == set(range(64)) for e in by)
    assert by[0] != by[1] != by[2]
    assert [r[0] for r in spark.range(8).select(tensor.epoch("id", 3)).collect()] == [0, 0, 0, 1, 1, 1, 2, 2]
