"""Grouped statistics against pairwise and textbook versions."""

import math
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from surety.functions import score
from surety.operators import evaluate, metrics
from surety.streaming import counts


def frame(spark, groups):
    rows = [(k, c, g, float(g)) for k, pairs in groups.items() for c, g in pairs]
    return spark.createDataFrame(rows, "k string, correct int, grade int, score double")


def brute(pairs):
    n, conc, disc = len(pairs), 0, 0
    for i in range(n):
        for j in range(i):
            s = (pairs[i][0] - pairs[j][0]) * (pairs[i][1] - pairs[j][1])
            conc, disc = conc + (s > 0), disc + (s < 0)
    right, wrong = [g for c, g in pairs if c], [g for c, g in pairs if not c]
    gamma = (conc - disc) / (conc + disc) if conc + disc else 0.0
    half = lambda m: m * (m - 1) / 2
    ties = lambda xs: sum(half(xs.count(x)) for x in set(xs))
    free = (half(n) - ties([g for _, g in pairs])) * (half(n) - ties([c for c, _ in pairs]))
    tau = (conc - disc) / math.sqrt(free) if free > 0 else 0.0
    area = sum((a > b) + (a == b) / 2 for a in right for b in wrong) / (len(right) * len(wrong)) if right and wrong else 0.5
    lo, hi = min(g for _, g in pairs), max(g for _, g in pairs)
    ece = 0.0
    if hi > lo:
        for g in {g for _, g in pairs}:
            own = [c for c, x in pairs if x == g]
            ece += len(own) / n * abs(sum(own) / len(own) - (g - lo) / (hi - lo))

    def d(t):
        if not right or not wrong:
            return math.nan
        clip = lambda p: min(max(p, 1e-4), 1 - 1e-4)
        z = statistics.NormalDist().inv_cdf
        return z(clip(sum(g >= t for g in right) / len(right))) - z(clip(sum(g >= t for g in wrong) / len(wrong)))

    return gamma, tau, area, ece, d(2), d(3)


def same(a, b):
    return all((math.isnan(x) and math.isnan(y)) or abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True))


FIXED = {
    "perfect": [(0, 0)] * 5 + [(1, 3)] * 5,
    "reversed": [(1, 0)] * 5 + [(0, 3)] * 5,
    "tied": [(0, 1), (1, 1), (1, 1)],
    "all right": [(1, 0), (1, 3)],
    "all wrong": [(0, 0), (0, 3)],
    "one row": [(1, 2)],
}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 3)), min_size=1, max_size=40), min_size=1, max_size=6))
def test_graded_metrics_match_brute_force(spark, lists):
    groups = FIXED | {str(i): x for i, x in enumerate(lists)}
    out = {r.k: r for r in metrics.graded_metrics(frame(spark, groups), ["k"], "graded").collect()}
    for k, pairs in groups.items():
        r = out[k]
        assert same((r.gamma_correlation, r.kendall_tau, r.type2_auroc, r.calibration_error, r.d_prime_t2, r.d_prime_t3), brute(pairs)), (k, pairs)
        assert -1 <= r.gamma_correlation <= 1 and 0 <= r.calibration_error <= 1
        assert abs(sum(r[f"grade_{g}_ratio"] for g in range(4)) - 1) < 1e-12


def test_values_of_ordered_data(spark):
    out = {r.k: r for r in metrics.rank_statistics(frame(spark, FIXED), ["k"]).collect()}
    assert [(out[k].gamma, out[k].type2_auroc) for k in ("perfect", "reversed", "tied")] == [(1, 1), (-1, 0), (0, 0.5)]


def test_continuous_area_matches_pairs(spark):
    rng = random.Random(1)
    groups = {k: [(rng.randint(0, 1), rng.choice((rng.randint(0, 5), rng.randint(0, 10**6)))) for _ in range(120)] for k in "abc"} | FIXED
    for buckets in (1, 7, 512):
        made = metrics.pair_counts_wide(frame(spark, groups), ["k"], buckets=buckets)
        got = {r[0]: r[1] for r in made.select("k", metrics.auroc()).collect()}
        assert all(abs(got[k] - brute(p)[2]) < 1e-12 for k, p in groups.items())


def test_area_is_unchanged_by_monotone_maps(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 1), rng.randint(0, 3)) for _ in range(60)]
    out = {r.k: r for r in metrics.rank_statistics(frame(spark, {"a": pairs, "b": [(c, g * g + 1) for c, g in pairs], "r": [(c, -g) for c, g in pairs]}), ["k"]).collect()}
    assert out["a"].type2_auroc == out["b"].type2_auroc and out["a"].gamma == -out["r"].gamma


def test_binary_metrics(spark):
    rows = [("x", 1, 1)] * 3 + [("x", 1, 0)] + [("x", 0, 1)] + [("x", 0, 0)] * 2 + [("one", 1, 1)]
    out = {r.k: r for r in metrics.binary_metrics(spark.createDataFrame(rows, "k string, correct int, yes int"), ["k"]).collect()}
    x = out["x"]
    assert (x.accuracy, x.yes_rate, x.meta_alignment, x.yes_failure_ratio, x.no_failure_ratio) == (4 / 7, 4 / 7, 5 / 7, 1 / 4, 1 / 3)
    z = statistics.NormalDist().inv_cdf
    assert abs(x.d_prime_type2 - (z(3 / 4) - z(1 / 3))) < 1e-12
    h = -(4 / 7 * math.log2(4 / 7) + 3 / 7 * math.log2(3 / 7))
    mi = sum(n / 7 * math.log2(n / 7 / (a / 7 * b / 7)) for n, a, b in ((3, 4, 4), (1, 4, 3), (1, 3, 4), (2, 3, 3)))
    assert abs(x.relative_meta_information - mi / h) < 1e-12
    assert math.isnan(out["one"].d_prime_type2) and out["one"].relative_meta_information == 0 and out["one"].no_failure_ratio == 0


def test_pearson_guards_and_summaries(spark):
    rows = [("v", 1, 1, 0.2), ("v", 0, 2, 0.4), ("v", 1, 3, 0.9), ("flat", 1, 2, 0.5), ("flat", 1, 3, 0.5)]
    df = spark.createDataFrame(rows, "k string, correct int, grade int, confidence double")
    out = {r.k: r for r in metrics.confidence_summary(df, ["k"], 3).collect()}
    assert abs(out["v"].verbal_logit_pearson - statistics.correlation([1, 2, 3], [0.2, 0.4, 0.9])) < 1e-12
    assert out["flat"].verbal_logit_pearson == 0 and out["flat"].logit_mean_confidence_incorrect == 0


def test_errors():
    with pytest.raises(ValueError):
        metrics.resolution("spearman")
    with pytest.raises(ValueError):
        metrics.graded_metrics(None, ["k"], "binary")


def test_whole_evaluations(spark):
    df = spark.createDataFrame([("1", "Paris it is", ["paris"], "yes", 2.0, 1.0), ("2", "I don't know", ["rome"], "no, 4", 0.0, 1.0)], "question_id string, prediction string, answers array<string>, meta_answer string, yes_logit double, no_logit double")
    rows = evaluate.score_binary(df, keep_length=True).orderBy("question_id").collect()
    assert [(r.direct_correctness, r.yes, r.yes_failures, r.no_failures, r.meta_alignments) for r in rows] == [(1, 1, 0, -100, 1), (0, 0, -100, 0, 1)]
    assert [r.meta_grade for r in evaluate.score_graded(df, "fok").orderBy("question_id").collect()] == [3, 4]
    rows = evaluate.score_threshold(df).orderBy("question_id").collect()
    assert [r.meta_answer for r in rows] == ["Yes", "No"] and rows[0].confidence > 0.7
    assert [r.yes for r in evaluate.score_abstention(df).orderBy("question_id").collect()] == [1, 0]
    assert evaluate.evaluate(evaluate.score_binary(df), []).first().accuracy == 0.5
    assert evaluate.evaluate(evaluate.score_graded(df, "fok"), [], "fok").first().mean_grade == 3.5


def test_streamed_counts_equal_batch(spark, tmp_path):
    trials = frame(spark, FIXED)
    trials.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(trials.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = counts.streaming_contingency(stream, ["k"]).writeStream.outputMode("complete").format("memory").queryName("stream_counts").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {r.k: r.gamma for r in counts.rank_from_counts(spark.table("stream_counts"), ["k"]).collect()}
    assert got == {r.k: r.gamma for r in metrics.rank_statistics(trials, ["k"]).collect()}


def test_scoring_plans_have_no_cartesian_product(spark):
    plan = metrics.graded_metrics(frame(spark, FIXED).withColumn("grade", score.parse_number_grade("k", 5)), ["k"], "fok")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "Python" not in plan


def test_areas_of_scores_with_outliers(spark):
    rng = random.Random(4)
    rows = [(k, rng.randint(0, 1), rng.gauss(0, 1)) for k in "ab" for _ in range(300)] + [("a", 1, 1e200), ("a", 0, -1e200), ("b", 0, None), ("c", 1, 2.0)]
    df = spark.createDataFrame(rows, "k string, correct int, score double")
    for buckets in (2, 7, 256):
        pairs = {r.k: r for r in metrics.pair_counts_wide(df, ["k"], buckets=buckets).collect()}
        for k in "abc":
            right, wrong = ([s for g, c, s in rows if g == k and c == x and s is not None] for x in (1, 0))
            assert pairs[k].concordant == sum(a > b for a in right for b in wrong) and pairs[k].discordant == sum(a < b for a in right for b in wrong)
