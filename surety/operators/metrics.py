"""Grouped metacognition statistics from counts.

Trials are reduced by one partial aggregation to a contingency table (keys, grade, right, wrong), at most a few rows a
group; every statistic follows from it. Pair counts are decimals, so no group size overflows them. Conventions for
degenerate groups: rank correlations and calibration 0, areas 0.5, means and ratios 0, d' NaN.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surety.functions import score
from surety.functions.columns import col, zero
from surety.functions.probit import probit
from surety.sources.shared import once

PAIRS = "decimal(38,0)"
LEAST_RATE = 1e-4


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def d_prime(hits, right, alarms, wrong) -> Column:
    """z(hit rate) - z(false-alarm rate), rates kept off 0 and 1; NaN if either class is empty."""
    rate = lambda n, of: F.least(F.greatest(ratio(col(n), col(of)), F.lit(LEAST_RATE)), F.lit(1 - LEAST_RATE))
    # one quantile expression for both rates: groups are few, and generated code stays small
    z = F.transform(F.array(rate(hits, right), rate(alarms, wrong)), probit)
    return F.when((col(right) == 0) | (col(wrong) == 0), F.lit(float("nan"))).otherwise(F.get(z, F.lit(0)) - F.get(z, F.lit(1)))


def binary_counts(trials: DataFrame, keys: list, correct="correct", yes="yes") -> DataFrame:
    """The 2 by 2 table of each group: n, right, yes, hits (right and yes), alarms (wrong and yes). correct: None if
    trials has been counted to right and wrong already."""
    if correct is None:
        y, right, wrong = col(yes), F.col("right"), F.col("wrong")
        add = lambda x: F.coalesce(F.sum(x), F.lit(0))
        return trials.groupBy(*keys).agg(add(right + wrong).alias("n"), add(right).alias("right"), add(F.when(y == 1, right + wrong)).alias("said_yes"), add(F.when(y == 1, right)).alias("hits"), add(F.when(y == 1, wrong)).alias("alarms"))
    c, y = col(correct), col(yes)
    count = lambda x: F.coalesce(F.sum(x.cast("bigint")), F.lit(0))
    return trials.groupBy(*keys).agg(F.count("*").alias("n"), count(c == 1).alias("right"), count(y == 1).alias("said_yes"), count((c == 1) & (y == 1)).alias("hits"), count((c == 0) & (y == 1)).alias("alarms"))


def binary_metrics(trials: DataFrame, keys: list, correct="correct", yes="yes") -> DataFrame:
    """accuracy, yes_rate, alignment, failure ratios, d' and relative meta-information of each group."""
    n = binary_counts(trials, keys, correct, yes)
    wrong = F.col("n") - F.col("right")
    said_no = F.col("n") - F.col("said_yes")
    misses = F.col("right") - F.col("hits")
    agree = F.col("hits") + wrong - F.col("alarms")
    return n.select(
        *keys,
        "n",
        zero(ratio(F.col("right"), F.col("n"))).alias("accuracy"),
        zero(ratio(F.col("said_yes"), F.col("n"))).alias("yes_rate"),
        zero(ratio(agree, F.col("n"))).alias("meta_alignment"),
        zero(ratio(F.col("alarms"), F.col("said_yes"))).alias("yes_failure_ratio"),
        zero(ratio(misses, said_no)).alias("no_failure_ratio"),
        d_prime(F.col("hits"), F.col("right"), F.col("alarms"), wrong).alias("d_prime_type2"),
        meta_information(F.col("hits"), misses, F.col("alarms"), wrong - F.col("alarms")).alias("relative_meta_information"),
    )


def meta_information(hits: Column, misses: Column, alarms: Column, rejections: Column) -> Column:
    """Mutual information of correctness and yes over the entropy of correctness, in bits; 0 at accuracy 0 or 1."""
    n = hits + misses + alarms + rejections
    share = lambda x: ratio(x, n)
    plog = lambda p: F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    right, yes = share(hits + misses), share(hits + alarms)
    cell = lambda x, a, b: F.when(share(x) > 0, share(x) * F.log2(share(x) / (a * b))).otherwise(0.0)
    mutual = cell(rejections, 1 - right, 1 - yes) + cell(alarms, 1 - right, yes) + cell(misses, right, 1 - yes) + cell(hits, right, yes)
    return F.when((right <= 0) | (right >= 1) | right.isNull(), 0.0).otherwise(mutual / -(plog(right) + plog(1 - right)))


def contingency(trials: DataFrame, keys: list, correct="correct", grade="grade") -> DataFrame:
    """(keys, grade, right, wrong). The only shuffle of the trials, and it carries partial counts. correct: None if
    trials has been counted so already."""
    if correct is None:
        return trials.select(*keys, col(grade).alias("grade"), "right", "wrong")
    c = col(correct)
    return trials.groupBy(*keys, col(grade).alias("grade")).agg(F.sum((c == 1).cast("bigint")).alias("right"), F.sum((c == 0).cast("bigint")).alias("wrong"))


def pair_counts(table: DataFrame, keys: list) -> DataFrame:
    """One row a group with what rank statistics need: concordant, discordant and tied pairs and the margins.

    Few grades a group are assumed here; pair_counts_wide() is for scores.
    """
    before = Window.partitionBy(*keys).orderBy("grade").rowsBetween(Window.unboundedPreceding, -1)
    lower = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0)).cast(PAIRS)
    return _sum_pairs(table.withColumn("lower_right", lower("right")).withColumn("lower_wrong", lower("wrong")), keys)


def _sum_pairs(rows: DataFrame, keys: list) -> DataFrame:
    size = (F.col("right") + F.col("wrong")).cast(PAIRS)
    total = lambda x: F.sum(x).cast(PAIRS)
    return rows.groupBy(*keys).agg(
        total(F.col("right") * F.col("lower_wrong")).alias("concordant"),
        total(F.col("wrong") * F.col("lower_right")).alias("discordant"),
        total(F.col("right").cast(PAIRS) * F.col("wrong")).alias("tied"),
        total(size * (size - 1) / 2).alias("grade_ties"),
        F.sum("right").alias("right"),
        F.sum("wrong").alias("wrong"),
        F.count("*").alias("grades"),
    )


def gamma(c="concordant", d="discordant") -> Column:
    """(C - D) / (C + D), 0 without untied pairs."""
    return zero(ratio(col(c) - col(d), col(c) + col(d)))


def tau_b(row=F.col) -> Column:
    n = (row("right") + row("wrong")).cast("double")
    half = lambda x: x.cast("double") * (x.cast("double") - 1) / 2
    free = (half(n) - row("grade_ties").cast("double")) * (half(n) - half(row("right")) - half(row("wrong")))
    return F.when(free > 0, (row("concordant") - row("discordant")).cast("double") / F.sqrt(free)).otherwise(0.0)


def auroc(row=F.col) -> Column:
    """P(right above wrong) plus half the ties; 0.5 if a class is empty."""
    pairs = row("right").cast("double") * row("wrong").cast("double")
    return F.coalesce(F.try_divide(row("concordant").cast("double") + row("tied").cast("double") / 2, pairs), F.lit(0.5))


def resolution(method: str = "gamma") -> Column:
    """Rank correlation of grade and correctness, over the columns of pair_counts()."""
    if method not in ("gamma", "kendall"):
        raise ValueError(f"unknown method {method!r}: gamma or kendall")
    return gamma() if method == "gamma" else tau_b()


def rank_statistics(trials: DataFrame, keys: list, correct="correct", grade="grade") -> DataFrame:
    pairs = pair_counts(contingency(trials, keys, correct, grade), keys)
    return pairs.select(*keys, (F.col("right") + F.col("wrong")).alias("n"), gamma().alias("gamma"), tau_b().alias("kendall_tau"), auroc().alias("type2_auroc"))


def calibration_error(table: DataFrame, keys: list) -> DataFrame:
    """Mean distance of each grade's accuracy from its place between the group's least and greatest grade."""
    whole = Window.partitionBy(*keys)
    size = F.col("right") + F.col("wrong")
    rows = table.withColumns({"least": F.min("grade").over(whole), "most": F.max("grade").over(whole), "n": F.sum(size).over(whole)})
    off = F.abs(ratio(F.col("right"), size) - ratio(F.col("grade") - F.col("least"), F.col("most") - F.col("least")))
    return rows.groupBy(*keys).agg(zero(F.sum(F.when(F.col("most") > F.col("least"), size / F.col("n") * off))).alias("calibration_error"))


def threshold_counts(t: int) -> list[Column]:
    """Aggregates over a contingency table: hits and alarms at a threshold."""
    high = F.col("grade") >= t
    return [F.coalesce(F.sum(F.when(high, F.col("right"))), F.lit(0)).alias(f"hits_{t}"), F.coalesce(F.sum(F.when(high, F.col("wrong"))), F.lit(0)).alias(f"alarms_{t}")]


def threshold_d_primes(table: DataFrame, keys: list, max_grade: int, thresholds=None) -> DataFrame:
    """d_prime_t<t> for each threshold, by default 1 to max_grade."""
    steps = list(thresholds or range(1, max_grade + 1))
    sums = table.groupBy(*keys).agg(F.sum("right").alias("right"), F.sum("wrong").alias("wrong"), *[x for t in steps for x in threshold_counts(t)])
    return sums.select(*keys, *[d_prime(f"hits_{t}", "right", f"alarms_{t}", "wrong").alias(f"d_prime_t{t}") for t in steps])


def roc_points(table: DataFrame, keys: list) -> DataFrame:
    """(keys, threshold, fpr, tpr) at each observed grade, ordered by fpr, tpr within a group."""
    up = Window.partitionBy(*keys).orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    rate = lambda x: ratio(F.sum(x).over(up), F.sum(x).over(whole))
    return table.select(*keys, F.col("grade").alias("threshold"), rate("wrong").alias("fpr"), rate("right").alias("tpr")).orderBy(*keys, "fpr", "tpr")


def graded_metrics(trials: DataFrame, keys: list, meta_type: str, correct="correct", grade="grade") -> DataFrame:
    """All graded statistics in one wide row a group, from one contingency table."""
    if meta_type not in score.SCALES:
        raise ValueError(f"unknown probe {meta_type!r}; one of {', '.join(score.SCALES)}")
    low, high, threshold = score.SCALES[meta_type]
    before = Window.partitionBy(*keys).orderBy("grade").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    table = contingency(trials, keys, correct, grade)
    lower = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0)).cast(PAIRS)
    size = F.col("right") + F.col("wrong")
    rows = table.withColumns({"lower_right": lower("right"), "lower_wrong": lower("wrong"), "least": F.min("grade").over(whole), "most": F.max("grade").over(whole), "n": F.sum(size).over(whole)})
    big = size.cast(PAIRS)
    total = lambda x: F.sum(x).cast(PAIRS)
    g = F.col("grade")
    off = F.abs(ratio(F.col("right"), size) - ratio(g - F.col("least"), F.col("most") - F.col("least")))
    steps, levels = range(1, high + 1), range(low, high + 1)
    sums = rows.groupBy(*keys).agg(
        F.sum("right").alias("right"),
        F.sum("wrong").alias("wrong"),
        F.sum(g * F.col("right")).alias("grade_right"),
        F.sum(g * F.col("wrong")).alias("grade_wrong"),
        total(F.col("right") * F.col("lower_wrong")).alias("concordant"),
        total(F.col("wrong") * F.col("lower_right")).alias("discordant"),
        total(F.col("right").cast(PAIRS) * F.col("wrong")).alias("tied"),
        total(big * (big - 1) / 2).alias("grade_ties"),
        zero(F.sum(F.when(F.col("most") > F.col("least"), size / F.col("n") * off))).alias("calibration_error"),
        *[x for t in steps for x in threshold_counts(t)],
        *[F.coalesce(F.sum(F.when(g == k, size)), F.lit(0)).alias(f"count_{k}") for k in levels],
    )
    n = F.col("right") + F.col("wrong")
    mean = lambda s, of: zero(ratio(s, of))
    right, wrong = mean(F.col("grade_right"), F.col("right")), mean(F.col("grade_wrong"), F.col("wrong"))
    return sums.select(
        *keys,
        n.alias("n"),
        mean(F.col("right"), n).alias("accuracy"),
        mean(F.col("grade_right") + F.col("grade_wrong"), n).alias("mean_grade"),
        right.alias("mean_grade_correct"),
        wrong.alias("mean_grade_incorrect"),
        (right - wrong).alias("grade_separation"),
        gamma().alias("gamma_correlation"),
        tau_b().alias("kendall_tau"),
        "calibration_error",
        auroc().alias("type2_auroc"),
        d_prime(f"hits_{threshold}", "right", f"alarms_{threshold}", "wrong").alias("d_prime_type2"),
        mean(F.col(f"hits_{threshold}") + F.col("wrong") - F.col(f"alarms_{threshold}"), n).alias("meta_alignment"),
        *[d_prime(f"hits_{t}", "right", f"alarms_{t}", "wrong").alias(f"d_prime_t{t}") for t in steps],
        *[mean(F.col(f"count_{k}"), n).alias(f"grade_{k}_ratio") for k in levels],
    )


def pair_counts_wide(trials: DataFrame, keys: list, correct="correct", score_="score", buckets=256) -> DataFrame:
    """pair_counts() for scores with any number of distinct values.

    Prefix sums have two levels: buckets between approximate quantiles of a group's distinct values, then values inside
    a bucket, so no task orders a whole group, however its values are spread. A row's bucket grows with its score, so
    the result doesn't depend on them; they are found once, so that all readers see the same.
    """
    table = contingency(trials.where(col(score_).isNotNull()), keys, correct, score_)
    buckets = max(buckets, 2)
    cuts = F.percentile_approx("grade", F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(8 * buckets))
    edges = once(table.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.array_distinct(cuts).alias("cuts")))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.lit(True))
    place = F.size(F.filter("cuts", lambda c: c < F.col("grade")))
    rows = table.join(edges, same).select(*keys, "grade", "right", "wrong", place.alias("bucket"))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    level = rows.groupBy(*keys, "bucket").agg(F.sum("right").alias("r"), F.sum("wrong").alias("w"))
    level = level.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("bucket").alias("_bucket"), F.coalesce(F.sum("r").over(earlier), F.lit(0)).alias("r"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w"))
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("bucket") == F.col("_bucket"))
    inside = Window.partitionBy(*keys, "bucket").orderBy("grade").rowsBetween(Window.unboundedPreceding, -1)
    below = lambda x, base: (F.coalesce(F.sum(x).over(inside), F.lit(0)) + F.col(base)).cast(PAIRS)
    return _sum_pairs(rows.join(level, match).withColumn("lower_right", below("right", "r")).withColumn("lower_wrong", below("wrong", "w")), keys)


def auroc_continuous(trials: DataFrame, keys: list, correct="correct", score_="score") -> DataFrame:
    return pair_counts_wide(trials, keys, correct, score_).select(*keys, "right", "wrong", auroc().alias("type2_auroc"))


def pearson(x, y) -> Column:
    """Aggregate: correlation, 0 if either side doesn't vary."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return zero(F.when(spread > 0, F.try_divide(F.covar_pop(x, y), spread)))


def confidence_summary(trials: DataFrame, keys: list, max_grade: int, correct="correct", grade="grade", confidence="confidence") -> DataFrame:
    """Means of the logit confidence, for right and wrong trials, and its correlation with the normalised grade."""
    c, x = col(correct), col(confidence)
    verbal = col(grade) / max_grade
    return trials.groupBy(*keys).agg(
        zero(F.avg(x)).alias("logit_mean_confidence"),
        zero(F.avg(F.when(c == 1, x))).alias("logit_mean_confidence_correct"),
        zero(F.avg(F.when(c == 0, x))).alias("logit_mean_confidence_incorrect"),
        pearson(verbal, x).alias("verbal_logit_pearson"),
    )


def parsed_metrics(trials: DataFrame, keys: list, meta_type: str, correct="correct", value="value") -> DataFrame:
    """d', alignment, gamma and mean grade at the probe's own threshold; binary probes get the binary metrics."""
    if meta_type not in score.SCALES:
        return binary_metrics(trials, keys, correct, value)
    return graded_metrics(trials, keys, meta_type, correct, value).select(*keys, "d_prime_type2", F.col("meta_alignment"), "gamma_correlation", "mean_grade")


def mean_ignoring(x, ignore=-100) -> Column:
    """Aggregate: mean of the values other than the sentinel and null."""
    return F.avg(F.nullif(col(x), F.lit(ignore)))


def mean_of_shards(trials: DataFrame, keys: list, shard, metric) -> DataFrame:
    """The mean over shards of a metric computed in each. metric: (trials, keys) to a frame with one value column."""
    made = metric(trials, [*keys, shard])
    value = [c for c in made.columns if c not in (*keys, shard)][0]
    return made.groupBy(*keys).agg(F.avg(value).alias(value))
