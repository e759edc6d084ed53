"""Area under the ROC curve of scores with any number of values, from sketches of fixed size.

Exact counts by score grow with the number of values, which a stream's state must not. A KLL sketch of the scores of each
class has a size that the accuracy sets, merges with others, and gives quantiles whose ranks are within a stated error.
The area is that of evenly spaced quantiles of both classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.functions.columns import col
from surety.operators import metrics

#: Accuracy of a sketch (8 to 65535), and number of quantiles that stand for a class.
ACCURACY, POINTS = 2048, 512


def rank_error(accuracy: int = ACCURACY) -> float:
    """The error of a sketch's normalised ranks that is kept with 99 % confidence (the sketch library's figure)."""
    return 2.296 / accuracy**0.9021


def error_bound(accuracy: int = ACCURACY, points: int = POINTS) -> float:
    """How far the area may be off. A class's quantiles stand for it within the rank error and half their distance, and
    the area moves by no more than the distributions of both classes do."""
    return 2 * (rank_error(accuracy) + 0.5 / points)


def score_sketches(trials: DataFrame, keys: list, correct="correct", score="score", accuracy: int = ACCURACY, time: str | None = None, window="5 minutes", late="10 minutes") -> DataFrame:
    """(keys, right_scores, wrong_scores, right, wrong): sketches and counts of the scores by class; of a stream too.

    time: event-time windows that close when the watermark passes. Trials without a score or class are left out.
    """
    c, x = col(correct), col(score).cast("double")
    trials = trials.where(x.isNotNull() & ~F.isnan(x) & c.isin(0, 1))
    by = list(keys)
    if time is not None:
        trials = trials.withWatermark(time, late)
        by = [F.window(time, window).alias("window"), *keys]
    part = lambda value: F.kll_sketch_agg_double(F.when(c == value, x), F.lit(accuracy))
    return trials.groupBy(*by).agg(part(1).alias("right_scores"), part(0).alias("wrong_scores"), F.count(F.when(c == 1, 1)).alias("right"), F.count(F.when(c == 0, 1)).alias("wrong"))


def merged(sketches: DataFrame, keys: list) -> DataFrame:
    """Sketches of coarser groups, or of several streams, from those of finer ones."""
    whole = lambda c: F.kll_merge_agg_double(c).alias(c)
    return sketches.groupBy(*keys).agg(whole("right_scores"), whole("wrong_scores"), F.sum("right").alias("right"), F.sum("wrong").alias("wrong"))


def areas(sketches: DataFrame, keys: list, points: int = POINTS) -> DataFrame:
    """(keys, area) of the rows of score_sketches(), one for each keys: P(right above wrong) plus half the ties, 0.5 if
    a class is empty. The quantiles of either class are counted like trials, a fixed number a group."""
    steps = F.array(*[F.lit((i + 0.5) / points) for i in range(points)])

    def counted(scores, n, right, wrong):
        # a class without scores has no quantiles
        found = F.kll_sketch_get_quantile_double(F.when(F.col(n) > 0, F.col(scores)), steps)
        rows = F.transform(found, lambda q: F.struct(q.alias("grade"), F.lit(right).alias("right"), F.lit(wrong).alias("wrong")))
        return F.coalesce(rows, F.array().cast("array<struct<grade:double,right:int,wrong:int>>"))

    rows = sketches.select(*keys, F.inline(F.concat(counted("right_scores", "right", 1, 0), counted("wrong_scores", "wrong", 0, 1))))
    table = rows.groupBy(*keys, "grade").agg(F.sum("right").alias("right"), F.sum("wrong").alias("wrong"))
    return metrics.pair_counts(table, keys).select(*keys, metrics.auroc().alias("area"))
