"""Contingency counts over a stream. The metrics are functions of additive counts, so a stream needs only these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.operators import metrics


def streaming_contingency(trials: DataFrame, keys: list, correct="correct", grade="grade", time: str | None = None, window="5 minutes", late="10 minutes") -> DataFrame:
    """Counts by keys and grade; with a time column, by event-time windows that close when the watermark passes."""
    c = F.col(correct)
    if time is None:
        by = [*keys, F.col(grade).alias("grade")]
    else:
        trials = trials.withWatermark(time, late)
        by = [F.window(time, window).alias("window"), *keys, F.col(grade).alias("grade")]
    return trials.groupBy(*by).agg(F.sum((c == 1).cast("bigint")).alias("right"), F.sum((c == 0).cast("bigint")).alias("wrong"))


def rank_from_counts(table: DataFrame, keys: list) -> DataFrame:
    """Rank statistics of counts that a stream has written."""
    pairs = metrics.pair_counts(table.groupBy(*keys, "grade").agg(F.sum("right").alias("right"), F.sum("wrong").alias("wrong")), keys)
    return pairs.select(*keys, metrics.gamma().alias("gamma"), metrics.tau_b().alias("kendall_tau"), metrics.auroc().alias("type2_auroc"))
