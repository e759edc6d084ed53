"""Model by dataset by probe matrices and their differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.sources.shared import beside

DIMENSIONS = ("model", "dataset", "meta_type")


def to_long(wide: DataFrame, keys=DIMENSIONS) -> DataFrame:
    """(keys, metric, value) from one wide row a group."""
    values = [c for c in wide.columns if c not in keys]
    doubles = wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in values])
    return doubles.unpivot(list(keys), values, "metric", "value")


def baseline_delta(long: DataFrame, baseline: str, primary: str | None = None) -> DataFrame:
    """For each dataset, probe and metric: primary (or every other model) minus baseline, and the sign's arrow."""
    on = ["dataset", "meta_type", "metric"]
    base = long.where(F.col("model") == baseline).select(*on, F.col("value").alias("baseline"))
    other = long.where(F.col("model") == primary if primary else F.col("model") != baseline)
    delta = F.col("value") - F.col("baseline")
    arrow = F.when(delta > 0, "↑").when(delta < 0, "↓").otherwise("=")
    return other.join(base, on).select("model", *on, "baseline", "value", delta.alias("delta"), arrow.alias("arrow"))


def product(*frames: DataFrame) -> DataFrame:
    """All combinations of small dimension tables, such as models, datasets and probes to run."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(beside(f)[0])
    return out
