"""The transfer matrix: every metric of every model, dataset and probe from one long table of trials."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.functions import score
from surety.operators import compare, metrics
from surety.sources.shared import once

BINARY_METRICS = ("accuracy", "yes_rate", "meta_alignment", "yes_failure_ratio", "no_failure_ratio", "d_prime_type2")


def transfer_results(details: DataFrame, probes=("binary", *score.SCALES), logits: bool = False) -> DataFrame:
    """(model, dataset, meta_type, metric, value).

    details: model, dataset, meta_type, correct, meta_value (yes or grade) and, with logits, logit_confidence. The
    trials are read once for all probes: their counts by probe and value are written, and every metric follows from
    these few rows; with logits, a second pass sums and a third orders the confidences. Probes without rows add nothing.
    """
    keys, parts = list(compare.DIMENSIONS), []
    rows = details.where(F.col("meta_type").isin(*probes))
    table = once(metrics.contingency(rows, keys, "correct", "meta_value"))
    for probe in probes:
        own = table.where(F.col("meta_type") == probe)
        if probe in score.SCALES:
            wide = metrics.graded_metrics(own, keys, probe, None, "grade").drop("n", "d_prime_type2", "meta_alignment")
        else:
            wide = metrics.binary_metrics(own, keys, None, "grade").select(*keys, *BINARY_METRICS)
        parts.append(compare.to_long(wide))
    graded = [p for p in probes if p in score.SCALES]
    if logits and graded:
        known = rows.where(F.col("meta_type").isin(*graded) & F.col("logit_confidence").isNotNull())
        highest = reduce(lambda a, p: a.when(F.col("meta_type") == p, score.SCALES[p][1]), graded, F)
        parts.append(compare.to_long(metrics.confidence_summary(known, keys, highest, "correct", "meta_value", "logit_confidence")))
        area = metrics.auroc_continuous(known, keys, "correct", "logit_confidence")
        parts.append(compare.to_long(area.select(*keys, F.col("type2_auroc").alias("logit_type2_auroc"))))
    return reduce(DataFrame.unionByName, parts)
