"""Mixing sources to target weights by Poisson replication.

Each source s gets a target repetition rate lambda_s = epochs * (w_s / sum w) * (total size / size_s). A document's
number of copies is the inverse of the Poisson(lambda_s) distribution at a uniform number hashed from the seed and
the document's key; it is exploded into that many rows. Whole rows are shuffled globally: hashed keys deal them out and
order each partition, so no bounds have to be sampled and every document is read and drawn once.

Defined results: a null source is a source of its own; a null key hashes as the word null; rows with equal key and
source get equal counts (repeated rows are replicated alike); an empty table gives an empty table; sources whose
total size is 0 have no rate to invert and keep each document once per epoch rounded down by the same draw with
lambda = epochs. Other columns pass through; the added columns ``copy`` (from 1) and ``shuffle_key`` replace columns of
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.llm.common import ROW, digest_long, digest_unit, materialise, packed, small_side, unpacked

#: Rates above this are drawn as a sum of equal independent parts, so exp(-rate) never underflows.
PART = 500.0


def source_rates(df: DataFrame, source="source", size=None, targets: dict | None = None, epochs=1.0) -> DataFrame:
    """One row per source: ``_source``, ``_rate``, the number of parts and the cumulative distribution of one part.

    targets: weights by source (absent sources get 0); None: the square root of the source's size.
    """
    size = F.lit(1) if size is None else size
    by = df.groupBy(F.col(source).alias("_source")).agg(F.sum(size).cast("double").alias("_size"))
    if targets is None:
        weight = F.sqrt("_size")
    else:
        pairs = [x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("_source")], F.lit(0.0)) if pairs else F.lit(0.0)
    by = by.withColumn("_weight", weight)
    total = by.agg(F.sum("_weight").alias("_w"), F.sum("_size").alias("_n"))
    rate = F.when((F.col("_size") > 0) & (F.col("_w") > 0), F.lit(float(epochs)) * F.col("_weight") / F.col("_w") * F.col("_n") / F.col("_size")).otherwise(F.lit(float(epochs)))
    by = by.join(F.broadcast(total)).withColumn("_rate", rate).withColumn("_parts", F.greatest(F.ceil(F.col("_rate") / PART), F.lit(1)).cast("int"))
    one = F.col("_rate") / F.col("_parts")
    last = F.ceil(one + 12 * F.sqrt(one) + 30).cast("int")
    start = F.struct(F.exp(-one).alias("term"), F.array(F.exp(-one)).alias("cdf"))

    def step(acc, i):
        term = acc["term"] * one / i
        return F.struct(term.alias("term"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + term)).alias("cdf"))

    return by.select("_source", "_rate", "_parts", F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["cdf"]).alias("_cdf"))


def poisson_mix(df: DataFrame, key="doc_id", source="source", size=None, targets=None, epochs=1.0, seed=17, shuffle=True) -> DataFrame:
    rates = materialise(source_rates(df, source, size, targets, epochs), "rates")
    own = F.col(ROW)[key]
    joined = packed(df).join(small_side(rates), F.col(ROW)[source].eqNullSafe(F.col("_source")))
    # one uniform number a part, drawn before it meets the distribution
    drawn = F.transform(F.sequence(F.lit(1), F.col("_parts")), lambda p: digest_unit(F.lit(seed), own, p))
    count = F.aggregate(drawn, F.lit(0), lambda a, u: a + F.size(F.filter("_cdf", lambda c: c <= u)))
    copies = F.transform(F.array(count), lambda k: F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")))[0]
    out = joined.withColumn("copy", F.explode(copies))
    out = out.withColumn("shuffle_key", digest_long(F.lit(seed), F.lit("order"), own, F.col("copy")))
    out = out.select(*unpacked(df.columns, "copy", "shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key") if shuffle else out
