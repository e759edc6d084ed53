"""Token batches and weights as arrays and long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surety.functions.columns import col
from surety.operators import permute
from surety.plans.schema import IGNORE
from surety.sources.corpora import numbered
from surety.sources.shared import once


def truncate(ids, length: int) -> Column:
    return F.slice(col(ids), 1, length)


def _pad(ids: Column, size: Column, value) -> Column:
    return F.concat(F.array_repeat(F.lit(value), (size - F.size(ids)).cast("int")), ids)


def left_pad(df: DataFrame, batch, ids="ids", pad=0, mask="mask") -> DataFrame:
    """ids padded on the left to the longest of their batch, and the mask of real tokens.

    The longest length is an aggregate joined back, so a batch of any size isn't gathered in one task.
    """
    longest = df.groupBy(col(batch).alias("_batch")).agg(F.max(F.size(ids)).alias("_longest"))
    size = F.col("_longest")
    joined = df.join(longest, col(batch).eqNullSafe(F.col("_batch")))
    kept = F.transform(F.col(ids), lambda x: F.lit(1))
    return joined.withColumn(mask, _pad(kept, size, 0)).withColumn(ids, _pad(F.col(ids), size, pad)).drop("_batch", "_longest")


def tuning_batch(df: DataFrame, batch, ids="ids", pad=0) -> DataFrame:
    """left_pad plus labels: the ids, and the ignored label on the padded prefix only."""
    out = left_pad(df, batch, ids, pad)
    return out.withColumn("labels", F.zip_with(ids, "mask", lambda x, m: F.when(m == 0, IGNORE).otherwise(x)))


def paired_batch(df: DataFrame, batch, no="no_ids", yes="yes_ids", pad=0) -> DataFrame:
    """meta: the no and yes sequences padded to the batch's longest of either, as an array of two."""
    longest = df.groupBy(col(batch).alias("_batch")).agg(F.max(F.greatest(F.size(no), F.size(yes))).alias("_longest"))
    joined = df.join(longest, col(batch).eqNullSafe(F.col("_batch")))
    return joined.withColumn("meta", F.array(_pad(F.col(no), F.col("_longest"), pad), _pad(F.col(yes), F.col("_longest"), pad))).drop("_batch", "_longest")


def batch_rows(df: DataFrame, batch, ids="ids") -> DataFrame:
    """One row a batch with its sequences, for batches of a size fixed by mini_batch()."""
    return df.groupBy(col(batch).alias("batch")).agg(F.sort_array(F.collect_list(F.struct("idx", ids))).alias("rows")).select("batch", F.col(f"rows.{ids}").alias(ids))


def select_meta(meta, correct, pad) -> tuple[Column, Column]:
    """(ids, labels) of the sequence that the correctness asks for; every pad id is ignored as a label."""
    ids = F.element_at(col(meta), col(correct) + 1)
    return ids, F.transform(ids, lambda x: F.when(x == pad, IGNORE).otherwise(x))


def shifted_matches(predicted, labels) -> tuple[Column, Column]:
    """(matches, counted): predictions of the next label that are right, and labels after the first that count."""
    p, t = col(predicted), col(labels)
    pairs = F.arrays_zip(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))).alias("p"), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))).alias("t"))
    counted = F.filter(pairs, lambda x: x["t"] != IGNORE)
    return F.size(F.filter(counted, lambda x: x["p"] == x["t"])), F.size(counted)


def valid_labels(labels) -> Column:
    return F.size(F.filter(col(labels), lambda x: x != IGNORE))


def weighted_loss(df: DataFrame, keys: list, loss="loss", tokens="tokens", matches="matches") -> DataFrame:
    """Token-weighted mean loss, its perplexity and token accuracy; 0, 1 and 0 without tokens."""
    n = F.sum(tokens)
    mean = F.coalesce(F.try_divide(F.sum(F.col(loss) * F.col(tokens)), n), F.lit(0.0))
    out = df.groupBy(*keys).agg(mean.alias("loss"), F.coalesce(F.try_divide(F.sum(matches).cast("double"), n), F.lit(0.0)).alias("accuracy"))
    return out.withColumn("perplexity", F.exp("loss"))


# weights: (name, pos, value)


def explode_weights(df: DataFrame, name, values) -> DataFrame:
    return df.select(col(name).alias("name"), F.posexplode(values).alias("pos", "value")).withColumn("pos", F.col("pos").cast("bigint"))


def weight_delta(tuned: DataFrame, base: DataFrame) -> DataFrame:
    """tuned - base for the positions both have."""
    b = base.select("name", "pos", F.col("value").alias("_base"))
    return tuned.join(b, ["name", "pos"]).select("name", "pos", (F.col("value") - F.col("_base")).alias("value"))


def array_delta(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def kth_magnitude(delta: DataFrame, filter_ratio: float, buckets=4096, small=100_000) -> DataFrame:
    """One row with the k-th smallest magnitude, k = max(1, floor(n (1 - ratio))), without a global sort.

    Histograms of the magnitudes zoom in on the bucket that holds it, each a scan with a partial aggregate of at most
    as many rows as buckets, until the bucket has few values; only these are ranked. Nulls don't count; infinite
    magnitudes follow all finite ones and NaN follows those; without values the threshold is null.
    """
    rows = delta.where(F.col("value").isNotNull()).select(F.abs("value").alias("m"))
    if rows.limit(small + 1).count() > small:
        # what makes the values is computed once, not for every histogram
        rows = once(rows)
    finite = F.col("m") < float("inf")
    n, low, high, endless, nan = rows.agg(F.count(F.when(finite, 1)), F.min(F.when(finite, F.col("m"))), F.max(F.when(finite, F.col("m"))), F.count(F.when(F.col("m") == float("inf"), 1)), F.count(F.when(F.isnan("m"), 1))).first()
    k = max(1, int((n + endless + nan) * (1 - filter_ratio)))
    if k > n:
        # infinite magnitudes come after all finite ones, NaN after those
        found = None if not endless and not nan else float("inf") if k <= n + endless else float("nan")
        return rows.sparkSession.range(1).select(F.lit(found).cast("double").alias("threshold"))
    left = n
    while left > small and high > low:
        place = F.least(F.floor((F.col("m") - low) / (high - low) * buckets), F.lit(buckets - 1)).alias("b")
        level = rows.where(F.col("m").between(low, high)).groupBy(place).agg(F.count("*").alias("c"), F.min("m").alias("low"), F.max("m").alias("high"))
        for r in sorted(level.collect()):
            if k <= r.c:
                left, low, high = r.c, r.low, r.high
                break
            k -= r.c
    inside = rows.where(F.col("m").between(low, high)).groupBy("m").count()
    upto = F.sum("count").over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("_upto", upto).where(F.col("_upto") >= k).agg(F.min("m").alias("threshold"))


def magnitude_filter(delta: DataFrame, filter_ratio=1.0, from_bottom=False, exclude_prefix: str | None = None) -> DataFrame:
    """delta without the names of the prefix and with the values of small (from_bottom: large) magnitude set to 0."""
    kept = delta if exclude_prefix is None else delta.where(~F.col("name").cast("string").startswith(exclude_prefix))
    if filter_ratio >= 1.0:
        return kept
    low = F.abs("value") < F.col("threshold")
    gone = ~low if from_bottom else low
    return kept.crossJoin(F.broadcast(kth_magnitude(delta, filter_ratio))).select(*[c for c in delta.columns if c != "value"], F.when(gone, 0.0).otherwise(F.col("value")).alias("value"))


def apply_delta(base: DataFrame, delta: DataFrame) -> DataFrame:
    """base + delta; positions without a delta stay."""
    d = delta.select("name", "pos", F.col("value").alias("_d"))
    return base.join(d, ["name", "pos"], "left").select("name", "pos", (F.col("value") + F.coalesce("_d", F.lit(0.0))).alias("value"))


# order and schedules


def mini_batch(index, size: int) -> Column:
    return F.floor(col(index) / size)


def cyclic(iteration, batches: int) -> Column:
    """The batch that an endlessly repeated loader gives at an iteration."""
    return F.pmod(col(iteration), F.lit(batches))


def epoch(iteration, batches: int) -> Column:
    """The pass over the data that an iteration belongs to."""
    return F.floor(col(iteration) / batches)


def hashed(*parts) -> Column:
    """52 bits of the md5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[col(p).cast("string") for p in parts])), 1, 13), 16, 10).cast("bigint")


def shuffled(df: DataFrame, key, seed: int) -> DataFrame:
    """Rows in an order hashed from seed and key."""
    return df.orderBy(hashed(F.lit(seed), key), key)


def shuffle_positions(df: DataFrame, key: str, seed: int, turn: int = 0) -> DataFrame:
    """Adds idx: the place of each row in an order hashed from seed, turn and key."""
    rows = df.withColumn("_hash", hashed(F.lit(seed), F.lit(turn), key))
    return numbered(rows, "_hash", key).drop("_hash")


def epoch_batches(df: DataFrame, key, size: int, epochs: int, seed: int) -> DataFrame:
    """Rows with epoch, batch: a loader that shuffles anew in each epoch and goes on over as many as asked.

    Rows are numbered once; an epoch's order is a permutation of the numbers, so epochs cost no sort.
    """
    rows = numbered(df, key)
    turn = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))) if epochs else rows.limit(0).withColumn("epoch", F.lit(0))
    return turn.withColumn("batch", mini_batch(permute.place("idx", rows.count(), seed, F.col("epoch")), size)).drop("idx")


def loader_batches(spark: SparkSession, n: int, size: int, seed: int, first: int, last: int) -> DataFrame:
    """(iteration, slot, idx) of the iterations from first to last, counted from 0, of an endless loader over n rows:
    which row is at which slot of which batch, found without the rows. The last batch of an epoch may be smaller."""
    batches = -(-n // size)
    at = spark.range(first * size, (last + 1) * size).select(F.floor(F.col("id") / size).alias("iteration"), (F.col("id") % size).alias("slot"))
    at = at.withColumn("_place", cyclic("iteration", batches) * size + F.col("slot")).where(F.col("_place") < n)
    return at.select("iteration", "slot", permute.row_at("_place", n, seed, epoch("iteration", batches)).alias("idx"))


def warmup_schedule(step, batches: int, accumulation: int, epochs: int, warmup_ratio: float) -> Column:
    """Share of the learning rate at a step: linear up over the warm-up, then linear down to 0."""
    total = batches // accumulation * epochs
    warm = int(total * warmup_ratio)
    step = col(step)
    return F.when(step < warm, step / max(1, warm)).otherwise(F.greatest(F.lit(0.0), (total - step) / max(1, total - warm)))


def running_best(order, loss, keys=()) -> Column:
    """Whether a loss is below all before it."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    least = F.min(loss).over(before)
    return least.isNull() | (col(loss) < least)
