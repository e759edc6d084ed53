"""Importance resampling towards a target corpus on hashed word n-grams.

A byte automaton runs over the UTF-8 buffer of a whole Arrow column: a lookup table classifies (and lower-cases) every
byte, differences of the classes give the words' bounds, and the checksums of all words advance together, one byte a
step, through the CRC table; words are ordered by length, so those that have ended fall off the end of the arrays. A run
of two words continues its first word's state by a blank and the second word. The few longest words are finished by
the library's checksum from the state they have reached.

A feature is a run of 1 to 2 consecutive words (repeats count), its bucket the checksum modulo BUCKETS. Buckets are
counted over all documents (s of S) and all target texts (t of T), both smoothed by one; a bucket's gain is
floor(1000 ln(((t + 1)(S + B)) / ((s + 1)(T + B)))), a document's weight the floored mean of its features' gains, and its
score the weight plus a Gumbel number hashed from the seed and the key: the highest scores are a sample without
replacement in proportion to the weights' exponentials. Only counts by bucket reach the driver; ranks are given by
range partitions of narrow rows.

Defined results: a null or empty text has no words, no features and weight 0; it isn't drawn, nor is any text of fewer
than LEAST words. Without target texts all gains follow from s alone, and the other way round. A null key hashes as the word null and ranks after
equal scores; repeated rows are separate draws with equal scores, in any order. An empty table gives no rows. Other columns are dropped but for the
kept ones, which the results replace where names clash.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.llm.common import map_batches, materialise
from surety.sources.corpora import numbered

BUCKETS, SEED, LEAST, PERCENT = 10_000, 7, 20, 25
#: Steps after which the words still open go to the library one by one.
STEPS = 48
#: The reversed polynomial of the CRC. Fixed value.
POLYNOMIAL = 0xEDB88320


@cache
def crc_table() -> np.ndarray:
    """The state's change by each byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


@cache
def byte_classes() -> np.ndarray:
    """Each byte in lower case where it belongs to a word, else 0."""
    t = np.zeros(256, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        t[low : high + 1] = np.arange(low, high + 1)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    return t


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC states after the bytes at starts, all stepped together; states are inverted checksums."""
    table = crc_table()
    order = np.argsort(-lengths, kind="stable")
    out, at, left = state[order], starts[order], lengths[order]
    # how many words have more than k bytes
    open_ = np.searchsorted(-left, -np.arange(STEPS), side="left")
    for k in range(STEPS):
        n = open_[k]
        if not n:
            break
        now = out[:n]
        out[:n] = table[(now ^ data[at[:n] + k]) & 0xFF] ^ (now >> 8)
    for i in range(np.searchsorted(-left, -STEPS, side="left")):
        rest = data[at[i] + STEPS : at[i] + left[i]].tobytes()
        out[i] = zlib.crc32(rest, int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words by text, texts of the features, checksums of the features) for a column of texts; nulls have none."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, buffer = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(buffer, np.uint8)[first:last] if buffer is not None else np.empty(0, np.uint8)
    data, edges = byte_classes()[raw], offsets - first
    # a word begins after a byte of none and at each text's start, and ends before one and at each text's end
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = data != 0
    cut = np.zeros(len(data) + 2, bool)
    cut[edges + 1] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut[1:]))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut[1:]))
    text = np.searchsorted(edges, starts, side="right") - 1
    lengths = ends - starts
    one = advance(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, lengths)
    pair = np.flatnonzero(text[1:] == text[:-1])
    two = crc_table()[(one[pair] ^ 0x20) & 0xFF] ^ (one[pair] >> 8)
    two = advance(two, data, starts[pair + 1], lengths[pair + 1])
    return np.bincount(text, minlength=n), np.concatenate([text, text[pair]]), np.concatenate([one, two]) ^ np.uint32(0xFFFFFFFF)


def bucket_counts(df: DataFrame, text="text", buckets=BUCKETS) -> DataFrame:
    """(bucket, n) of all texts' features; a task sends at most one row a bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(features(batch.column(0))[2] % buckets, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    return map_batches(df.select(text), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, text="text", buckets=BUCKETS) -> np.ndarray:
    """The gain of each bucket, an array of the buckets' number."""
    s, t = (bucket_counts(df, text, buckets) for df in (documents, target))
    both = s.withColumnRenamed("n", "s").join(t.withColumnRenamed("n", "t"), "bucket", "full")
    counts = np.zeros((2, buckets), np.int64)
    for r in both.fillna(0, ["s", "t"]).collect():  # at most one row a bucket
        counts[:, r.bucket] = r.s, r.t
    s, t = counts.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(df: DataFrame, gain: np.ndarray, text="text", keep=("doc_id",)) -> DataFrame:
    """The kept columns, n_words, n_features and weight."""
    added = ("n_words", "n_features", "weight")
    keep = [c for c in keep if c not in added]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in added])
    share = df.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches):
        for batch in batches:
            words, of, crc = features(batch.column(text))
            n = np.bincount(of, minlength=len(words))
            # whole numbers stay exact in doubles: a text's sum is far below 2**53
            total = np.bincount(of, share.value[crc % len(share.value)], minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=schema.names)

    return map_batches(df.select(*dict.fromkeys([*keep, text])), run, schema)


def gumbel(seed: int, key) -> F.Column:
    """floor(-1000 ln(-ln u)) at a uniform number hashed from seed and key."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(documents: DataFrame, target: DataFrame, text="text", key="doc_id", percent=PERCENT, least=LEAST, seed=SEED, buckets=BUCKETS) -> DataFrame:
    """Every document's key, n_words, n_features, weight, score, and rank among the drawn (null: not drawn)."""
    gain = gains(documents, target, text, buckets)
    made = weights(documents, gain, text, [key]).withColumn("score", (F.col("weight") + gumbel(seed, key)).cast("long"))
    made = materialise(made, "importance")
    able = numbered(made.where(F.col("n_words") >= least).withColumns({"_down": -F.col("score"), "_null": F.col(key).isNull()}), "_down", "_null", key)
    n = F.floor(F.lit(percent) * made.where(F.col("n_words") >= least).count() / 100)
    rank = F.when(F.col("idx") < n, F.col("idx") + 1)
    return able.withColumn("rank", rank).select(*made.columns, "rank").unionByName(made.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))
