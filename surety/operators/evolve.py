"""Populations: rewards by seed, their standard scores, and the weight update they ask for."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surety.functions import philox
from surety.functions.reward import reward


def seed_rewards(trials: DataFrame, name: str, correct="correct", meta="yes", iteration="iteration", seed="seed") -> DataFrame:
    """Mean reward of each seed."""
    return trials.groupBy(iteration, seed).agg(F.avg(reward(name, correct, meta).cast("double")).alias("reward"))


def standard_scores(population: DataFrame, iteration="iteration", small=1e-8) -> DataFrame:
    """Adds z = (reward - mean) / (sample deviation + small) within each iteration; null for a population of one."""
    of = Window.partitionBy(iteration)
    z = (F.col("reward") - F.avg("reward").over(of)) / (F.stddev_samp("reward").over(of) + small)
    return population.withColumn("z", z)


def noise(df: DataFrame, seed="seed", name="name", pos="pos", out="noise") -> DataFrame:
    """Adds a standard normal number for each seed, name and position, in columns: four positions share a counter."""
    bits = ["_bits0", "_bits1", "_bits2", "_bits3"]
    block = F.floor(F.col(pos) / 4).cast("bigint")
    made = philox.philox(df, [*philox.words_of(block), *philox.name_words(F.col(name).cast("string"))], philox.words_of(seed), tuple(bits))
    return made.withColumn(out, philox.normal(bits, F.pmod(F.col(pos), F.lit(4)))).drop(*bits)


def _update(names: list[str], pos: np.ndarray, seeds: list[tuple[int, float]]) -> np.ndarray:
    """The sum over seeds of noise() times their scores, for rows of weights."""
    at = {n: int.from_bytes(hashlib.md5(n.encode()).digest()[:8], "big") for n in set(names)}
    marks = np.fromiter((at[n] for n in names), np.uint64, len(names))
    # rows that share a counter, mostly neighbours, share its four numbers
    block = pos >> 2
    new = np.ones(len(pos), bool)
    new[1:] = (block[1:] != block[:-1]) | (marks[1:] != marks[:-1])
    group, lane = np.cumsum(new) - 1, pos & 3
    block, marks = block[new].view(np.uint64), marks[new]
    low, high = np.uint64(philox.MASK), np.uint64(32)
    counter = [block & low, block >> high, marks >> high, marks & low]
    total = np.zeros(len(pos))
    for seed, score in seeds:
        key = (seed & philox.MASK, (seed >> 32) & philox.MASK)
        total += score * philox.normals(philox.philox_array(counter, key))[group, lane]
    return total


def apply_evolution(weights: DataFrame, population: DataFrame, scale: float, relative="z", reverse=False) -> DataFrame:
    """weights + sum over seeds of noise(seed, name, pos) * relative * scale / number of seeds.

    Noise is regenerated from the seeds, so only (seed, score) pairs meet the weights. population: the seeds of one
    iteration, whose number is a setting; it travels to the weights, which are not shuffled. Seeds without a score
    move nothing.
    """
    seeds = sorted((int(r[0]), float(r[1])) for r in population.select("seed", relative).collect() if r[0] is not None and r[1] is not None)
    factor = (-1.0 if reverse else 1.0) * scale / max(population.count(), 1)
    rows = weights.select(F.col("name").cast("string").alias("name"), F.col("pos").cast("bigint").alias("pos"), F.col("value").cast("double").alias("value"))

    def run(batches):
        for batch in batches:
            step = _update(batch.column("name").to_pylist(), np.asarray(batch.column("pos")), seeds)
            moved = pc.add(batch.column("value"), pa.array(factor * step))
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("pos"), moved], names=["name", "pos", "value"])

    return rows.mapInArrow(run, "name string, pos bigint, value double")
