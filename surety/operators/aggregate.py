"""User-defined metrics as mergeable aggregates: no group is ever gathered.

A metric gives a start value, adds a block of a group's rows to a state, merges two states, and finishes one. Tasks keep
a state for each group and send only states; a group's states merge in a tree, at most FAN_IN of them at a time, so a group
that holds all rows costs one state a task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from surety.sources.shared import once

#: States merged at a time, and groups whose states a task holds before it sends them on.
FAN_IN, HELD = 64, 20_000


@dataclass(frozen=True)
class Metric:
    """The four parts of a metric. A state is any value that pickles; merging must not depend on order or grouping.

    start: () to a state. add: (state, rows of one group as pandas) to a state. merge: (state, state) to a state.
    finish: state to a tuple of the result's columns. columns: the columns that add reads. result: their DDL.
    """

    start: Callable[[], Any]
    add: Callable[[Any, pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], tuple]
    columns: tuple[str, ...]
    result: str


def partial_states(df: DataFrame, keys: list[str], metric: Metric, held: int = HELD) -> DataFrame:
    """(keys, _state): one row a task and group, or more where a task meets more groups than it may hold."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("_state", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, list] = {}
        kinds: list[pa.DataType] = []

        def sent():
            columns = [pa.array([key[i] for key, _ in states.values()], kind) for i, kind in enumerate(kinds)]
            columns.append(pa.array([pickle.dumps(s) for _, s in states.values()], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            number, firsts = _groups(batch, keys)
            rows = batch.select(list(metric.columns)).to_pandas()
            for g, part in rows.groupby(number, sort=False):
                key = tuple(batch.column(k)[int(firsts[g])].as_py() for k in keys)
                found = states.setdefault(_hashable(key), [key, metric.start()])
                found[1] = metric.add(found[1], part.reset_index(drop=True))
            if len(states) >= held:
                yield sent()
                states = {}
        if states:
            yield sent()

    wanted = [F.col(f"`{c}`") for c in dict.fromkeys([*keys, *metric.columns])]
    return df.select(*wanted).mapInArrow(run, schema)


def _hashable(key: tuple) -> tuple:
    """A key as equal keys have it: NaN is one value, as in Spark's groups."""
    return tuple("nan" if isinstance(k, float) and k != k else ("value", k + 0.0 if isinstance(k, float) else k) for k in key)


def _groups(batch: pa.RecordBatch, keys: list[str]) -> tuple[np.ndarray, list[int]]:
    """(group number of each row, a row of each group)."""
    seen: dict[tuple, int] = {}
    firsts, number = [], []
    for i, key in enumerate(zip(*[batch.column(k).to_pylist() for k in keys]) if keys else [()] * batch.num_rows):
        g = seen.setdefault(_hashable(key), len(seen))
        if g == len(firsts):
            firsts.append(i)
        number.append(g)
    return np.array(number, np.int64), firsts


def aggregate(df: DataFrame, keys: list[str], metric: Metric, fan_in: int = FAN_IN, held: int = HELD) -> DataFrame:
    """(keys, the metric's result) of each group; a null key is a group, no rows are no groups."""
    states = once(partial_states(df, keys, metric, held))
    kinds = T.StructType([df.schema[k] for k in keys] + [T.StructField("_state", T.BinaryType())])

    def merged(blobs) -> bytes:
        return pickle.dumps(reduce(metric.merge, map(pickle.loads, blobs)))

    def level(table: pa.Table) -> pa.Table:
        one = table.slice(0, 1).select(keys)
        return one.append_column("_state", pa.array([merged(table.column("_state").to_pylist())], pa.binary()))

    most = lambda: states.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    while (n := most()) > 1:
        # a group's states are dealt out by their numbers, so that some fan_in of them meet
        parts = -(-n // fan_in)
        dealt = states.withColumn("_part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)) if parts > 1 else F.lit(0).cast("bigint"))
        states = once(dealt.groupBy(*keys, "_part").applyInArrow(level, kinds))
    values = T.StructType.fromDDL(metric.result).fields
    result = T.StructType([*kinds.fields[:-1], *values])

    def finish(batches):
        for batch in batches:
            made = [metric.finish(pickle.loads(b)) for b in batch.column("_state").to_pylist()]
            columns = [batch.column(k) for k in keys]
            columns += [pa.array([row[i] for row in made], to_arrow_type(f.dataType)) for i, f in enumerate(values)]
            yield pa.RecordBatch.from_arrays(columns, names=result.names)

    return states.mapInArrow(finish, result)
