"""Whitening of embeddings by merged covariances (Chan, Golub and LeVeque).

Entries become whole numbers x = floor(256 c), and each distinct vector counts once in the fit. A first pass gives each
partition's count, exact sums, local mean and scatter centred on that mean; two of them merge by
M = Ma + Mb + (mb - ma)(mb - ma)' na nb / (na + nb), in a tree over the executors, so the driver receives one matrix of
the dimension's size. It finds the eigenvectors, which are broadcast. A second pass over the fit list whitens each vector
and merges the covariances of the results in the same way: its distance from the identity is reported with every row.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped, and so are those of another
length than most rows (of equally frequent lengths the shortest stays) and entries beyond 2**62 in magnitude are held
there; vectors without entries and an empty table give no rows. Equal vectors have equal results, repeated rows stay
repeated. A component whose eigenvalue is at most FLAT of the trace has no variance to divide by: its ``whitened`` is
null, and it is left out of the identity's check (nothing left: 0). A ``deviation`` that a long can't hold is null. Eigenvectors are turned so
that their entry of largest magnitude (the first of equals) is positive. Only the kept columns and the results return.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.llm.common import map_batches, materialise

SCALE, COMPONENTS, LIMIT, FLAT = 256.0, 4, 1 << 62, 1e-13
#: Vectors that a task centres at once.
BLOCK = 4096


class Moments(NamedTuple):
    """Count, exact sums by dimension, mean, and scatter centred on the mean."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray


def moments(rows: np.ndarray, sums: list[int] | None = None) -> Moments:
    mean = rows.mean(axis=0, dtype=np.float64)
    centred = rows - mean
    return Moments(len(rows), sums or [], mean, centred.T @ centred)


def merged(a: Moments, b: Moments) -> Moments:
    n, step = a.n + b.n, b.mean - a.mean
    return Moments(n, [x + y for x, y in zip(a.sums, b.sums, strict=True)], a.mean + step * (b.n / n), a.scatter + b.scatter + np.outer(step, step) * (a.n * (b.n / n)))


def exact_sums(rows: np.ndarray) -> list[int]:
    """Sums by dimension as whole numbers of any size; rows: int64."""
    high, low = rows >> 31, rows & 0x7FFFFFFF
    return [(int(h) << 31) + int(x) for h, x in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]


def scaled(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values.astype(np.float64)), -LIMIT, LIMIT).astype(np.int64)


def packed_vector(x: np.ndarray) -> bytes:
    """The vector's bytes, each entry as wide as the largest needs; equal vectors have equal bytes."""
    most = int(max(x.max(), -(x.min() + 1)))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w - 1)
    return x.astype(f"<i{width}").tobytes()


def unpacked_vectors(blobs: list[bytes], dimension: int) -> np.ndarray:
    """int64 rows of packed vectors."""
    out = np.empty((len(blobs), dimension), np.int64)
    for i, b in enumerate(blobs):
        out[i] = np.frombuffer(b, f"<i{len(b) // dimension}")
    return out


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has finite entries only."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return df.where(F.col(vector).isNotNull() & ~bad)


def common_length(df: DataFrame, vector: str) -> int:
    """The length of most vectors, the shortest of equally frequent ones; 0 without rows."""
    found = df.groupBy(F.size(vector).alias("d")).count().agg(F.max_by("d", F.struct("count", -F.col("d")))).first()[0]
    return found or 0


def _matrix(column, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten().cast(pa.float64())).reshape(-1, dimension)


def fit_list(df: DataFrame, vector: str, dimension: int) -> DataFrame:
    """Each distinct scaled vector once, packed; written, as two passes read it."""

    def run(batches):
        for batch in batches:
            rows = scaled(_matrix(batch.column(0), dimension))
            yield pa.RecordBatch.from_arrays([pa.array([packed_vector(x) for x in rows], pa.binary())], names=["x"])

    return materialise(map_batches(df.select(vector), run, "x binary").distinct(), "fit-list")


def _merge_all(rows: DataFrame, summarise) -> Moments | None:
    """Moments of all rows: one for each partition, merged in a tree on the executors."""

    def run(batches):
        total, held, size = None, [], 0
        for batch in batches:
            held += batch.column(0).to_pylist()
            if len(held) >= BLOCK:
                part = summarise(held)
                total, held = part if total is None else merged(total, part), []
        if held:
            part = summarise(held)
            total = part if total is None else merged(total, part)
        if total is not None:
            sums = [str(s) for s in total.sums]
            yield pa.RecordBatch.from_arrays([pa.array([total.n]), pa.array([sums], pa.list_(pa.string())), pa.array([total.mean.tobytes()]), pa.array([total.scatter.tobytes()])], names=["n", "sums", "mean", "scatter"])

    def opened(r) -> Moments:
        mean = np.frombuffer(r.mean)
        return Moments(r.n, [int(s) for s in r.sums], mean, np.frombuffer(r.scatter).reshape(len(mean), -1))

    parts = map_batches(rows, run, "n long, sums array<string>, mean binary, scatter binary").rdd.map(lambda r: [opened(r)])
    # tree merges of lists of at most one, so that no rows are no error
    both = lambda a, b: [merged(a[0], b[0])] if a and b else a or b
    found = parts.treeAggregate([], both, both)
    return found[0] if found else None


class Whitener:
    """What tasks need: sums, and the projection of the leading components."""

    def __init__(self, fit: Moments, components: int):
        self.n, self.sums = fit.n, fit.sums
        covariance = fit.scatter / fit.n
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        order = np.argsort(-values, kind="stable")[:components]
        self.values, axes = values[order], vectors[:, order]
        self.axes = axes * np.sign(axes[np.argmax(np.abs(axes), axis=0), np.arange(len(order))])
        self.trace = float(np.trace(covariance))
        self.varies = self.values > FLAT * self.trace
        self.explained = np.divide(self.values, self.trace, out=np.zeros(len(order)), where=self.trace > 0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """The components that vary, by row; x - S/n is formed before it is projected."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return ((x - whole).astype(np.float64) - rest) @ self.axes[:, self.varies] / np.sqrt(self.values[self.varies])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2 as whole numbers; None beyond a long."""
        reach = max((abs(s) for s in self.sums), default=0) + self.n * int(np.abs(x).max(initial=0))
        if reach * reach * x.shape[1] < 1 << 62:
            off = self.n * x - np.array(self.sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        # whole numbers of any size only for rows that may fit
        near = ((self.n * x.astype(np.float64) - np.array([float(s) for s in self.sums])) ** 2).sum(axis=1)
        out: list[int | None] = [None] * len(x)
        for i in np.flatnonzero(near < 1.1 * 2.0**63):
            exact = sum((self.n * v - s) ** 2 for v, s in zip(x[i].tolist(), self.sums, strict=True))
            out[i] = exact if exact < 1 << 63 else None
        return out


def whiten(df: DataFrame, vector="embedding", keep=("vec_id",), components=COMPONENTS) -> DataFrame:
    """For each usable row and leading component: the kept columns, component, n, deviation, whitened, explained and
    identity_error."""
    added = {"component": T.IntegerType(), "n": T.LongType(), "deviation": T.LongType(), "whitened": T.DoubleType(), "explained": T.DoubleType(), "identity_error": T.DoubleType()}
    keep = [c for c in keep if c not in added]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(k, t) for k, t in added.items()])
    rows = usable(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, vector])]), vector)
    d = common_length(rows, vector)
    if d == 0:
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size(vector) == d)
    distinct = fit_list(rows, vector, d)

    def first(blobs):
        x = unpacked_vectors(blobs, d)
        return moments(x, exact_sums(x))

    model = Whitener(_merge_all(distinct, first), components)
    share = df.sparkSession.sparkContext.broadcast(model)  # dimension times components
    error = 0.0
    if model.varies.any():
        seen = _merge_all(distinct, lambda blobs: moments(share.value.whitened(unpacked_vectors(blobs, d))))
        error = float(np.abs(seen.scatter / seen.n - np.eye(int(model.varies.sum()))).max())

    def run(batches):
        made, k = share.value, len(share.value.values)
        place = np.cumsum(made.varies) - 1
        for batch in batches:
            x = scaled(_matrix(batch.column(vector), d))
            white = made.whitened(x)
            columns = [white[:, place[j]].tolist() if made.varies[j] else [None] * len(x) for j in range(k)]
            at = pa.array(np.repeat(np.arange(len(x)), k))
            flat = [v for row in zip(*columns) for v in row]
            out = [batch.column(c).take(at) for c in keep]
            out += [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, made.n)), pa.array(made.deviations(x), pa.int64()).take(at), pa.array(flat, pa.float64())]
            out += [pa.array(np.tile(made.explained, len(x))), pa.array(np.full(len(x) * k, error))]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return map_batches(rows, run, schema)
