"""User metrics through mergeable states against brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from surety.operators import aggregate
from surety.operators.aggregate import Metric


def moments() -> Metric:
    """Mean and deviation by Chan's merging, and the set of names: states of any kind."""

    def add(state, rows):
        x = rows["x"].dropna().to_numpy()
        one = (len(x), float(x.mean()) if len(x) else 0.0, float(((x - x.mean()) ** 2).sum()) if len(x) else 0.0, set(rows["name"].dropna()))
        return merge(state, one)

    def merge(a, b):
        n = a[0] + b[0]
        if not n:
            return 0, 0.0, 0.0, a[3] | b[3]
        d = b[1] - a[1]
        return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n, a[3] | b[3]

    def finish(s):
        return s[0], s[1] if s[0] else None, math.sqrt(s[2] / s[0]) if s[0] else None, sorted(s[3])

    return Metric(lambda: (0, 0.0, 0.0, set()), add, merge, finish, ("x", "name"), "n bigint, mean double, deviation double, names array<string>")


def brute(rows, key):
    groups = defaultdict(list)
    for r in rows:
        groups[key(r)].append(r)
    out = {}
    for k, rs in groups.items():
        x = [r[2] for r in rs if r[2] is not None]
        out[k] = (len(x), np.mean(x) if x else None, np.std(x) if x else None, sorted({r[3] for r in rs if r[3] is not None}))
    return out


def same(a, b):
    return a[0] == b[0] and a[3] == b[3] and all((p is None and q is None) or abs(p - q) < 1e-9 for p, q in zip(a[1:3], b[1:3]))


@pytest.mark.parametrize("parts, fan_in, held", [(1, 64, 20_000), (13, 2, 3), (7, 3, 1)])
def test_equals_brute_force_with_a_hot_group(spark, parts, fan_in, held):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot"] * 9 + ["a", "b", None]), rng.choice([1.0, float("nan"), None, -0.0, 0.0]), rng.choice([None, rng.random()]), rng.choice([None, "n1", "n2", "n3"])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, f double, x double, name string").repartition(parts)
    got = {r.k: tuple(r)[1:] for r in aggregate.aggregate(df, ["k"], moments(), fan_in, held).collect()}
    want = brute(rows, lambda r: r[0])
    assert got.keys() == want.keys() and all(same(got[k], want[k]) for k in want)
    name = lambda f: "nan" if f is not None and f != f else None if f is None else f + 0.0
    got = aggregate.aggregate(df, ["k", "f"], moments(), fan_in, held).collect()
    want = brute(rows, lambda r: (r[0], name(r[1])))
    assert len(got) == len(want) and all(same(tuple(r)[2:], want[r.k, name(r.f)]) for r in got)
    (whole,) = aggregate.aggregate(df, [], moments(), fan_in, held).collect()
    assert same(tuple(whole), brute(rows, lambda r: 0)[0])


def test_no_task_meets_the_rows_of_a_group(spark):
    """What is shuffled is states: as many as tasks, whatever the rows."""
    df = spark.range(200_000, numPartitions=11).selectExpr("'all' AS k", "CAST(id AS double) AS x", "'n' AS name")
    assert aggregate.partial_states(df, ["k"], moments()).count() == 11
    (row,) = aggregate.aggregate(df, ["k"], moments(), fan_in=3).collect()
    assert row.n == 200_000 and row.mean == pytest.approx(99_999.5)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, x double, name string")
    assert aggregate.aggregate(df, ["k"], moments()).count() == aggregate.aggregate(df, [], moments()).count() == 0
