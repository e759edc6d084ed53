"""Whitened embeddings against whole-number sums and a plain covariance."""

import random
from fractions import Fraction

import numpy as np
import pytest

from surety.llm import whitening

KIND = "vec_id long, embedding array<float>, n string, component string"


def plain(vectors):
    """n, S, eigenvalues and eigenvectors from all distinct vectors at once."""
    fit = np.array(sorted({tuple(int(np.floor(256 * float(c))) for c in v) for v in vectors}), dtype=np.int64)
    sums = fit.sum(axis=0)
    centred = fit - sums / len(fit)
    values, axes = np.linalg.eigh(centred.T @ centred / len(fit))
    return len(fit), sums, values[::-1], axes[:, ::-1]


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    rows = (rng.normal(size=(n, d)) * np.linspace(3, 0.2, d) + rng.normal(size=d)).astype(np.float32)
    return [[float(c) for c in r] for r in rows]


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_a_plain_covariance(spark, parts):
    good = vectors(300, 6, parts)
    rows = [(i, v, "x", None) for i, v in enumerate(good)] + [(1000 + i, good[0], None, "y") for i in range(150)]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None, "x", "x"), (2001, [None] * 6, "x", "x"), (2002, [nan] + [0.0] * 5, "x", "x"), (2003, [inf] * 6, "x", "x"), (2004, [1.0], "x", "x"), (2005, [], "x", "x"), (None, good[1], "x", "x")]
    df = spark.createDataFrame(rows, KIND).repartition(parts)
    got = whitening.whiten(df).collect()
    n, sums, values, axes = plain(good)
    assert len(got) == 4 * (300 + 150 + 1) and {r.n for r in got} == {n} and sorted({r.component for r in got}) == [1, 2, 3, 4]
    by = {(r.vec_id, r.component): r for r in got}
    for i, v in enumerate(good):
        x = np.array([int(np.floor(256 * float(c))) for c in v])
        assert by[i, 1].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums))
        for k in range(1, 5):
            want = (x - sums / n) @ axes[:, k - 1] / np.sqrt(values[k - 1])
            assert abs(abs(by[i, k].whitened) - abs(want)) < 1e-9
            assert abs(by[i, k].explained - values[k - 1] / values.sum()) < 1e-12
    for k in range(1, 5):
        assert by[1007, k].whitened == pytest.approx(by[0, k].whitened, abs=1e-12) and by[None, k].whitened == pytest.approx(by[1, k].whitened, abs=1e-12)
        # one sign for all rows
        want = np.array([(np.floor(256 * np.array(v)) - sums / n) @ axes[:, k - 1] for v in good])
        assert abs(np.corrcoef(want, [by[i, k].whitened for i in range(300)])[0, 1]) > 1 - 1e-9
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_merging_is_the_moments_of_all():
    rng = random.Random(3)
    rows = np.array([[rng.randint(-(10**6), 10**6) + 10**9 * j for j in range(3)] for _ in range(500)])
    whole = whitening.moments(rows, whitening.exact_sums(rows))
    cuts = [0, 1, 2, 40, 300, 500]
    parts = [whitening.moments(rows[a:b], whitening.exact_sums(rows[a:b])) for a, b in zip(cuts, cuts[1:])]
    total = parts[0]
    for p in parts[1:]:
        total = whitening.merged(total, p)
    assert total.n == 500 and total.sums == whole.sums == [sum(map(int, c)) for c in rows.T]
    assert np.allclose(total.scatter, whole.scatter, rtol=1e-12)
    means = [Fraction(s, 500) for s in total.sums]
    exact = float(sum((int(a) - means[0]) * (int(b) - means[2]) for a, b in rows[:, [0, 2]]))
    assert total.scatter[0, 2] == pytest.approx(exact, rel=1e-9)


def test_sums_and_packing_of_large_entries():
    rows = np.array([[2**62, -(2**62)], [2**62, -5], [2**62, 7]])
    assert whitening.exact_sums(rows) == [3 * 2**62, -(2**62) + 2]
    for x in ([0, 0], [127, -128], [128, 0], [-32769, 1], [2**31, 2**62], [-(2**31), 3]):
        assert whitening.unpacked_vectors([whitening.packed_vector(np.array(x))], 2).tolist() == [x]


def test_flat_small_and_empty_tables(spark):
    make = lambda rows: spark.createDataFrame([(i, v, None, None) for i, v in enumerate(rows)], KIND)
    same = whitening.whiten(make([[1.0, 2.0]] * 3)).collect()
    assert len(same) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, 0.0, 0.0)}
    line = whitening.whiten(make([[float(i), 2.0 * i, 0.0] for i in range(20)])).collect()
    assert len(line) == 60 and all((r.whitened is None) == (r.component > 1) for r in line)
    assert line[0].identity_error < 1e-9 and sum(r.explained for r in line if r.vec_id == 0) == pytest.approx(1)
    huge = whitening.whiten(make([[3e38, 1.0], [-3e38, 2.0], [0.0, 3.0]])).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge if r.vec_id == 0)
    for rows in ([], [None], [[]], [[], [], [1.0]]):
        assert whitening.whiten(make(rows)).count() == 0
    assert whitening.whiten(make([[1.0], [2.0], [1.0, 2.0], [3.0, 4.0]])).where("component = 1").count() == 2
