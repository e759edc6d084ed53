"""The generator's published vectors, in columns and arrays, and the noise drawn from it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from surety.functions import philox
from surety.operators import evolve

#: Counter, key and result. Fixed values.
VECTORS = [
    ((0, 0, 0, 0), (0, 0), (0x6627E8D5, 0xE169C58D, 0xBC57AC4C, 0x9B00DBD8)),
    ((0xFFFFFFFF,) * 4, (0xFFFFFFFF,) * 2, (0x408F276D, 0x41C83B0E, 0xA20BC7C6, 0x6D5451FD)),
    ((0x243F6A88, 0x85A308D3, 0x13198A2E, 0x03707344), (0xA4093822, 0x299F31D0), (0xD16CFE09, 0x94FDCCEB, 0x5001E420, 0x24126EA1)),
]


def test_published_vectors(spark):
    df = spark.createDataFrame([(i, *c, *k) for i, (c, k, _) in enumerate(VECTORS)], "i int, a long, b long, c long, d long, k long, m long")
    made = philox.philox(df, ["a", "b", "c", "d"], ["k", "m"]).orderBy("i")
    assert made.columns == [*df.columns, "r0", "r1", "r2", "r3"]
    assert [tuple(r)[-4:] for r in made.collect()] == [v for *_, v in VECTORS]
    for counter, key, want in VECTORS:
        got = philox.philox_array([np.array([x], np.uint64) for x in counter], key)
        assert tuple(int(x[0]) for x in got) == want
    # a word that clashes with a result's name is replaced
    assert philox.philox(df.withColumnRenamed("i", "r0"), ["a", "b", "c", "d"], ["k", "m"]).count() == 3


def test_rounds_stay_in_generated_code(spark):
    df = philox.philox(spark.range(10).withColumn("z", F.lit(0)), ["id", "z", "z", "z"], ["z", "z"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Project") >= philox.ROUNDS and "*(1)" in plan and "*(2)" not in plan


def test_columns_and_arrays_draw_the_same_noise(spark):
    rows = [(s, n, p) for s in (0, 5, -1, 1 << 40, -(1 << 62)) for n in ("a", "layer/é", "") for p in (0, 1, 2, 3, 4, 6, 1 << 20, (1 << 40) + 3)]
    got = evolve.noise(spark.createDataFrame(rows, "seed long, name string, pos long")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.noise == pytest.approx(evolve._update([r.name], np.array([r.pos]), [(r.seed, 1.0)])[0], abs=1e-12)
    order = sorted(rows, key=lambda r: (r[2], r[1]))
    mixed = [r for r in order if r[0] == 5]
    together = evolve._update([r[1] for r in mixed], np.array([r[2] for r in mixed]), [(5, 1.0)])
    assert np.allclose(together, [evolve._update([n], np.array([p]), [(5, 1.0)])[0] for _, n, p in mixed])


def test_noise_is_normal_and_independent():
    x, y = (evolve._update(["w"] * 200_000, np.arange(200_000), [(s, 1.0)]) for s in (1, 2))
    assert abs(x.mean()) < 0.01 and abs(x.std() - 1) < 0.01 and abs((x**3).mean()) < 0.03 and abs((x**4).mean() - 3) < 0.1
    assert abs(np.corrcoef(x, y)[0, 1]) < 0.01 and abs(np.corrcoef(x[1:], x[:-1])[0, 1]) < 0.01


def test_the_update_is_signed_and_by_position(spark):
    w = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0), ("b", 0, None), ("b", 9, 2.0)], "name string, pos long, value double").repartition(3)
    pop = spark.createDataFrame([(3, 2.0), (4, -1.0), (5, None)], "seed long, z double")
    got = {(r.name, r.pos): r.value for r in evolve.apply_evolution(w, pop, 0.3).collect()}
    for (n, p), base in {("a", 0): 1.0, ("a", 1): 1.0, ("b", 9): 2.0}.items():
        step = sum(z * evolve._update([n], np.array([p]), [(s, 1.0)])[0] for s, z in ((3, 2.0), (4, -1.0)))
        assert got[n, p] == pytest.approx(base + 0.1 * step)
    assert got["b", 0] is None
    assert {r.value for r in evolve.apply_evolution(w, pop.limit(0), 0.3).where("value is not null").collect()} == {1.0, 2.0}
