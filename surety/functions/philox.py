"""Counter-based random numbers (Philox 4x32 with ten rounds): what a key and a counter give, anywhere and in any order.

The same numbers come from bigint columns, whose rounds are projections of their own that stay in generated code, and
from numpy arrays inside tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.functions.columns import col

#: Multipliers, steps of the key, rounds. Fixed values.
MULTIPLIERS = (0xD2511F53, 0xCD9E8D57)
STEPS = (0x9E3779B9, 0xBB67AE85)
ROUNDS = 10
MASK = 0xFFFFFFFF


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _halves(x: Column, by: int) -> tuple[Column, Column]:
    """(upper, lower) 32 bits of a product; through 16-bit parts, as a bigint has no room for the whole."""
    low, high = x.bitwiseAND(_long(0xFFFF)) * _long(by), F.shiftright(x, 16) * _long(by)
    upper = F.shiftright(high + F.shiftright(low, 16), 16)
    lower = (F.shiftleft(high.bitwiseAND(_long(0xFFFF)), 16) + low).bitwiseAND(_long(MASK))
    return upper, lower


def philox(df: DataFrame, counter: list, key: list, out: tuple[str, ...] = ("r0", "r1", "r2", "r3")) -> DataFrame:
    """Adds four columns of 32 random bits from four counter words and two key words (bigints of 32 bits)."""
    own = [F.col(f"`{c}`") for c in df.columns if c not in out]
    words = [f"_philox{i}" for i in range(6)]
    now = df.select("*", *[col(x).cast("bigint").alias(w) for x, w in zip([*counter, *key], words, strict=True)])
    a, b, c, d, k, m = (F.col(w) for w in words)
    for _ in range(ROUNDS):
        (upper0, lower0), (upper1, lower1) = _halves(a, MULTIPLIERS[0]), _halves(c, MULTIPLIERS[1])
        made = [upper1.bitwiseXOR(b).bitwiseXOR(k), lower1, upper0.bitwiseXOR(d).bitwiseXOR(m), lower0]
        made += [(x + _long(s)).bitwiseAND(_long(MASK)) for x, s in zip((k, m), STEPS)]
        now = now.select(*own, *[x.alias(w) for x, w in zip(made, words)])
    return now.select(*own, *[F.col(w).alias(o) for w, o in zip(words, out)])


def philox_array(counter: list[np.ndarray], key: tuple[int, int]) -> list[np.ndarray]:
    """The same for uint64 arrays of 32-bit words."""
    (a, b, c, d), (k, m) = counter, key
    for _ in range(ROUNDS):
        p, q = a * np.uint64(MULTIPLIERS[0]), c * np.uint64(MULTIPLIERS[1])
        a, b, c, d = (q >> np.uint64(32)) ^ b ^ np.uint64(k), q & np.uint64(MASK), (p >> np.uint64(32)) ^ d ^ np.uint64(m), p & np.uint64(MASK)
        k, m = (k + STEPS[0]) & MASK, (m + STEPS[1]) & MASK
    return [a, b, c, d]


def normals(bits: list[np.ndarray]) -> np.ndarray:
    """Four standard normal numbers from four words (Box and Muller), a column each."""
    u = [(x.astype(np.float64) + 0.5) / 2.0**32 for x in bits]
    out = []
    for r, angle in ((u[0], u[1]), (u[2], u[3])):
        size = np.sqrt(-2 * np.log(r))
        out += [size * np.cos(2 * np.pi * angle), size * np.sin(2 * np.pi * angle)]
    return np.stack(out, axis=1)


def normal(r: list, lane) -> Column:
    """The standard normal number of a lane (0 to 3) from the columns that philox() adds."""
    unit = lambda x: (col(x).cast("double") + 0.5) / 2.0**32
    lane = col(lane)
    size = F.sqrt(-2 * F.ln(F.when(lane < 2, unit(r[0])).otherwise(unit(r[2]))))
    angle = 2 * F.pi() * F.when(lane < 2, unit(r[1])).otherwise(unit(r[3]))
    return size * F.when(lane % 2 == 0, F.cos(angle)).otherwise(F.sin(angle))


def words_of(x) -> list[Column]:
    """The lower and the upper 32 bits of a bigint."""
    x = col(x).cast("bigint")
    return [x.bitwiseAND(_long(MASK)), F.shiftrightunsigned(x, 32)]


def name_words(name) -> list[Column]:
    """64 bits of a name's md5, as two words."""
    part = lambda at: F.conv(F.substring(F.md5(col(name)), at, 8), 16, 10).cast("bigint")
    return [part(1), part(9)]
