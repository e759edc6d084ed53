"""Shuffles by an index permutation: a row's place in any epoch is a column expression over its number.

Numbers 0 to n - 1 lie in a grid of ceil(sqrt n) columns. A Feistel network moves them inside the grid: in turn, the
column is shifted by a hash of the line and the line by a hash of the column. The grid has fewer cells beyond n than
columns; a number that lands on one of those moves on until it is back inside, which keeps the whole a permutation.
Nothing is sorted or shuffled for an epoch, and the inverse tells which row is at a place without touching data.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from surety.functions.columns import col

#: Primes below 2**31, so that products of two residues fit in a bigint. Fixed values.
PRIMES = (2147483647, 2147483629, 2147483587)
HALF_ROUNDS = 6
#: Most steps that a number takes back into the range. A walk is shorter than the grid is wide, so up to n = WALK ** 2 no
#: number needs more; beyond, one step leads outside with a chance below n ** -0.5, so one of n numbers needs more with
#: a chance below n ** (1 - WALK / 2).
WALK = 64


def constants(seed: int, turn: int) -> list[int]:
    """Factors and offsets of a half round's hash, from the seed."""
    words = hashlib.sha256(f"{seed}:{turn}".encode()).digest()
    return [1 + int.from_bytes(words[4 * i : 4 * i + 4], "big") % (PRIMES[-1] - 1) for i in range(7)]


def _long(x: int) -> Column:
    """A bigint: nested expressions of one type need no casts, which the analyser would add level by level."""
    return F.lit(x).cast("bigint")


def _hash(x: Column, epoch: Column, seed: int, turn: int) -> Column:
    """A residue of the last prime: products by constants modulo one prime after the other."""
    a, b, c, d, e, f, g = map(_long, constants(seed, turn))
    p, q, r = map(_long, PRIMES)
    y = (x + (epoch * a + b) % p) % p * c % p
    y = (y % q + d) % q * e % q
    return (y % r + f) % r * g % r


def _div(x: Column, y: Column) -> Column:
    """The whole quotient, exact for all bigints."""
    return F.call_function("div", x, y)


def _sides(n: Column) -> tuple[Column, Column]:
    """Columns and lines of the grid."""
    wide = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")
    # the root of a large number may be rounded down
    wide = F.when(wide * wide < n, wide + _long(1)).otherwise(F.greatest(wide, _long(1)))
    return wide, _div(n + wide - _long(1), wide)


def _step(x: Column, wide: Column, high: Column, epoch: Column, seed: int, back: bool) -> Column:
    a, b = x % wide, _div(x, wide)
    for turn in range(HALF_ROUNDS)[:: -1 if back else 1]:
        side, moved, other = (wide, a, b) if turn % 2 == 0 else (high, b, a)
        shift = _hash(other, epoch, seed, turn) % side
        moved = (moved + (side - shift if back else shift)) % side
        a, b = (moved, b) if turn % 2 == 0 else (a, moved)
    return a + b * wide


def _permuted(x, n, epoch, seed: int, back: bool) -> Column:
    x, n, epoch = (F.lit(c).cast("bigint") if isinstance(c, int) else col(c).cast("bigint") for c in (x, n, epoch))
    wide, high = _sides(n)
    first = _step(x, wide, high, epoch, seed, back)
    walk = F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), first, lambda y, _: F.when(y < n, y).otherwise(_step(y, wide, high, epoch, seed, back)))
    return F.when(first < n, first).otherwise(walk)


def place(index, n, seed: int, epoch=0) -> Column:
    """The place of the row of a number (0 to n - 1) in an epoch's order. n, epoch: numbers or columns; n up to 2**61."""
    return _permuted(index, n, epoch, seed, back=False)


def row_at(place, n, seed: int, epoch=0) -> Column:
    """The number of the row at a place: the inverse of place()."""
    return _permuted(place, n, epoch, seed, back=True)
