"""Best-fit packing of token sequences after a dominance reduction (Martello and Toth).

Documents become pieces of at most ``capacity`` tokens. Pieces of equal length are interchangeable, so the instance
is the histogram of lengths, which has at most ``capacity`` rows however large the corpus is. On it, sets of up to
three lengths that provably dominate every other way of placing their largest member are fixed for good, as many at
once as there are; what remains goes best-fit decreasing, again in bulk. The resulting plan of ranges
(length, ranks, sequences, offset) is applied to pieces ranked by length in two levels: parts of at most some PART
pieces are dealt out, each with the ranks its lengths begin at, so a length that holds most rows is never gathered in
one task and nothing but the plan is broadcast.

Defined results: a null text is empty and becomes the one token ``end``; repeated rows are packed each on their own;
an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surety.llm.common import map_batches, materialise
from surety.llm.tokens import ByteEncoder

#: Pieces ranked together, in one task.
PART = 50_000


@lru_cache(maxsize=2)
def encoder(tokenizer: str, ranks: str | None) -> ByteEncoder:
    return ByteEncoder(tokenizer, ranks)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, and before them what is left over."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(df: DataFrame, tokenizer: str, ranks: str | None = None, text="text", key="doc_id", capacity=2048, end=0) -> DataFrame:
    """One row per piece; ``part`` numbers runs of about PART pieces that one task made, for ranking."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        enc = encoder(tokenizer, ranks)
        part, made = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            keys, rows = batch.column(key), []
            for i, t in enumerate(batch.column(text).to_pylist()):
                ids = array("I", enc.ids(t or ""))
                ids.append(end)
                raw = memoryview(ids).cast("B")
                rows += [(i, p, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for p, (s, n) in enumerate(cut(len(ids), capacity))]
            if made > PART:
                part, made = part + 1, 0
            made += len(rows)
            at, piece, start, length, crc = map(list, zip(*rows)) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(at), pa.int64())],
                names=[key, "piece", "start", "length", "ids_crc32", "part"],
            )

    return map_batches(df.select(key, text), run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, part long")


class Plan:
    """Ranges (length, first rank, count, first sequence, offset); count sequences get one piece each."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {k: n for k, n in counts.items() if n}
        self.taken = dict.fromkeys(self.left, 0)
        self.lengths = sorted(self.left)
        self.ranges: list[tuple[int, int, int, int, int]] = []
        self.sequences = self.fixed = 0
        self._reduce()
        self._best_fit()

    def _take(self, length: int, n: int, first: int, offset: int) -> None:
        self.ranges.append((length, self.taken[length], n, first, offset))
        self.taken[length] += n
        self.left[length] -= n
        if not self.left[length]:
            self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def _fix(self, lengths: list[int]) -> None:
        """Fill as many sequences with these lengths as there are pieces for."""
        n = min(self.left[x] // lengths.count(x) for x in lengths)
        offset = 0
        for x in lengths:
            self._take(x, n, self.sequences, offset)
            offset += x
        self.sequences += n
        self.fixed += n

    def _smallest(self, own: int, k: int) -> list[int]:
        """Up to k smallest lengths that remain beside one piece of the length own."""
        out = []
        for x in self.lengths:
            out += [x] * min(k, self.left[x] - (x == own))
            if len(out) >= k:
                break
        return out[:k]

    def _pairs(self, own: int, room: int) -> tuple[int, int]:
        """Of the pairs that fit beside own: the largest sum and the largest smaller member."""
        best = least = 0
        spare = lambda x: self.left[x] - (x == own)
        fits = [x for x in self.lengths[: bisect.bisect_right(self.lengths, room)] if spare(x)]
        i, j = 0, len(fits) - 1
        while i <= j:
            a, b = fits[i], fits[j]
            if a + b > room:
                j -= 1
            else:
                if i < j or spare(a) > 1:
                    best, least = max(best, a + b), max(least, a)
                i += 1
        return best, least

    def _dominant(self, own: int) -> list[int] | None:
        """A feasible set with own that dominates all others with it, if the criterion proves one."""
        room = self.capacity - own
        at = bisect.bisect_right(self.lengths, room) - 1
        while at >= 0 and self.left[self.lengths[at]] - (self.lengths[at] == own) < 1:
            at -= 1
        if at < 0:
            return [own]
        mate = self.lengths[at]
        if mate == room:
            return [own, mate]
        small = self._smallest(own, 3)
        if len(small) < 2 or small[0] + small[1] > room:
            return [own, mate]
        if len(small) == 3 and sum(small) <= room:
            return None
        best, least = self._pairs(own, room)
        if best <= mate:
            return [own, mate]
        third = bisect.bisect_right(self.lengths, room - mate) - 1
        while third >= 0 and self.left[x := self.lengths[third]] - (x == own) - (x == mate) < 1:
            third -= 1
        if third >= 0 and least <= self.lengths[third]:
            return [own, mate, self.lengths[third]]
        return None

    def _reduce(self) -> None:
        again = True
        while again:
            again = False
            for own in reversed(list(self.lengths)):
                while self.left.get(own) and (found := self._dominant(own)):
                    self._fix(found)
                    again = True

    def _best_fit(self) -> None:
        open_, rooms = {}, []  # room left -> [(first sequence, how many)]
        def put(room, first, n):
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append((first, n))

        for length in reversed(list(self.lengths)):
            while n := self.left[length]:
                at = bisect.bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    first, have = open_[room].pop()
                    if not open_[room]:
                        del open_[room], rooms[at]
                else:
                    room, first, have = self.capacity, self.sequences, n
                each = room // length
                if n < each:
                    each, used = n, 1
                else:
                    used = min(have, n // each)
                if room == self.capacity and first == self.sequences:
                    self.sequences += used
                    have = used
                for k in range(each):
                    self._take(length, used, first, self.capacity - room + k * length)
                if have > used:
                    put(room, first + used, have - used)
                if room > each * length:
                    put(room - each * length, first, used)


def pack(made: DataFrame, key="doc_id", capacity=2048) -> DataFrame:
    """The pieces with sequence_id and offset. made: the result of pieces()."""
    made = materialise(made, "pieces")
    by = materialise(made.groupBy("length", "part").agg(F.count("*").alias("_n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    plan = Plan(counts, capacity)
    table: dict[int, list] = {}
    for length, rank, n, first, offset in plan.ranges:
        table.setdefault(length, []).append((rank, first, offset))
    lookup = {k: np.array(sorted(v), np.int64).T for k, v in table.items()}
    share = made.sparkSession.sparkContext.broadcast(lookup)  # grows with the capacity, not with the corpus
    start = F.sum("_n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = by.select("part", F.struct("length", F.coalesce(start, F.lit(0)).alias("n")).alias("at")).groupBy("part").agg(F.collect_list("at").alias("starts"))
    names = [key, "piece", "start", "length", "ids_crc32"]
    kind = dict(made.dtypes)[key]

    def place(rows: pa.Table, before: pa.Table) -> pa.Table:
        """The pieces of one part, ranked by key inside each length and sent to the ranges of the plan."""
        at = before.column("starts").combine_chunks().values
        known = dict(zip(at.field("length").to_pylist(), at.field("n").to_pylist(), strict=True))
        rows = rows.sort_by([(c, "ascending") for c in ("length", key, "piece", "start", "ids_crc32")])
        length = rows.column("length").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        edges = np.flatnonzero(np.diff(length, prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(length)], strict=True):
            rank = known[int(length[a])] + np.arange(b - a)
            ranks, first, offsets = share.value[int(length[a])]
            found = np.searchsorted(ranks, rank, "right") - 1
            sequence[a:b], offset[a:b] = first[found] + rank - ranks[found], offsets[found]
        return rows.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return made.groupBy("part").cogroup(starts.groupBy("part")).applyInArrow(place, schema)


def pack_documents(df: DataFrame, tokenizer: str, ranks: str | None = None, text="text", key="doc_id", capacity=2048, end=0) -> DataFrame:
    return pack(pieces(df, tokenizer, ranks, text, key, capacity, end), key, capacity)
