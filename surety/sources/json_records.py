"""Records of one large JSON document, read by many tasks.

A document such as {"Questions": [{...}, {...}]} is read as text cut at closing braces, so that files are split into
byte ranges like any text. Whether a brace counts depends on what precedes it: on being inside a string, and on the depth
of brackets. A byte range is therefore summarised as an automaton's transition: whether it flips the string state, and how
far it changes the depth from either state. The transitions of a file's ranges, a row each, are composed in order; then
every range knows its first state and cuts out its records by itself. Only what a border cuts through is put together from
its parts, a group for each cut record, and every record is parsed on its own.

Defined results: records are the objects directly inside the array of the given field of the outermost object (of the
outermost array without a field); other values in it are no records, and arrays under other keys are passed over. A
record cut off by the end of a file is lost, one that isn't valid JSON has null fields, and an empty file has no records.
Several files are read in the order of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surety.sources.shared import beside, once

QUOTE, ESCAPE, OPEN, CLOSE, OPEN_LIST, CLOSE_LIST = b'"\\{}[]'
#: What precedes an array's bracket: the end of its key. Keys are looked for in so many bytes.
KEY_REACH = 4096


def _strings(data: np.ndarray) -> np.ndarray:
    """Whether each byte is inside a string, if the first one is not; data begins after an unescaped byte."""
    quote = data == QUOTE
    escapes = np.flatnonzero(data == ESCAPE)
    if len(escapes):
        # what follows a run of an odd number of escapes is escaped
        ends = np.flatnonzero(np.diff(escapes, append=escapes[-1] + 2) != 1)
        starts = np.concatenate([[0], ends[:-1] + 1])
        odd = escapes[ends[(ends - starts) % 2 == 0]] + 1
        quote[odd[odd < len(data)]] = False
    return np.logical_xor.accumulate(quote)


def _signs(data: np.ndarray) -> np.ndarray:
    return ((data == OPEN) | (data == OPEN_LIST)).astype(np.int8) - ((data == CLOSE) | (data == CLOSE_LIST))


def transition(data: bytes) -> tuple[bool, int, int]:
    """(whether the string state flips, change of depth from outside a string, from inside one)."""
    if not data:
        return False, 0, 0
    bytes_ = np.frombuffer(data, np.uint8)
    inside, sign = _strings(bytes_), _signs(bytes_)
    return bool(inside[-1]), int(sign[~inside].sum()), int(sign[inside].sum())


class Cutter:
    """Cuts a byte range, given in parts, into records; level is the depth of their array."""

    def __init__(self, inside: bool, depth: int, level: int):
        self.inside, self.depth, self.level = inside, depth, level
        #: parts of the open record, whether it began in this range, the key of the open array (None: an earlier range's)
        self.open: list[bytes] | None = [] if depth > level else None
        self.began, self.key, self.before = False, None, b""

    def cut(self, data: bytes) -> Iterator[tuple[str, bytes, str | None]]:
        """(kind, text, key of its array) of the records that end in data."""
        raw = np.frombuffer(data, np.uint8)
        if not len(raw):
            return
        strings = _strings(raw) ^ self.inside
        at = np.flatnonzero((_signs(raw) != 0) & ~strings)
        depth = self.depth + np.cumsum(_signs(raw[at]), dtype=np.int64)
        begins = (raw[at] == OPEN) & (depth == self.level + 1)
        ends = (raw[at] == CLOSE) & (depth == self.level)
        arrays = (raw[at] == OPEN_LIST) & (depth == self.level)
        start = 0
        for i in np.flatnonzero(begins | ends | arrays):
            place = int(at[i])
            if arrays[i]:
                self.key = self._key((self.before + data[max(0, place - KEY_REACH) : place])[-KEY_REACH:])
            elif begins[i]:
                self.open, self.began, start = [], True, place
            elif self.open is not None:
                yield "whole" if self.began else "head", b"".join([*self.open, data[start : place + 1]]), self.key
                self.open = None
        if self.open is not None:
            self.open.append(data[start:])
        self.before = (self.before + data[-KEY_REACH:])[-KEY_REACH:]
        self.inside = bool(strings[-1])
        self.depth = int(depth[-1]) if len(depth) else self.depth

    @staticmethod
    def _key(before: bytes) -> str:
        """The key whose value begins after these bytes, as it is written; '' if there is none."""
        text = before.rstrip(b" \t\r\n")
        if not text.endswith(b":"):
            return ""
        text = text[:-1].rstrip(b" \t\r\n")
        end = len(text) - 1
        start = text.rfind(b'"', 0, end)
        while start > 0:
            run = start - len(text[:start].rstrip(b"\\"))
            if run % 2 == 0:
                break
            start = text.rfind(b'"', 0, start)
        return text[start + 1 : end].decode("utf-8", "replace")

    def rest(self) -> Iterator[tuple[str, bytes, str | None]]:
        """What is open at the end of the range."""
        if self.open is not None:
            yield "tail" if self.began else "middle", b"".join(self.open), self.key


def _ranges(batches) -> Iterator[tuple[tuple, bytes, list]]:
    """(file and range, bytes, the row's further columns) of each run of rows of one range in a batch."""
    for batch in batches:
        file, block = batch.column("_file").to_pylist(), batch.column("_block").to_pylist()
        # the brace at which the text was cut belongs to it
        texts = [x.encode() + b"}" for x in batch.column("value").to_pylist()]
        i = 0
        while i < len(texts):
            j = i
            while j < len(texts) and file[j] == file[i] and block[j] == block[i]:
                j += 1
            yield (file[i], block[i]), b"".join(texts[i:j]), [c[i].as_py() for c in batch.columns[3:]]
            i = j


def _composed(parts: DataFrame) -> DataFrame:
    """Adds _inside and _depth, the state before each range, from the transitions of the ranges before it in its file.

    Whether a range begins inside a string is the parity of the flips before it, so the changes that apply are known
    and are summed.
    """
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    flips = F.coalesce(F.sum(F.col("flips").cast("bigint")).over(before), F.lit(0)) % 2 == 1
    parts = parts.withColumn("_inside", flips)
    change = F.when(F.col("_inside"), F.col("inside")).otherwise(F.col("outside"))
    return parts.withColumn("_depth", F.coalesce(F.sum(change).over(before), F.lit(0))).select("_file", "_block", "_inside", "_depth")


def read_records(spark: SparkSession, path: str, schema, field: str | None = None) -> DataFrame:
    """(_file, _block, _at, record) of each record: parsed by the schema, ordered by the first three columns."""
    level = 1 if field is None else 2
    raw = spark.read.option("lineSep", "}").text(path)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    raw = raw.select(*place, "value")

    def summarise(batches):
        now, total = None, (False, 0, 0)
        for where, data, _ in _ranges(batches):
            if where != now:
                if now is not None:
                    yield _row(now, total)
                now, total = where, (False, 0, 0)
            flips, outside, inside = transition(data)
            was, out, in_ = total
            # from either first state, the state before this part decides which of its changes applies
            total = was ^ flips, out + (inside if was else outside), in_ + (outside if was else inside)
        if now is not None:
            yield _row(now, total)

    def _row(where, total):
        names = ["_file", "_block", "flips", "outside", "inside"]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*where, *total)], names=names)

    states = _composed(raw.mapInArrow(summarise, "_file string, _block long, flips boolean, outside long, inside long"))
    ranges, by_broadcast = beside(once(states))
    joined = raw.withColumn("_at", F.monotonically_increasing_id()).join(ranges, ["_file", "_block"])
    if not by_broadcast:
        joined = joined.sortWithinPartitions("_file", "_block", "_at")
    joined = joined.select("_file", "_block", "value", "_inside", "_depth")

    def cut(batches):
        now, cutter, made, size, at = None, None, [], 0, 0
        for where, data, state in _ranges(batches):
            if where != now:
                if cutter is not None:
                    made += [(*now, at, *x) for x in cutter.rest()] + [(*now, -1, "keys", b"", cutter.key)]
                now, cutter = where, Cutter(*state, level)
                at = 0
            for found in cutter.cut(data):
                made.append((*where, at, *found))
                at, size = at + 1, size + len(found[1])
            if size > 1 << 22:
                yield _rows(made)
                made, size = [], 0
        if cutter is not None:
            made += [(*now, at, *x) for x in cutter.rest()] + [(*now, -1, "keys", b"", cutter.key)]
        yield _rows(made)

    def _rows(made):
        file, block, at, kind, text, key = zip(*made) if made else ((),) * 6
        return pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(block, pa.int64()), pa.array(at, pa.int64()), pa.array(kind, pa.string()), pa.array([t.decode("utf-8", "replace") for t in text], pa.string()), pa.array(key, pa.string())], names=["_file", "_block", "_at", "kind", "text", "key"])

    rows = once(joined.mapInArrow(cut, "_file string, _block long, _at long, kind string, text string, key string"))
    # a row a range: the array that is open when it begins, and the range where the record that is cut by its start began
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tails = rows.where("kind = 'tail'").select("_file", "_block", F.lit(True).alias("tail"))
    marks = rows.where("kind = 'keys'").select("_file", "_block", "key").join(tails, ["_file", "_block"], "left")
    open_key = F.last("key", ignorenulls=True).over(earlier).alias("open_key")
    owner = F.last(F.when(F.col("tail"), F.col("_block")), ignorenulls=True).over(earlier).alias("owner")
    marks, _ = beside(once(marks.select("_file", "_block", open_key, owner)))
    found = rows.where("kind != 'keys'").join(marks, ["_file", "_block"]).withColumn("key", F.coalesce("key", "open_key"))
    whole = found.where("kind = 'whole'").select("_file", "_block", "_at", "text", "key")
    parts = found.where("kind != 'whole'").withColumn("_own", F.when(F.col("kind") == "tail", F.col("_block")).otherwise(F.col("owner")))
    # one cut record in a group; the part in its own range comes first and carries the key
    piece = F.sort_array(F.collect_list(F.struct("_block", "text", "kind", "key", "_at")))
    joined_parts = parts.where("_own is not null").groupBy("_file", F.col("_own").alias("_block")).agg(piece.alias("p")).where(F.exists("p", lambda x: x["kind"] == "head"))
    cut_ones = joined_parts.select("_file", "_block", F.col("p")[0]["_at"].alias("_at"), F.array_join(F.col("p.text"), "").alias("text"), F.col("p")[0]["key"].alias("key"))
    records = whole.unionByName(cut_ones)
    if field is not None:
        records = records.where(F.col("key") == field)
    return records.select("_file", "_block", "_at", F.from_json("text", schema).alias("record"))
