"""Weight files in a flat tensor format: eight bytes that give a header's length, a JSON header, and the tensors' bytes.

The header names each tensor with its type, shape and byte range, so that a value is found without reading what precedes it.
Files are read by byte ranges, many tasks to a tensor, and written a file a task. Nothing is ever unpickled. Tasks open
files with pyarrow, so the paths must be of a kind that it knows (local and mounted folders, hdfs, s3, gs and such);
folders are listed by Spark.

Defined results: rows are (name, pos, value) with positions counted through a tensor's values in their stored order;
names of several files are kept apart by the file's name only if asked for; tensors of other types than F64, F32, F16
and BF16 are an error unless they are left out by name; a file whose header or ranges don't fit its length is an error, files of no bytes are passed over.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surety.sources.files import opened
from surety.sources.shared import once

#: The ending of such files; types by name and the bytes of a value. Fixed values.
ENDING = ".safetensors"
WIDTHS = {"F64": 8, "F32": 4, "F16": 2, "BF16": 2}
#: Longest header, as readers of the format have it.
LONGEST_HEADER = 100_000_000
#: Values that a task reads at once, and that a row batch holds.
CHUNK, BATCH = 4_000_000, 262_144
#: Headers are filled up with blanks, so that the values begin at a multiple of this.
ALIGNED = 8


def _values(shape: list[int]) -> int:
    """How many values a shape holds."""
    return math.prod(shape)


def decode(data: bytes, kind: str) -> np.ndarray:
    """Little-endian bytes as doubles."""
    if kind == "BF16":
        return (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32).astype(np.float64)
    return np.frombuffer(data, {"F64": "<f8", "F32": "<f4", "F16": "<f2"}[kind]).astype(np.float64)


def encode(values: np.ndarray, kind: str) -> bytes:
    """Doubles as little-endian bytes, rounded to the nearest (ties to even); what is too large becomes infinite."""
    if kind == "BF16":
        with np.errstate(over="ignore"):
            bits = values.astype(np.float32).view(np.uint32)
        rounded = (bits + 0x7FFF + ((bits >> 16) & 1)) >> 16
        # NaN stays NaN, whatever its bits
        return np.where(np.isnan(values), (bits >> 16) | 0x40, rounded).astype("<u2").tobytes()
    with np.errstate(over="ignore"):
        return values.astype({"F64": "<f8", "F32": "<f4", "F16": "<f2"}[kind]).tobytes()


def read_header(stream, length: int) -> tuple[int, dict]:
    """(where the values begin, the tensors by name) of a file; ValueError if it can't be one."""
    size = int.from_bytes(stream.read(8), "little")
    if length < 8 or not 2 <= size <= min(length - 8, LONGEST_HEADER):
        raise ValueError(f"no header of {size} bytes fits a file of {length}")
    found = json.loads(stream.read(size))
    found.pop("__metadata__", None)
    for name, t in found.items():
        begin, end = t["data_offsets"]
        if not 0 <= begin <= end <= length - 8 - size:
            raise ValueError(f"{name}: bytes {begin} to {end} are outside the file")
        if t["dtype"] in WIDTHS and end - begin != WIDTHS[t["dtype"]] * _values(t["shape"]):
            raise ValueError(f"{name}: {end - begin} bytes don't hold the shape {t['shape']}")
    return 8 + size, found


def list_tensors(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, dtype, shape, start, n): the tensors of a file or folder, from the headers alone."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where(F.endswith("path", F.lit(ENDING)))

    def headers(batches):
        for batch in batches:
            rows = []
            for p, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, name = opened(p)
                with system.open_input_file(name) as f:
                    begin, found = read_header(f, length)
                rows += [(p, k, t["dtype"], t["shape"], begin + t["data_offsets"][0], _values(t["shape"])) for k, t in found.items()]
            columns = zip(*rows) if rows else ((),) * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "name", "dtype", "shape", "start", "n"])

    return files.mapInArrow(headers, "file string, name string, dtype string, shape array<bigint>, start bigint, n bigint")


def read_tensors(spark: SparkSession, path: str, with_file=False, chunk: int = CHUNK) -> DataFrame:
    """(name, pos, value), and file if asked for. A tensor of more than chunk values is read by several tasks."""
    tensors = list_tensors(spark, path)
    known = F.col("dtype").isin(*WIDTHS)
    checked = tensors.withColumn("dtype", F.when(known, F.col("dtype")).otherwise(F.raise_error(F.concat(F.lit("no weights of type "), "dtype", F.lit(" in "), "name"))))
    parts = checked.where("n > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(chunk).cast("bigint"))))
    # written, so that the number of parts is known: some CHUNK values go to a task, but small inputs to all cores
    parts = once(parts)
    n, total = parts.agg(F.count("*"), F.sum(F.least(F.lit(chunk), F.col("n") - F.col("first")))).first()
    dealt = parts.repartition(max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, (total or 0) // CHUNK))), "file", "name", "first")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                width, last = WIDTHS[r["dtype"]], min(r["n"], r["first"] + chunk)
                system, name = opened(r["file"])
                with system.open_input_file(name) as f:
                    for at in range(r["first"], last, BATCH):
                        n = min(BATCH, last - at)
                        values = decode(f.read_at(n * width, r["start"] + at * width), r["dtype"])
                        columns = [pa.repeat(r["name"], n), pa.array(np.arange(at, at + n)), pa.array(values)] + ([pa.repeat(r["file"], n)] if with_file else [])
                        yield pa.RecordBatch.from_arrays(columns, names=["name", "pos", "value", "file"][: len(columns)])

    return dealt.mapInArrow(run, "name string, pos bigint, value double" + ", file string" * with_file)


def _header(tensors: list[tuple[str, int, list[int]]], kind: str) -> bytes:
    at, out = 0, {}
    for name, n, shape in tensors:
        out[name] = {"dtype": kind, "shape": shape, "data_offsets": [at, at + n * WIDTHS[kind]]}
        at += n * WIDTHS[kind]
    text = json.dumps(out, ensure_ascii=False, separators=(",", ":")).encode()
    text += b" " * (-len(text) % ALIGNED)
    return len(text).to_bytes(8, "little") + text


def _places(tensors) -> list[list[int]]:
    """What _check() has still to see: the next position and the size of each tensor in turn."""
    return [[0, n] for _, n, _ in reversed(tensors)]


def _check(following: list[list[int]], pos: np.ndarray) -> None:
    """Whether the positions go on without gaps or repeats."""
    while len(pos):
        at, n = following[-1]
        now = min(n - at, len(pos))
        if not np.array_equal(pos[:now], np.arange(at, at + now)):
            raise ValueError(f"positions are missing or repeated from {at} on")
        following[-1][0], pos = at + now, pos[now:]
        if at + now == n:
            following.pop()


def write_tensors(df: DataFrame, path: str, kind: str = "F32", shapes: dict[str, list[int]] | None = None, files: int | None = None) -> DataFrame:
    """Writes (name, pos, value) to files of path, whole tensors to a file; returns (file, tensors, bytes).

    Values stream through a task in their order; a file appears under its name only once it is complete, so a task that
    runs again replaces what it made. Every position from 0 must be there once. shapes: by name, else one dimension.
    """
    if kind not in WIDTHS:
        raise ValueError(f"unknown type {kind!r}; one of {', '.join(WIDTHS)}")
    spark = df.sparkSession
    rows = df.select("name", F.col("pos").cast("bigint").alias("pos"), F.col("value").cast("double").alias("value"))
    sizes = once(rows.groupBy("name").agg(F.count("*").alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.count("value").alias("values")))
    bad = sizes.where("name is null or low != 0 or high != n - 1 or values != n").select("name").limit(5).collect()
    if bad:
        raise ValueError(f"positions or values are missing or repeated in {', '.join(str(r.name) for r in bad)}")
    wanted = shapes or {}
    wrong = [r.name for r in sizes.where(F.col("name").isin(*wanted)).collect() if _values(wanted[r.name]) != r.n] if wanted else []
    if wrong:
        raise ValueError(f"shapes don't hold the values of {', '.join(wrong)}")
    system, root = opened(path)
    system.create_dir(root)
    # a task's names and sizes come before all values, so that it can write the header first
    heads = sizes.select("name", F.lit(-1).cast("bigint").alias("pos"), F.lit(0.0).alias("value"), "n")
    both = heads.unionByName(rows.withColumn("n", F.lit(None).cast("bigint")))
    dealt = both.repartition(files or spark.sparkContext.defaultParallelism, "name").sortWithinPartitions(F.col("pos") >= 0, "name", "pos")

    def run(batches):
        system, root = opened(path)
        part = f"{root}/.{uuid.uuid4().hex}"
        tensors: list[tuple[str, int, list[int]]] = []
        stream, total, following = None, 0, []
        try:
            for batch in batches:
                names, pos = batch.column("name"), np.asarray(batch.column("pos"))
                head = int((pos < 0).sum())
                tensors += [(name, n, wanted.get(name, [n])) for name, n in zip(names[:head].to_pylist(), batch.column("n")[:head].to_pylist())]
                if head == len(pos):
                    continue
                if stream is None:
                    stream, following = system.open_output_stream(part), _places(tensors)
                    total += stream.write(_header(tensors, kind))
                _check(following, pos[head:])
                total += stream.write(encode(np.asarray(batch.column("value"))[head:], kind))
            if stream is not None:
                stream.close()
                # named by what it holds, so that a task which runs again replaces its own file
                held = chr(0).join(name for name, *_ in tensors)
                final = f"{root}/weights-{uuid.uuid5(uuid.NAMESPACE_OID, held).hex}{ENDING}"
                system.move(part, final)
                yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([len(tensors)]), pa.array([total])], names=["file", "tensors", "bytes"])
        except BaseException:
            if stream is not None:
                stream.close()
                system.delete_file(part)
            raise

    return once(dealt.mapInArrow(run, "file string, tensors bigint, bytes bigint"))
