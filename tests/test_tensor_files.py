"""Tensor files: hand-made bytes, round trips bit for bit, byte ranges and damaged files."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from surety.sources import sinks, tensor_files
from surety.sources.tensor_files import decode, encode, read_tensors, write_tensors


def made(tensors, metadata=None, pad=b""):
    """A file by hand: (name, type, shape, bytes)."""
    at, head, body = 0, {"__metadata__": metadata} if metadata else {}, b""
    for name, kind, shape, data in tensors:
        head[name] = {"dtype": kind, "shape": shape, "data_offsets": [at, at + len(data)]}
        at, body = at + len(data), body + data
    text = json.dumps(head).encode() + pad
    return struct.pack("<Q", len(text)) + text + body


def rows_of(df):
    out = {}
    for r in df.orderBy("name", "pos").collect():
        out.setdefault(r.name, []).append(r.value)
    return out


@pytest.mark.parametrize("chunk", [1, 3, 4_000_000])
def test_hand_made_files(spark, tmp_path, chunk):
    a, b = [1.5, -2.0, float("inf"), 0.1, -0.0, 3e-45], [0.5, 65504.0, -1.0, 2.0]
    data = made([("a", "F32", [2, 3], struct.pack("<6f", *a)), ("b/é", "F16", [4], struct.pack("<4e", *b)), ("c", "BF16", [2, 1], bytes.fromhex("803f40c0")), ("d", "F64", [], struct.pack("<d", 0.1)), ("none", "F32", [0, 5], b"")], {"format": "x"}, b"  ")
    (tmp_path / "one.safetensors").write_bytes(data)
    (tmp_path / "note.txt").write_text("no weights")
    got = rows_of(read_tensors(spark, str(tmp_path), chunk=chunk))
    assert got == {"a": [struct.unpack("<f", struct.pack("<f", x))[0] for x in a], "b/é": b, "c": [1.0, -3.0], "d": [0.1]}
    listed = {r.name: (r.dtype, r.shape, r.n) for r in tensor_files.list_tensors(spark, str(tmp_path / "one.safetensors")).collect()}
    assert listed["a"] == ("F32", [2, 3], 6) and listed["d"] == ("F64", [], 1) and listed["none"][2] == 0


@pytest.mark.parametrize("kind", ["F64", "F32", "F16", "BF16"])
def test_codecs_keep_every_value_of_their_type(kind):
    rng = np.random.default_rng(1)
    width = tensor_files.WIDTHS[kind]
    bits = np.arange(1 << 16, dtype="<u2").tobytes() if width == 2 else rng.bytes(width * 50_000)
    values = decode(bits, kind)
    back = encode(values, kind)
    kind_of = {2: "<u2", 4: "<u4", 8: "<u8"}[width]
    a, b = np.frombuffer(bits, kind_of), np.frombuffer(back, kind_of)
    finite = ~np.isnan(values)
    assert np.array_equal(a[finite], b[finite]) and np.isnan(decode(back, kind)[~finite]).all()


def test_rounding_to_the_nearest():
    assert decode(encode(np.array([1.0 + 2**-8, 1.0 + 3 * 2**-8, 1.0 + 2**-8 + 2**-20, 3.4e38, 1e300]), "BF16"), "BF16").tolist() == [1.0, 1.0 + 2**-6, 1.0 + 2**-7, float("inf"), float("inf")]


@pytest.mark.parametrize("kind, files", [("F32", 3), ("BF16", 1), ("F64", 8)])
def test_round_trip(spark, tmp_path, kind, files):
    path = f"{tmp_path}/w"
    df = spark.range(5000).select(F.concat(F.lit("layer."), F.col("id") % 7).alias("name"), F.floor(F.col("id") / 7).alias("pos"), (F.col("id") * 0.37 - 900).alias("value"))
    exact = df.withColumn("value", F.col("value").cast("float").cast("double"))
    if kind == "BF16":
        exact = df.withColumn("value", F.round("value") % 128)
    written = write_tensors(exact.orderBy(F.rand(3)), path, kind, {"layer.0": [5, 143]}, files)
    assert written.agg(F.sum("tensors")).first()[0] == 7 and written.count() <= files
    assert rows_of(read_tensors(spark, path, chunk=100)) == rows_of(exact)
    assert {r.name: r.shape for r in tensor_files.list_tensors(spark, path).collect()}["layer.0"] == [5, 143]
    write_tensors(exact, path, kind, files=files)
    assert read_tensors(spark, path).count() == 5000
    assert read_tensors(spark, path, with_file=True).select("file").distinct().count() == written.count()


def test_one_large_tensor_is_read_by_many_tasks(spark, tmp_path):
    values = np.arange(3_000_000, dtype="<f4")
    (tmp_path / "big.safetensors").write_bytes(made([("w", "F32", [3_000_000], values.tobytes())]))
    df = read_tensors(spark, str(tmp_path), chunk=100_000)
    tasks = df.select(F.spark_partition_id().alias("p")).distinct().count()
    n, off = df.agg(F.count("*"), F.sum(F.abs(F.col("value") - F.col("pos")))).first()
    assert n == 3_000_000 and off == 0 and tasks > 10


@pytest.mark.parametrize(
    "data",
    [b"short", struct.pack("<Q", 1 << 40) + b"{}", made([("a", "F32", [3], bytes(8))]), made([("a", "F32", [2], bytes(8))])[:-1], made([("a", "I64", [1], bytes(8))])],
)
def test_damaged_files_are_errors(spark, tmp_path, data):
    (tmp_path / "bad.safetensors").write_bytes(data)
    with pytest.raises(Exception):
        read_tensors(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("rows", [[("a", 0, 1.0), ("a", 2, 1.0)], [("a", 0, 1.0), ("a", 0, 2.0), ("a", 2, 2.0)], [("a", 1, 1.0)], [("a", 0, None)], [(None, 0, 1.0)]])
def test_incomplete_tensors_are_not_written(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "name string, pos long, value double")
    with pytest.raises(Exception, match="missing or repeated"):
        write_tensors(df, f"{tmp_path}/w")
    assert not list(tmp_path.glob("w/*"))


def test_weights_by_the_paths_ending(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 0.25)], "name string, pos long, value double")
    for path in (f"{tmp_path}/w.safetensors", f"{tmp_path}/w.parquet"):
        sinks.write_weights(df, path)
        assert rows_of(sinks.read_weights(spark, path)) == {"a": [1.0, 0.25]}
    with pytest.raises(ValueError):
        write_tensors(df, f"{tmp_path}/x", "I8")
    with pytest.raises(ValueError):
        write_tensors(df, f"{tmp_path}/x", shapes={"a": [3]})
