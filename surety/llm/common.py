"""Shared helpers: table reads, shared-folder materialisation and checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows are at most this; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The session setting that holds the secret of pseudonyms, and what stands in for it on sample tables.
SECRET, SAMPLE_SECRET = "spark.surety.pseudonym.secret", "sample tables only"


def secret(spark: SparkSession) -> str:
    """The session's secret for pseudonyms; without one, pseudonyms can be inverted by anyone who reads this."""
    return spark.conf.get(SECRET, SAMPLE_SECRET)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, one is made for local masters only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            return made.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="surety-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _delete(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by materialise() whose last reader has run."""
    for t in tables:
        if t._written in _WRITTEN:
            _WRITTEN.remove(t._written)
            _delete(t.sparkSession, t._written)


def written() -> int:
    """How many tables stand; forget() deletes those written after such a mark."""
    return len(_WRITTEN)


def forget(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Deletes the tables written to the shared folder since a mark, but for one, once their readers are done."""
    gone = [p for p in _WRITTEN[since:] if keep is None or p != keep._written]
    _WRITTEN[since:] = [p for p in _WRITTEN[since:] if p not in gone]
    return sum(_delete(spark, p) for p in gone)


def small_side(df: DataFrame, rows: int | None = None, limit: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows are at most limit (BROADCAST_ROWS), else unchanged."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= (BROADCAST_ROWS if limit is None else limit) else df


def digest_unit(*parts):
    """A double in [0, 1) from the first 52 bits of the md5 of the parts joined by ':'."""
    return digest_long(*parts) / F.lit(float(16**13))


def digest_long(*parts):
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


#: The column that packed() makes; columns of the input can't clash with an operator's own inside it.
ROW = "_row"


def packed(df: DataFrame) -> DataFrame:
    """df with all its columns in one struct, so that whatever they are called, they don't meet working columns."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW))


def unpacked(columns: list[str], *added: str) -> list:
    """The columns of packed() but for those that the added ones replace, then the added ones."""
    return [F.col(ROW)[c].alias(c) for c in columns if c not in added] + [F.col(a) for a in added]


#: Rows and bytes of an Arrow batch on its way to Python, so that long texts don't pile up in a worker.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow in batches of bounded size; a worker gives its free memory back when its task ends."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def bounded(batches):
        yield from run(batches)
        release()

    return df.mapInArrow(bounded, schema)


def release() -> None:
    """Hands free memory back to the system, which other tasks of the executor need."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
