"""The folder that driver and executors share, and tables written there once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a side may have to be broadcast.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where it names none, one is made for local masters only."""
    sc = spark.sparkContext._jsc.sc()
    if not sc.getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="surety-"))
    return sc.getCheckpointDir().get()


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def once(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder: all readers see the same rows, partitions and numbers."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def measured(df: DataFrame) -> int:
    """Bytes of df's rows: texts and arrays by what they hold, other cells by eight bytes."""
    sized = [F.coalesce(F.octet_length(c) if t in ("string", "binary") else 8 * F.size(c) if t.startswith("array") else F.lit(0), F.lit(0)) for c, t in df.dtypes]
    return df.select(F.sum(sum(sized, F.lit(16 * len(df.columns))))).first()[0] or 0


def beside(df: DataFrame, limit: int | None = None) -> tuple[DataFrame, bool]:
    """(df, whether it is to be broadcast): only where its rows, which are read once for it, have few bytes; else joins
    shuffle."""
    few = measured(df) <= (BROADCAST_BYTES if limit is None else limit)
    return (F.broadcast(df) if few else df), few
