"""Result files: tab-separated trials, metric tables, weight tables. Missing values become the sentinel at the sink."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.functions.columns import col
from surety.operators.tensor import running_best
from surety.plans import schema
from surety.sources import tensor_files
from surety.sources.shared import beside, once


def result_name(dataset: str, model: str, split: str, n: int, suffix: str | None = None, ending="tsv") -> str:
    parts = [dataset, model.replace("/", "_"), split, str(n), *([suffix] if suffix else [])]
    return "_".join(parts) + f".{ending}"


def result_names(dataset, model, split, n, suffix=None, ending="tsv") -> Column:
    """result_name() of columns; a null suffix is none."""
    parts = [col(dataset), F.replace(col(model), F.lit("/"), F.lit("_")), col(split), col(n).cast("string"), *([] if suffix is None else [col(suffix)])]
    return F.concat(F.concat_ws("_", *parts), F.lit(f".{ending}"))


def _flat(df: DataFrame, columns: list[str], sentinel=schema.IGNORE) -> DataFrame:
    """The columns as text cells: arrays as JSON, missing failures as the sentinel."""
    kinds = dict(df.dtypes)
    out = []
    for c in columns:
        x = F.to_json(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c)
        if c in ("yes_failures", "no_failures"):
            x = F.coalesce(x, F.lit(sentinel))
        out.append(x.alias(c))
    return df.select(*out)


#: Cells keep their blanks, quotes and line breaks, in both directions.
TSV = {"sep": "\t", "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_tsv(spark, path: str, kind=None) -> DataFrame:
    reader = spark.read.options(**TSV, multiLine=True)
    return (reader.schema(kind) if kind else reader).csv(path)


def write_tsv(df: DataFrame, path: str, columns: list[str] | None = None, partition_by=(), mode="error") -> None:
    flat = _flat(df, columns or df.columns)
    writer = flat.write.mode(mode).options(**TSV)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_binary(df: DataFrame, path: str, mode="error") -> None:
    write_tsv(df, path, schema.BINARY_COLUMNS, mode=mode)


def write_graded(df: DataFrame, path: str, mode="error") -> None:
    write_tsv(df, path, schema.GRADED_COLUMNS, mode=mode)


def write_threshold(df: DataFrame, path: str, mode="error") -> None:
    write_tsv(df, path, schema.THRESHOLD_COLUMNS, mode=mode)


#: Abstention and remote evaluations have the binary columns; token counts are not kept.
write_abstention = write_remote = write_binary


def write_transfer_detail(df: DataFrame, path: str, mode="error") -> None:
    write_tsv(df, path, partition_by=("model", "dataset", "meta_type"), mode=mode)


def nested_results(long: DataFrame) -> DataFrame:
    """One JSON object of metrics for each model/dataset/probe."""
    key = F.concat_ws("/", "model", "dataset", "meta_type").alias("key")
    rows = F.sort_array(F.collect_list(F.struct("metric", "value")))
    return long.groupBy(key).agg(F.to_json(F.map_from_entries(rows)).alias("metrics"))


def write_results(long: DataFrame, path: str, mode="error") -> None:
    nested_results(long).write.mode(mode).json(path)


def append_metrics(df: DataFrame, path: str, commit: str | None = None) -> None:
    """The metric log: rows stamped with their iteration, added under the name of a commit.

    A commit that is made again, after a failure or by a retry, replaces itself, so its rows are there once; without a
    name each call is a commit of its own. Until a commit has ended, readers may see it in part.
    """
    commit = commit or uuid.uuid4().hex
    if not re.fullmatch(r"[\w.-]+", commit):
        raise ValueError(f"not a commit's name: {commit!r}")
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/commit={commit}")


def read_metrics(spark, path: str) -> DataFrame:
    """The metric log with the column commit; columns that a commit lacks are null."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    return rows.withColumn("commit", F.regexp_extract("_metadata.file_path", "/commit=([^/]+)/", 1))


def write_weights(df: DataFrame, path: str, mode="error") -> None:
    """A weight table as Parquet, or as tensor files in a folder whose name has their ending."""
    if path.rstrip("/").endswith(tensor_files.ENDING):
        tensor_files.write_tensors(df, path)
    else:
        df.select("name", "pos", "value").write.mode(mode).parquet(path)


def read_weights(spark, path: str) -> DataFrame:
    """A weight table, or tensor files where the path has their ending. Pickled objects are never read."""
    if path.rstrip("/").endswith(tensor_files.ENDING):
        return tensor_files.read_tensors(spark, path)
    return spark.read.schema(schema.WEIGHTS).parquet(path)


def periodic(iteration, every: int):
    """Whether a checkpoint or validation is due."""
    return iteration % every == 0


def due_checkpoints(log: DataFrame, every: int, order="iteration", loss="loss") -> DataFrame:
    """(order, best, due) of the iterations whose weights are kept: those with a loss below all before, every so many,
    and the last. The log has one row an iteration."""
    flagged = log.withColumn("best", running_best(order, loss)).crossJoin(F.broadcast(log.agg(F.max(order).alias("_last"))))
    due = periodic(F.col(order), every) | (F.col(order) == F.col("_last"))
    return flagged.withColumn("due", due).where("best or due").select(order, "best", "due")


def write_checkpoints(weights: DataFrame, log: DataFrame, path: str, every: int, mode="error") -> None:
    """The weights (iteration, name, pos, value) of the iterations that are due, one folder an iteration."""
    due, _ = beside(once(due_checkpoints(log, every)))
    kept = weights.join(due, "iteration", "left_semi")
    kept.select("iteration", "name", "pos", "value").write.mode(mode).partitionBy("iteration").parquet(path)


def best_checkpoint(log: DataFrame, order="iteration", loss="loss"):
    """The iteration of the least loss, the first of equals."""
    return log.agg(F.min_by(order, F.struct(loss, order))).first()[0]
