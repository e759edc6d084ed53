"""Training runs as streams: best loss so far, periodic triggers, and a metric log that a replay doesn't repeat."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from surety.sources import sinks

#: The session setting that names the state store, and the one that processors with named state need. Fixed values.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The setting from which a new query takes the number of its state's parts; rows that a part may see.
PARTS = "spark.sql.shuffle.partitions"
PART_ROWS = 250_000


@contextmanager
def named_state(spark: SparkSession, rows: int | None = None):
    """The session with the state store that processors with named state need, while queries are started. rows: how many
    a new query is to see, from which the number of its state's parts follows (every part costs a store and a worker in
    every trigger); without it the session's number holds."""
    settings = {STORE: ROCKS}
    if rows is not None:
        settings[PARTS] = str(max(spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS)))
    was = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield spark
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


class BestSoFar(StatefulProcessor):
    """Keeps a run's last iteration and least loss: two numbers a run, however long it is.

    A run's rows of one trigger are put in order, in memory; a row whose iteration isn't beyond the last one (a repeated
    or late row) gives nothing, so that a log which is sent again changes nothing.
    """

    def __init__(self, every: int, names: tuple[str, str, str]):
        self.every, self.made = every, T.Row(*names, "best", "due")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("progress", T.StructType([T.StructField("last", T.LongType()), T.StructField("least", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[T.Row], timerValues) -> Iterator[T.Row]:
        # plain rows: most runs have a few in a trigger, which a data frame each would make dear
        found = sorted((r[1], r[2]) for r in rows)
        last, least = self.state.get() or (None, None)
        if last is not None and found[-1][0] <= last:
            return
        for iteration, loss in found:
            if last is None or iteration > last:
                best = least is None or loss < least
                yield self.made(key[0], iteration, loss, best, iteration % self.every == 0)
                last, least = iteration, loss if best else least
        self.state.update((last, least))

    def close(self) -> None:
        pass


def running_best(stream: DataFrame, every: int, run="run", iteration="iteration", loss="loss") -> DataFrame:
    """(run, iteration, loss, best, due): whether a loss is below all before it in its run, and whether a period is
    due. The query starts inside named_state(); rows without an iteration or a loss are left out."""
    kind = {f.name: f.dataType for f in stream.schema}
    schema = T.StructType([T.StructField(run, kind[run]), T.StructField(iteration, T.LongType()), T.StructField(loss, T.DoubleType()), T.StructField("best", T.BooleanType()), T.StructField("due", T.BooleanType())])
    rows = stream.select(run, stream[iteration].cast("bigint").alias(iteration), stream[loss].cast("double").alias(loss)).dropna(subset=[iteration, loss])
    return rows.groupBy(run).transformWithState(BestSoFar(every, (run, iteration, loss)), outputStructType=schema, outputMode="Append", timeMode="None")


def log_metrics(stream: DataFrame, path: str, checkpoint: str, run: str, make: Callable[[DataFrame], DataFrame] | None = None, trigger=None):
    """Starts a query that commits each of the stream's batches (or what make gives for it) to the metric log once: the
    commit is named after the run and the batch, so a batch that is replayed after a failure replaces itself."""

    def commit(batch: DataFrame, number: int) -> None:
        sinks.append_metrics(make(batch) if make else batch, path, f"{run}-{number}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
