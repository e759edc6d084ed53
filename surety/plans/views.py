"""Canonical views of the sample tables as confidence trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surety.operators import containment as contain
from surety.sources import shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trial_binary(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("k"), (F.col("l_returnflag") == "R").cast("int").alias("correct"), (F.col("l_linestatus") == "F").cast("int").alias("yes"))


def trial_orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).cast("int").alias("k"), (F.col("o_orderstatus") == "F").cast("int").alias("correct"), F.col("o_orderpriority").alias("meta_output"))


def trial_events(spark, sf_dir) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    grade = F.least(F.lit(3), F.floor(F.col("value") / 25)).cast("int")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("k"), (k >= 50).cast("int").alias("correct"), grade.alias("grade"), F.col("value").alias("score"))


def trial_docs(spark, sf_dir) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("k"), F.col("quality").alias("correct"), F.col("text").alias("meta_output"))


def logit_rows(spark, sf_dir) -> DataFrame:
    e = lambda i: F.element_at("embedding", i).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 4).alias("grade_logits"), e(5).alias("l_no"), e(6).alias("l_yes"))


def weights(spark, sf_dir) -> DataFrame:
    """One parameter a vector: name is label/vec_id."""
    return table(spark, sf_dir, "embeddings").select(F.concat_ws("/", F.col("label").cast("string"), F.col("vec_id").cast("string")).alias("name"), F.posexplode("embedding").alias("pos", "value")).select("name", F.col("pos").cast("bigint").alias("pos"), F.col("value").cast("double").alias("value"))


def turn_pairs(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    ask = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return ask.join(reply, ["conv_id", "turn"])


def containment(spark, sf_dir, broadcast=shared.BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id) where a document contains a benchmark passage, whatever the case."""
    return contain.containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), item="item_id", limit=broadcast)
