"""Token usage and its price."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.sources.shared import beside

#: Prices in dollars for a million input and output tokens, in the order in which names are tried. Fixed values.
PRICES = (
    ("gemini-3-flash-preview", 0.50, 3.00),
    ("gpt-5.2-2025-12-11", 1.75, 14.00),
    ("claude-sonnet-4-5-20250929", 3.00, 15.00),
)
PER = 1_000_000


def usage_totals(usage: DataFrame, keys: list) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return usage.groupBy(*keys).agg(total("prompt_tokens"), total("completion_tokens"), total("total_tokens"))


def price_table(spark, prices=PRICES) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(prices)], "ordinal int, price_model string, input_price double, output_price double")


def with_cost(totals: DataFrame, prices: DataFrame, model="model") -> DataFrame:
    """Adds input_cost, output_cost and total_cost; null where no price's name contains the model's or is contained.

    Models are few after totalling and the price list is a list, so their substring join is cheap: it compares all of
    one with all of the other, wherever the list stands, and the list travels only if its bytes are few. The first
    listed match counts.
    """
    prices, _ = beside(prices)
    models = totals.select(F.col(model).alias("_m")).distinct()
    either = F.contains(F.col("_m"), F.col("price_model")) | F.contains(F.col("price_model"), F.col("_m"))
    found = models.join(prices, either).groupBy("_m").agg(F.min_by(F.struct("input_price", "output_price"), "ordinal").alias("_p"))
    joined = totals.join(found, F.col(model) == F.col("_m"), "left")
    cost = lambda tokens, price: F.col(tokens) / PER * F.col(f"_p.{price}")
    out = joined.withColumns({"input_cost": cost("prompt_tokens", "input_price"), "output_cost": cost("completion_tokens", "output_price")})
    return out.withColumn("total_cost", F.col("input_cost") + F.col("output_cost")).drop("_m", "_p")
