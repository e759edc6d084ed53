"""Implicit confidence from logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.functions.columns import col
from surety.functions.score import GRADES, SCALES


def yes_odds(yes_logit, no_logit) -> Column:
    """Odds of yes against no; a model says yes where they exceed 1."""
    return F.exp(col(yes_logit).cast("double") - col(no_logit).cast("double"))


def odds_confidence(odds) -> Column:
    return 1 - 1 / (col(odds) + 1)


def expected_confidence(logits, options: dict[int, list[int]], max_grade: int) -> Column:
    """Expected grade / max_grade under the softmax over the option tokens; 0.5 without options or mass.

    options: token ids by grade; ids count from 0. The masses of a grade's tokens are added.
    """
    pairs = [(g, i) for g, ids in options.items() for i in ids]
    if not pairs or max_grade <= 0:
        return F.lit(0.5)
    taken = F.array(*[F.struct(F.lit(float(g)).alias("g"), F.element_at(col(logits), i + 1).cast("double").alias("x")) for g, i in pairs])
    top = F.array_max(F.transform(taken, lambda p: p["x"]))
    mass = F.transform(taken, lambda p: F.struct(p["g"].alias("g"), F.exp(p["x"] - top).alias("m")))
    add = lambda f: F.aggregate(mass, F.lit(0.0), lambda a, p: a + f(p))
    total = add(lambda p: p["m"])
    return F.when(total > 0, add(lambda p: p["g"] * p["m"]) / total / max_grade).otherwise(0.5)


def option_variants(meta_type: str) -> dict[int, list[str]]:
    """Spellings of each grade whose first token counts for it."""
    if meta_type == "graded":
        return {g: [k.upper(), f" {k.upper()}", f"{k.upper()})", f"{k.upper()}."] for k, g in GRADES.items()}
    if meta_type not in SCALES:
        raise ValueError(f"no option tokens for the probe {meta_type!r}")
    low, high, _ = SCALES[meta_type]
    return {g: [str(g), f" {g}"] for g in range(low, high + 1)}


def option_token_ids(first_token, meta_type: str) -> dict[int, list[int]]:
    """Token ids by grade. first_token: text to the id of its first token, or None."""
    return {g: sorted({i for v in texts if (i := first_token(v)) is not None}) for g, texts in option_variants(meta_type).items()}


def option_token_table(vocabulary: DataFrame, meta_type: str) -> DataFrame:
    """(grade, token_ids) from a table (token, token_id) of whole-token spellings."""
    rows = [(g, v) for g, texts in option_variants(meta_type).items() for v in texts]
    wanted = vocabulary.sparkSession.createDataFrame(rows, "grade int, token string")
    joined = F.broadcast(wanted).join(vocabulary, "token")  # as many rows as spellings
    return joined.groupBy("grade").agg(F.sort_array(F.collect_set("token_id")).alias("token_ids"))
