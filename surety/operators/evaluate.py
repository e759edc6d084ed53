"""Whole evaluations: scored trials from questions, predictions and confidence answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.functions import logits, score
from surety.operators import generate, metrics
from surety.plans import prompts
from surety.plans.schema import IGNORE


def score_binary(df: DataFrame, dataset: str = "trivia_qa", lang=None, keep_length=False, scorer=None) -> DataFrame:
    """Adds the binary columns. keep_length: failures that don't apply carry the sentinel instead of null."""
    correct = scorer("prediction", "answers") if scorer else score.correct_for(dataset, "prediction", "answers")
    out = df.withColumn("direct_correctness", correct)
    out = out.withColumn("yes", score.says_yes("meta_answer", None if lang is None else F.lit(lang) if isinstance(lang, str) else lang))
    fill = (lambda x: F.coalesce(x, F.lit(IGNORE))) if keep_length else (lambda x: x)
    return out.withColumns(
        {
            "ground_truths": F.col("answers"),
            "yes_failures": fill(score.wrong_yes("direct_correctness", "yes")),
            "no_failures": fill(score.wrong_no("direct_correctness", "yes")),
            "meta_alignments": score.aligned("direct_correctness", "yes"),
        }
    )


def score_graded(df: DataFrame, meta_type: str, dataset: str = "trivia_qa", scorer=None) -> DataFrame:
    correct = scorer("prediction", "answers") if scorer else score.correct_for(dataset, "prediction", "answers")
    return df.withColumns({"direct_correctness": correct, "ground_truths": F.col("answers"), "meta_grade": score.parse_meta("meta_answer", meta_type)})


def score_threshold(df: DataFrame, yes_logit="yes_logit", no_logit="no_logit", dataset: str = "trivia_qa") -> DataFrame:
    """The answer is Yes where its odds exceed 1; adds yes_over_no and confidence."""
    odds = df.withColumn("yes_over_no", logits.yes_odds(yes_logit, no_logit))
    odds = odds.withColumns({"meta_answer": F.when(F.col("yes_over_no") > 1, "Yes").otherwise("No"), "confidence": logits.odds_confidence("yes_over_no")})
    return score_binary(odds, dataset)


def score_abstention(df: DataFrame, dataset: str = "trivia_qa") -> DataFrame:
    """The confidence answer is whether the prediction abstains."""
    return score_binary(df.withColumn("meta_answer", score.abstention("prediction")), dataset)


def answer_questions(questions: DataFrame, make, meta_type: str = "binary", dataset: str = "trivia_qa", lang: str | None = None, mode: str = "answers") -> DataFrame:
    """Scored trials from questions (question_id, question, answers): prompts are built, the model that make() gives in
    each task answers them, and the answers are scored. mode: answers, or abstention, which asks no second question."""
    asked = prompts.build_prompts(questions, meta_type, dataset, lang)
    if mode == "abstention":
        asked = asked.withColumn("direct_prompt", prompts.direct_prompt("question", may_abstain=True))
        return score_abstention(generate.generate(asked, make), dataset)
    answered = generate.generate(generate.generate(asked, make), make, "meta_prompt", "meta_answer")
    if meta_type in score.SCALES:
        return score_graded(answered, meta_type, dataset)
    return score_binary(answered, dataset, lang if dataset == "mkqa" else None, keep_length=True)


def evaluate(scored: DataFrame, keys: list, meta_type: str = "binary") -> DataFrame:
    if meta_type not in score.SCALES:
        return metrics.binary_metrics(scored, keys, "direct_correctness", "yes")
    return metrics.graded_metrics(scored, keys, meta_type, "direct_correctness", "meta_grade")
