"""Rewards of single trials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surety.functions.columns import col


def correct_reward(correct, yes) -> Column:
    return col(correct)


def alignment_reward(correct, yes) -> Column:
    return (col(correct) == col(yes)).cast("int")


def combined_reward(correct, yes) -> Column:
    """Correctness plus alignment: 2 for a right yes, 1 for a right or wrong no, 0 for a wrong yes."""
    return F.when(col(correct) != 0, F.lit(1)).otherwise(F.lit(0)) + alignment_reward(correct, yes)


def _graded(correct, share: Column) -> Column:
    return F.when(col(correct) != 0, 1.0 + share).otherwise(1.0 - share)


def letter_reward(correct, grade) -> Column:
    return _graded(correct, col(grade) / 3)


def five_point_reward(correct, grade) -> Column:
    return _graded(correct, (col(grade) - 1) / 4)


def ten_point_reward(correct, grade) -> Column:
    return _graded(correct, (col(grade) - 1) / 9)


def quadratic_reward(correct, grade) -> Column:
    """2 (1 - (grade / 3 - correct) ** 2)."""
    miss = col(grade) / 3 - col(correct)
    return 2.0 * (1.0 - miss * miss)


#: Names under which rewards are chosen.
REWARDS = {
    "correct": correct_reward,
    "alignment": alignment_reward,
    "combined": combined_reward,
    "graded": letter_reward,
    "graded_fok": five_point_reward,
    "graded_numeric": ten_point_reward,
    "graded_quadratic": quadratic_reward,
}


def reward(name: str, correct, meta) -> Column:
    if name not in REWARDS:
        raise ValueError(f"unknown reward {name!r}; one of {', '.join(REWARDS)}")
    return REWARDS[name](correct, meta)
