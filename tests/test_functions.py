"""Scorers, parsers, rewards and quantiles against tables of cases."""

import statistics

import pytest
from pyspark.sql import functions as F

from surety.functions import logits, reward, score, text
from surety.functions.probit import probit


def run(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.coalesce(1).select(*columns).collect()]


LETTERS = [
    ("A) I am certain", 3, True), ("I am certain", 3, True), ("certain", 1, True), ("uncertain", 3, False), ("not sure", 3, False), ("I think so", 2, False),
    ("no idea", 0, False), ("éb)", 1, False), ("", 1, False), (None, 1, False), ("don't know", 0, True), ("  D.", 0, True), ("_a", 1, False), ("2b", 1, False), ("[C]", 1, True), ("probable b", 2, True),
]


def test_letter_grades(spark):
    got = run(spark, [(t,) for t, _, _ in LETTERS], "t string", score.parse_letter_grade("t"), score.grade_letter_found("t"))
    assert got == [(g, ok) for _, g, ok in LETTERS]


@pytest.mark.parametrize("value, scale, grade", [("10", 5, 3), ("-3", 5, 3), ("7 or 4", 5, 4), ("", 10, 5), (None, 5, 3), ("9" * 30 + " 2", 5, 2), ("0 1", 5, 1), ("10", 10, 10), ("007", 10, 7)])
def test_number_grades(spark, value, scale, grade):
    assert run(spark, [(value,)], "t string", score.parse_number_grade("t", scale)) == [(grade,)]


INCLUSION = [("The Answer is PARIS", ["paris"], 1), ("x", [""], 1), ("x", [], 0), ("x", None, 0), (None, ["x"], 0), ("abc", [None, "B"], 1), ("abc", [None], 0)]


def test_inclusion(spark):
    assert run(spark, [(a, b) for a, b, _ in INCLUSION], "o string, a array<string>", score.correct_by_inclusion("o", "a")) == [(c,) for _, _, c in INCLUSION]


CHOICE = [("The answer is b.", ["B"], 1), ("ABBA", ["A"], 0), ("A cat", [" a "], 1), ("", ["A"], 0), ("C", [], 0), ("(D)", ["D", "A"], 1), (None, ["A"], 0)]


def test_choice(spark):
    assert run(spark, [(a, b) for a, b, _ in CHOICE], "o string, a array<string>", score.correct_by_choice("o", "a")) == [(c,) for _, _, c in CHOICE]


NUMBERS = [("5-3", ["-3"], 1), ("12,3456", ["6"], 1), ("1,234.50 is it", ["1234.5"], 1), ("none", ["1"], 0), ("420", ["42"], 0), ("so 42", ["x", "42"], 1), ("7", ["7d"], 0), ("7", [" 7 "], 1), ("1000", ["1,000"], 1), ("3", [], 0)]


def test_numbers(spark):
    assert run(spark, [(a, b) for a, b, _ in NUMBERS], "o string, a array<string>", score.correct_by_number("o", "a")) == [(c,) for _, _, c in NUMBERS]


YES = [("Yes!", None, 1), ("my eyes", "fr", 1), ("예", "ko", 1), ("yes", "ko", 0), ("不是", "zh_cn", 1), ("SÍ", "es", 1), ("si", "es", 0), (None, "en", 0)]


def test_yes(spark):
    assert run(spark, [(a, b) for a, b, _ in YES], "o string, l string", score.says_yes("o", "l")) == [(c,) for _, _, c in YES]


def test_row_metrics_and_dispatch(spark):
    got = run(spark, [(c, y) for c in (0, 1) for y in (0, 1)], "c int, y int", score.wrong_yes("c", "y"), score.wrong_no("c", "y"), score.aligned("c", "y"))
    assert got == [(None, 0, 1), (1, None, 0), (None, 1, 0), (0, None, 1)]
    rows = [("graded", "B"), ("fok", "4"), ("numeric", "9"), ("binary", "yes"), (None, "no")]
    assert run(spark, rows, "m string, o string", score.parse_meta_by("o", "m")) == [(2,), (4,), (9,), (1,), (0,)]
    rows = [("mmlu", "B", ["B"]), ("gsm8k", "= 5", ["5.0"]), ("web_questions", "five", ["FIVE"])]
    assert run(spark, rows, "d string, o string, a array<string>", score.correct_by_dataset("d", "o", "a")) == [(1,), (1,), (1,)]
    assert run(spark, [("I DON'T KNOW it",), ("sure",), (None,)], "o string", score.abstention("o")) == [("no",), ("yes",), ("yes",)]
    assert run(spark, [(1, 2), (0, 2), (0, 1)], "c int, g int", score.grade_aligned("c", "g"), score.at_least("g", 2)) == [(1, 1), (0, 1), (1, 0)]


def test_rewards(spark):
    pairs = [(1, 1), (1, 0), (0, 0), (0, 1)]
    assert run(spark, pairs, "c int, y int", reward.reward("combined", "c", "y"), reward.reward("alignment", "c", "y"), reward.reward("correct", "c", "y")) == [(2, 1, 1), (1, 0, 1), (1, 1, 0), (0, 0, 0)]
    got = run(spark, [(1, 3), (1, 0), (0, 0), (0, 3)], "c int, g int", reward.reward("graded", "c", "g"), reward.reward("graded_quadratic", "c", "g"))
    assert got == [(2.0, 2.0), (1.0, 0.0), (1.0, 2.0), (0.0, 0.0)]
    got = run(spark, [(1, 5), (0, 5), (1, 1)], "c int, g int", reward.reward("graded_fok", "c", "g"))
    assert got == [(2.0,), (0.0,), (1.0,)]
    assert run(spark, [(1, 10), (0, 1)], "c int, g int", reward.reward("graded_numeric", "c", "g")) == [(2.0,), (1.0,)]
    with pytest.raises(ValueError):
        reward.reward("multilevel", "c", "y")


def test_probit(spark):
    ps = [1e-4 + i * (1 - 2e-4) / 400 for i in range(401)]
    got = run(spark, [(p,) for p in ps], "p double", probit("p"))
    assert max(abs(x - statistics.NormalDist().inv_cdf(p)) for (x,), p in zip(got, ps, strict=True)) < 1e-13


def test_logits(spark):
    rows = [([0.0, 0.0, 0.0, 0.0],), ([1000.0, 0.0, 0.0, 0.0],), ([-1000.0, -1000.0, -1000.0, 5000.0],)]
    got = run(spark, rows, "l array<double>", logits.expected_confidence("l", {3: [0], 2: [1], 1: [2], 0: [3]}, 3))
    assert got == [(0.5,), (1.0,), (0.0,)]
    assert run(spark, rows[:1], "l array<double>", logits.expected_confidence("l", {}, 3)) == [(0.5,)]
    assert run(spark, [(0.0, 0.0), (800.0, 0.0)], "y double, n double", logits.odds_confidence(logits.yes_odds("y", "n"))) == [(0.5,), (1.0,)]
    assert logits.option_token_ids(lambda t: ord(t[0]), "graded") == {3: [32, 65], 2: [32, 66], 1: [32, 67], 0: [32, 68]}
    with pytest.raises(ValueError):
        logits.option_variants("binary")


def test_text(spark):
    assert run(spark, [("The  cat's, an Hat!\tA é",), ("theme anthem",), (None,)], "t string", text.normalise_answer("t")) == [("cats hat é",), ("theme anthem",), (None,)]


def test_plans_stay_native(spark):
    df = spark.createDataFrame([("a", ["b"])], "o string, a array<string>")
    plan = df.select(score.correct_by_number("o", "a"), score.parse_letter_grade("o"), score.says_yes("o", F.lit("ko")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_capitals_differ_in_case_alone(spark):
    words = ["Erßie", "ﬁn", "ŉa", "ǰ", "ΟΔΟΣ", "οδος", "İstanbul", "ıssız", "naïve", "𐐨x", "😀", "", None]
    got = run(spark, [(w,) for w in words], "t string", text.capitals("t"), F.lower(text.capitals("t")) == F.lower("t"))
    assert got == list(zip(["ERßIE", "ﬁN", "ŉA", "ǰ", "ΟΔΟΣ", "ΟΔΟς", "İSTANBUL", "ıSSıZ", "NAÏVE", "𐐀X", "😀", "", None], [True] * 12 + [None]))
