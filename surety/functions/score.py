"""Scorers of free-text answers and parsers of confidence answers, as native columns.

A null output scores like an empty one. Digits are ASCII digits; letters at word boundaries are told by Unicode classes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from surety.functions.columns import col, strip

#: Fixed patterns: a grade letter at a word's start, a letter standing alone, numbers, plain decimal numbers.
GRADE_LETTER = r"(?:^|[^\p{L}\p{N}_])([abcd])"
CHOICE_LETTER = r"(?:^|[^\p{L}\p{N}_])([ABCD])(?:$|[^\p{L}\p{N}_])"
NUMBER = r"-?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Fixed word lists in the order in which they are tried, with the grade each gives.
GRADE_WORDS = ((3, ("certain", "sure")), (2, ("probably", "think")), (1, ("uncertain", "not sure")), (0, ("not know", "no idea")))
GRADES = {"a": 3, "b": 2, "c": 1, "d": 0}
DEFAULT_GRADE = 1
YES_WORDS = {"en": "yes", "ko": "예", "zh": "是", "es": "sí"}
#: Probe: lowest and highest grade, and the grade from which it counts as yes.
SCALES = {"graded": (0, 3, 2), "fok": (1, 5, 3), "jol": (1, 5, 3), "numeric": (1, 10, 6)}
ABSTAINS = "i don't know"


def _text(x) -> Column:
    return F.coalesce(col(x), F.lit(""))


def _flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False)).cast("int")


def correct_by_inclusion(output, answers) -> Column:
    """1 if some answer occurs in the output, whatever the case; an empty answer occurs everywhere."""
    text = F.lower(_text(output))
    return _flag(F.exists(col(answers), lambda a: F.contains(text, F.lower(a))))


def choice_letter(output) -> Column:
    """The first letter A to D that stands alone in the upper-cased output, else null."""
    return F.nullif(F.regexp_extract(F.upper(_text(output)), CHOICE_LETTER, 1), F.lit(""))


def correct_by_choice(output, answers) -> Column:
    """1 if the chosen letter is the first answer."""
    gold = F.coalesce(F.upper(strip(F.try_element_at(col(answers), F.lit(1)))), F.lit(""))
    return _flag(choice_letter(output) == gold)


def last_number(output) -> Column:
    """The last number of the output, else null."""
    found = F.try_element_at(F.regexp_extract_all(_text(output), F.lit(NUMBER), F.lit(0)), F.lit(-1))
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def correct_by_number(output, answers, tolerance=1e-6) -> Column:
    """1 if the last number is within the tolerance of some answer that is a number."""
    value = last_number(output)

    def near(a):
        plain = strip(F.replace(a, F.lit(","), F.lit("")))
        return F.when(plain.rlike(DECIMAL), F.abs(value - plain.try_cast("double")) < tolerance).otherwise(False)

    return _flag(F.exists(col(answers), near))


def says_yes(output, lang=None) -> Column:
    """1 if the output contains the language's word for yes. lang: null or other languages count as English."""
    text = F.lower(_text(output))
    has = lambda k: F.contains(text, F.lit(YES_WORDS[k]))
    if lang is None:
        return _flag(has("en"))
    lang = F.coalesce(col(lang), F.lit("en"))
    return _flag(F.when(lang == "ko", has("ko")).when(lang.startswith("zh"), has("zh")).when(lang == "es", has("es")).otherwise(has("en")))


def wrong_yes(correct, yes) -> Column:
    """1 - correct where the answer was yes, else null."""
    return F.when(col(yes) == 1, 1 - col(correct))


def wrong_no(correct, yes) -> Column:
    """correct where the answer was no, else null."""
    return F.when(col(yes) == 0, col(correct))


def aligned(correct, yes) -> Column:
    return (col(correct) == col(yes)).cast("int")


def grade_letter_found(output) -> Column:
    """Whether a grade letter was found, so that no keyword or default was needed."""
    return F.regexp_extract(F.lower(strip(_text(output))), GRADE_LETTER, 1) != ""


def parse_letter_grade(output) -> Column:
    """A to D as 3 to 0; else by keywords, in their order; else the default."""
    text = F.lower(strip(_text(output)))
    letter = F.regexp_extract(text, GRADE_LETTER, 1)
    out = None
    for k, g in GRADES.items():
        out = F.when(letter == k, g) if out is None else out.when(letter == k, g)
    for g, words in GRADE_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = out.when(hit, g)
    return out.otherwise(DEFAULT_GRADE)


def parse_number_grade(output, scale: int) -> Column:
    """The first integer from 1 to scale, else the middle."""
    found = F.transform(F.regexp_extract_all(_text(output), F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("bigint"))
    inside = F.filter(found, lambda x: (x >= 1) & (x <= scale))
    return F.coalesce(F.try_element_at(inside, F.lit(1)), F.lit((scale + 1) // 2)).cast("int")


def is_graded(meta_type) -> Column | bool:
    return meta_type in SCALES if isinstance(meta_type, str) else meta_type.isin(*SCALES)


def parse_meta(output, meta_type: str) -> Column:
    """The value of a confidence answer: a grade, or yes (1) or no (0) for other probes."""
    if meta_type == "graded":
        return parse_letter_grade(output)
    if meta_type in SCALES:
        return parse_number_grade(output, SCALES[meta_type][1])
    return says_yes(output)


def parse_meta_by(output, meta_type) -> Column:
    """parse_meta with the probe in a column."""
    kind, out = col(meta_type), None
    for k in SCALES:
        case = parse_meta(output, k)
        out = F.when(kind == k, case) if out is None else out.when(kind == k, case)
    return out.otherwise(says_yes(output))


def at_least(grade, threshold) -> Column:
    return (col(grade) >= threshold).cast("int")


def grade_aligned(correct, grade, threshold=2) -> Column:
    return ((col(grade) >= threshold) == (col(correct) == 1)).cast("int")


def abstention(output) -> Column:
    """no where the output says that it doesn't know, else yes."""
    return F.when(F.contains(F.lower(_text(output)), F.lit(ABSTAINS)), "no").otherwise("yes")


#: Scorer by dataset; all others by inclusion.
SCORERS: dict[str, Callable] = {"mmlu": correct_by_choice, "gsm8k": correct_by_number}


def correct_for(dataset: str, output, answers) -> Column:
    return SCORERS.get(dataset, correct_by_inclusion)(output, answers)


def correct_by_dataset(dataset, output, answers) -> Column:
    """correct_for with the dataset in a column."""
    name, out = col(dataset), None
    for k, f in SCORERS.items():
        out = F.when(name == k, f(output, answers)) if out is None else out.when(name == k, f(output, answers))
    return out.otherwise(correct_by_inclusion(output, answers))
