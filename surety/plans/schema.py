"""Explicit schemas of the tables that the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


STRINGS = T.ArrayType(S)
QUESTIONS = _struct(("question_id", S), ("question", S), ("answers", STRINGS))
CHOICE_QUESTIONS = _struct(("question_id", S), ("question", S), ("answers", STRINGS), ("subject", S))

# raw corpora: fixed values, the field names of the published files
TRIVIA = _struct(("question_id", S), ("question", S), ("answer", _struct(("aliases", STRINGS), ("value", S), ("type", S))))
FICTIONAL = _struct(("event_id", S), ("question_id", S), ("question", S), ("natural_answer", S), ("duplicate_relationship", S))
FREEBASE_PARSES = T.ArrayType(_struct(("Answers", T.ArrayType(_struct(("AnswersName", STRINGS))))))
FREEBASE = _struct(("Questions", T.ArrayType(_struct(("Question-ID", S), ("RawQuestion", S), ("ProcessedQuestion", S), ("Parses", FREEBASE_PARSES)))))
MATH = _struct(("question", S), ("answer", S))
MULTILINGUAL = _struct(("example_id", S), ("query", S), ("queries", T.MapType(S, S)), ("answers", T.MapType(S, T.ArrayType(_struct(("text", S), ("aliases", STRINGS))))))
CHOICE = _struct(("question", S), ("subject", S), ("choices", STRINGS), ("answer", I))
OPEN = _struct(("question", S), ("answer", STRINGS))
WEB = _struct(("url", S), ("question", S), ("answers", STRINGS))

# results: fixed values, the column names of result files in their order
BINARY_COLUMNS = ["question_id", "question", "ground_truths", "prediction", "meta_answer", "direct_correctness", "yes", "yes_failures", "no_failures", "meta_alignments"]
GRADED_COLUMNS = ["question_id", "question", "ground_truths", "prediction", "meta_answer", "direct_correctness", "meta_grade"]
THRESHOLD_COLUMNS = [*BINARY_COLUMNS, "yes_over_no", "confidence"]
TRANSFER_RESULT = _struct(("model", S), ("dataset", S), ("meta_type", S), ("metric", S), ("value", D))
WEIGHTS = _struct(("name", S), ("pos", L), ("value", D))
POPULATION = _struct(("iteration", I), ("seed", L), ("reward", D))
#: Value that stands for a missing one in result files, and for positions without a label.
IGNORE = -100
