"""Question corpora: readers of raw files and their normalisation to (question_id, question, answers).

Readers take a path that Spark can open. Limits follow each corpus's own order: the maths corpus is limited before
unusable rows are dropped, the multiple-choice corpus after its subject filter, the fictional one after its split.
num_samples: None for all, 0 for none. Positional ids come from the column idx: load() numbers the rows of a file in
their order, as raw files carry no numbers.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surety.functions.columns import strip
from surety.operators import permute
from surety.plans import schema
from surety.sources.json_records import read_records
from surety.sources.shared import beside, once

#: Letters of the choices; the format of a worked solution's last line; instruction of our own wording.
LETTERS = ("A", "B", "C", "D")
SOLUTION = r"####[ \t\n\r\f\x0B]*(.+)"
CHOICE_INSTRUCTION = "Choose the correct option and reply with its letter alone (A, B, C or D).\n\n"
#: Splits used where none is named, and the splits that exist where not all do.
DEFAULT_SPLITS = {"trivia_qa": "validation", "fictional_qa": "train", "freebase_qa": "test", "gsm8k": "test", "mkqa": "train", "mmlu": "test", "nq_open": "validation", "web_questions": "test"}
ONLY_SPLIT = {"freebase_qa": "test", "mkqa": "train"}


def _limit(df: DataFrame, num_samples: int | None, *order: str) -> DataFrame:
    if num_samples is None:
        return df
    return (df.orderBy(*order) if order else df).limit(num_samples)


def offset(df: DataFrame, start: int, order: str) -> DataFrame:
    """Without the first rows, in the given order."""
    return df.orderBy(order).offset(start)


def default_split(dataset) -> Column:
    """The split of a corpus where none is named; null for other names."""
    pairs = [F.lit(x) for pair in DEFAULT_SPLITS.items() for x in pair]
    return F.create_map(*pairs)[dataset]


def check_split(dataset: str, split: str | None) -> str:
    split = split or DEFAULT_SPLITS[dataset]
    if dataset in ONLY_SPLIT and split != ONLY_SPLIT[dataset]:
        raise ValueError(f"{dataset} has no split {split!r}")
    return split


def read_raw(spark: SparkSession, path: str, kind, field: str | None = None) -> DataFrame:
    """JSON lines, the records of a field of one JSON document, or Parquet, by the path's ending; columns that a file
    lacks are null."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(kind).parquet(path)
    if field is not None:
        return read_records(spark, path, kind[field].dataType.elementType, field)
    return spark.read.schema(kind).json(path)


def _counted(placed: DataFrame, group: str, within: str | None = None) -> DataFrame:
    """placed has been written once, with the increasing number _at: idx counts its rows by group, by within inside a
    group, then by _at.

    Rows of a part (a group, or a value of within in it) follow each other, so a part's first number and the rows before
    it place all of them; no rows are ordered, only one row a part: parts inside their group, groups by their totals.
    The parts travel to the rows while they have few bytes; beyond, they meet by a shuffle.
    """
    parts = [group] if within is None else [group, within]
    sizes = once(placed.groupBy(*parts).agg(F.count("*").alias("_n"), F.min("_at").alias("_first")))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = sizes.groupBy(group).agg(F.sum("_n").alias("_n")).select(F.col(group).alias("_g"), earlier(Window.orderBy(group)).alias("_before"))
    base = sizes.join(totals, F.col(group) == F.col("_g")).drop("_g")
    inside = F.lit(0) if within is None else earlier(Window.partitionBy(group).orderBy(within))
    base = base.select(*[F.col(c).alias(f"_of{c}") for c in parts], (F.col("_before") + inside - F.col("_first")).alias("_shift"))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_of{c}") for c in parts])
    travelling, _ = beside(once(base))
    return placed.join(travelling, same).withColumn("idx", F.col("_at") + F.col("_shift")).drop(*parts, "_at", "_shift", *[f"_of{c}" for c in parts])


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds idx from 0 in the given order, ties in any order. Range partitions, sorted and written once, keep it."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return _counted(once(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})), "_part")


def positions(df: DataFrame) -> DataFrame:
    """Adds idx from 0 in the order of a file's rows, and of the files' names; df reads files."""
    place = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()}
    return _counted(once(df.withColumns(place)), "_file", "_block")


def trivia_qa(raw: DataFrame, num_samples: int | None = None) -> DataFrame:
    return _limit(raw, num_samples, "question_id").select("question_id", "question", F.col("answer.aliases").alias("answers"))


def distinct_fictional(raw: DataFrame) -> DataFrame:
    """Without the rows that are marked as duplicates."""
    return raw.where(F.col("duplicate_relationship").isNull())


def fictional_qa(raw: DataFrame, split="train", num_samples: int | None = None, seed=42, exact=True) -> DataFrame:
    """Half of the events for each split, so that no event is in both.

    exact: the halves come from Python's seeded shuffle of the places of the sorted event ids. Ids are numbered where they
    are, only as many whole numbers as there are events are shuffled on the driver. Otherwise they come from a
    permutation of the places that needs no driver.
    """
    if split not in ("train", "validation", "all"):
        raise ValueError(f"unknown split {split!r}")
    rows = distinct_fictional(raw)
    if split != "all":
        half = shuffled_half if exact else permuted_half
        rows = rows.join(half(rows, "event_id", split, seed), "event_id", "left_semi")
    return _limit(rows.select("question_id", "question", F.array("natural_answer").alias("answers")), num_samples, "question_id")


def shuffled_half(ids: DataFrame, key: str, split: str, seed: int) -> DataFrame:
    """The distinct ids whose places, in their order, Python's seeded shuffle puts in the first (train) or second half."""
    rows = numbered(ids.select(key).distinct(), key)
    places = list(range(rows.count()))
    random.Random(seed).shuffle(places)
    middle = len(places) // 2
    chosen = rows.sparkSession.createDataFrame([(x,) for x in (places[:middle] if split == "train" else places[middle:])], "idx long")
    return rows.join(chosen, "idx", "left_semi").select(key)


def permuted_half(ids: DataFrame, key: str, split: str, seed: int) -> DataFrame:
    """The distinct ids whose places, in their order, a permutation puts in the first (train) or second half."""
    rows = numbered(ids.select(key).distinct(), key)
    n = rows.count()
    first = permute.place("idx", max(n, 1), seed) < n // 2
    return rows.where(first if split == "train" else ~first).select(key)


def sorted_half(ids: DataFrame, key: str, split: str) -> DataFrame:
    """The first (train) or second half of the sorted distinct ids."""
    n = numbered(ids.select(key).distinct(), key)
    total = n.agg(F.floor(F.count("*") / 2).alias("_half"))
    return n.crossJoin(F.broadcast(total)).where(F.col("idx") < F.col("_half") if split == "train" else F.col("idx") >= F.col("_half")).select(key)


def merged_names(parses):
    """All non-empty answer names of all parses, each once, in order of appearance."""
    names = F.flatten(F.transform(parses, lambda p: F.flatten(F.transform(F.coalesce(p["Answers"], F.array()), lambda a: F.coalesce(a["AnswersName"], F.array())))))
    return F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != "")))


def freebase_qa(raw: DataFrame, num_samples: int | None = None) -> DataFrame:
    """raw: records by position, as read_records() gives them, or one row with the array Questions. Rows keep the
    file's order."""
    if "Questions" in raw.columns:
        rows = _limit(raw.select(F.posexplode("Questions").alias("idx", "q")), num_samples, "idx")
    else:
        rows = _limit(raw, num_samples, "_file", "_block", "_at").withColumnRenamed("record", "q")
    empty = lambda x: F.coalesce(x, F.lit(""))
    answers = F.coalesce(merged_names(F.col("q.Parses")), F.array().cast("array<string>"))
    return rows.select(empty(F.col("q")["Question-ID"]).alias("question_id"), empty(F.col("q.RawQuestion")).alias("question"), answers.alias("answers"))


def solution_answers(answer):
    """The text after the solution mark, and the same without commas if that differs."""
    found = strip(F.regexp_extract(answer, SOLUTION, 1))
    return F.filter(F.array_distinct(F.array(found, F.replace(found, F.lit(","), F.lit("")))), lambda x: x != "")


def gsm8k(raw: DataFrame, num_samples: int | None = None) -> DataFrame:
    rows = _limit(raw, num_samples, "idx")
    made = rows.select(F.concat(F.lit("gsm8k_"), F.col("idx")).alias("question_id"), "question", solution_answers(F.col("answer")).alias("answers"))
    return made.where(F.size("answers") > 0)


def language_answers(answers):
    """Texts as they come, then each one's aliases unless they are there already."""
    none = F.array().cast("array<string>")

    def add(have, one):
        text = F.when(F.coalesce(one["text"], F.lit("")) != "", F.concat(have, F.array(one["text"]))).otherwise(have)
        return F.aggregate(F.coalesce(one["aliases"], none), text, lambda a, x: F.when((F.coalesce(x, F.lit("")) != "") & ~F.array_contains(a, F.coalesce(x, F.lit(""))), F.concat(a, F.array(x))).otherwise(a))

    return F.aggregate(F.coalesce(answers, F.array().cast("array<struct<text:string,aliases:array<string>>>")), none, add)


def mkqa(raw: DataFrame, lang="en", num_samples: int | None = None) -> DataFrame:
    """The question falls back to English only where the language's key is missing."""
    rows = _limit(raw, num_samples, "example_id")
    question = F.when(F.map_contains_key("queries", lang), F.try_element_at("queries", F.lit(lang))).otherwise(F.coalesce("query", F.lit("")))
    return rows.select(F.coalesce("example_id", F.lit("")).alias("question_id"), question.alias("question"), language_answers(F.try_element_at("answers", F.lit(lang))).alias("answers"))


def lettered(question, choices, instruction=CHOICE_INSTRUCTION):
    """The question with its choices on lines of their own after their letters."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    lines = F.transform(choices, lambda c, i: F.concat(F.lit("\n"), F.element_at(letters, i + 1), F.lit(") "), c))
    return F.concat(F.lit(instruction), question, F.array_join(lines, ""))


def mmlu(raw: DataFrame, subject="all", num_samples: int | None = None) -> DataFrame:
    rows = raw if subject == "all" else numbered(raw.where(F.col("subject") == subject).withColumnRenamed("idx", "_row"), "_row").drop("_row")
    letters = F.array(*[F.lit(x) for x in LETTERS])
    rows = _limit(rows, num_samples, "idx")
    gold = F.array(F.element_at(letters, F.col("answer") + 1))
    return rows.select(F.concat(F.lit("mmlu_"), F.col("idx")).alias("question_id"), lettered(F.col("question"), F.col("choices")).alias("question"), gold.alias("answers"), F.coalesce("subject", F.lit("unknown")).alias("subject"))


def nq_open(raw: DataFrame, num_samples: int | None = None) -> DataFrame:
    return _limit(raw, num_samples, "idx").select(F.col("idx").cast("string").alias("question_id"), "question", F.col("answer").alias("answers"))


def web_questions(raw: DataFrame, num_samples: int | None = None) -> DataFrame:
    return _limit(raw, num_samples, "idx").select(F.coalesce("url", F.col("idx").cast("string")).alias("question_id"), "question", "answers")


#: Corpora whose question ids are positions.
POSITIONAL = frozenset(["gsm8k", "mmlu", "nq_open", "web_questions"])
#: Corpus by name: raw schema, the field that holds the records if the file is one JSON document, and the normaliser.
CORPORA = {
    "trivia_qa": (schema.TRIVIA, None, trivia_qa),
    "fictional_qa": (schema.FICTIONAL, None, fictional_qa),
    "freebase_qa": (schema.FREEBASE, "Questions", freebase_qa),
    "gsm8k": (schema.MATH, None, gsm8k),
    "mkqa": (schema.MULTILINGUAL, None, mkqa),
    "mmlu": (schema.CHOICE, None, mmlu),
    "nq_open": (schema.OPEN, None, nq_open),
    "web_questions": (schema.WEB, None, web_questions),
}


def load(spark: SparkSession, name: str, path: str, split: str | None = None, **options) -> DataFrame:
    """A corpus from path, where {split} is filled in."""
    if name not in CORPORA:
        raise ValueError(f"unknown corpus {name!r}; one of {', '.join(CORPORA)}")
    kind, field, make = CORPORA[name]
    split = check_split(name, split)
    if name == "fictional_qa":
        options["split"] = split
    raw = read_raw(spark, path.replace("{split}", split), kind, field)
    return make(positions(raw) if name in POSITIONAL else raw, **options)
