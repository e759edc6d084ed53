"""The data source against load(), its byte ranges, pushed conditions and commits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from surety.sources import corpora, source
from surety.sources.source import CorpusReader, Part, QuestionWriter


@pytest.fixture(autouse=True)
def registered(spark):
    source.register(spark)


def read(spark, corpus, path, **options):
    reader = spark.read.format(source.NAME).option("corpus", corpus)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(str(path))


def rows(df):
    return sorted(map(str, df.collect()))


def write_lines(path, raw):
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in raw), encoding="utf-8")


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
def test_every_line_is_in_one_range(tmp_path, size):
    rng = random.Random(size)
    text = "".join("é" * rng.randint(0, 9) + "x" * rng.randint(0, 30) + "\n" for _ in range(200)) + rng.choice(["", "last"])
    (tmp_path / "a.json").write_text(text, encoding="utf-8")
    n = (tmp_path / "a.json").stat().st_size
    got = [x for a in range(0, n, size) for x in source._lines(Part(str(tmp_path / "a.json"), a, min(a + size, n)))]
    assert got == [x.encode() for x in text.split("\n") if x.strip()]


def test_lines_of_the_corpora_without_positions(spark, tmp_path):
    trivia = [{"question_id": f"t{i}", "question": f"é {i}", "answer": {"aliases": ["a", str(i)], "value": "a", "type": "x"} if i % 7 else None} for i in range(200)]
    fictional = [{"event_id": f"e{i % 5}", "question_id": f"f{i}", "question": "?", "natural_answer": str(i), "duplicate_relationship": "same" if i % 3 == 0 else None} for i in range(60)]
    texts = [{"text": "a", "aliases": ["b", "a", ""]}, {"text": "", "aliases": None}, {"text": "a", "aliases": ["c", "b"]}]
    mkqa = [{"example_id": str(i), "query": "en?", "queries": {"ko": "ko?"} if i % 2 else {}, "answers": {"ko": texts}} for i in range(30)]
    for name, raw, options in (("trivia_qa", trivia, {}), ("fictional_qa", fictional, {"split": "all"}), ("mkqa", mkqa, {"lang": "ko"})):
        path = tmp_path / f"{name}.json"
        write_lines(path, raw)
        want = corpora.load(spark, name, str(path), **options) if name != "fictional_qa" else corpora.load(spark, name, str(path), "all")
        options = {k: v for k, v in options.items() if k != "split"}
        got = read(spark, name, path, range_bytes=500, **options)
        assert rows(got) == rows(want) and got.rdd.getNumPartitions() > 3 and got.dtypes == want.dtypes


def test_parquet_corpora_with_positions(spark, tmp_path):
    base = spark.range(0, 900).repartitionByRange(3, "id").sortWithinPartitions("id")
    word = F.concat(F.lit("w"), "id")
    made = {
        "gsm8k": base.select(word.alias("question"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("so\n#### "), F.format_number(F.col("id") * 37, 0), F.lit(" "))).otherwise("none").alias("answer")),
        "mmlu": base.select(word.alias("question"), F.when(F.col("id") % 5 > 0, F.element_at(F.array(*map(F.lit, "pqrst")), (F.col("id") / 200 + 1).cast("int"))).alias("subject"), F.array(*map(F.lit, "abcd")).alias("choices"), (F.col("id") % 4).cast("int").alias("answer")),
        "nq_open": base.select(word.alias("question"), F.array(word).alias("answer")),
        "web_questions": base.select(F.when(F.col("id") % 2 == 0, word).alias("url"), word.alias("question"), F.array(word).alias("answers")),
    }
    for name, raw in made.items():
        path = f"{tmp_path}/{name}.parquet"
        raw.write.option("parquet.block.size", 2000).parquet(path)
        got, want = read(spark, name, path), corpora.load(spark, name, path)
        assert rows(got) == rows(want) and got.schema.names == want.schema.names
    path = f"{tmp_path}/mmlu.parquet"
    whole = corpora.load(spark, "mmlu", path)
    for condition in ("subject = 'q'", "subject IN ('r', 'unknown') AND question LIKE '%w5%'", "subject = 'zz'", "subject = 'p' AND subject = 'q'"):
        assert rows(read(spark, "mmlu", path).where(condition)) == rows(whole.where(condition))
    reader = CorpusReader({"corpus": "mmlu", "path": path}, source.tables.CHOICE_QUESTIONS)
    every = len(reader.partitions())
    rest = list(reader.pushFilters([source.EqualTo(("subject",), "q"), source.EqualTo(("question",), "x")]))
    assert rest == [source.EqualTo(("question",), "x")] and 0 < len(reader.partitions()) < every


def test_written_questions_are_read_again(spark, tmp_path):
    path = f"{tmp_path}/out"
    df = spark.range(100).repartition(4).select(F.concat(F.lit("q"), "id").alias("question_id"), F.lit("what\n\"?").alias("question"), F.array(F.lit("a"), F.col("id").cast("string")).alias("answers"))
    save = lambda mode: df.write.format(source.NAME).option("corpus", "trivia_qa").mode(mode).save(path)
    save("append")
    assert rows(corpora.load(spark, "trivia_qa", path)) == rows(df) == rows(read(spark, "trivia_qa", path))
    save("append")
    assert corpora.load(spark, "trivia_qa", path).count() == 200
    save("overwrite")
    assert rows(corpora.load(spark, "trivia_qa", path)) == rows(df)


def test_an_aborted_write_leaves_nothing(tmp_path):
    writer = QuestionWriter({"path": str(tmp_path / "w")}, overwrite=True)
    rows_ = iter([{"question_id": "1", "question": "?", "answers": ["x"]}])
    message = writer.write(rows_)
    assert len(list((tmp_path / "w").iterdir())) == 1
    writer.abort([message, None])
    assert not list((tmp_path / "w").iterdir())


def test_what_the_format_refuses(spark, tmp_path):
    write_lines(tmp_path / "x.json", [{"question": "a", "answer": ["b"]}])
    for corpus, message in (("nq_open", "positions"), ("freebase_qa", "no corpus"), ("", "no corpus")):
        with pytest.raises(Exception, match=message):
            read(spark, corpus, tmp_path / "x.json").collect()
