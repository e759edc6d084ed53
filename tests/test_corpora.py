"""Loaders, prompts and sinks on small files written here."""

import json
import random

import pytest
from pyspark.sql import functions as F

from surety.plans import prompts, schema
from surety.sources import corpora, sinks


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_trivia(spark, tmp_path):
    p = lines(tmp_path / "validation.json", [{"question_id": f"t{i}", "question": "q", "answer": {"aliases": ["a", "b"], "value": "a"}} for i in range(3)])
    assert rows(corpora.load(spark, "trivia_qa", p.replace("validation", "{split}"), num_samples=2)) == [("t0", "q", ["a", "b"]), ("t1", "q", ["a", "b"])]
    assert corpora.load(spark, "trivia_qa", p, num_samples=0).count() == 0
    assert corpora.load(spark, "trivia_qa", p).columns == schema.QUESTIONS.names


def test_fictional_split_keeps_events_whole(spark, tmp_path):
    raw = [{"event_id": f"e{i % 9}", "question_id": f"q{i:02}", "question": "?", "natural_answer": str(i), "duplicate_relationship": "dup" if i == 5 else None} for i in range(30)]
    p = lines(tmp_path / "f.json", raw)
    ids = sorted({r["event_id"] for r in raw})
    random.Random(42).shuffle(ids)
    want = sorted(r["question_id"] for r in raw if r["event_id"] in ids[:4] and r["duplicate_relationship"] is None)
    train, val = (corpora.load(spark, "fictional_qa", p, split=s) for s in ("train", "validation"))
    assert sorted(r.question_id for r in train.collect()) == want
    assert train.count() + val.count() == 29 and corpora.load(spark, "fictional_qa", p, split="all").count() == 29
    a, b = ({r.question_id for r in corpora.load(spark, "fictional_qa", p, split=s, exact=False).collect()} for s in ("train", "validation"))
    assert not a & b and len(a | b) == 29 and a and b
    with pytest.raises(ValueError):
        corpora.load(spark, "fictional_qa", p, split="test")


def test_freebase(spark, tmp_path):
    doc = {"Questions": [{"Question-ID": "1", "RawQuestion": "r", "ProcessedQuestion": "p", "Parses": [{"Answers": [{"AnswersName": ["x", "", "y"]}]}, {"Answers": [{"AnswersName": ["y", None, "z"]}]}]}, {"Question-ID": "2", "RawQuestion": "s", "Parses": []}, {"RawQuestion": None, "Parses": [{"Answers": None}]}]}
    p = tmp_path / "f.json"
    p.write_text(json.dumps(doc, indent=1))
    assert rows(corpora.load(spark, "freebase_qa", str(p))) == [("1", "r", ["x", "y", "z"]), ("2", "s", []), ("", "", [])]
    with pytest.raises(ValueError):
        corpora.load(spark, "freebase_qa", str(p), split="train")


def test_maths(spark, tmp_path):
    p = lines(tmp_path / "g.json", [{"idx": 0, "question": "a", "answer": "so #### 1,234 "}, {"idx": 1, "question": "b", "answer": "none"}, {"idx": 2, "question": "c", "answer": "####5"}])
    assert rows(corpora.load(spark, "gsm8k", p)) == [("gsm8k_0", "a", ["1,234", "1234"]), ("gsm8k_2", "c", ["5"])]
    assert rows(corpora.load(spark, "gsm8k", p, num_samples=2)) == [("gsm8k_0", "a", ["1,234", "1234"])]


def test_multilingual(spark, tmp_path):
    one = {"example_id": "7", "query": "en?", "queries": {"ko": "ko?", "fr": None}, "answers": {"ko": [{"text": "a", "aliases": ["b", "a", ""]}, {"text": "a", "aliases": None}, {"text": "", "aliases": ["b", "c"]}]}}
    p = lines(tmp_path / "m.json", [one])
    assert rows(corpora.load(spark, "mkqa", p, lang="ko")) == [("7", "ko?", ["a", "b", "a", "c"])]
    assert rows(corpora.load(spark, "mkqa", p, lang="de")) == [("7", "en?", [])]
    assert rows(corpora.load(spark, "mkqa", p, lang="fr")) == [("7", None, [])]


def test_choices(spark, tmp_path):
    p = lines(tmp_path / "c.json", [{"idx": i, "question": f"q{i}", "subject": s, "choices": ["w", "x", "y", "z"], "answer": i} for i, s in enumerate(["law", None, "law"])])
    got = rows(corpora.load(spark, "mmlu", p))
    assert got[1] == ("mmlu_1", corpora.CHOICE_INSTRUCTION + "q1\nA) w\nB) x\nC) y\nD) z", ["B"], "unknown")
    assert [r[0] for r in rows(corpora.load(spark, "mmlu", p, subject="law", num_samples=1))] == ["mmlu_0"]


def test_open_and_web(spark, tmp_path):
    p = lines(tmp_path / "n.json", [{"idx": i, "question": "q", "answer": ["a"]} for i in range(3)])
    assert [r[0] for r in rows(corpora.load(spark, "nq_open", p))] == ["0", "1", "2"]
    p = lines(tmp_path / "w.json", [{"idx": 0, "url": "u", "question": "q", "answers": ["a"]}, {"idx": 1, "question": "q", "answers": []}])
    assert [r[0] for r in rows(corpora.load(spark, "web_questions", p))] == ["u", "1"]
    assert set(corpora.CORPORA) == set(corpora.DEFAULT_SPLITS) and len(corpora.CORPORA) == 8
    with pytest.raises(ValueError):
        corpora.load(spark, "nothing", p)


def test_numbering_and_slices(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as v").repartition(5)
    assert sorted(rows(corpora.numbered(df, "v"))) == [(i, i) for i in range(1000)]
    wide = spark.range(300_000).selectExpr("(id * 7919) % 300000 as v", "repeat(cast(id as string), 20) as w").repartition(7)
    got = corpora.numbered(wide, "v").selectExpr("count(*)", "sum(if(idx = v, 0, 1))", "count(distinct idx)", "count(distinct w)").first()
    assert tuple(got) == (300_000, 0, 300_000, 300_000)
    tied = spark.createDataFrame([(i // 10, i) for i in range(500)], "v long, w long").repartition(6)
    placed = corpora.numbered(tied, "v").collect()
    assert sorted(r.idx for r in placed) == list(range(500)) and all(r.idx // 10 == r.v for r in placed)
    assert corpora.numbered(df.limit(0), "v").count() == 0
    assert [r.v for r in corpora.offset(df, 10, "v").limit(3).collect()] == [10, 11, 12]
    half = [r[0] for r in corpora.sorted_half(df, "v", "train").collect()]
    assert sorted(half) == list(range(500))


@pytest.mark.parametrize("ending", ["json", "parquet"])
def test_positions_follow_the_order_of_files(spark, tmp_path, ending):
    raw = spark.range(5000).selectExpr("concat('q', id) as question", "array(cast(id as string)) as answer").coalesce(3)
    path = f"{tmp_path}/n.{ending}"
    raw.write.format(ending).save(path)
    got = corpora.load(spark, "nq_open", path).collect()
    assert len(got) == 5000 and all(r.question == "q" + r.question_id and r.answers == [r.question_id] for r in got)
    few = corpora.load(spark, "nq_open", path, num_samples=3).collect()
    assert [r.question_id for r in few] == ["0", "1", "2"]


def test_prompts(spark):
    q = spark.createDataFrame([("1", "what is {answer}?", ["x", "y"]), ("2", None, [])], "question_id string, question string, answers array<string>")
    made = prompts.build_prompts(q, "graded").orderBy("question_id").collect()
    assert "what is {answer}?" in made[0].direct_prompt and made[0].meta_prompt.startswith("Question: what is {answer}?")
    a = spark.createDataFrame([("1", "forty {question}")], "question_id string, answer string")
    judged = prompts.judged_prompts(q, a).orderBy("question_id").collect()
    assert "what is {answer}?" in judged[0].meta_prompt and judged[0].meta_prompt.endswith("Your answer: forty {question}\n") and judged[1].meta_prompt.endswith("Your answer: \n")
    ko = prompts.build_prompts(q, "binary", "mkqa", "ko").first()
    assert "질문" in ko.meta_prompt and "질문" not in prompts.build_prompts(q, "binary", "trivia_qa", "ko").first().meta_prompt
    assert set(prompts.META) == {"binary", "graded", "fok", "jol", "numeric"}
    with pytest.raises(ValueError):
        prompts.build_prompts(q, "mood")
    pair = prompts.tuning_pairs(q).orderBy("question_id").collect()
    assert [m.role for m in pair[0].messages] == ["user", "assistant"] and pair[0].messages[1].content in "xy" and pair[1].messages[1].content == ""
    triple = prompts.tuning_triples(q).first()
    assert [m[1].content for m in triple.meta_messages] == ["No", "Yes"]
    assert q.select(prompts.chat_turn("question")).first()[0] == "what is {answer}?"


def test_sinks(spark, tmp_path):
    one = [("1", "q\tq", ["a", "b"], "p \"x\"", "yes", 1, 1, 0, None, 1)]
    df = spark.createDataFrame(one, "question_id string, question string, ground_truths array<string>, prediction string, meta_answer string, direct_correctness int, yes int, yes_failures int, no_failures int, meta_alignments int")
    sinks.write_binary(df, f"{tmp_path}/b")
    back = spark.read.option("sep", "\t").option("header", True).option("escape", '"').csv(f"{tmp_path}/b")
    assert back.columns == schema.BINARY_COLUMNS and tuple(back.first()) == ("1", "q\tq", '["a","b"]', 'p "x"', "yes", "1", "1", "0", "-100", "1")
    sinks.write_graded(df.withColumn("meta_grade", F.lit(2)), f"{tmp_path}/g")
    sinks.write_threshold(df.withColumns({"yes_over_no": F.lit(2.0), "confidence": F.lit(0.5)}), f"{tmp_path}/t")
    sinks.write_transfer_detail(df.withColumns({"model": F.lit("m"), "dataset": F.lit("d"), "meta_type": F.lit("fok")}), f"{tmp_path}/d")
    assert (tmp_path / "d" / "model=m" / "dataset=d" / "meta_type=fok").exists()
    long = spark.createDataFrame([("m", "d", "fok", "accuracy", 0.5), ("m", "d", "fok", "gamma", 1.0)], schema.TRANSFER_RESULT)
    sinks.write_results(long, f"{tmp_path}/r")
    got = spark.read.json(f"{tmp_path}/r").first()
    assert got.key == "m/d/fok" and json.loads(got.metrics) == {"accuracy": 0.5, "gamma": 1.0}
    for i in (1, 2):
        sinks.append_metrics(long.withColumn("iteration", F.lit(i)), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4
    w = spark.createDataFrame([("a", 0, 1.5)], schema.WEIGHTS)
    sinks.write_weights(w, f"{tmp_path}/w")
    assert rows(sinks.read_weights(spark, f"{tmp_path}/w")) == [("a", 0, 1.5)]
    assert sinks.result_name("nq", "org/m", "test", 10, "fok") == "nq_org_m_test_10_fok.tsv"
    assert sinks.periodic(120, 60) and not sinks.periodic(1, 60)
