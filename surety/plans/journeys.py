"""Queries that go through files, streams or model boundaries, and their SQL: what comes back must be what went in.

Files are written to the session's shared folder from the sample tables and read by the library's own readers.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surety.functions import score
from surety.operators import aggregate, evaluate, generate, metrics, permute, tensor
from surety.plans import oracles, prompts, schema, views
from surety.plans.views import table
from surety.sources import corpora, sinks, source, tensor_files
from surety.sources.shared import once, shared_path
from surety.streaming import counts, runs, sketches

QUERIES, ORACLES = {}, {}


def query(sql: str):
    """Registers a query and the SQL for it."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _words(x="text"):
    return F.split(x, " ")


def _written(df: DataFrame, label: str, ending: str) -> str:
    """df in a new file of the shared folder, rows in their order."""
    path = f"{shared_path(df.sparkSession, label)}/validation.{ending}"
    df.write.format(ending).save(path)
    return path


def _answers(df: DataFrame) -> DataFrame:
    return df.withColumn("answers", F.array_join("answers", "|"))


def _permuted_sql(numbered: str, seed: int) -> str:
    """(all columns, x: the place in epoch e) from the table numbered, which has idx, e and n; the walk is a recursion."""

    def hashed(x, turn):
        a, b, c, d, e, f, g = permute.constants(seed, turn)
        p, q, r = permute.PRIMES
        return f"(((({x} + (e * {a} + {b}) % {p}) % {p} * {c} % {p} % {q} + {d}) % {q} * {e} % {q} % {r} + {f}) % {r} * {g} % {r})"

    def step(x):
        a, b = f"({x} % w)", f"({x} // w)"
        for turn in range(permute.HALF_ROUNDS):
            if turn % 2 == 0:
                a = f"(({a} + {hashed(b, turn)} % w) % w)"
            else:
                b = f"(({b} + {hashed(a, turn)} % h) % h)"
        return f"{a} + {b} * w"

    sides = f"SELECT *, ceil(sqrt(n))::BIGINT AS w, ceil(n / ceil(sqrt(n)))::BIGINT AS h FROM {numbered}"
    return f"WITH RECURSIVE p AS (SELECT *, {step('idx')} AS x FROM ({sides}) UNION ALL SELECT * EXCLUDE (x), {step('x')} AS x FROM p WHERE x >= n)"


ITEMS = "(SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark)"

# corpora


@query(f"SELECT 't' || item_id AS question_id, text AS question, w[1] || '|' || w[-1] AS answers FROM {ITEMS}")
def load_trivia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found by its default split."""
    answer = F.struct(F.array(F.element_at(_words(), 1), F.element_at(_words(), -1)).alias("aliases"), F.element_at(_words(), 1).alias("value"), F.lit("x").alias("type"))
    raw = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("t"), "item_id").alias("question_id"), F.col("text").alias("question"), answer.alias("answer"))
    path = _written(raw, "trivia", "json").replace("validation", "{split}")
    return _answers(corpora.load(spark, "trivia_qa", path))


def _fictional(spark, sf_dir) -> str:
    items = table(spark, sf_dir, "benchmark")
    raw = items.select(F.concat(F.lit("e"), F.col("item_id") % 7).alias("event_id"), F.concat(F.lit("f"), "item_id").alias("question_id"), F.col("text").alias("question"), F.element_at(_words(), 1).alias("natural_answer"), F.when(F.col("item_id") % 5 == 0, "same").alias("duplicate_relationship"))
    return _written(raw, "fictional", "json")


@query(f"SELECT 'f' || item_id AS question_id, text AS question, w[1] AS answers FROM {ITEMS} WHERE item_id % 5 <> 0")
def load_fictional(spark, sf_dir):
    return _answers(corpora.load(spark, "fictional_qa", _fictional(spark, sf_dir), "all"))


def _shuffled_places(seed: int, most: int) -> str:
    """A list by n: the places that Python's seeded shuffle of n numbers puts in the first half, up to most."""
    halves = []
    for n in range(most + 1):
        places = list(range(n))
        random.Random(seed).shuffle(places)
        halves.append(places[: n // 2])
    return f"({halves}::BIGINT[][])"


@query(f"WITH e AS (SELECT event, row_number() OVER (ORDER BY event) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT 'e' || item_id % 7 AS event FROM benchmark WHERE item_id % 5 <> 0)) SELECT 'f' || item_id AS question_id, text AS question, w[1] AS answers FROM {ITEMS} WHERE item_id % 5 <> 0 AND 'e' || item_id % 7 IN (SELECT event FROM e WHERE list_contains({_shuffled_places(42, 7)}[n + 1], idx))")
def load_fictional_split(spark, sf_dir):
    """The half of the events that Python's shuffle of their places with seed 42 puts first."""
    return _answers(corpora.load(spark, "fictional_qa", _fictional(spark, sf_dir), "train"))


#: Bytes of records in one JSON document; larger tables give several documents.
DOCUMENT_BYTES = 256 << 20


def _document(records: DataFrame, key: str, label: str) -> str:
    """JSON documents that hold the column record of all rows, some DOCUMENT_BYTES each; one task writes each of them,
    lines as they come."""
    spark = records.sparkSession
    lines = records.select(F.col(key).alias("key"), F.to_json("record").alias("value"))
    n = max(1, -(-(lines.agg(F.sum(F.octet_length("value"))).first()[0] or 0) // DOCUMENT_BYTES))
    lines = lines.withColumn("document", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int"))
    first = lines.groupBy("document").agg(F.min("key").alias("_first"))  # a row a document
    comma = F.when(F.col("key") == F.col("_first"), F.lit("")).otherwise(F.lit(","))
    inner = lines.join(F.broadcast(first), "document").select("document", F.lit(1).alias("place"), "key", F.concat(comma, "value").alias("value"))
    line = lambda at, text: F.struct(F.lit(at).alias("place"), F.lit(None).cast("bigint").alias("key"), F.lit(text).alias("value"))
    ends = spark.range(n).select(F.col("id").cast("int").alias("document"), F.inline(F.array(line(0, '{"Dataset": "}[", "Questions": ['), line(2, "]}"))))
    path = f"{shared_path(spark, label)}/test.json"
    inner.unionByName(ends).repartitionById(n, "document").sortWithinPartitions("document", "place", "key").select("value").write.text(path)
    return path


def _names(*x):
    return F.struct(F.array(F.struct(F.array(*x).alias("AnswersName"))).alias("Answers"))


@query(f"SELECT 'q' || item_id AS question_id, text AS question, CASE WHEN w[1] = w[2] THEN w[1] ELSE w[1] || '|' || w[2] END AS answers FROM {ITEMS}")
def load_freebase(spark, sf_dir):
    """One JSON document with all questions."""
    one, two = F.element_at(_words(), 1), F.element_at(_words(), 2)
    row = F.struct(F.concat(F.lit("q"), "item_id").alias("Question-ID"), F.col("text").alias("RawQuestion"), F.array(_names(one, F.lit("")), _names(two, one)).alias("Parses"))
    records = table(spark, sf_dir, "benchmark").select("item_id", row.alias("record"))
    return _answers(corpora.load(spark, "freebase_qa", _document(records, "item_id", "freebase")))


@query("SELECT 'd' || doc_id AS question_id, coalesce(text, '') AS question, source || '|' || lang AS answers FROM documents")
def load_json_document(spark, sf_dir):
    """A large JSON document with all texts, whatever brackets and quotes they hold, read by byte ranges; several beyond DOCUMENT_BYTES."""
    row = F.struct(F.concat(F.lit("d"), "doc_id").alias("Question-ID"), F.col("text").alias("RawQuestion"), F.array(_names("source", F.lit("")), _names("lang", "source")).alias("Parses"))
    records = table(spark, sf_dir, "documents").select("doc_id", row.alias("record"))
    return _answers(corpora.load(spark, "freebase_qa", _document(records, "doc_id", "document")))


@query(f"SELECT 'k' || item_id AS question_id, 'ko ' || text AS question, CASE WHEN w[1] = w[2] THEN w[1] ELSE w[1] || '|' || w[2] END AS answers FROM {ITEMS}")
def load_mkqa(spark, sf_dir):
    answers = F.array(F.struct(F.element_at(_words(), 1).alias("text"), F.array(F.element_at(_words(), 2), F.element_at(_words(), 1)).alias("aliases")))
    raw = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("k"), "item_id").alias("example_id"), F.col("text").alias("query"), F.create_map(F.lit("ko"), F.concat(F.lit("ko "), "text")).alias("queries"), F.create_map(F.lit("ko"), answers).alias("answers"))
    return _answers(corpora.load(spark, "mkqa", _written(raw, "mkqa", "json"), lang="ko"))


@query("SELECT (row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR AS question_id, lang || doc_id AS question, source AS answers FROM documents")
def load_nq_open(spark, sf_dir):
    """Ids are positions in files of JSON lines that carry no numbers."""
    raw = table(spark, sf_dir, "documents").orderBy("doc_id").select(F.concat("lang", "doc_id").alias("question"), F.array("source").alias("answer"))
    return _answers(corpora.load(spark, "nq_open", _written(raw, "nq", "json")))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'u' || doc_id ELSE (row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR END AS question_id, lang AS question, source AS answers FROM documents")
def load_web_questions(spark, sf_dir):
    """Ids are addresses, else positions in Parquet files."""
    url = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("u"), "doc_id"))
    raw = table(spark, sf_dir, "documents").orderBy("doc_id").select(url.alias("url"), F.col("lang").alias("question"), F.array("source").alias("answers"))
    return _answers(corpora.load(spark, "web_questions", _written(raw, "web", "parquet")))


@query("SELECT 'gsm8k_' || i AS question_id, o_orderpriority AS question, CASE WHEN contains(g, ',') THEN g || '|' || replace(g, ',', '') ELSE g END AS answers FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, format('{:,}', round_even(o_totalprice, 0)::BIGINT) AS g FROM orders) WHERE o_orderkey % 7 <> 0")
def load_gsm8k(spark, sf_dir):
    solved = F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("work #### "), F.format_number("o_totalprice", 0))).otherwise(F.lit("no mark"))
    raw = table(spark, sf_dir, "orders").orderBy("o_orderkey").select(F.col("o_orderpriority").alias("question"), solved.alias("answer"))
    return _answers(corpora.load(spark, "gsm8k", _written(raw, "gsm8k", "parquet")))


@query(f"SELECT 'mmlu_' || (row_number() OVER (ORDER BY doc_id) - 1) AS question_id, {oracles._quote(corpora.CHOICE_INSTRUCTION)} || source || chr(10) || 'A) a' || chr(10) || 'B) b' || chr(10) || 'C) c' || chr(10) || 'D) d' AS question, ['A', 'B', 'C', 'D'][doc_id % 4 + 1] AS answers, lang AS subject FROM documents WHERE lang = 'fr'")
def load_mmlu(spark, sf_dir):
    """Ids are positions among the questions of the subject."""
    choices = F.array(*[F.lit(x) for x in "abcd"])
    raw = table(spark, sf_dir, "documents").orderBy("doc_id").select(F.col("source").alias("question"), F.col("lang").alias("subject"), choices.alias("choices"), (F.col("doc_id") % 4).cast("int").alias("answer"))
    return _answers(corpora.load(spark, "mmlu", _written(raw, "mmlu", "json"), subject="fr"))


@query("SELECT 'mmlu_' || i AS question_id, source AS question, ['A', 'B', 'C', 'D'][doc_id % 4 + 1] AS answers, lang AS subject FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE lang IN ('fr', 'de')")
def source_format(spark, sf_dir):
    """A corpus through its data source, with a condition on the subject; ids are positions among all rows."""
    source.register(spark)
    choices = F.array(*[F.lit(x) for x in "abcd"])
    raw = table(spark, sf_dir, "documents").orderBy("doc_id").select(F.col("source").alias("question"), F.col("lang").alias("subject"), choices.alias("choices"), (F.col("doc_id") % 4).cast("int").alias("answer"))
    read = spark.read.format(source.NAME).option("corpus", "mmlu").load(_written(raw, "source", "parquet")).where("subject IN ('fr', 'de')")
    question = F.split(F.replace("question", F.lit(corpora.CHOICE_INSTRUCTION), F.lit("")), "\n")[0]
    return _answers(read.withColumn("question", question))


# result files

#: Turns as trials: the first word of the answer is the truth, the answer the prediction, the question the confidence.
TURNS = f"(SELECT conv_id || '/' || turn AS question_id, question, answer, string_split(answer, ' ')[1] AS truth, contains(lower(question), 'the')::BIGINT AS t, conv_id, turn, length(question) % 7 AS d FROM {oracles.TURNS})"


def _turns(spark, sf_dir) -> DataFrame:
    """Every other truth is one that the prediction lacks."""
    pairs = views.turn_pairs(spark, sf_dir)
    truth = F.when(F.col("turn") % 4 == 0, F.lit("nowhere")).otherwise(F.element_at(_words("answer"), 1))
    says = F.when(F.col("conv_id") % 3 == 0, "Yes, I am").otherwise("No")
    return pairs.select(F.concat_ws("/", "conv_id", "turn").alias("question_id"), "question", F.array(truth).alias("answers"), F.col("answer").alias("prediction"), says.alias("meta_answer"), "conv_id", "turn")


SCORED = f"(SELECT conv_id, turn, conv_id || '/' || turn AS question_id, question, answer AS prediction, CASE WHEN conv_id % 3 = 0 THEN 'Yes, I am' ELSE 'No' END AS meta_answer, CASE WHEN turn % 4 = 0 THEN 'nowhere' ELSE string_split(answer, ' ')[1] END AS truth, contains(lower(answer), lower(CASE WHEN turn % 4 = 0 THEN 'nowhere' ELSE string_split(answer, ' ')[1] END))::BIGINT AS c, (conv_id % 3 = 0)::BIGINT AS y FROM {oracles.TURNS})"
ROW = "c AS direct_correctness, y AS yes, CASE WHEN y = 1 THEN 1 - c ELSE -100 END AS yes_failures, CASE WHEN y = 0 THEN c ELSE -100 END AS no_failures, (c = y)::BIGINT AS meta_alignments"
FLAGS = ("direct_correctness", "yes", "yes_failures", "no_failures", "meta_alignments")


def _read_back(spark, path, numbers=FLAGS, more=()) -> DataFrame:
    """Texts as written, numbers as numbers, the first ground truth."""
    rows = sinks.read_tsv(spark, path)
    return rows.select("question_id", "question", "prediction", "meta_answer", F.get_json_object("ground_truths", "$[0]").alias("truth"), *[F.col(c).cast("bigint").alias(c) for c in numbers], *more)


@query(f"SELECT question_id, question, prediction, meta_answer, truth, {ROW} FROM {SCORED}")
def sink_binary(spark, sf_dir):
    path = shared_path(spark, "binary")
    sinks.write_binary(evaluate.score_binary(_turns(spark, sf_dir)), path)
    return _read_back(spark, path)


@query(f"SELECT question_id, {ROW} FROM {SCORED}")
def row_bundle(spark, sf_dir):
    scored = evaluate.score_binary(_turns(spark, sf_dir), keep_length=True)
    return scored.select("question_id", *[F.col(c).cast("bigint").alias(c) for c in FLAGS])


@query(f"SELECT question_id, question, prediction, 'I say ' || conv_id % 9 AS meta_answer, truth, c AS direct_correctness, CASE WHEN conv_id % 9 BETWEEN 1 AND 5 THEN conv_id % 9 ELSE 3 END AS meta_grade FROM {SCORED}")
def sink_graded(spark, sf_dir):
    path = shared_path(spark, "graded")
    rows = _turns(spark, sf_dir).withColumn("meta_answer", F.concat(F.lit("I say "), F.col("conv_id") % 9))
    sinks.write_graded(evaluate.score_graded(rows, "fok"), path)
    return _read_back(spark, path, ("direct_correctness", "meta_grade"))


@query(f"SELECT question_id, question, prediction, CASE WHEN turn > 2 THEN 'Yes' ELSE 'No' END AS meta_answer, truth, {ROW.replace('y ', 'z ').replace('y AS', 'z AS').replace('= y)', '= z)')}, round(exp(turn - 2), 6) AS yes_over_no, round(1 - 1 / (exp(turn - 2) + 1), 6) AS confidence FROM (SELECT *, (turn > 2)::BIGINT AS z FROM {SCORED})")
def sink_threshold(spark, sf_dir):
    path = shared_path(spark, "threshold")
    rows = _turns(spark, sf_dir).withColumns({"yes_logit": F.col("turn").cast("double"), "no_logit": F.lit(2.0)})
    sinks.write_threshold(evaluate.score_threshold(rows), path)
    return _read_back(spark, path, more=[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("yes_over_no", "confidence")])


@query(f"SELECT question_id, question, p AS prediction, CASE WHEN contains(lower(p), 'i don''t know') THEN 'no' ELSE 'yes' END AS meta_answer, truth, {ROW.replace('c AS', 'x AS').replace('1 - c', '1 - x').replace('THEN c', 'THEN x').replace('(c =', '(x =').replace('y ', 'z ').replace('y AS', 'z AS').replace('= y)', '= z)')} FROM (SELECT *, contains(lower(p), lower(truth))::BIGINT AS x, (NOT contains(lower(p), 'i don''t know'))::BIGINT AS z FROM (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'I don''t KNOW ' ELSE '' END || prediction AS p FROM {SCORED}))")
def sink_abstention(spark, sf_dir):
    path = shared_path(spark, "abstention")
    said = F.concat(F.when(F.col("conv_id") % 2 == 0, "I don't KNOW ").otherwise(""), "prediction")
    sinks.write_abstention(evaluate.score_abstention(_turns(spark, sf_dir).withColumn("prediction", said)), path)
    return _read_back(spark, path)


def make_echo():
    """A stand-in for a remote model: the prompt backwards, and counts; prompts of 7 n characters fail."""

    def call(prompt: str) -> dict:
        if len(prompt) % 7 == 0:
            raise ConnectionError("no answer")
        return {"text": prompt[::-1], "prompt_tokens": len(prompt), "completion_tokens": 1}

    return call


_SAID = "CASE WHEN length({0}) % 7 = 0 THEN '' ELSE reverse({0}) END"
_COST = "CASE WHEN length({0}) % 7 = 0 THEN 0 ELSE length({0}) END"


@query(f"SELECT question_id, prediction, meta_answer, p + m AS prompt_tokens, (p > 0)::BIGINT + (m > 0)::BIGINT AS completion_tokens, contains(lower(prediction), reverse(lower(truth)))::BIGINT AS direct_correctness, contains(lower(meta_answer), 'yes')::BIGINT AS yes FROM (SELECT question_id, truth, {_SAID.format('question')} AS prediction, {_SAID.format('answer')} AS meta_answer, {_COST.format('question')} AS p, {_COST.format('answer')} AS m FROM {TURNS})")
def sink_remote(spark, sf_dir):
    """Answers of a remote model with failures, scored, written and read; token counts stay beside the file."""
    pairs = views.turn_pairs(spark, sf_dir).select(F.concat_ws("/", "conv_id", "turn").alias("question_id"), "question", F.array(F.reverse(F.element_at(_words("answer"), 1))).alias("answers"), F.col("question").alias("direct_prompt"), F.col("answer").alias("meta_prompt"))
    scored = once(evaluate.score_binary(generate.remote_chat(pairs, make_echo)))
    path = shared_path(spark, "remote")
    sinks.write_remote(scored, path)
    back = sinks.read_tsv(spark, path).select("question_id", F.coalesce("prediction", F.lit("")).alias("prediction"), F.coalesce("meta_answer", F.lit("")).alias("meta_answer"), *[F.col(c).cast("bigint").alias(c) for c in ("direct_correctness", "yes")])
    return back.join(scored.select("question_id", "prompt_tokens", "completion_tokens"), "question_id")


def _details(spark, sf_dir) -> DataFrame:
    rows = views.trial_events(spark, sf_dir)
    return rows.select(F.concat(F.lit("m/"), F.col("id") % 2).alias("model"), F.col("k").alias("dataset"), F.lit("graded").alias("meta_type"), "id", "correct", F.col("grade").alias("meta_value"))


@query(f"SELECT 'm/' || id % 2 AS model, k AS dataset, 'graded' AS meta_type, count(*) AS n, sum(correct)::BIGINT AS correct, sum(grade)::BIGINT AS grades, sum(id)::BIGINT AS ids FROM {oracles.EVENTS} GROUP BY ALL")
def sink_transfer_detail(spark, sf_dir):
    path = shared_path(spark, "details")
    sinks.write_transfer_detail(_details(spark, sf_dir), path)
    back = sinks.read_tsv(spark, path)
    total = lambda c, name: F.sum(F.col(c).cast("bigint")).alias(name)
    return back.groupBy("model", "dataset", "meta_type").agg(F.count("*").alias("n"), total("correct", "correct"), total("meta_value", "grades"), total("id", "ids"))


@query(f"SELECT 'm/' || id % 2 || '/' || k || '/graded' AS key, round(avg(correct), 7) AS accuracy, round(avg(grade), 7) AS mean_grade FROM {oracles.EVENTS} GROUP BY ALL")
def sink_results(spark, sf_dir):
    from surety.operators import transfer

    path = shared_path(spark, "results")
    sinks.write_results(transfer.transfer_results(_details(spark, sf_dir), ("graded",)), path)
    value = lambda c: F.round(F.get_json_object("metrics", f"$.{c}").cast("double"), 7).alias(c)
    return spark.read.json(path).select("key", value("accuracy"), value("mean_grade"))


@query(f"SELECT i AS iteration, k, count(*) AS n, i % 2 = 0 AS due FROM {oracles.EVENTS}, (SELECT unnest([1, 2, 3]) AS i) GROUP BY ALL")
def sink_metric_log(spark, sf_dir):
    """Three appends to one log, and which iterations a period of two marks."""
    path = shared_path(spark, "log")
    for i in (1, 2, 3):
        sinks.append_metrics(views.trial_events(spark, sf_dir).groupBy("k").agg(F.count("*").alias("n")).withColumn("iteration", F.lit(i).cast("bigint")), path, f"run-{i}")
    return sinks.read_metrics(spark, path).drop("commit").withColumn("due", sinks.periodic(F.col("iteration"), 2))


@query(f"SELECT name, pos, value FROM {oracles.WEIGHTS}")
def weights_round_trip(spark, sf_dir):
    path = shared_path(spark, "weights")
    sinks.write_weights(views.weights(spark, sf_dir), path)
    return sinks.read_weights(spark, path)


@query(f"SELECT name, pos, value FROM {oracles.WEIGHTS}")
def tensor_round_trip(spark, sf_dir):
    """Weights through files of the flat tensor format, read by byte ranges."""
    path = shared_path(spark, "tensors") + tensor_files.ENDING
    sinks.write_weights(views.weights(spark, sf_dir), path)
    return tensor_files.read_tensors(spark, path, chunk=24)


#: A run of twelve iterations whose loss is the mean price of every twelfth order.
LOSSES = "(SELECT o_orderkey % 12 + 1 AS iteration, round(avg(o_totalprice), 4) AS loss FROM orders GROUP BY ALL)"


@query(f"SELECT iteration, name, sum(pos)::BIGINT AS pos, round(sum(value), 6) AS value FROM (SELECT iteration, name, pos, value * iteration AS value FROM {oracles.WEIGHTS}, (SELECT a.iteration FROM {LOSSES} a WHERE a.iteration % 5 = 0 OR a.iteration = (SELECT max(iteration) FROM {LOSSES}) OR NOT EXISTS (SELECT 1 FROM {LOSSES} b WHERE b.iteration < a.iteration AND b.loss <= a.loss))) GROUP BY ALL")
def checkpoints(spark, sf_dir):
    """Weights of a run's iterations: every fifth, the last, and those that were the best so far are written."""
    log = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 12 + 1).alias("iteration")).agg(F.round(F.avg("o_totalprice"), 4).alias("loss"))
    run = views.weights(spark, sf_dir).withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(12)).cast("array<bigint>")))
    path = shared_path(spark, "checkpoints")
    sinks.write_checkpoints(run.withColumn("value", F.col("value") * F.col("iteration")), log, path, 5)
    back = spark.read.parquet(path).groupBy("iteration", "name").agg(F.sum("pos").alias("pos"), F.round(F.sum("value"), 6).alias("value"))
    return back.withColumn("iteration", F.col("iteration").cast("bigint"))


@query("SELECT source || '_org_' || lang || '_validation_' || count(*) || CASE WHEN lang = 'en' THEN '' ELSE '_fok' END || '.tsv' AS name, count(*) AS n FROM documents GROUP BY source, lang")
def output_names(spark, sf_dir):
    """The result file of each source (as a dataset) and language (as a model)."""
    groups = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    suffix = F.when(F.col("lang") != "en", "fok")
    return groups.select(sinks.result_names("source", F.concat(F.lit("org/"), "lang"), F.lit("validation"), "n", suffix).alias("name"), "n")


_NAMED = "['trivia_qa', 'fictional_qa', 'freebase_qa', 'gsm8k', 'mkqa', 'mmlu', 'nq_open', 'web_questions', 'none'][item_id % 9 + 1]"


@query(f"SELECT item_id, dataset, CASE dataset WHEN 'trivia_qa' THEN 'validation' WHEN 'nq_open' THEN 'validation' WHEN 'fictional_qa' THEN 'train' WHEN 'mkqa' THEN 'train' WHEN 'none' THEN NULL ELSE 'test' END AS split FROM (SELECT item_id, {_NAMED} AS dataset FROM benchmark)")
def corpus_splits(spark, sf_dir):
    """The split that each passage's corpus has by default."""
    names = F.array(*[F.lit(x) for x in (*corpora.CORPORA, "none")])
    items = table(spark, sf_dir, "benchmark").select("item_id", F.get(names, (F.col("item_id") % 9).cast("int")).alias("dataset"))
    return items.withColumn("split", corpora.default_split(F.col("dataset")))


@query(f"{_permuted_sql('(SELECT event, row_number() OVER (ORDER BY event) - 1 AS idx, count(*) OVER () AS n, 0::BIGINT AS e FROM (SELECT DISTINCT source || lang AS event FROM documents WHERE doc_id % 11 <> 0))', 42)} SELECT 'd' || doc_id AS question_id, lang AS question, source AS answers FROM documents WHERE doc_id % 11 <> 0 AND source || lang IN (SELECT event FROM p WHERE x < n // 2)")
def load_fictional_halves(spark, sf_dir):
    """The first half of the events by a permutation of their places; nothing goes to the driver."""
    docs = table(spark, sf_dir, "documents")
    raw = docs.select(F.concat("source", "lang").alias("event_id"), F.concat(F.lit("d"), "doc_id").alias("question_id"), F.col("lang").alias("question"), F.col("source").alias("natural_answer"), F.when(F.col("doc_id") % 11 == 0, "same").alias("duplicate_relationship"))
    return _answers(corpora.load(spark, "fictional_qa", _written(raw, "halves", "json"), "train", exact=False))


# prompts and tuning rows


@query(f"SELECT conv_id, turn, {oracles._fill(prompts.DIRECT_OR_ABSTAIN, 'question')} AS abstain_prompt, {oracles._fill(prompts.META['fok'], 'question')} AS fok_prompt, {oracles._fill(prompts.META['numeric'], 'question')} AS numeric_prompt FROM {oracles.TURNS}")
def probe_prompts(spark, sf_dir):
    pairs = views.turn_pairs(spark, sf_dir)
    return pairs.select("conv_id", "turn", prompts.direct_prompt("question", may_abstain=True).alias("abstain_prompt"), prompts.meta_prompt("fok", "question").alias("fok_prompt"), prompts.meta_prompt("numeric", "question").alias("numeric_prompt"))


def _questions(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").cast("string").alias("question_id"), F.col("text").alias("question"), F.slice(_words(), 1, 5).alias("answers"))


@query(f"SELECT item_id::VARCHAR AS question_id, {oracles._fill(prompts.DIRECT['en'], 'text')} AS prompt, w[1:5][('0x' || substr(md5(item_id || ':42'), 1, 13))::BIGINT % len(w[1:5]) + 1] AS reply FROM {ITEMS}")
def tuning_pairs(spark, sf_dir):
    made = prompts.tuning_pairs(_questions(spark, sf_dir))
    return made.select("question_id", F.col("messages")[0]["content"].alias("prompt"), F.col("messages")[1]["content"].alias("reply"))


@query(f"SELECT item_id::VARCHAR AS question_id, {oracles._fill(prompts.DIRECT['en'], 'text')} AS direct_prompt, {oracles._fill(prompts.META['binary'], 'text')} AS meta_prompt, 'assistant:No,assistant:Yes' AS replies FROM {ITEMS}")
def tuning_triples(spark, sf_dir):
    made = prompts.tuning_triples(_questions(spark, sf_dir))
    replies = F.array_join(F.transform("meta_messages", lambda m: F.concat_ws(":", m[1]["role"], m[1]["content"])), ",")
    return made.select("question_id", "direct_prompt", F.col("meta_messages")[0][0]["content"].alias("meta_prompt"), replies.alias("replies"))


@query(f"SELECT id, (grade >= 4)::BIGINT AS high, ((grade >= 4) = (correct = 1))::BIGINT AS aligned FROM {oracles.ORDERS}")
def grade_thresholds(spark, sf_dir):
    rows = views.trial_orders(spark, sf_dir).withColumn("grade", score.parse_number_grade("meta_output", 5))
    return rows.select("id", score.at_least("grade", 4).cast("bigint").alias("high"), score.grade_aligned("correct", "grade", 4).cast("bigint").alias("aligned"))


# model boundaries


def make_parrot():
    """A stand-in for a model: it repeats a direct prompt, and to other prompts says Yes where their length is even."""
    return lambda texts: [t if t.startswith("Give") else "Yes" if len(t) % 2 == 0 else "No" for t in texts]


_ASKED = f"(SELECT k, (length({oracles._fill(prompts.META['binary'], 'question')}) % 2 = 0)::BIGINT AS y, contains(lower({oracles._fill(prompts.DIRECT['en'], 'question')}), lower(truth))::BIGINT AS c FROM (SELECT conv_id % 3 AS k, question, CASE WHEN turn % 4 = 0 THEN 'nowhere to be found' ELSE string_split(question, ' ')[1] END AS truth FROM {oracles.TURNS}))"


@query(f"SELECT k, count(*) AS n, round(avg(c), 9) AS accuracy, round(avg(y), 9) AS yes_rate, round(avg((c = y)::INT), 9) AS meta_alignment, round(coalesce(avg(1 - c) FILTER (y = 1), 0.0), 9) AS yes_failure_ratio FROM {_ASKED} GROUP BY k")
def questions_to_metrics(spark, sf_dir):
    """The whole way: prompts, answers of a model, scores, metrics."""
    truth = F.when(F.col("turn") % 4 == 0, "nowhere to be found").otherwise(F.element_at(_words("question"), 1))
    questions = views.turn_pairs(spark, sf_dir).select(F.concat_ws("/", "conv_id", "turn").alias("question_id"), "question", F.array(truth).alias("answers"), (F.col("conv_id") % 3).alias("k"))
    out = evaluate.evaluate(evaluate.answer_questions(questions, make_parrot), ["k"])
    return out.select("k", "n", *[F.round(c, 9).alias(c) for c in ("accuracy", "yes_rate", "meta_alignment", "yes_failure_ratio")])


def make_lengths():
    """A stand-in for a tokenizer: a word's id is its length."""
    return lambda texts: [[len(w) for w in t.split(" ")] for t in texts]


@query(f"SELECT item_id, {oracles._joined('list_transform(w[1:6], lambda x: length(x))')} AS ids FROM {ITEMS}")
def tokenise(spark, sf_dir):
    made = generate.tokenise(table(spark, sf_dir, "benchmark"), make_lengths, "text", max_length=6)
    return made.select("item_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def make_logits():
    """A stand-in for first-token logits: tenths of the prompt's length, and of its words."""
    return lambda texts: [[len(t) / 10, len(t.split(" ")) / 10] for t in texts]


@query(f"SELECT item_id, round(1 - 1 / (exp(length(text) / 10.0 - len(w) / 10.0) + 1), 9) AS confidence FROM {ITEMS}")
def logits_to_confidence(spark, sf_dir):
    from surety.functions import logits

    made = generate.first_token_logits(table(spark, sf_dir, "benchmark").withColumn("meta_prompt", F.col("text")), make_logits)
    odds = logits.yes_odds(F.col("logits")[0], F.col("logits")[1])
    return made.select("item_id", F.round(logits.odds_confidence(odds), 9).alias("confidence"))


# order and streams


@query("SELECT o_orderkey, row_number() OVER (ORDER BY ('0x' || substr(md5('9:0:' || o_orderkey), 1, 13))::BIGINT, o_orderkey) - 1 AS idx FROM orders")
def seeded_shuffle(spark, sf_dir):
    return tensor.shuffle_positions(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 9)


@query(f"{_permuted_sql('(SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx, count(*) OVER () AS n, unnest(range(0, 300)) AS e FROM benchmark)', 3)} SELECT item_id, e AS epoch, x // 16 AS batch FROM p WHERE x < n")
def epoch_batches(spark, sf_dir):
    """A loader that shuffles anew in each of three hundred epochs."""
    made = tensor.epoch_batches(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", 16, 300, 3)
    return made.select("item_id", F.col("epoch").cast("bigint").alias("epoch"), F.col("batch").cast("bigint").alias("batch"))


@query(f"{_permuted_sql('(SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS n, unnest([0, 1, 2]::BIGINT[]) AS e FROM orders)', 5)} SELECT e * (n // 64 + (n % 64 > 0)::BIGINT) + x // 64 AS iteration, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, min(o_orderkey) AS first_key FROM p WHERE x < n GROUP BY ALL")
def loader_batches(spark, sf_dir):
    """The batches of three epochs of an endless loader over the orders, drawn by the inverse permutation."""
    rows = corpora.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    n = rows.count()
    drawn = tensor.loader_batches(spark, n, 64, 5, 0, 3 * -(-n // 64) - 1)
    return drawn.join(rows, "idx").groupBy("iteration").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.min("o_orderkey").alias("first_key"))


@query(f"SELECT k, round({oracles.GAMMA}, 9) AS gamma, round({oracles.AUROC}, 9) AS type2_auroc FROM {oracles._pairs(oracles.EVENTS)}")
def streamed_ranks(spark, sf_dir):
    """Trials arrive as a stream of files; its counts give the rank statistics."""
    root = shared_path(spark, "stream")
    views.trial_events(spark, sf_dir).select("k", "correct", "grade").write.parquet(f"{root}/in")
    stream = spark.readStream.schema("k string, correct int, grade int").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    counted = counts.streaming_contingency(stream, ["k"])
    latest = lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/counts-{n}")
    run = counted.writeStream.outputMode("complete").option("checkpointLocation", f"{root}/checkpoint").foreachBatch(latest).trigger(availableNow=True).start()
    run.awaitTermination()
    last = run.lastProgress["batchId"]
    out = counts.rank_from_counts(spark.read.parquet(f"{root}/counts-{last}"), ["k"])
    return out.select("k", F.round("gamma", 9).alias("gamma"), F.round("type2_auroc", 9).alias("type2_auroc"))


@query(f"SELECT k, count(*) FILTER (correct = 1) AS n_right, count(*) FILTER (correct = 0) AS n_wrong, true AS within FROM {oracles.EVENTS} GROUP BY k")
def streamed_scores(spark, sf_dir):
    """Areas from sketches that a stream of files has filled: whether each is within the bound of the exact area."""
    root = shared_path(spark, "scores")
    rows = views.trial_events(spark, sf_dir).select("k", "correct", "score")
    rows.repartition(4).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("k string, correct int, score double").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    latest = lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/sketches-{n}")
    run = sketches.score_sketches(stream, ["k"]).writeStream.outputMode("complete").option("checkpointLocation", f"{root}/checkpoint").foreachBatch(latest).trigger(availableNow=True).start()
    run.awaitTermination()
    last = spark.read.parquet(f"{root}/sketches-{run.lastProgress['batchId']}")
    exact = metrics.auroc_continuous(rows, ["k"]).select("k", "type2_auroc")
    within = F.abs(F.col("area") - F.col("type2_auroc")) <= sketches.error_bound()
    return last.join(sketches.areas(last, ["k"]), "k").join(exact, "k").select("k", F.col("right").alias("n_right"), F.col("wrong").alias("n_wrong"), within.alias("within"))


def _file_stream(df: DataFrame, order: str, parts: int, label: str) -> tuple[str, DataFrame]:
    """(folder, stream) of df's rows, in files that arrive in the given order."""
    spark, root = df.sparkSession, shared_path(df.sparkSession, label)
    high = df.agg(F.max(order)).first()[0] or 0
    for i in range(parts):
        part = F.least(F.floor(F.col(order) * parts / (high + 1)), F.lit(parts - 1))
        df.where(part == i).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return root, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


@query("SELECT o_orderkey AS iteration, o_custkey AS run, (o_totalprice < coalesce(min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE))::BIGINT AS best, (o_orderkey % 10 = 0)::BIGINT AS due FROM orders")
def streamed_best(spark, sf_dir):
    """The best loss so far of every run, and a period's triggers, as state of a stream."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("iteration"), F.col("o_totalprice").alias("loss"))
    root, stream = _file_stream(rows, "iteration", 3, "runs")
    with runs.named_state(spark, rows.count()):
        run = runs.running_best(stream, 10).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    flag = lambda c: F.col(c).cast("int").cast("bigint").alias(c)
    return spark.read.parquet(f"{root}/out").select("iteration", "run", flag("best"), flag("due"))


@query(f"SELECT k, count(*) AS n, sum(correct)::BIGINT AS correct, 3 AS commits FROM {oracles.EVENTS} GROUP BY k")
def replayed_log(spark, sf_dir):
    """A stream's metrics are logged by batch; the last batch's commit is forgotten and made again."""
    rows = views.trial_events(spark, sf_dir).select("id", "k", "correct")
    root, stream = _file_stream(rows, "id", 3, "replay")
    totals = lambda batch: batch.groupBy("k").agg(F.count("*").alias("n"), F.sum("correct").alias("correct"))
    for again in (False, True):
        if again:
            forget = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/checkpoint/commits/2")
            forget.getFileSystem(spark._jsc.hadoopConfiguration()).delete(forget, False)
        runs.log_metrics(stream, f"{root}/log", f"{root}/checkpoint", "run", totals).awaitTermination()
    log = sinks.read_metrics(spark, f"{root}/log")
    commits = log.agg(F.countDistinct("commit").alias("commits"))
    return log.groupBy("k").agg(F.sum("n").alias("n"), F.sum("correct").alias("correct")).crossJoin(F.broadcast(commits))


def binned_error(bins: int = 10) -> aggregate.Metric:
    """Expected calibration error over equal bins of a confidence in [0, 1], as a metric of a user's own."""
    import numpy as np

    def add(state, rows):
        at = np.minimum((rows["confidence"].to_numpy() * bins).astype(int), bins - 1)
        return state + np.stack([np.bincount(at, w, bins) for w in (None, rows["confidence"], rows["correct"])])

    def finish(state):
        n, confidence, correct = state
        return (float(np.abs(correct - confidence).sum() / n.sum()), int(n.sum()))

    return aggregate.Metric(lambda: np.zeros((3, bins)), add, lambda a, b: a + b, finish, ("confidence", "correct"), "error double, n bigint")


@query(f"SELECT k, round(sum(abs(right_ - sure)) / sum(n), 9) AS error, sum(n)::BIGINT AS n FROM (SELECT k, least(floor(score / 100 * 10), 9) AS bin, count(*) AS n, sum(correct) AS right_, sum(score / 100) AS sure FROM {oracles.EVENTS} GROUP BY ALL) GROUP BY k")
def user_metric(spark, sf_dir):
    """A user's metric by group through mergeable states."""
    rows = views.trial_events(spark, sf_dir).withColumn("confidence", F.col("score") / 100)
    out = aggregate.aggregate(rows, ["k"], binned_error())
    return out.select("k", F.round("error", 9).alias("error"), "n")
