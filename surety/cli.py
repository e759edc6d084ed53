"""Command line: evaluations, transfer comparisons and weight tables over files that Spark can open.

    python -m surety.cli evaluate --input predictions.parquet --output out --dataset gsm8k --meta-type fok
    python -m surety.cli run --dataset nq_open --input dev.json --output out --model my_models:make --meta-type fok
    python -m surety.cli transfer --input details.parquet --output out --baseline base --primary tuned
    python -m surety.cli extract-weights --tuned a.parquet --base b.parquet --output delta
    python -m surety.cli apply-weights --base b.parquet --delta delta --output out --filter-ratio 0.3
    python -m surety.cli load --dataset mmlu --input test.json --output questions
"""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surety.functions import score
from surety.operators import compare, cost, evaluate, tensor, transfer
from surety.sources import corpora, sinks


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)


def run_evaluate(spark: SparkSession, a) -> dict:
    """Scores predictions (question_id, question, answers, prediction, meta_answer), writes them, returns the metrics."""
    df = _read(spark, a.input)
    if a.start is not None:
        df = corpora.offset(df, a.start, "question_id")
    if a.num_samples is not None:
        df = df.orderBy("question_id").limit(a.num_samples)
    if a.mode == "threshold":
        scored, write = evaluate.score_threshold(df, dataset=a.dataset), sinks.write_threshold
    elif a.mode == "abstention":
        scored, write = evaluate.score_abstention(df, a.dataset), sinks.write_abstention
    elif a.meta_type in score.SCALES:
        scored, write = evaluate.score_graded(df, a.meta_type, a.dataset), sinks.write_graded
    else:
        scored, write = evaluate.score_binary(df, a.dataset, a.lang if a.dataset == "mkqa" else None), sinks.write_binary
    write(scored, a.output, mode="overwrite")
    out = evaluate.evaluate(scored, [], a.meta_type if a.mode == "answers" else "binary").first().asDict()
    if a.price_model and "prompt_tokens" in df.columns:
        totals = cost.usage_totals(df.withColumn("model", F.lit(a.price_model)), ["model"])
        out |= cost.with_cost(totals, cost.price_table(spark)).drop("model").first().asDict()
    return out


def run_questions(spark: SparkSession, a) -> dict:
    """From a corpus to metrics: loads questions, lets a model answer them, writes the scored trials."""
    module, name = a.model.split(":")
    options = {k: v for k, v in (("num_samples", a.num_samples), ("lang", a.lang if a.dataset == "mkqa" else None)) if v is not None}
    questions = corpora.load(spark, a.dataset, a.input, a.split, **options)
    scored = evaluate.answer_questions(questions, getattr(importlib.import_module(module), name), a.meta_type, a.dataset, a.lang, a.mode)
    graded = a.mode == "answers" and a.meta_type in score.SCALES
    # written before it is measured, so that the model answers once
    scored.write.mode("overwrite").parquet(f"{a.output}/trials")
    scored = spark.read.parquet(f"{a.output}/trials")
    (sinks.write_graded if graded else sinks.write_binary)(scored, f"{a.output}/" + sinks.result_name(a.dataset, name, corpora.check_split(a.dataset, a.split), scored.count(), a.meta_type), mode="overwrite")
    return evaluate.evaluate(scored, [], a.meta_type if graded else "binary").first().asDict()


def run_transfer(spark: SparkSession, a) -> dict:
    details = _read(spark, a.input)
    long = transfer.transfer_results(details, a.meta_types.split(","), "logit_confidence" in details.columns).cache()
    sinks.write_results(long, f"{a.output}/results", mode="overwrite")
    if a.save_details:
        sinks.write_transfer_detail(details, f"{a.output}/details", mode="overwrite")
    out = {"rows": long.count()}
    if a.baseline:
        delta = compare.baseline_delta(long, a.baseline, a.primary)
        delta.write.mode("overwrite").json(f"{a.output}/deltas")
        out["deltas"] = delta.count()
    long.unpersist()
    return out


def run_extract(spark: SparkSession, a) -> dict:
    sinks.write_weights(tensor.weight_delta(sinks.read_weights(spark, a.tuned), sinks.read_weights(spark, a.base)), a.output, mode="overwrite")
    return {"output": a.output}


def run_apply(spark: SparkSession, a) -> dict:
    delta = tensor.magnitude_filter(sinks.read_weights(spark, a.delta), a.filter_ratio, a.from_bottom, a.filter_prefix)
    sinks.write_weights(tensor.apply_delta(sinks.read_weights(spark, a.base), delta), a.output, mode="overwrite")
    return {"output": a.output}


def run_load(spark: SparkSession, a) -> dict:
    options = {k: v for k, v in (("num_samples", a.num_samples), ("lang", a.lang), ("subject", a.subject)) if v is not None}
    questions = corpora.load(spark, a.dataset, a.input, a.split, **options)
    questions.write.mode("overwrite").parquet(a.output)
    return {"questions": spark.read.parquet(a.output).count()}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="surety", description="Confidence evaluations on Spark")
    sub = p.add_subparsers(required=True)

    def command(name, run, *needed):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for n in needed:
            c.add_argument(f"--{n}", required=True)
        return c

    e = command("evaluate", run_evaluate, "input", "output")
    e.add_argument("--dataset", default="trivia_qa", choices=[*corpora.CORPORA])
    e.add_argument("--meta-type", default="binary", choices=["binary", *score.SCALES])
    e.add_argument("--mode", default="answers", choices=["answers", "threshold", "abstention"])
    e.add_argument("--lang")
    e.add_argument("--start", type=int)
    e.add_argument("--num-samples", type=int)
    e.add_argument("--price-model")
    r = command("run", run_questions, "input", "output", "model")
    r.add_argument("--dataset", required=True, choices=[*corpora.CORPORA])
    r.add_argument("--meta-type", default="binary", choices=["binary", *score.SCALES])
    r.add_argument("--mode", default="answers", choices=["answers", "abstention"])
    for n in ("split", "lang"):
        r.add_argument(f"--{n}")
    r.add_argument("--num-samples", type=int)
    t = command("transfer", run_transfer, "input", "output")
    t.add_argument("--meta-types", default="binary,graded,fok,jol,numeric")
    t.add_argument("--baseline")
    t.add_argument("--primary")
    t.add_argument("--save-details", action="store_true")
    command("extract-weights", run_extract, "tuned", "base", "output")
    w = command("apply-weights", run_apply, "base", "delta", "output")
    w.add_argument("--filter-ratio", type=float, default=1.0)
    w.add_argument("--filter-prefix")
    w.add_argument("--from-bottom", action="store_true")
    q = command("load", run_load, "dataset", "input", "output")
    for n in ("split", "lang", "subject"):
        q.add_argument(f"--{n}")
    q.add_argument("--num-samples", type=int)
    return p


def main(argv=None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("surety").getOrCreate()
    print(json.dumps(args.run(spark, args), default=str))


if __name__ == "__main__":
    main()
