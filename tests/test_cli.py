"""The command line over small files."""

import json

from surety import cli
from surety.plans import schema
from surety.sources import sinks


def call(capsys, *argv):
    cli.main(list(argv))
    return json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_evaluations(spark, tmp_path, capsys):
    rows = [(str(i), "q?", ["42"], f"= {40 + i}", str(1 + i), 10, 5, 15, 1.0, float(i)) for i in range(5)]
    spark.createDataFrame(rows, "question_id string, question string, answers array<string>, prediction string, meta_answer string, prompt_tokens long, completion_tokens long, total_tokens long, yes_logit double, no_logit double").write.parquet(f"{tmp_path}/p.parquet")
    base = ["evaluate", "--input", f"{tmp_path}/p.parquet", "--dataset", "gsm8k"]
    got = call(capsys, *base, "--output", f"{tmp_path}/g", "--meta-type", "fok", "--price-model", "gpt-5.2-2025-12-11")
    assert got["accuracy"] == 0.2 and got["mean_grade"] == 3 and got["prompt_tokens"] == 50 and got["total_cost"] > 0
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/g").columns == schema.GRADED_COLUMNS
    assert call(capsys, *base, "--output", f"{tmp_path}/b", "--start", "1", "--num-samples", "2")["accuracy"] == 0.5
    assert call(capsys, *base, "--output", f"{tmp_path}/t", "--mode", "threshold")["yes_rate"] == 0.2
    assert call(capsys, *base, "--output", f"{tmp_path}/a", "--mode", "abstention")["yes_rate"] == 1


def test_transfer_weights_and_loading(spark, tmp_path, capsys):
    rows = [(m, "d", t, i % 2, i % 4 if t == "graded" else i % 2, i / 8) for m in ("a", "b") for t in ("graded", "binary") for i in range(8)]
    spark.createDataFrame(rows, "model string, dataset string, meta_type string, correct int, meta_value int, logit_confidence double").write.parquet(f"{tmp_path}/d.parquet")
    got = call(capsys, "transfer", "--input", f"{tmp_path}/d.parquet", "--output", f"{tmp_path}/t", "--baseline", "a", "--save-details")
    assert got["deltas"] * 2 == got["rows"]
    for name, v in (("x", 2.0), ("y", 0.5)):
        spark.createDataFrame([("w", i, v * i) for i in range(4)], schema.WEIGHTS).write.parquet(f"{tmp_path}/{name}.parquet")
    call(capsys, "extract-weights", "--tuned", f"{tmp_path}/x.parquet", "--base", f"{tmp_path}/y.parquet", "--output", f"{tmp_path}/delta")
    call(capsys, "apply-weights", "--base", f"{tmp_path}/y.parquet", "--delta", f"{tmp_path}/delta", "--output", f"{tmp_path}/z")
    assert sorted(r.value for r in spark.read.parquet(f"{tmp_path}/z").collect()) == [0.0, 2.0, 4.0, 6.0]
    (tmp_path / "n.json").write_text('{"idx": 0, "question": "q", "answer": ["a"]}')
    assert call(capsys, "load", "--dataset", "nq_open", "--input", f"{tmp_path}/n.json", "--output", f"{tmp_path}/q") == {"questions": 1}


def test_from_questions_to_metrics(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "n.json").write_text("\n".join(json.dumps({"question": f"q{i}", "answer": ["Forty Two" if i < 3 else "none"]}) for i in range(4)))
    monkeypatch.syspath_prepend(tmp_path)
    (tmp_path / "stub_models.py").write_text("def make():\n    return lambda prompts: ['I feel 4' if 'how well' in p else 'forty two' for p in prompts]\n")
    spark.sparkContext.addPyFile(str(tmp_path / "stub_models.py"))
    base = ["run", "--dataset", "nq_open", "--input", f"{tmp_path}/n.json", "--model", "stub_models:make"]
    got = call(capsys, *base, "--output", f"{tmp_path}/o", "--meta-type", "fok")
    assert got["n"] == 4 and got["accuracy"] == 0.75 and got["mean_grade"] == 4
    back = sinks.read_tsv(spark, f"{tmp_path}/o/nq_open_make_validation_4_fok.tsv")
    assert back.columns == schema.GRADED_COLUMNS and sorted(r.question_id for r in back.collect()) == ["0", "1", "2", "3"]
    got = call(capsys, *base, "--output", f"{tmp_path}/a", "--mode", "abstention", "--num-samples", "2")
    assert got["n"] == 2 and got["yes_rate"] == 1 and got["accuracy"] == 1
