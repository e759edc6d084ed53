"""Records of one JSON document against a whole parse, with borders everywhere."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.sources import corpora, json_records
from surety.sources.json_records import Cutter, read_records, transition

KIND = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("more", T.ArrayType(T.StructType([T.StructField("x", T.StringType())])))])
HARD = ['{"a}": [', '\\', '\\"', '"', '}{', ']', '\\\\"}', "é日本", " ", "", "x" * 300, '"}', "\n\t", "\\\\\\"]


def document(seed, n=400, indent=None):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(HARD) for _ in range(rng.randint(0, 6)))
    records = [{"id": i, "text": text(), "more": [{"x": text()} for _ in range(rng.randint(0, 3))]} for i in range(n)]
    other = [{"id": -1, "text": text()} for _ in range(20)]
    doc = {"about": {"Questions": [{"id": -2}], "of": text()}, "first": other, 'Ques}"tions': other, "Questions": records, "last": other, "n": [1, [2, {"id": -3}]]}
    return doc, json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=indent)


def test_transitions_compose_and_cut_at_any_brace():
    doc, text = document(1, 60)
    data = text.encode()
    braces = [i + 1 for i, b in enumerate(data) if b == ord("}")]
    rng = random.Random(2)
    for _ in range(60):
        cuts = [0, *sorted(rng.sample(braces[:-1], rng.randint(0, 12))), len(data)]
        parts = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        inside, depth, found, held, key = False, 0, [], b"", None
        for part in parts:
            cutter = Cutter(inside, depth, 2)
            # a range may come in pieces, cut at braces too
            middle = [i + 1 for i, b in enumerate(part) if b == ord("}")]
            edge = rng.choice([0, *middle])
            got = [*cutter.cut(part[:edge]), *cutter.cut(part[edge:]), *cutter.rest()]
            for kind, piece, k in got:
                k = k if k is not None else key
                if kind in ("tail", "middle"):
                    held += piece
                    if kind == "tail":
                        held_key = k
                else:
                    whole = held + piece if kind == "head" else piece
                    found.append((held_key if kind == "head" else k, whole))
                    held = b"" if kind == "head" else held
            key = cutter.key if cutter.key is not None else key
            flips, outside, within = transition(part)
            inside, depth = inside ^ flips, depth + (within if inside else outside)
        assert (inside, depth) == (False, 0)
        assert [json.loads(t) for k, t in found if k == "Questions"] == doc["Questions"]
        assert [json.loads(t) for k, t in found if k == "last"] == doc["last"]


def plain(rows):
    return [(r.record.id, r.record.text, None if r.record.more is None else [x.x for x in r.record.more]) for r in rows]


def wanted(records):
    return [(r["id"], r["text"], [x["x"] for x in r["more"]] if "more" in r else None) for r in records]


@pytest.mark.parametrize("size, indent", [("1200", None), ("500b", 2), ("128m", None)])
def test_many_tasks_read_what_a_whole_parse_reads(spark, tmp_path, size, indent):
    conf = spark.conf
    was = {k: conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        conf.set("spark.sql.files.maxPartitionBytes", size)
        conf.set("spark.sql.files.openCostInBytes", "0")
        doc, text = document(3, 120, indent=indent)
        (tmp_path / "a.json").write_text(text, encoding="utf-8")
        rows = read_records(spark, str(tmp_path / "a.json"), KIND, "Questions")
        if size != "128m":
            assert spark.read.text(str(tmp_path / "a.json"), lineSep="}").rdd.getNumPartitions() > 15
        assert plain(rows.orderBy("_file", "_block", "_at").collect()) == wanted(doc["Questions"])
        whole = spark.read.json(str(tmp_path / "a.json"), multiLine=True).select(F.explode("Questions").alias("q")).select("q.id", "q.text")
        assert sorted(map(tuple, whole.collect())) == sorted((a, b) for a, b, _ in plain(rows.collect()))
    finally:
        for k, v in was.items():
            conf.set(k, v)


def test_states_by_a_shuffle_and_several_files(spark, tmp_path, monkeypatch):
    docs = [document(s, 50) for s in (5, 6, 7)]
    for i, (_, text) in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(text, encoding="utf-8")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text('{"Questions": [], "Meta": [{"id": 9}]}')
    monkeypatch.setattr("surety.sources.shared.BROADCAST_BYTES", 0)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = read_records(spark, str(tmp_path), KIND, "Questions").orderBy("_file", "_block", "_at").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert plain(rows) == [w for d, _ in docs for w in wanted(d["Questions"])]


def test_an_outermost_array_and_odd_documents(spark, tmp_path):
    def read(text, field=None):
        path = tmp_path / f"{abs(hash(text))}.json"
        path.write_text(text)
        return [r.record.id for r in read_records(spark, str(path), KIND, field).orderBy("_block", "_at").collect()]

    assert read('[{"id": 1}, 5, "}", [{"id": 2}], {"id": 3, "more": [{"x": "}]"}]}]\n') == [1, 3]
    assert read('{"Questions" : \n [{"id": 4}]}', "Questions") == [4] and read('{"Q\\"uestions": [{"id": 4}]}', "Questions") == []
    assert read('{"Questions": [{"id": 1}, {"id": 2, "text": "cut', "Questions") == [1]
    assert read("[]") == read("") == read('{"a": 1}', "Questions") == []
    assert read('[{"id": "no number"}, {}, {"id": 7}]') == [None, None, 7]


def test_a_corpus_through_the_range_reader(spark, tmp_path):
    names = lambda *x: {"Answers": [{"AnswersName": list(x)}]}
    rows = [{"Question-ID": f"q{i}", "RawQuestion": f"what }} is {i}", "Parses": [names("a", f"b{i}"), names("a", "")]} for i in range(300)]
    (tmp_path / "test.json").write_text(json.dumps({"Dataset": "x", "Questions": rows}))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = corpora.load(spark, "freebase_qa", str(tmp_path / "{split}.json"), num_samples=120).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert [tuple(r) for r in got] == [(r["Question-ID"], r["RawQuestion"], ["a", f"b{i}"]) for i, r in enumerate(rows[:120])]


def test_documents_of_bounded_size_hold_every_row(spark, monkeypatch):
    from surety.plans import journeys

    rows = [(i, "}]" * (i % 5) + '"' * (i % 3) + "x" * 100, "s", "en") for i in range(400)] + [(400, None, "s", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    record = F.struct(F.col("doc_id").alias("id"), "text")
    want = sorted(((r[0], r[1]) for r in rows), key=str)
    for most, few in ((1 << 20, 1), (8000, 4)):
        monkeypatch.setattr(journeys, "DOCUMENT_BYTES", most)
        path = journeys._document(docs.select("doc_id", record.alias("record")), "doc_id", "bounded")
        files = [(r.path, r.length) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length").collect()]
        assert few <= len(files) <= 10 * few and max(n for _, n in files) < 3 * most
        for file, _ in files:
            whole = json.loads(spark.read.text(file, wholetext=True).first().value)
            assert whole["Dataset"] == "}["
        got = read_records(spark, path, T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())]), "Questions")
        assert sorted(((r.record.id, r.record.text) for r in got.collect()), key=str) == want
