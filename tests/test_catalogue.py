"""Every catalogue query against its SQL on the smallest tables, and the entry's contract."""

import os
import random

import duckdb
import pytest

import __spark_entry__
from surety.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are absent")


def cell(x):
    if x is None:
        return "null"
    if isinstance(x, float):
        return "nan" if x != x else repr(round(x, 7) + 0.0)
    return repr(float(x)) if isinstance(x, int) and not isinstance(x, bool) else str(x)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@needs_data
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    made = con.execute(ORACLES[name])
    columns = [d[0] for d in made.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(cell(r[columns.index(c)]) for c in sorted(columns)) for r in made.fetchall())

    def number(x):
        return float(x) if hasattr(x, "as_tuple") else x

    assert sorted(tuple(cell(number(r[c])) for c in sorted(columns)) for r in got) == want


def test_answers_in_another_case_and_items_without_text(spark, tmp_path):
    texts = ["Erßie entech", "ﬁn de siècle", "ΟΔΟΣ οδος", "İstanbul", " leads", "", None]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["inclusion_by_answers"](spark, str(tmp_path)).collect()
    want = duckdb.sql(ORACLES["inclusion_by_answers"].replace("benchmark", f"'{tmp_path}/benchmark.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_containment_equals_a_nested_loop(spark, tmp_path, broadcast):
    from surety.plans import views

    rng = random.Random(broadcast)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    docs = [(i, (" " if i % 5 else "  ").join(word() for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(900, None), (901, "ÉCOLE des filles et autres"), (902, "x" * 50_000 + " one two")]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 7)))) for i in range(60)] + [(i, rng.choice(docs[:80])[1][3:40]) for i in range(60, 90)]
    items += [(200, ""), (201, None), (202, " "), (203, "école"), (204, "ONE TWO"), (205, "a"), (206, "xx one t"), (207, "des filles et"), (208, "s filles e")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted((d, i) for d, t in docs for i, p in items if t is not None and p is not None and p.lower() in t.lower())
    assert sorted(tuple(r) for r in views.containment(spark, str(tmp_path), broadcast).collect()) == want and len(want) > 200


def test_the_core_works_without_the_corpus_part(tmp_path):
    """In a copy without the subpackage and the pipeline, and in one whose subpackage lacks a library."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for broken in (False, True):
        copy = tmp_path / str(broken)
        shutil.copytree(os.path.join(here, "surety"), copy / "surety", ignore=lambda *_: ["llm", "__pycache__"])
        shutil.copy(os.path.join(here, "__spark_entry__.py"), copy)
        if broken:
            (copy / "surety" / "llm").mkdir()
            (copy / "surety" / "llm" / "queries.py").write_text("import no_such_library\n")
            (copy / "corpus_pipeline.py").write_text("from surety.llm import quality\n")
        code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), 'pipeline' in q)"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
        assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLES)), "False"], out.stderr
