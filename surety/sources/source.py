"""The question corpora as a data source: spark.read.format("surety_corpus").option("corpus", name).load(path).

Files are read in parallel: JSON lines by byte ranges, Parquet by row groups. Conditions on the subject are taken over: row groups whose statistics exclude it aren't read. The rows are those of
corpora.load() for all rows of the files. Corpora whose ids are positions must be Parquet, whose footers tell how many
rows precede a group; the one that is a single JSON document, and halves of a corpus's events, are for load().

Written questions are JSON lines that load() reads as the trivia corpus. Tasks write files under a run's own name; the commit
moves them to theirs, and a run that fails leaves nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from surety.plans import schema as tables
from surety.sources import corpora
from surety.sources.files import listed, opened

#: Bytes of JSON lines that a task reads.
RANGE_BYTES = 32 << 20
#: Rows of a batch on its way to Spark.
BATCH = 4096
NAME = "surety_corpus"


def _solution(text: str | None) -> list[str]:
    found = re.search(corpora.SOLUTION, text or "", re.ASCII)
    answer = found.group(1).strip() if found else ""
    return [x for x in dict.fromkeys((answer, answer.replace(",", ""))) if x]


def _lettered(r: dict) -> str:
    return corpora.CHOICE_INSTRUCTION + r["question"] + "".join(f"\n{a}) {c}" for a, c in zip(corpora.LETTERS, r["choices"]))


def _translated(r: dict, lang: str) -> tuple:
    answers: list[str] = []
    for one in dict(r.get("answers") or ()).get(lang) or []:
        answers += [one["text"]] if one.get("text") else []
        for alias in one.get("aliases") or []:
            answers += [alias] if alias and alias not in answers else []
    queries = dict(r.get("queries") or ())
    return r.get("example_id") or "", queries[lang] if lang in queries else r.get("query") or "", answers


#: How a raw row of a corpus, and its position, become (question_id, question, answers, subject); None drops it.
ROWS: dict[str, Callable[[dict, int, dict], tuple | None]] = {
    "trivia_qa": lambda r, i, o: (r["question_id"], r["question"], (r["answer"] or {}).get("aliases")),
    "fictional_qa": lambda r, i, o: (r["question_id"], r["question"], [r["natural_answer"]]) if r.get("duplicate_relationship") is None else None,
    "gsm8k": lambda r, i, o: (f"gsm8k_{i}", r["question"], found) if (found := _solution(r["answer"])) else None,
    "mkqa": lambda r, i, o: _translated(r, o.get("lang", "en")),
    "mmlu": lambda r, i, o: (f"mmlu_{i}", _lettered(r), [corpora.LETTERS[r["answer"]]], r.get("subject") or "unknown"),
    "nq_open": lambda r, i, o: (str(i), r["question"], r["answer"]),
    "web_questions": lambda r, i, o: (r.get("url") or str(i), r["question"], r["answers"]),
}


@dataclass
class Part(InputPartition):
    """A byte range of JSON lines (start, end), or a row group of Parquet (start: its number) with the rows before it."""

    path: str
    start: int
    end: int
    before: int = 0


def _lines(part: Part) -> Iterator[bytes]:
    """The lines that begin in the range: all from the file's start, or from the first one after a line's end."""
    system, path = opened(part.path)
    with system.open_input_file(path) as f:
        at = part.start
        if at:
            # the line that begins before the range ends with the first break from the byte before it on
            at, skip = at - 1, True
        else:
            skip = False
        f.seek(at)
        held = b""
        while True:
            data = f.read(1 << 20)
            pieces = (held + data).split(b"\n")
            held = pieces.pop() if data else b""
            for piece in pieces:
                begins, at = at, at + len(piece) + 1
                if skip:
                    skip = False
                elif begins >= part.end:
                    return
                elif piece.strip():
                    yield piece
            if not data:
                return


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict, kind: T.StructType):
        self.options, self.kind = options, kind
        self.corpus, self.path = options.get("corpus", ""), options["path"].replace("{split}", options.get("split") or corpora.DEFAULT_SPLITS.get(options.get("corpus", ""), ""))
        self.subjects: set | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("subject",) and "subject" in self.kind.names:
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.subjects = wanted if self.subjects is None else self.subjects & wanted
            else:
                yield f

    def partitions(self) -> list[Part]:
        parquet = listed(self.path, ".parquet")
        if parquet:
            return self._groups([p for p, _ in parquet])
        if self.corpus in corpora.POSITIONAL:
            raise ValueError(f"the ids of {self.corpus} are positions: read Parquet files, or use load()")
        size = int(self.options.get("range_bytes", RANGE_BYTES))
        return [Part(p, a, min(a + size, n)) for p, n in listed(self.path, ".json") for a in range(0, n, size)] or [Part("", 0, 0)]

    def _groups(self, paths: list[str]) -> list[Part]:
        out, before = [], 0
        for p in paths:
            system, name = opened(p)
            with system.open_input_file(name) as f:
                meta = pq.ParquetFile(f).metadata
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                if self._wanted(group):
                    out.append(Part(p, g, -1, before))
                before += group.num_rows
        return out or [Part("", 0, 0)]

    def _wanted(self, group) -> bool:
        """Whether the group's statistics admit a wanted subject; rows without one are unknown."""
        if self.subjects is None or "unknown" in self.subjects:
            return True
        for c in range(group.num_columns):
            column = group.column(c)
            if column.path_in_schema == "subject" and column.is_stats_set and column.statistics.has_min_max:
                return any(column.statistics.min <= s <= column.statistics.max for s in self.subjects if s is not None)
        return True

    def _raw(self, part: Part) -> Iterator[tuple[dict, int]]:
        if part.end >= 0:
            yield from ((json.loads(x), 0) for x in _lines(part))
            return
        system, path = opened(part.path)
        with system.open_input_file(path) as f:
            at = part.before
            for batch in pq.ParquetFile(f).iter_batches(BATCH, row_groups=[part.start]):
                for row in batch.to_pylist():
                    yield row, at
                    at += 1

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        make, held = ROWS[self.corpus], []
        for raw, at in self._raw(part):
            row = make(raw, at, self.options)
            if row is None or self.subjects is not None and row[3] not in self.subjects:
                continue
            held.append(row)
            if len(held) == BATCH:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=self.kind.names)


@dataclass
class Written(WriterCommitMessage):
    part: str
    final: str
    rows: int


class QuestionWriter(DataSourceWriter):
    """Questions as JSON lines of the trivia corpus."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.before = [] if not overwrite else self._old()

    def _old(self) -> list[str]:
        try:
            return [p for p, _ in listed(self.path, ".json")]
        except FileNotFoundError:
            return []

    def write(self, rows) -> Written:
        system, root = opened(self.path)
        system.create_dir(root)
        name = uuid.uuid4().hex
        part, n = f"{root}/.{self.run}-{name}", 0
        with system.open_output_stream(part) as out:
            for r in rows:
                out.write(json.dumps({"question_id": r["question_id"], "question": r["question"], "answer": {"aliases": r["answers"]}}, ensure_ascii=False).encode() + b"\n")
                n += 1
        return Written(part, f"{root}/part-{name}.json", n)

    def commit(self, messages: list) -> None:
        system, root = opened(self.path)
        for m in messages:
            if m is not None:
                system.move(m.part, m.final) if m.rows else system.delete_file(m.part)
        for p in self.before:
            system.delete_file(p)

    def abort(self, messages: list) -> None:
        system, _ = opened(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.part)


class CorpusSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        name = self.options.get("corpus", "")
        if name not in ROWS:
            raise ValueError(f"no corpus {name!r} for this format; one of {', '.join(ROWS)}")
        corpora.check_split(name, self.options.get("split"))
        return tables.CHOICE_QUESTIONS if name == "mmlu" else tables.QUESTIONS

    def reader(self, schema: T.StructType) -> CorpusReader:
        return CorpusReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> QuestionWriter:
        return QuestionWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, which must let Python sources take over conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(CorpusSource)
