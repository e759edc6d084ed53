"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is turned into a Boolean trigram query. The index holds, for every trigram that some
query names, the postings of the documents whose case-folded text contains it (the vocabulary is bounded by the
rules, never by the corpus). Postings are intersected per query by counting, and only candidate documents are
verified with the expression; rules without mandatory trigrams scan every document.

Spans are code points, end exclusive, leftmost and non-overlapping within a kind. Defined results: a null text is
empty (no spans); a null key is a key of its own; repeated rows each get their row; an empty table gives no rows.
Every input row gives one output row, whatever its other columns are called; one named like the result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.llm.common import ROW, materialise, packed, small_side, unpacked
from surety.llm.trigram_query import query


@dataclass(frozen=True)
class Rule:
    """measured: the group whose length must reach least; a match that fails is dropped after it was consumed."""

    kind: str
    pattern: str
    measured: int = 0
    least: int = 1


#: The first three are the base kinds; the others are published formats of well-known credentials.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("bearer", r"(?i:authorization: bearer) +[A-Za-z0-9._~+/-]{20,}"),
)
BASE = ("assign", "access", "hex")


def candidates(df: DataFrame, text: Column, key: Column, rules=RULES) -> DataFrame:
    """(_key, _rules): the indexed rules whose trigram query a document's postings satisfy."""
    queries = {r.kind: q for r in rules if (q := query(r.pattern)) is not None}
    terms = [(kind, i, gram, len(grams)) for kind, q in queries.items() for i, grams in enumerate(q) for gram in sorted(grams)]
    vocabulary = sorted({t[2] for t in terms})
    spark = df.sparkSession
    if not vocabulary:
        return df.select(key.alias("_key"), F.array().cast("array<string>").alias("_rules")).limit(0)
    folded = df.select(key.alias("_key"), F.lower(text).alias("_folded"))
    present = F.array_compact(F.array(*[F.when(F.contains("_folded", F.lit(g)), F.lit(g)) for g in vocabulary]))
    postings = folded.select("_key", F.explode(present).alias("gram")).distinct()
    wanted = spark.createDataFrame(terms, "kind string, branch int, gram string, need int")  # as many rows as the rules name
    met = postings.join(F.broadcast(wanted), "gram").groupBy("_key", "kind", "branch", "need").count().where("count = need")
    return met.groupBy("_key").agg(F.collect_set("kind").alias("_rules"))


#: Matches that are placed one after another; longer lists are placed block by block, in about linear time.
BLOCK = 512


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of one rule: the lengths of what lies between the matches and of the matches give the positions."""
    gaps = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sized = found if rule.measured == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.measured))
    lengths = lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit"))
    pairs = F.filter(F.zip_with(found, gaps, lambda hit, gap: lengths(gap, hit)), lambda x: x["hit"].isNotNull())
    rows = F.zip_with(pairs, sized, lambda x, part: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), F.length(part).alias("part")))
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")

    def place(block, base):
        def step(acc, row):
            start = acc["at"] + row["gap"]
            end = start + row["hit"]
            one = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(row["part"] >= rule.least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, F.struct(base.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def placed(blocks):
        widths = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda s, x: s + x["gap"] + x["hit"]))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        bases = F.aggregate(widths, start, lambda acc, w: F.struct((acc["at"] + w).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, bases, place))

    def cut(rows):
        last = F.greatest(F.floor((F.size(rows) - 1) / BLOCK).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(rows, b * BLOCK + 1, F.lit(BLOCK)))

    return _once(_once(rows, cut), placed)


def find_secrets(df: DataFrame, text="text", key="doc_id", rules=RULES, out="secrets") -> DataFrame:
    """df with the array column ``out`` of (start, ord, kind, end), in order of start, then of the rules."""
    rows = packed(df)
    body, own = F.coalesce(F.col(ROW)[text], F.lit("")), F.col(ROW)[key]
    met = materialise(candidates(rows, body, own, rules), "secret-candidates")
    joined = rows.join(small_side(met), own.eqNullSafe(F.col("_key")), "left")
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    kinds = []
    for i, rule in enumerate(rules):
        scan = body.rlike(rule.pattern)
        if query(rule.pattern) is not None:
            scan = F.coalesce(F.array_contains("_rules", rule.kind), F.lit(False)) & scan
        kinds.append(F.when(scan, _spans(body, rule, i)).otherwise(none))
    return joined.withColumn(out, F.array_sort(F.concat(*kinds))).select(*unpacked(df.columns, out))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
