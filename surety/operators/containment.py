"""Which texts contain which passages, whatever the case: a join by rare keys, without pairs that share none.

A passage inside a text cuts at most its first and last word, so what lies between are whole words of the text. From five
words on, every run of three of them is a candidate key, and a passage is looked up under the one that fewest texts have.
Passages of three and four words have one or two whole words, which may be common: their key takes in the ends of the
words around them, up to EDGE characters of the first and the last word. The longest word of shorter passages lies inside
some word of the text: its vocabulary is searched by pieces of three characters (fewer for shorter words). Empty
passages are in every text. All candidates are verified.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.sources.shared import BROADCAST_BYTES, beside, once

RUN, EDGE, PIECE = 3, 4, 3
#: A passage from these many words on has a run of whole words.
LONG = RUN + 2


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _join(*parts: Column) -> Column:
    return F.xxhash64(F.concat_ws(" ", *parts))


def run_keys(own: Column, first: int = 1, last: int = 0) -> Column:
    """Hashes of the runs of RUN words, but for those that meet the first words left out or the last."""
    starts = F.sequence(F.lit(first), F.size(own) - RUN + 1 - last)
    return F.when(F.size(own) >= RUN - 1 + first + last, F.transform(starts, lambda i: _join(F.lit("run"), F.slice(own, i, F.lit(RUN))))).otherwise(F.array().cast("array<bigint>"))


def edged_key(before: Column, inner: Column, after: Column, a, b) -> Column:
    """The hash of whole words between the last a characters of a word and the first b of another."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    return _join(F.lit("edged"), a.cast("string"), b.cast("string"), F.right(before, a), F.array_join(inner, " "), F.left(after, b))


def _edged_keys(own: Column, inner: int, a: int, b: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(own) - inner - 1)
    key = lambda i: edged_key(F.get(own, i - 1), F.slice(own, i + 1, F.lit(inner)), F.get(own, i + inner), a, b)
    return F.when(F.size(own) >= inner + 2, F.transform(starts, key)).otherwise(F.array().cast("array<bigint>"))


def _pieces(word: Column, n: int) -> Column:
    """The substrings of n characters of a word."""
    return F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, F.lit(n)))


def candidate_keys(items: DataFrame) -> DataFrame:
    """(item_id, key) of the passages of three words and more; items: item_id, w, n."""
    size = lambda i: F.least(F.length(F.get("w", F.lit(0) if i == 0 else F.col("n") - 1)), F.lit(EDGE))
    edged = edged_key(F.get("w", F.lit(0)), F.slice("w", F.lit(2), F.col("n") - 2), F.get("w", F.col("n") - 1), size(0), size(-1))
    keys = F.when(F.col("n") >= LONG, F.array_distinct(run_keys(F.col("w"), 2, 1))).otherwise(F.array(edged))
    return items.where("n >= 3").select("item_id", F.explode(keys).alias("key"))


def _kinds(items: DataFrame) -> tuple[bool, list[tuple[int, int, int]]]:
    """Whether there are long passages, and the shapes (whole words, characters before, after) of the edged keys: at
    most 2 * EDGE ** 2."""
    size = lambda at: F.least(F.length(F.get("w", at)), F.lit(EDGE))
    shapes = items.where(f"n between 3 and {LONG - 1}").select((F.col("n") - 2).alias("k"), size(F.lit(0)).alias("a"), size(F.col("n") - 1).alias("b")).distinct()
    return bool(items.where(F.col("n") >= LONG).limit(1).count()), sorted(tuple(r) for r in shapes.collect())


def _by_keys(docs: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    """(doc_id, item_id) of candidates of three words and more, each found under its rarest key."""
    long_ones, shapes = _kinds(items)
    kinds = ([run_keys(F.col("own"))] if long_ones else []) + [_edged_keys(F.col("own"), *s) for s in shapes]
    if not kinds:
        return docs.select("doc_id", F.lit(0).cast("bigint").alias("item_id")).limit(0)
    keys = once(candidate_keys(items))
    wanted, _ = beside(keys.select("key").distinct(), limit)
    seen = docs.select("doc_id", F.explode(F.array_distinct(F.concat(*kinds))).alias("key"))
    hits = once(seen.join(wanted, "key", "left_semi"))
    # a passage one of whose keys no text has is in none
    texts = hits.groupBy("key").agg(F.count("*").alias("texts"))
    rated = keys.join(texts, "key", "left").groupBy("item_id").agg(F.min_by("key", F.struct("texts", "key")).alias("key"), F.count_if(F.col("texts").isNull()).alias("absent"))
    picked, _ = beside(once(rated.where("absent = 0").select("item_id", "key")), limit)
    return hits.join(picked, "key").select("doc_id", "item_id")


def _by_pieces(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of candidates of one and two words: texts with a word that holds the passage's longest."""
    longest = F.get(F.array_sort("w", lambda a, b: F.length(b) - F.length(a)), F.lit(0))
    short = once(items.where("n between 1 and 2").select("item_id", longest.alias("part"))).withColumn("size", F.least(F.length("part"), F.lit(PIECE)))
    keys = short.select("part", "size", F.substring("part", F.lit(1), F.col("size")).alias("piece")).distinct()
    sizes = sorted(r[0] for r in short.select("size").distinct().collect())
    if not sizes:
        return docs.select("doc_id", F.lit(0).cast("bigint").alias("item_id")).limit(0)
    own = docs.select("doc_id", F.explode(F.array_distinct("own")).alias("word"))
    by_size = [F.when(F.length("word") >= k, F.transform(_pieces(F.col("word"), k), lambda x: F.struct(F.lit(k).alias("size"), x.alias("piece")))) for k in sizes]
    none = F.array().cast("array<struct<size:int,piece:string>>")
    pieces = own.select("word").distinct().select("word", F.explode(F.array_distinct(F.concat(*[F.coalesce(x, none) for x in by_size]))).alias("s")).select("word", "s.*")
    hosts = pieces.join(keys, ["size", "piece"]).where(F.contains("word", F.col("part"))).select("word", "part").distinct()
    return own.join(hosts, "word").select("doc_id", "part").distinct().join(short.select("item_id", "part"), "part").select("doc_id", "item_id")


def containment(docs: DataFrame, items: DataFrame, text="text", doc="doc_id", item="item_id", limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc, item), each pair once, where the document's text contains the item's. Null texts contain nothing and are in
    nothing. limit: bytes that a side may have to be broadcast; beyond it joins shuffle."""
    docs = docs.select(F.col(doc).alias("doc_id"), F.lower(text).alias("t")).where("t is not null").withColumn("own", words(F.col("t")))
    items = items.select(F.col(item).alias("item_id"), F.lower(text).alias("p")).where("p is not null").withColumn("w", words(F.col("p"))).withColumn("n", F.size("w"))
    inside = F.contains("t", F.col("p"))
    found, _ = beside(once(_by_keys(docs, items, limit).unionByName(_by_pieces(docs, items)).distinct()), limit)
    passages, _ = beside(items.select("item_id", "p"), limit)
    parts = [docs.select("doc_id", "t").join(found, "doc_id").join(passages, "item_id").where(inside).select("doc_id", "item_id")]
    blank = items.where("n = 0").select("item_id", "p")
    if blank.limit(1).count():
        # as many rows as there are texts for each: that is the result
        parts.append(docs.select("doc_id", "t").crossJoin(F.broadcast(blank)).where(inside).select("doc_id", "item_id"))
    return reduce(DataFrame.unionByName, parts).distinct().select(F.col("doc_id").alias(doc), F.col("item_id").alias(item))
