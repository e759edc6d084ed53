"""N-gram Jaccard self-join by vertical partitioning (after Rong et al., FS-Join), down to connected components.

A text's set holds the distinct n-word shingles as 64-bit hashes. Equal sets form a class and are joined once. The
global n-gram order is cut into fragments and overlaps are counted fragment by fragment, then summed:

1. Fragments of the hash order. Each fragment holds its segment of every set, and counts how many of a segment's
   n-grams occur in some other set; summed over the fragments, that bounds a set's overlap with any other. Sets whose
   bound is below the threshold can have no partner and are done. An n-gram that repeats among the sets of one batch
   is settled in the batch and sent once, so a passage shared by a third of all texts costs one entry a batch. Hashes
   are cut to 32 bits within a fragment here, whose density is constant; a collision can only raise the bound.
2. For the few sets left, n-grams are ordered by (document frequency, hash). Sets that share an n-gram of their
   prefixes in that order (what must be shared to reach the threshold) fall into one candidate group, if at least one
   of them shares enough to have a partner of its own size.
3. Groups are cut into blocks of at most BLOCK sets. A unit of work is one or two blocks: the order's fragments of
   FRAGMENT n-grams give partial overlaps of its pairs as products of 0/1 matrices, which are summed, compared with
   the threshold and reduced to a spanning forest, so no list of pairs is made. First each block meets itself and the
   group's first block; then only sets outside a group's main component meet the whole group. Copies by the thousand
   therefore cost linear work, and no link between different texts is lost.

Defined results: null and blank texts have no n-grams and are linked with nothing (component: their own key); fewer
words than n form one n-gram; equal texts share a component; repeated rows give a row each; a null key can be linked
but is never a component's name unless all its members are null; an empty table gives no rows. Texts may have any
length. Hash collisions of 64 bits are not checked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.llm.common import map_batches, materialise, small_side
from surety.llm.components import components

#: Words remembered by a worker; n-grams gathered before a batch is sent; n-grams in a hash fragment; least fragments.
MEMO, BATCH, SEGMENT, LEAST = 200_000, 1_000_000, 2_000_000, 48
#: Sets in a block; n-grams of a set that count as one set more; n-grams in a fragment of the frequency order.
BLOCK, LONG, FRAGMENT = 256, 8000, 4096
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Shingler:
    def __init__(self, words: int):
        self.words, self.memo = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingles of text, lower-casing A to Z only."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w)
        codes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(codes))
        n = len(codes) - k + 1
        h = np.full(n, k, np.uint64)
        for i in range(k):
            h = (h ^ codes[i : i + n]) * _MIX[i % 4]
            h ^= h >> np.uint64(29)
        return np.unique(h)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def class_sets(df: DataFrame, text: str, key: str, words: int) -> DataFrame:
    """(key, n_shingles, _digest) of every row; no digest without shingles."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        shingle = Shingler(words)
        for batch in batches:
            n, marks = [], []
            for t in batch.column(text).to_pylist():
                s = shingle(t)
                n.append(len(s))
                marks.append(digest(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n, pa.int64()), pa.array(marks, pa.binary())], names=[key, "n_shingles", "_digest"])

    return map_batches(df.select(key, text), run, f"`{key}` {kind}, n_shingles long, _digest binary")


#: Digests as numpy holds them.
MARK = np.dtype("V16")


def shared_counts(df: DataFrame, text: str, words: int, fragments: int) -> DataFrame:
    """(_digest, shared): an upper bound of how many n-grams of the set occur in another set, by fragments of the hashes."""
    schema = "fragment int, marks binary, counts binary, grams binary, repeats binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def send(sets):
        marks = np.frombuffer(b"".join(sets), MARK)
        arrays = list(sets.values())
        sizes = np.array([len(a) for a in arrays], np.int64)
        grams, owner = np.concatenate(arrays), np.repeat(np.arange(len(arrays)), sizes)
        part = (grams >> np.uint64(32)) % np.uint64(fragments)
        order = np.lexsort((grams, part))
        g = grams[order]
        same = g[1:] == g[:-1]
        twice = np.zeros(len(g), bool)
        twice[1:] |= same
        twice[:-1] |= same
        first = twice.copy()
        first[1:] &= ~same
        repeat = np.zeros(len(g), bool)
        repeat[order] = twice
        lead = np.zeros(len(g), bool)
        lead[order] = first
        local = np.bincount(owner[repeat], minlength=len(arrays))
        keep = np.flatnonzero(~repeat)
        keep = keep[np.argsort(part[keep], kind="stable")]
        leads = np.flatnonzero(lead)
        leads = leads[np.argsort(part[leads], kind="stable")]
        # only fragments that the batch meets, however many there are
        met = np.union1d(part[keep], part[leads])
        cuts = np.append(np.searchsorted(part[keep], met), len(keep))
        lead_cuts = np.append(np.searchsorted(part[leads], met), len(leads))
        rows = []
        for k, f in enumerate(met.tolist()):
            at, more = keep[cuts[k] : cuts[k + 1]], leads[lead_cuts[k] : lead_cuts[k + 1]]
            held, counts = np.unique(owner[at], return_counts=True)
            rows.append((f, marks[held].tobytes(), counts.astype(np.int32).tobytes(), grams[at].astype(np.uint32).tobytes(), grams[more].astype(np.uint32).tobytes()))
        some = np.flatnonzero(local)
        rows.append((int.from_bytes(marks[0].tobytes()[:4], "big") % fragments, marks[some].tobytes(), local[some].astype(np.int32).tobytes(), None, None))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(),) + (pa.binary(),) * 4, strict=True)], names=names)

    def deal(batches):
        shingle, sets, held = Shingler(words), {}, 0
        for batch in batches:
            for t in batch.column(text).to_pylist():
                s = shingle(t)
                if len(s) and (m := digest(s)) not in sets:
                    sets[m] = s
                    held += len(s)
                if held > BATCH:
                    yield send(sets)
                    sets, held = {}, 0
        if sets:
            yield send(sets)

    def count(part: pa.Table) -> pa.Table:
        marks, sums, grams, owners, repeats, places, sets = [], [], [], [], [], [], 0
        for m, c, g, r in zip(*(part.column(x).to_pylist() for x in names[1:]), strict=True):
            m, c = np.frombuffer(m, MARK), np.frombuffer(c, np.int32)
            if g is None:
                marks.append(m)
                sums.append(c.astype(np.int64))
                continue
            grams.append(np.frombuffer(g, np.uint32))
            owners.append(np.repeat(np.arange(sets, sets + len(m)), c))
            places.append(m)
            sets += len(m)
            repeats.append(np.frombuffer(r, np.uint32))
        if grams:
            g, o, r = np.concatenate(grams), np.concatenate(owners), np.concatenate(repeats)
            order = np.argsort(g, kind="stable")
            s = g[order]
            same = s[1:] == s[:-1]
            twice = np.zeros(len(s), bool)
            twice[1:] |= same
            twice[:-1] |= same
            twice |= np.isin(s, r)
            place = np.concatenate(places)
            n = np.bincount(o[order][twice], minlength=len(place))
            marks.append(place[n > 0])
            sums.append(n[n > 0])
        m = np.concatenate(marks) if marks else np.empty(0, MARK)
        c = np.concatenate(sums) if sums else np.empty(0, np.int64)
        return pa.table({"_digest": pa.Array.from_buffers(pa.binary(16), len(m), [None, pa.py_buffer(m.tobytes())]).cast(pa.binary()), "shared": pa.array(c.astype(np.int64), pa.int64())})

    dealt = map_batches(df.select(text), deal, schema)
    return dealt.groupBy("fragment").applyInArrow(count, "_digest binary, shared long").groupBy("_digest").agg(F.sum("shared").alias("shared"))


def need(n, percent: int):
    """The least overlap of a set of n with any partner: ceil(percent * n / 100)."""
    return F.floor((n * percent + 99) / 100)


def _survivors(df, sets, text, key, words, percent) -> DataFrame:
    """(cid, _digest, n, grams) of the classes that can have a partner, numbered."""
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    bound = shared_counts(df, text, words, max(LEAST, -(-total // SEGMENT)))
    classes = sets.where("n_shingles > 0").groupBy("_digest", "n_shingles").agg(F.min(key).alias("_rep"))
    left = classes.join(bound, "_digest").where(F.col("shared") >= need(F.col("n_shingles"), percent))
    reps = materialise(left.select("_rep").distinct(), "join-survivors")
    texts = df.select(key, text).join(small_side(reps), F.col(key).eqNullSafe(F.col("_rep")), "left_semi")

    def run(batches):
        shingle = Shingler(words)
        for batch in batches:
            made = [s for t in batch.column(text).to_pylist() if len(s := shingle(t))]
            for k in range(0, len(made), 500):
                part = made[k : k + 500]
                ends = np.cumsum([0] + [len(s) for s in part]).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(part).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in part], pa.binary()), pa.array(np.diff(ends), pa.int64()), grams], names=["_digest", "n", "grams"])

    found = map_batches(texts, run, "_digest binary, n long, grams array<long>").dropDuplicates(["_digest"])
    return materialise(found.withColumn("cid", F.monotonically_increasing_id()), "join-sets")


def _ordered(sets: DataFrame, percent: int) -> DataFrame:
    """(cid, n, shared): the n-grams that occur in several sets, rarest first, of sets with enough of them."""
    rows = sets.select("cid", "n", F.explode("grams").alias("gram"))
    # written first: a join of two plain exchanges can be split where one n-gram fills a partition
    often = materialise(rows.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"), "join-often")
    kept = rows.join(often, "gram").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("s"))
    kept = kept.where(F.size("s") >= need(F.col("n"), percent))
    return materialise(kept.select("cid", "n", F.col("s.gram").alias("shared")), "join-ordered")


def _candidate_groups(ordered: DataFrame, percent: int) -> DataFrame:
    """(cid, root, weight, size) of sets that share n-grams of their prefixes, directly or through others.

    The smaller set of a link shares so many n-grams that its partner can be as large as itself: (100 + percent) shared
    >= 2 percent n. An n-gram without such a set in its postings links nothing, so texts that are mostly one common
    passage, but not mostly each other, form no group.

    A set weighs as many as its n-grams would fill, so blocks are bounded in sets and in n-grams; size is the group's
    weight.
    """
    prefix = F.slice("shared", F.lit(1), (F.size("shared") - need(F.col("n"), percent) + 1).cast("int"))
    strong = (100 + percent) * F.size("shared") >= 2 * percent * F.col("n")
    posts = ordered.select("cid", strong.alias("strong"), F.explode(prefix).alias("gram"))
    met = posts.groupBy("gram").agg(F.min("cid").alias("head"), F.count("*").alias("c"), F.max("strong").alias("strong"))
    heads = materialise(met.where("c > 1 and strong").select("gram", "head"), "join-heads")
    roots = materialise(components(posts.join(heads, "gram").select(F.col("cid").alias("a"), F.col("head").alias("b")), "join-groups"), "join-roots")
    weighed = roots.withColumnRenamed("node", "cid").join(ordered.select("cid", F.ceil(F.col("n") / LONG).alias("weight")), "cid")
    sizes = weighed.groupBy("root").agg(F.sum("weight").alias("size"))
    return materialise(weighed.join(sizes, "root").select("cid", "root", "weight", "size"), "join-sized")


def unit_links(grams: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets marked left and those marked right."""
    n = len(grams)
    lengths = np.array([len(g) for g in grams])
    values, ids = np.unique(np.concatenate(grams), return_inverse=True)
    many = np.bincount(ids, minlength=len(values)) > 1
    number = np.cumsum(many) - 1
    owner = np.repeat(np.arange(n), lengths)
    use = many[ids]
    owner, ids = owner[use], number[ids[use]]
    order = np.argsort(ids, kind="stable")
    owner, ids = owner[order], ids[order]
    overlap = np.zeros((n, n), np.float32)
    for low in range(0, int(many.sum()), FRAGMENT):
        a, b = np.searchsorted(ids, (low, low + FRAGMENT))
        width = int(ids[b - 1]) - low + 1 if b > a else 1
        cells = np.zeros((n, width), np.float32)
        cells[owner[a:b], ids[a:b] - low] = 1
        overlap += cells @ cells.T
    got = np.rint(overlap).astype(np.int64)
    linked = 100 * got >= percent * (sizes[:, None] + sizes[None, :] - got)
    linked &= (left[:, None] & right[None, :]) | (right[:, None] & left[None, :])
    x, y = np.nonzero(np.triu(linked, 1))
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            parent[a] = b
            out.append((i, j))
    return out


def _verify(units: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found in units: rows (root, u, v, left, right, cid, n, shared) of one (root, u, v) form a unit."""
    columns = ["root", "u", "v", "cid", "n", "left", "right", "shared"]
    rows = units.select(*columns).repartition("root", "u", "v").sortWithinPartitions("root", "u", "v", "cid")

    def solve(parts):
        cid, n, left, right = (np.concatenate([np.asarray(p.column(c).to_numpy(zero_copy_only=False)) for p in parts]) for c in ("cid", "n", "left", "right"))
        grams = [np.asarray(x.values) for p in parts for x in p.column("shared")]
        # a set may come as both sides of a unit
        ids, at, back = np.unique(cid, return_index=True, return_inverse=True)
        lefts, rights = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        np.logical_or.at(lefts, back, left)
        np.logical_or.at(rights, back, right)
        found = unit_links([grams[i] for i in at], n[at], lefts, rights, percent)
        return [(int(ids[i]), int(ids[j])) for i, j in found]

    def run(batches):
        held, where, out = [], None, []
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in ("root", "u", "v")])
            edges = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if b <= a:
                    continue
                key = tuple(keys[:, a].tolist())
                if key != where and held:
                    out += solve(held)
                    held = []
                where = key
                held.append(batch.slice(a, b - a))
            held = [pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in p.columns], names=columns) for p in held]
            if len(out) > 20_000:
                yield _pairs(out)
                out = []
        if held:
            out += solve(held)
        yield _pairs(out)

    return map_batches(rows, run, "a long, b long")


def _pairs(rows):
    a, b = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _block(count):
    """A set's block among ceil(weight / BLOCK) blocks."""
    return F.pmod(F.xxhash64("cid"), F.ceil(count / BLOCK)).cast("long")


def set_links(ordered: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links that connect exactly the sets of each component."""
    rows = ordered.join(groups, "cid").withColumn("b", _block(F.col("size"))).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("long"))
    yes, no = F.lit(True), F.lit(False)
    own = F.array(F.struct(F.col("b").alias("u"), F.col("b").alias("v"), yes.alias("left"), yes.alias("right")))
    first = F.struct(F.lit(0).cast("long").alias("u"), F.col("b").alias("v"), no.alias("left"), yes.alias("right"))
    spread = F.transform(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1), lambda v: F.struct(F.lit(0).cast("long").alias("u"), v.alias("v"), yes.alias("left"), no.alias("right")))
    tasks = F.when(F.col("blocks") == 1, own).when(F.col("b") == 0, F.concat(own, spread)).otherwise(F.concat(own, F.array(first)))
    one = materialise(_verify(rows.select("root", "cid", "n", "shared", F.inline(tasks)), percent), "join-links")
    if groups.where(F.col("size") > BLOCK).limit(1).count() == 0:
        return one
    large = groups.where(F.col("size") > BLOCK)
    named = large.join(components(one, "join-parts").withColumnRenamed("root", "part"), large["cid"] == F.col("node"), "left").select("cid", "root", "weight", "size", F.coalesce("part", "cid").alias("part"))
    named = materialise(named, "join-named")
    counts = named.groupBy("root", "part").agg(F.sum("weight").alias("c"))
    main = counts.groupBy("root").agg(F.max(F.struct("c", "part")).alias("m"), F.sum("c").alias("all")).select("root", F.col("m.part").alias("main"), (F.col("all") - F.col("m.c")).alias("rest")).where("rest > 0")
    again = named.join(main, "root").join(ordered, "cid").withColumn("v", _block(F.col("size"))).withColumn("u", _block(F.col("rest")))
    range_ = lambda count: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(count) / BLOCK).cast("long") - 1)
    every = again.select("root", "cid", "n", "shared", F.explode(range_("rest")).alias("u"), "v", no.alias("left"), yes.alias("right"))
    rest = again.where("part != main").select("root", "cid", "n", "shared", "u", F.explode(range_("size")).alias("v"), yes.alias("left"), no.alias("right"))
    return one.unionByName(materialise(_verify(every.unionByName(rest), percent), "join-links"))


def _named(df: DataFrame, text: str, key: str, words: int, percent: int) -> DataFrame:
    """(key, n_shingles, _digest, _name, _class) of every row: its component's name and number (its digest if alone)."""
    sets = materialise(class_sets(df, text, key, words), "join-classes")
    survivors = _survivors(df, sets, text, key, words, percent)
    ordered = _ordered(survivors, percent)
    links = set_links(ordered, _candidate_groups(ordered, percent), percent)
    roots = components(links, "join-components")
    named = survivors.select("cid", "_digest").join(roots, F.col("cid") == F.col("node")).select("_digest", "root")
    reps = sets.where("_digest is not null").groupBy("_digest").agg(F.min(key).alias("_rep")).join(named, "_digest", "left")
    least = reps.where("root is not null").groupBy("root").agg(F.min("_rep").alias("_least"))
    names = reps.join(least, "root", "left").select("_digest", F.coalesce("_least", "_rep").alias("_name"), F.coalesce(F.col("root").cast("string"), F.hex("_digest")).alias("_class"))
    return sets.join(names, "_digest", "left").select(key, "n_shingles", "_digest", "_name", "_class")


def jaccard_components(df: DataFrame, text="text", key="doc_id", words=4, percent=85) -> DataFrame:
    """(key, n_shingles, component_id), one row per row of df."""
    out = _named(df, text, key, words, percent)
    return out.select(key, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("_name")).otherwise(F.col(key)).alias("component_id"))


def keep_one(df: DataFrame, text="text", key="doc_id", words=5, percent=80) -> DataFrame:
    """df with one row of each component, that of the smallest (key, digest); rows without n-grams all stay.

    Rows are told apart by (key, digest of the set), nulls last; of rows that share both, the one of the smallest text
    stays. Rows of a key that occurs once are removed by it, so only the few removed keys meet the texts; rows of
    null or repeated keys have their digests made again.
    """
    named = materialise(_named(df, text, key, words, percent), "join-named")
    own = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), F.col("_digest").alias("d"))
    first = materialise(named.where("n_shingles > 0").groupBy("_class").agg(F.min(own).alias("m")).select("_class", F.col("m.k").alias("_stay"), F.col("m.d").alias("_kept")), "join-stay")
    often = named.groupBy(key).agg(F.count("*").alias("c")).where((F.col("c") > 1) | F.col(key).isNull()).select(F.col(key).alias("_twice"))
    often = materialise(often, "join-repeats")
    other = named.where("n_shingles > 0").join(first, "_class").where(~F.col(key).eqNullSafe(F.col("_stay")))
    gone = materialise(other.select(F.col(key).alias("_twice")).unionByName(often).distinct(), "join-removed")
    single = df.join(small_side(gone), F.col(key).eqNullSafe(F.col("_twice")), "left_anti")
    if often.limit(1).count() == 0:
        return single
    unclear, columns = df.join(small_side(often), F.col(key).eqNullSafe(F.col("_twice")), "left_semi"), df.columns

    def mark(batches):
        shingle = Shingler(words)
        for batch in batches:
            made = [shingle(t) for t in batch.column(text).to_pylist()]
            marks = pa.array([digest(s) if len(s) else None for s in made], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, marks], names=[*columns, "_digest"])

    schema = T.StructType([*df.schema.fields, T.StructField("_digest", T.BinaryType())])
    marked = materialise(map_batches(unclear, mark, schema), "join-unclear")
    stays = first.select("_stay", "_kept")
    chosen = marked.join(small_side(stays), F.col(key).eqNullSafe(F.col("_stay")) & (F.col("_digest") == F.col("_kept")), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    one = chosen.groupBy(key, "_digest").agg(F.min_by(row, F.col(text)).alias("_one")).select("_one.*")
    return single.unionByName(one).unionByName(marked.where("_digest is null").select(*columns))
