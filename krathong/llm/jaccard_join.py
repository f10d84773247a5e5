"""N-gram Jaccard join: an R-tree over count vectors, with an exact partition that says which points can meet.

A document is its set of distinct word shingles. Shingles are hashed into groups, and how many of a set fall into each group makes it a
point; the overlap of two sets is at most the sum of the lesser counts by group, and that of a set and all points in a box at most the sum
of the lesser of its counts and the box's upper corner. A tree of such boxes is descended for each point; pairs that the bound leaves are
verified by their shingles. Points that are known to be connected already are passed over, so a large group of copies
costs about one comparison of shingles for each, not one for each pair.

What is split over tasks. Two sets that link differ in at most a ninth of their summed sizes, D shingles. If the
space of shingles is cut into P ranges, more than D of which hold something of one of them, some range holds exactly the same shingles of both. So
each set is dealt by a hash of each of its ranges, and sets that share none never link. P comes from a ladder of sizes by
the summed size; a set uses each step that a partner may have in common with it. The sets that share a range form a run (a run that comes with many ranges
is taken once); their points go into a tree, and a spanning forest of the pairs that its bound leaves joins runs into blocks. Shingles themselves travel only to the
block of their set, where a tree again chooses the pairs to verify. Blocks of too many sets or shingles are cut into chunks, every pair of which is a
task of its own, and so are runs; the work on one grows with the square of the different sets in it.

Shingles and sets go by 64-bit hashes.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common as C
from .components import components

SHINGLE = 5
#: Two sets link where RATIO[1] * overlap >= RATIO[0] * summed sizes: a similarity of 0.8.
RATIO = (4, 9)
#: Steps of the ladder of numbers of ranges.
LADDER = sorted({math.ceil(1.7**k) for k in range(40)})
#: Sets and shingles of a chunk.
RUN, CHUNK_SHINGLES = 1024, 1 << 22
#: Points of a leaf, boxes of a node; words and sets that a task remembers; texts that a task works on at once.
LEAF, FAN, MEMO, BATCH = 8, 4, 1 << 16, 500
#: Bits that say which texts may be needed again: a table of at most 16 MB. Where more are needed than it tells apart, more texts travel.
BITS = 1 << 27


class Words(dict):
    """Hashes of words, worked out once for each word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str, memo: dict) -> np.ndarray:
    """Sorted hashes of the distinct shingles; the whole sequence of fewer words is one, no words give none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i]
    return np.unique(_mix(h))


def ranges_for(total: int) -> int:
    """The step of the ladder for two sets of ``total`` shingles together: enough ranges that, as a rule, more than a ninth of ``total`` of the larger one's hold something."""
    return bisect_left(LADDER, 0.1135 * total + 1 + 0.12 * math.sqrt(total))


def steps(n: int) -> list[tuple[int, int]]:
    """(step, how much a partner may differ there) for the steps that a set of ``n`` shingles may have in common with a different one that it links with."""
    a, b = RATIO
    least, most = max(b, n - (-n * a // (b - a))), n + n * (b - a) // a
    out = []
    while least <= most:
        k = ranges_for(least)
        top = bisect_left(range(most + 1), k + 1, lo=least, key=ranges_for) - 1  # the largest total of this step
        out.append((k, top // b))
        least = top + 1
    return out


def range_keys(s: np.ndarray) -> np.ndarray:
    """A hash of each range of a set that holds something, for all its steps.

    Where too few of them do, the set is dealt by finer ranges too, up to the first ladder step where enough do; two such sets meet at
    the lesser of their last steps.
    """
    m, out = _mix(s + np.uint64(1)), []
    for k, differ in steps(len(s)):
        for j in range(k, len(LADDER)):
            at = ((s >> np.uint64(32)) * np.uint64(LADDER[j])) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            out.append(_mix(np.add.reduceat(m, starts) ^ _mix(at[starts] + np.uint64((k << 8 | j) << 40))))
            if len(starts) > differ:
                break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def links_sets(overlap: int, a: int, b: int) -> bool:
    return RATIO[1] * overlap >= RATIO[0] * (a + b)


def count_vector(s: np.ndarray) -> bytes:
    """How many shingles of a set fall into each group, with a first byte for the width of a count. A power of two of groups, so that vectors fold onto each other."""
    groups = 1 << min(max(math.ceil(math.log2(max(len(s), 1) / 8)), 4), 8)
    count = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    width = next(w for w in (1, 2, 4) if count.max() < 1 << 8 * w)
    return bytes([width]) + count.astype(f"<u{width}").tobytes()


def points_of(vectors: list[bytes]) -> np.ndarray:
    """The vectors as rows of one array, folded to the least number of groups among them."""
    counts = [np.frombuffer(v, f"<u{v[0]}", offset=1) for v in vectors]
    groups = min(map(len, counts))
    return np.stack([c.reshape(-1, groups).sum(0, dtype=np.int32) for c in counts])


class Tree:
    """An R-tree over count vectors, packed by halving at the coordinate that varies most; upper corners and sizes by level, the leaves first."""

    def __init__(self, points: np.ndarray):
        size = points.sum(1)
        self.order = self._packed(points, np.arange(len(points)))
        self.points, self.size = points[self.order], size[self.order]
        at = np.arange(0, len(points), LEAF)
        self.high, self.least, self.most, self.begin = [np.maximum.reduceat(self.points, at)], [np.minimum.reduceat(self.size, at)], [np.maximum.reduceat(self.size, at)], [at]
        while len(self.high[-1]) > 1:
            up = np.arange(0, len(self.high[-1]), FAN)
            for rows, f in ((self.high, np.maximum), (self.least, np.minimum), (self.most, np.maximum)):
                rows.append(f.reduceat(rows[-1], up))
            self.begin.append(self.begin[-1][up])

    def _packed(self, points: np.ndarray, idx: np.ndarray) -> np.ndarray:
        if len(idx) <= LEAF:
            return idx
        axis = int(points[idx].var(0).argmax())
        idx = idx[np.argsort(points[idx, axis], kind="stable")]
        half = max(LEAF, (len(idx) // LEAF // 2) * LEAF)
        return np.concatenate([self._packed(points, idx[:half]), self._packed(points, idx[half:])])

    def reach(self, q: int, label: np.ndarray) -> np.ndarray:
        """Points before ``q`` (in the tree's order) that may link with it and don't have its label."""
        point, n, own = self.points[q], self.size[q], label[q]
        node = np.arange(len(self.high[-1]))
        for level in range(len(self.high) - 1, -1, -1):
            node = node[self.begin[level][node] < q]
            bound = np.minimum(np.minimum(self.high[level][node], point).sum(1), self.most[level][node])
            node = node[RATIO[1] * bound >= RATIO[0] * (n + self.least[level][node])]
            if level:
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                node = node[node < len(self.high[level - 1])]
        at = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = at[at < q]
        at = at[label[at] != own]
        return at[RATIO[1] * np.minimum(self.points[at], point).sum(1) >= RATIO[0] * (n + self.size[at])]


def _forest(tree: Tree, linked, side=None) -> list[tuple[int, int]]:
    """(first, other) for each point but the first of each group that the pairs (i, j) with ``linked`` connect, among those that the bound leaves."""
    label = np.arange(len(tree.size))
    for q in range(1, len(label)):
        near = tree.reach(q, label)
        if side is not None:
            near = near[side[tree.order[near]] != side[tree.order[q]]]
        while len(near):
            p, near = near[0], near[1:]
            if linked(tree.order[p], tree.order[q]):
                label[label == label[q]] = label[p]
                near = near[label[near] != label[q]]
    return [(int(tree.order[label[q]]), int(tree.order[q])) for q in np.flatnonzero(label != np.arange(len(label)))]


def near_forest(points: np.ndarray) -> list[tuple[int, int]]:
    """Stars of the groups that the pairs which the bound leaves connect: they hold whatever links connect, and more."""
    if len(points) == 2:
        return [(0, 1)] if links_sets(np.minimum(*points).sum(), *points.sum(1)) else []
    return _forest(Tree(points), lambda i, j: True)


def forest(sets: list[np.ndarray], points: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Stars of exactly the groups that chains of links connect. With ``side``, only pairs of different sides count."""
    if len(sets) < 2:
        return []
    return _forest(Tree(points), lambda i, j: links_sets(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), len(sets[i]), len(sets[j])), side)


def _name(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def _prints(kind: pa.DataType):
    """For mapInArrow over (doc_id, text, hash of the text): size and hash of each set, and the keys and the point of those that the task has not seen lately."""
    types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def run(batches):
        memo, seen = Words(), set()
        for b in (b.slice(a, BATCH) for b in batches for a in range(0, b.num_rows, BATCH)):
            out = []
            for i, t, own in zip(*(c.to_pylist() for c in b.columns)):
                s = shingle_set(t or "", memo)
                name = _name(s) if len(s) else None
                if name is None or name in seen:
                    out.append((i, len(s), name, None, None, None))
                    continue
                if len(seen) > MEMO:
                    seen.clear()
                seen.add(name)
                out.append((i, len(s), name, own, range_keys(s).view(np.int64), count_vector(s)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "n", "c", "h", "keys", "vector"])

    return run


def _runs(batches):
    """For mapInArrow over rows sorted by (key, set): (run, set) of each key that several sets share.

    A run is named after its sets, so that one which comes with many keys is seen as one. One of more than RUN sets comes as all pairs of its halves of
    RUN.
    """
    seen: set = set()

    def named(members):
        if len(members) > RUN:
            half = RUN // 2
            cuts = [members[a : a + half] for a in range(0, len(members), half)]
            parts = [np.concatenate([x, y]) for i, x in enumerate(cuts) for y in cuts[i + 1 :]]
        else:
            parts = [members]
        for p in parts:
            name = _name(p)
            if name not in seen:
                if len(seen) > MEMO:
                    seen.clear()
                seen.add(name)
                yield np.full(len(p), name, np.int64), p

    key, sets = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in _with_end(batches):
        if b is not None:
            key, sets = (np.concatenate([held, col.to_numpy()]) for held, col in zip((key, sets), b.columns))
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
        else:
            cut = len(key)
        k, c, key, sets = key[:cut], sets[:cut], key[cut:], sets[cut:]
        fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))[: len(k)]
        k, c = k[fresh], c[fresh]
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))[: len(k)])
        ends = np.concatenate((starts[1:], [len(k)]))
        several = np.flatnonzero(ends - starts > 1)
        out = [x for i in several for x in named(c[starts[i] : ends[i]])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in out])), pa.array(np.concatenate([x[1] for x in out]))], ["run", "c"])


def _with_end(batches):
    yield from batches
    yield None


def _near(batches):
    """For mapInArrow over (run, set, vector) sorted by run: (u, v) of a forest of the pairs that the bound leaves in each run."""
    run, sets, vectors = [], [], []
    for b in _with_end(batches):
        if b is not None:
            for held, col in zip((run, sets, vectors), b.columns):
                held.extend(col.to_pylist())
        cut = 0 if not run else len(run) if b is None else bisect_left(run, run[-1])
        out, at = [], 0
        while at < cut:
            end = bisect_right(run, run[at], lo=at, hi=cut)
            out += [(sets[at + i], sets[at + j]) for i, j in near_forest(points_of(vectors[at:end]))] if end - at > 1 else []
            at = end
        run, sets, vectors = run[cut:], sets[cut:], vectors[cut:]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["u", "v"])


def _members(batches):
    """For mapInArrow over (text, set, block, chunks): the shingles of each set; texts that only share its text's hash go."""
    memo = Words()
    for b in (b.slice(a, BATCH) for b in batches for a in range(0, b.num_rows, BATCH)):
        sets = [shingle_set(t, memo) for t in b.column(0).to_pylist()]
        at = pa.array([i for i, (s, c) in enumerate(zip(sets, b.column(1).to_pylist())) if _name(s) == c], pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in (1, 2, 3)), pa.array([sets[i].view(np.int64) for i in at.to_pylist()], pa.list_(pa.int64()))], ["c", "b", "chunks", "s"])


def needed(texts: DataFrame, hashes: DataFrame) -> DataFrame:
    """The rows (t, h) of ``texts`` whose hash may be among ``hashes`` (h), each hash once: a table of bits is broadcast, so that the other texts never travel.

    Copies of a text are dropped before the shuffle, however many there are.
    """
    bit = F.pmod(F.col("h"), F.lit(BITS))
    marks = hashes.select(bit.alias("m")).groupBy(F.bitmap_bucket_number("m").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("m")).alias("bits"))
    rows = texts.withColumn("m", bit).withColumn("at", F.bitmap_bit_position("m").cast("int")).join(F.broadcast(marks), F.bitmap_bucket_number("m") == F.col("k"))
    byte = F.conv(F.hex(F.substr("bits", (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.filter(F.getbit(byte, F.col("at") % 8) == 1).groupBy("h").agg(F.first("t").alias("t"))


def _joined(key, table):
    """For applyInArrow over a pair of chunks of a block: the links of a spanning forest."""
    names = table.column("c").to_numpy()
    first = np.unique(names, return_index=True)[1]
    column = table.column("s").combine_chunks()
    values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    sets = [values[ends[i] : ends[i + 1]] for i in first]
    side = None if key[1].as_py() == key[2].as_py() else table.column("chunk").to_numpy()[first]
    found = forest(sets, points_of([count_vector(s) for s in sets]), side)
    at = lambda k: pa.array([int(names[first[x[k]]]) for x in found], pa.int64())
    return pa.table({"u": at(0), "v": at(1)})


def links(prints: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Links (u, v) between hashes of sets, as many as connect what links connect."""
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = prints.filter("keys is not null").select(F.explode("keys").alias("key"), "c")
    runs = keys.repartition(n, "key").sortWithinPartitions("key", "c").mapInArrow(_runs, "run long, c long").distinct()
    vectors = prints.filter("vector is not null").groupBy(F.col("c").alias("o")).agg(F.first("vector").alias("vector"))
    near = runs.join(vectors, F.col("c") == F.col("o")).select("run", "c", "vector").repartition(n, "run").sortWithinPartitions("run", "c").mapInArrow(_near, "u long, v long")
    blocks = components(near).select(F.col("node"), F.col("root").alias("b"))
    sets = prints.filter("h is not null").groupBy("c").agg(F.min("h").alias("h"), F.first("n").alias("n"))
    sets = C.materialize(sets.join(blocks, F.col("c") == F.col("node")).select("c", "h", "n", "b"))
    sizes = sets.groupBy(F.col("b").alias("o")).agg(F.greatest(F.ceil(F.count("*") / RUN), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("m")).filter("m > 1")
    where = sets.join(sizes, F.col("b") == F.col("o"), "left").select(F.col("h").alias("g"), "c", "b", F.coalesce("m", F.lit(1)).alias("chunks"))
    text = docs.select(F.col(text_col).cast("string").alias("t")).filter("t is not null").withColumn("h", F.xxhash64("t"))
    members = needed(text, sets.select("h")).join(where, F.col("h") == F.col("g")).select("t", "c", "b", "chunks").mapInArrow(_members, "c long, b long, chunks int, s array<long>")
    dealt = members.withColumn("chunk", F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pairs = dealt.select("b", F.least("chunk", "o").alias("x"), F.greatest("chunk", "o").alias("y"), "chunk", "c", "s")
    return pairs.groupBy("b", "x", "y").applyInArrow(_joined, "u long, v long")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row: component_id is the least id that chains of links reach.

    Null and empty texts, and those without words, have no shingles and are their own component. Repeated rows give repeated
    results. A null id gets its row but never names a component (a component of null ids only has a null component_id). Other
    columns are not read, so their names cannot clash. An empty table gives none.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    kind = src.schema["doc_id"].dataType
    prints = C.materialize(src.select("doc_id", "t", F.xxhash64("t").alias("h")).mapInArrow(_prints(to_arrow_type(kind)), f"doc_id {kind.simpleString()}, n long, c long, h long, keys array<long>, vector binary"))
    roots = components(links(prints, docs, text_col))
    classes = prints.filter("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    named = classes.join(roots, F.col("c") == F.col("node"), "left").select(F.col("c").alias("name"), "least", F.coalesce("root", "c").alias("root"))
    least = named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    named = named.join(least, F.col("root") == F.col("r")).select("name", "component_id")
    rows = prints.select("doc_id", F.col("n").alias("n_shingles"), "c").join(named, F.col("c") == F.col("name"), "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(C.table(spark, sf_dir, "documents"))


#: All pairs by their common shingles, in DuckDB; what links reach by recursion.
ORACLE = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM w),
t AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
l AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS seen FROM s UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.seen)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) USING (doc_id)"""
