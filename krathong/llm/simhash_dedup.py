"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into ``radius // 2 + 1`` segments. Two fingerprints within the radius
then differ by at most one bit in at least one segment, so they share one of that segment's
one-wildcard variants (the segment with one bit masked out, and which bit that is). Variants are
equality-joined: rows are dealt by variant and each run of equal variants is verified by popcount.
Runs longer than ``RUN`` are not compared in place; their members are cut into chunks and every
pair of chunks is compared by a task of its own, so no task holds an unbounded group. Variants that a
sample of the fingerprints shows to be hot are cut into chunks before they are dealt, so that
their members do not meet in one task at all; the sample only chooses the route, what it misses goes the other
one. What leaves a task is a spanning forest of the links found there, never all pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components

#: Longest run of one variant that a task compares in place, and the chunk length beyond it.
RUN = 1024
#: One of so many fingerprints is looked at for hot variants, and at most so many of these are dealt in chunks at once.
SAMPLE, HOT = 64, 4096


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the text's word shingles, each repeat counted; zero without words."""
    b = text.encode("utf-8", "surrogatepass").lower().split()
    if not b:
        return 0
    line = b" ".join(b)
    if len(b) <= words:
        h = [xxhash.xxh64_intdigest(line, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in b]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        h = [digest(line[s:e], seed) for s, e in zip(starts[: len(b) - words + 1].tolist(), ends[words - 1 :].tolist())]
    bits = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 14):
        part = np.array(h[a : a + (1 << 14)], dtype=">u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    kind = src.schema["doc_id"].dataType

    def run(batches):
        for b in batches:
            fp = pa.array([fingerprint(t or "", words) for t in (x.as_py() for x in b.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])

    return src.mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


def segments(radius: int) -> list[tuple[int, int]]:
    """(first bit, length) of each segment: so few that one of them differs by at most one bit."""
    n = radius // 2 + 1
    cut = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def variants(nodes: DataFrame, radius: int) -> DataFrame:
    """A row (k1, k2, fp) for each wildcard bit: k1 names the bit (and so its segment), k2 the rest of the segment."""
    fp = F.col("fp")
    each = []
    for a, n in segments(radius):
        seg = F.shiftrightunsigned(fp, a) if n < 64 else fp
        for i in range(n):
            mask = ((1 << n) - 1) & ~(1 << i)
            mask -= (mask >> 63) << 64
            each.append(F.struct(F.lit(a + i).alias("k1"), seg.bitwiseAND(F.lit(mask).cast("long")).alias("k2")))
    return nodes.select(F.explode(F.array(*each)).alias("k"), "fp").select("k.k1", "k.k2", "fp")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links (u, v): the same connectivity in fewer links."""
    if not len(u):
        return u, v
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(names)))
    return names[own], names[root[own]]


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)) <= radius


def _links(k: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal k (k sorted, runs of at most RUN)."""
    us, vs, held = [], [], 0
    at = np.arange(len(k))
    for lag in range(1, RUN + 1):
        at = at[: np.searchsorted(at, len(k) - lag)]
        at = at[k[at] == k[at + lag]]
        if not len(at):
            break
        hit = at[_near(fp[at], fp[at + lag], radius)]
        us.append(fp[hit])
        vs.append(fp[hit + lag])
        held += len(hit)
        if held > 1 << 20:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], 0
    return forest(np.concatenate(us), np.concatenate(vs)) if us else (fp[:0], fp[:0])


def _compare_runs(radius: int):
    """Over rows sorted by variant: links of short runs (hot false), and members of long runs (hot true) untouched."""

    def out(u, v, k1=None, k2=None, hot=False):
        n = len(u)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(u), none if v is None else pa.array(v), none if k1 is None else pa.array(k1), none if k2 is None else pa.array(k2), pa.array(np.full(n, hot))], ["u", "v", "k1", "k2", "hot"])

    def run(batches):
        held = [np.empty(0, np.int64)] * 3
        hot = None
        for b in batches:
            new = [b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy(), b.column(2).to_numpy()]
            rows = [np.concatenate([x, y]) for x, y in zip(held, new)]
            if not len(rows[0]):
                continue
            last = (int(rows[0][-1]), int(rows[1][-1]))
            tail = (rows[0] == last[0]) & (rows[1] == last[1])
            cut = len(tail) if tail.all() and len(tail) > RUN else int(np.argmax(tail))
            now, held = [x[:cut] for x in rows], [x[cut:] for x in rows]
            yield from flush(now, hot)
            if cut == len(tail):
                hot = last
            elif hot != last:
                hot = None
        yield from flush(held, hot)

    def flush(rows, hot):
        """``hot``: a variant of which members have already been passed on."""
        k1, k2, fp = rows
        if not len(k1):
            return
        start = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
        run_of = np.cumsum(start) - 1
        long = np.bincount(run_of)[run_of] > RUN
        if hot is not None:
            long |= (k1 == hot[0]) & (k2 == hot[1])
        if long.any():
            yield out(fp[long], None, k1[long], k2[long], True)
        u, v = _links(run_of[~long], fp[~long], radius)
        if len(u):
            yield out(u, v)

    return run


def _compare_chunks(radius: int):
    """Over one pair of chunks of a long run: a spanning forest of the links."""

    def run(key, table):
        fp, c = table.column("fp").to_numpy(), table.column("c").to_numpy()
        x, y = fp[c == key[2].as_py()], fp[c == key[3].as_py()]
        us, vs = [x[:0]], [x[:0]]
        for a in range(0, len(x), 64):
            i, j = np.nonzero(_near(x[a : a + 64, None], y[None], radius))
            us.append(x[a + i])
            vs.append(y[j])
            if sum(map(len, us)) > 1 << 20:
                u, v = forest(np.concatenate(us), np.concatenate(vs))
                us, vs = [u], [v]
        u, v = forest(np.concatenate(us), np.concatenate(vs))
        return pa.table({"u": u, "v": v})

    return run


def hot_variants(nodes: DataFrame, radius: int) -> list[tuple[int, int, int]]:
    """(k1, k2, members) of the variants that hold well over RUN fingerprints by a sample, the largest first; at most HOT of them."""
    some = variants(nodes.filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0), radius).groupBy("k1", "k2").agg(F.count("*").alias("n"))
    return [(r.k1, r.k2, r.n * SAMPLE) for r in some.filter(F.col("n") * SAMPLE >= 4 * RUN).orderBy(F.desc("n"), "k1", "k2").limit(HOT).collect()]


def _in_chunks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members (k1, k2, fp) dealt to each pair of chunks of their variant (a, b), given the chunks of each (h1, h2, n)."""
    return (
        members.join(sizes, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")))
        .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("k1", "k2", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "c", "fp")
    )


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) between distinct fingerprints that connect exactly those which chains of links within the radius connect."""
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # each fingerprint becomes 64 rows: dealt evenly first, as a shuffle of so small rows ends in few tasks
    every = variants(nodes.repartition(n, "fp"), radius)
    known = hot_variants(nodes, radius)
    parts = []
    if known:
        at = spark.createDataFrame([(a, b, -(-size // RUN)) for a, b, size in known], "h1 int, h2 long, n int")
        parts.append(_in_chunks(every, F.broadcast(at)))  # at most HOT rows
        every = every.join(F.broadcast(at), (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left_anti")
    dealt = every.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "fp")
    found = C.materialize(dealt.mapInArrow(_compare_runs(radius), "u long, v long, k1 long, k2 long, hot boolean"))
    out = found.filter("not hot").select("u", "v")
    hot = found.filter("hot").select(F.col("k1").cast("int").alias("k1"), "k2", F.col("u").alias("fp"))
    parts.append(_in_chunks(hot, hot.groupBy(F.col("k1").alias("h1"), F.col("k2").alias("h2")).agg(F.ceil(F.count("*") / RUN).cast("int").alias("n"))))
    for p in parts:
        out = out.unionAll(p.groupBy("k1", "k2", "a", "b").applyInArrow(_compare_chunks(radius), "u long, v long"))
    return out


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, words: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row: component_id is the least id that chains of links reach.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows give repeated
    results. A null id gets its row but never names a component (a component of null ids only has a null
    component_id). Other columns are not read, so their names cannot clash. An empty table gives none.
    """
    prints = C.materialize(fingerprints(docs, id_col, text_col, words))
    named, least = _named(prints, radius)
    named = named.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return prints.join(named, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(prints: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(fp, root) of each fingerprint, and (r, component_id) of each root: the least doc_id of its component."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), radius))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return named, named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))


def keep_one(docs: DataFrame, radius: int = 4) -> DataFrame:
    """The rows of ``documents`` that represent their group: exactly one row of each, whatever its ids are.

    The row with the least (doc_id, text hash, text digest) stays, null ids last; of rows that share id and
    text, the least by their JSON. Rows of one id whose texts are in different groups count for each group.
    """
    digest = lambda t: F.coalesce(F.sha2(t, 256), F.lit(""))
    # the id and the digest fix the text, and so the group: no two groups have the same key
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), digest("text").alias("digest"))
    prints = C.materialize(fingerprints(docs.select(key.alias("key"), "text"), "key", "text", 4))
    kept = C.materialize(_named(prints, radius)[1].select("component_id.id", "component_id.digest"))
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("d") == F.col("digest"))
    rows = C.pack(docs).withColumn("d", digest("row.text")).join(kept, same, "left_semi")
    often = prints.groupBy("doc_id.id", "doc_id.digest").count().filter("count > 1").select(F.col("id").alias("i"), F.col("digest").alias("g"))
    twice = C.materialize(kept.join(often, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("g")), "left_semi"))
    if not twice.limit(1).count():
        return rows.select("row.*")
    one = rows.join(twice, same, "left_semi").groupBy("row.doc_id", "d").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return rows.join(twice, same, "left_anti").select("row").unionAll(one).select("row.*")


def op3_simhash_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(C.table(spark, sf_dir, "documents"))
