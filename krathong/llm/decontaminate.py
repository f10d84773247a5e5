"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming search, exact check.

For every benchmark item the text's windows of the item's length in words are fingerprinted. The
64 fingerprint bits are cut into ``BLOCKS`` blocks; fingerprints within ``RADIUS`` differ by at most
``RADIUS // BLOCKS`` bits in one block, and the index holds every block value of an item with so
many flips, so looking up a window's blocks finds all items within the radius. Candidates are
verified by weighted Jaccard similarity of their word shingles (each counted as often as it occurs).

Only windows that share a shingle with an item are fingerprinted, and only items that share one with the text are
candidates: without one the similarity is 0, so nothing is lost, and clean text costs one dictionary lookup for
each word. A similarity of 0.8 asks for a wide radius (pairs at 0.8 differ in 10 of 64 bits on average, hardly ever in
over 20: measured in the tests), and at that radius the blocks alone let pass nearly half of all items of a
length; the shared shingles make the search selective. Every window goes through the index: of the items that share a shingle with its text those stay that
one of its blocks leads to, and of these the ones within the radius are verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, RADIUS = 7, 20
#: Items are sent to the executors in blocks of at most about so many items and characters; more blocks for more items.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000
_WORD = re.compile(r"\w+")
_NONE: frozenset = frozenset()
_CUTS = [64 * i // BLOCKS for i in range(BLOCKS + 1)]


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall(text.lower())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(words: list[str], k: int) -> np.ndarray:
    """One 64-bit hash for each run of ``k`` words; the whole sequence where there are fewer."""
    w = _mix(np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) | len(x) << 32 for x in words], np.uint64))
    k = min(k, len(w))
    out = np.zeros(max(len(w) - k + 1, 0) if k else 0, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x100000001B3) + w[i : len(w) - k + 1 + i]
    return _mix(out)


def window_prints(h: np.ndarray, n: int) -> np.ndarray:
    """SimHash of each run of ``n`` shingle hashes."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    return np.packbits(2 * (total[n:] - total[:-n]) > n, axis=1).view(">u8").ravel().astype(np.uint64)


def block_values(fp: int) -> list[int]:
    return [(fp >> a) & ((1 << (b - a)) - 1) for a, b in zip(_CUTS, _CUTS[1:])]


class Index:
    """Items by length, shingle and block value."""

    def __init__(self, items: list[tuple]):
        self.ids, self.length, self.prints, self.counts, self.total = [], [], [], [], []
        self.vocabulary: dict[str, int] = {}
        self.anchors: dict[int, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.blocks: dict[tuple, set[int]] = defaultdict(set)
        flips = {n: [0, *(sum(1 << i for i in c) for r in range(1, RADIUS // BLOCKS + 1) for c in combinations(range(n), r))] for n in {b - a for a, b in zip(_CUTS, _CUTS[1:])}}
        for item, text in items:
            w = words_of(text or "")
            if not w:
                continue
            i, k = len(self.ids), min(SHINGLE, len(w))
            h = shingle_hashes(w, k)
            fp = int(window_prints(h, len(h))[0])
            self.ids.append(item)
            self.length.append(len(w))
            self.prints.append(fp)
            self.counts.append(Counter(h.tolist()))
            self.total.append(len(h))
            ids = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w]
            for s in {tuple(ids[a : a + k]) for a in range(len(ids) - k + 1)}:
                self.anchors[k][s].append(i)
            for b, v in enumerate(block_values(fp)):
                for flip in flips[_CUTS[b + 1] - _CUTS[b]]:
                    self.blocks[len(w), b, v ^ flip].add(i)
        self.anchors = {k: dict(v) for k, v in self.anchors.items()}
        self.blocks = dict(self.blocks)
        self.firsts = {k: np.array(sorted({s[0] * (len(self.vocabulary) + 1) + s[-1] for s in v})) for k, v in self.anchors.items()}

    def find(self, text: str) -> list[tuple]:
        """(item, similarity, first word, hamming) of each item with a window that is similar enough: its best window, the first of equals."""
        w = words_of(text)
        if not w or not self.ids:
            return []
        get, v = self.vocabulary.get, len(self.vocabulary) + 1
        ids = np.array([get(x, 0) for x in w], np.int64)
        best: dict[int, tuple] = {}
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for k, table in self.anchors.items():
            if len(ids) < k:
                continue
            at = np.flatnonzero(known[k:] - known[:-k] == k)
            if not len(at):
                continue
            ends = ids[at] * v + ids[at + k - 1]
            near = np.minimum(np.searchsorted(self.firsts[k], ends), len(self.firsts[k]) - 1)
            at = at[self.firsts[k][near] == ends]
            starts: dict[int, set] = defaultdict(set)
            near: dict[int, set] = defaultdict(set)
            for p in at.tolist():
                for i in table.get(tuple(ids[p : p + k].tolist()), ()):
                    n = self.length[i]
                    near[n].add(i)
                    starts[n].add((max(0, p + k - n), min(p, max(0, len(w) - n))))
            for n, spans in starts.items():
                self._windows(w, n, k, spans, near[n], best)
        return [(self.ids[i], s, a, d) for i, (s, a, d) in sorted(best.items(), key=lambda x: x[1][1])]

    def candidates(self, fp: int, n: int, near: set) -> list[int]:
        """The items of ``n`` words among ``near`` that a block of the fingerprint leads to and that are within the radius."""
        led = {i for blk, val in enumerate(block_values(fp)) for i in near & self.blocks.get((n, blk, val), _NONE)}
        return [i for i in led if (fp ^ self.prints[i]).bit_count() <= RADIUS]

    def _windows(self, w, n, k, spans, near, best):
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            h = shingle_hashes(w[a : b + n], k)
            size = min(n - k + 1, len(h))
            for off, fp in enumerate(window_prints(h, size).tolist()):
                found = self.candidates(fp, n, near)
                own = Counter(h[off : off + size].tolist()) if found else None
                for i in found:
                    both = sum(min(c, own[s]) for s, c in self.counts[i].items() if s in own)
                    sim = both / (size + self.total[i] - both)
                    if sim >= SIMILARITY and (i not in best or (-sim, a + off) < (-best[i][0], best[i][1])):
                        best[i] = (sim, a + off, (fp ^ self.prints[i]).bit_count())


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """(items, whether they are the last) in blocks of bounded size, one block on the driver at a time."""
    items = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("t is not null")
    n, size = items.select(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    parts = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_CHARS))
    for p in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("t"), F.lit(parts)) == p).distinct().orderBy("i", "t").collect()
        yield [(r.i, r.t) for r in rows], p == parts - 1


def leak_column(items: list[tuple], kind: str, text):
    """The leaks of a block of items in ``text``: array of (item_id, similarity, start_word, hamming)."""
    index = Index(items)

    @F.pandas_udf(f"array<struct<item_id:{kind},similarity:double,start_word:bigint,hamming:int>>")
    def leaks(t: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("item_id", "similarity", "start_word", "hamming"), x)) for x in index.find(s)] for s in C.clean(t)], dtype=object)

    return leaks(text)


def _kind(benchmark: DataFrame) -> str:
    return benchmark.schema["item_id"].dataType.simpleString()


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start_word, hamming): a row for each document and item that it holds.

    Null and empty texts hold nothing, nor is a null or empty item found. Items of fewer than five words are
    one shingle, found only whole. Repeated rows of documents give repeated results; items repeated whole
    count once. A null id is kept. Other columns are not read. An empty table on either side gives no rows.
    """
    out = None
    for items, last in item_blocks(benchmark):
        # the outer form: for an inner one the optimizer infers a filter on the array and evaluates the function twice
        part = docs.select(F.col(id_col).alias("doc_id"), leak_column(items, _kind(benchmark), F.col(text_col)).alias("_l")).select("doc_id", F.inline_outer("_l")).filter("similarity is not null")
        part = part if last and out is None else C.materialize(part)  # written, so that the driver holds one index at a time
        out = part if out is None else out.unionAll(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text holds no item.

    Null and empty texts hold none, null and empty items are held by none. Rows, repeated ones and those without an id
    too, are judged by their text alone; extra columns of any name come along. Empty tables: nothing goes, nothing comes.
    """
    rows = C.pack(docs)
    for items, last in item_blocks(benchmark):
        rows = rows.withColumn("leaks", F.size(leak_column(items, _kind(benchmark), F.col("row")[text_col]))).filter("leaks = 0").select("row")
        rows = rows if last else C.materialize(rows)
    return rows.select("row.*")


def op10_window_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
