"""N-gram Jaccard join: whole results by brute force, the partition and the tree against all pairs, large groups, odd texts."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from krathong.llm import jaccard_join as J

COLS = "doc_id long, text string, n long, c string, h string, keys string, t string, b long, s string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "c", "h", "k", "t", 2, "s") for i, t in rows], COLS)


def brute_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 5 * len(sets[a]) >= 4 * len(sets[b]) and 5 * len(sets[b]) >= 4 * len(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(s), low.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def result(spark, rows):
    return sorted(map(tuple, J.jaccard_groups(docs_of(spark, rows)).collect()), key=repr)


def varied(rng, base, changes):
    """A copy with so many words changed, dropped or added."""
    w = list(base)
    for _ in range(changes):
        at = rng.randrange(len(w))
        what = rng.randrange(3)
        w[at : at + (what != 0)] = [] if what == 1 else [f"new{rng.randrange(10**6)}"]
    return w


def corpus(rng, groups):
    out = []
    for n in groups:
        base = [f"w{rng.randrange(4000)}" for _ in range(n)]
        out += [varied(rng, base, rng.randrange(0, max(2, n // 18))) for _ in range(rng.randrange(2, 7))]
    passage = [f"p{k}" for k in range(60)]
    out += [[*(f"w{rng.randrange(4000)}" for _ in range(30)), *passage, *(f"w{rng.randrange(4000)}" for _ in range(rng.randrange(90)))] for _ in range(40)]
    return [" ".join(w) for w in out]


LONG = " ".join(f"word{i % 977} filler." for i in range(60_000))
ODD = [None, "", " \n", "one", "One", "a b c d", "a b c d e", "a b c d e f", "A  b\tc d e f", "a b c d e f g h i j", "a b c d e f g h i j k", "Ünï ſK a\x1cb c d e", LONG, LONG + " end", LONG.upper()]


def test_equals_brute_force(spark):
    rng = random.Random(2)
    texts = corpus(rng, [5, 6, 8, 9, 10, 12, 15, 20, 30, 60, 120, 250, 400, 900] * 3) + ODD
    rows = [*enumerate(texts), (None, texts[0]), (None, "only nulls here and there so"), (3, texts[7]), (3, texts[3]), (3, texts[3])]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def test_real_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("changes", [1, 4])
def test_large_groups_in_chunks(spark, monkeypatch, changes):
    """A group of copies over many chunks; with few changes all are linked, with more nearly none is."""
    monkeypatch.setattr(J, "RUN", 16)
    rng = random.Random(7)
    base = [f"w{k}" for k in range(150)]
    rows = [*enumerate([" ".join(varied(rng, base, changes)) for _ in range(150)] + [" ".join(base)] * 30)]
    assert result(spark, rows) == brute(rows)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**31), st.integers(1, 90))
def test_linked_sets_share_a_range(seed, n):
    """Sets at the limit of the similarity: with as many shingles taken and put as it allows."""
    rng = np.random.default_rng(seed)
    own = np.unique(rng.integers(0, 2**64, n, np.uint64))
    if seed % 3 == 0:  # sparse: all in few ranges
        own = own >> np.uint64(int(rng.integers(0, 12)))
    for _ in range(8):
        gone, put = int(rng.integers(0, n // 5 + 1)), int(rng.integers(0, n // 4 + 1))
        other = np.unique(np.concatenate([rng.permutation(own)[gone:], rng.integers(0, 2**64, put, np.uint64)]))
        both = len(np.intersect1d(own, other))
        if J.links_sets(both, len(own), len(other)) and not (len(own) == len(other) == both):
            assert np.intersect1d(J.range_keys(np.unique(own)), J.range_keys(other)).size


def test_unrelated_sets_share_none():
    rng = np.random.default_rng(3)
    keys = [J.range_keys(np.unique(rng.integers(0, 2**64, int(n), np.uint64))) for n in rng.integers(20, 900, 300)]
    every = np.concatenate(keys)
    assert len(np.unique(every)) == len(every)
    assert len(every) < 0.75 * 300 * 460


def points(sets):
    return J.points_of([J.count_vector(s) for s in sets])


def test_count_vectors_fold():
    rng = np.random.default_rng(4)
    a, b = (np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in (90, 1500))
    pts = points([a, b])
    assert pts.shape[1] == 16 and pts.sum(1).tolist() == [90, 1500]
    assert pts[1].tolist() == np.bincount((b % np.uint64(16)).astype(int), minlength=16).tolist()
    assert J.count_vector(np.arange(0, 2**20, 2, dtype=np.uint64))[0] == 2


def test_near_forest_keeps_what_the_bound_leaves():
    rng, memo = random.Random(6), J.Words()
    pts = points([J.shingle_set(t, memo) for t in corpus(rng, [40, 90] * 6)])
    label = list(range(len(pts)))
    for i, j in J.near_forest(pts):
        label[j] = i
    for i, j in combinations(range(len(pts)), 2):
        if J.links_sets(np.minimum(pts[i], pts[j]).sum(), pts[i].sum(), pts[j].sum()):
            assert label[i] == label[j]


def test_needed_texts(spark):
    texts = spark.createDataFrame([(f"t{k % 300}",) for k in range(900)], "t string").selectExpr("t", "xxhash64(t) AS h")
    some = texts.filter("t < 't2'").select("h")
    got = [r.t for r in J.needed(texts, some).collect()]
    assert sorted(got) == sorted({f"t{k}" for k in range(300) if f"t{k}" < "t2"})


def test_tree_bounds_never_lose_a_link():
    rng = random.Random(11)
    memo = J.Words()
    sets = [J.shingle_set(t, memo) for t in corpus(rng, [30, 80, 200] * 10)]
    tree = J.Tree(points(sets))
    alone = np.arange(len(sets))
    tried = 0
    for q in range(1, len(sets)):
        near = set(tree.reach(q, alone).tolist())
        tried += len(near)
        for p in range(q):
            a, b = sets[tree.order[p]], sets[tree.order[q]]
            if J.links_sets(len(np.intersect1d(a, b)), len(a), len(b)):
                assert p in near
    assert tried < 0.1 * len(sets) ** 2 / 2  # nor are nearly all pairs left to verify


def test_copies_cost_one_comparison_each(monkeypatch):
    rng, memo, calls = random.Random(1), J.Words(), []
    base = [f"w{k}" for k in range(300)]
    sets = [J.shingle_set(" ".join(varied(rng, base, 1)), memo) for _ in range(400)]
    monkeypatch.setattr(J, "links_sets", lambda *x: calls.append(x) or J.RATIO[1] * x[0] >= J.RATIO[0] * (x[1] + x[2]))
    assert len(J.forest(sets, points(sets))) == 399 and len(calls) < 800
