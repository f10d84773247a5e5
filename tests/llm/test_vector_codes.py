"""Vector codes: whole results by brute force, the screen's intervals, odd vectors."""

import hashlib
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from krathong.llm import vector_codes as V

COLS = "vec_id long, embedding array<float>, label int, code string, l string, s string, v int"


def table(spark, rows):
    return spark.createDataFrame([(i, e, y, "a", "b", "c", 7) for i, e, y in rows], COLS)


def brute(rows, rounds=4):
    """Plain Python integers all along; rows: (id, vector, label), ids distinct."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    w = len(kept[0][1]) // 4
    part = lambda v, p: v[p * w : (p + 1) * w]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: r[0])[:256]
    books = [[part(v, p) for _, v, _ in first] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, p: min(range(len(books[p])), key=lambda k: (far(part(v, p), books[p][k]), k))
    for _ in range(rounds):
        got = [[[] for _ in b] for b in books]
        for _, v, _ in kept:
            for p in range(4):
                got[p][best(v, p)].append(part(v, p))
        books = [[[sum(c) // len(g) for c in zip(*g)] if g else old for g, old in zip(got[p], books[p])] for p in range(4)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, y in kept:
        at = [best(v, p) for p in range(4)]
        out.append((i, y, "".join(f"{k:02x}" for k in at), sum(far(part(v, p), books[p][k]) for p, k in enumerate(at))))
    return sorted([(i, c, e, sum(o[3] for o in out if o[1] == y), sha) for i, y, c, e in out], key=repr)


def result(spark, rows):
    t = table(spark, rows)
    books = V.fit(t)
    return sorted([(r.vec_id, r.code, r.error, r.label_error, V.digest(books)) for r in V.with_label_error(V.encode(t, books)).collect()], key=repr)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(0, 0.4, 8).astype("float32").tolist(), int(i) % 3 if i % 7 else None) for i in rng.permutation(320)]
    rows += [(400 + k, rows[0][1], 1) for k in range(40)]  # one vector many times
    rows += [(500, None, 1), (501, [0.5] * 7 + [None], 1), (502, [0.5] * 7 + [float("nan")], None), (503, [float("inf")] * 8, 2), (None, [0.25] * 8, None)]
    assert result(spark, rows) == brute(rows)


def test_fewer_vectors_than_entries_and_ties(spark):
    rows = [(3, [0.0] * 4, 1), (1, [0.002] * 4, 1), (2, [0.0] * 4, None), (9, [-0.001] * 4, None)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == [] and result(spark, [(1, None, 2)]) == []


def test_odd_vectors(spark):
    """Another width or components out of range: kept, without a code; repeated rows repeat; a repeated id gives one entry."""
    rows = [(1, [0.5] * 8, 1), (2, [0.25] * 8, 1), (2, [0.125] * 8, 1), (3, [0.5] * 4, 1), (4, [], None), (5, [1e9] * 8, 1), (2, [0.25] * 8, 1)]
    t = table(spark, rows)
    books = V.fit(t, rounds=0)
    assert [c.tolist() for c in books] == [[[512, 512], [128, 128]]] * 4
    got = sorted((r.vec_id, r.code, r.error) for r in V.encode(t, books).filter("code is not null").collect())
    assert got == [(1, "00" * 4, 0), (2, "01" * 4, 0), (2, "01" * 4, 8 * 128**2), (2, "01" * 4, 8 * 128**2)]
    assert sorted(r.vec_id for r in V.encode(t, books).filter("code is null").collect()) == [3, 4, 5]
    assert np.allclose(V.decode(["00" * 4], books), 0.5, atol=1 / 1024)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**31), st.sampled_from([3, 300, 1 << 20, 1 << 24]), st.integers(1, 9))
def test_screen_never_loses_the_nearest(seed, size, width):
    """Entries a step apart, which float32 can't tell from each other at the larger sizes."""
    rng = np.random.default_rng(seed)
    base = rng.integers(-size, size + 1, width)
    c = np.clip(base + rng.integers(-1, 2, (40, width)), -V.LARGEST, V.LARGEST)
    x = np.clip(base + rng.integers(-2, 3, (30, width)), -V.LARGEST, V.LARGEST)
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (V.nearest(x, c) == d.argmin(1)).all()
    row, entry = V.screen(x, c)
    assert {(i, j) for i, j in zip(*np.nonzero(d == d.min(1, keepdims=True)))} <= set(zip(row.tolist(), entry.tolist()))


def test_screen_settles_most_rows():
    """On vectors like those of the table nearly all rows are left with one entry."""
    rng = np.random.default_rng(1)
    x, c = rng.integers(-300, 300, (4000, 16)), rng.integers(-300, 300, (256, 16))
    assert len(V.screen(x, c)[0]) < 1.01 * len(x)
