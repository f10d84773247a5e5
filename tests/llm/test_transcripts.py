"""Transcripts: best paths by brute force, pieces against whole decoding, roles on conversations that the model has not seen."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from krathong.llm import transcripts as T
from krathong.llm.quality_rank import held_out

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def turns(spark):
    return spark.read.parquet(f"{SF}/conversations.parquet")


@pytest.fixture(scope="module")
def model(turns):
    return T.fit(turns)


def value(path, seen, model, before=T.START, end=True):
    total = model["end"][path[-1]] if end else 0
    for a, b, o in zip([before, *path], path, seen):
        total += model["trans"][a, b] + sum(e[b, o[i]] for i, e in enumerate(model["emit"]))
    return total


LINES = ["User: a", "b?", "Assistant: c", "d e f g h i j"]


def test_decode_is_the_best_path():
    model = T.train([T.write_turns([("user", "hi?"), ("assistant", "a b c\nd")], 0)])
    seen = T.observed(LINES)
    every = np.stack(np.meshgrid(*[np.arange(T.N)] * len(LINES), indexing="ij"), -1).reshape(-1, len(LINES))
    assert math.isclose(value(T.decode(LINES, model)[0], seen, model), max(value(p, seen, model) for p in every.tolist()))


def test_matrices_and_cuts(model):
    """Products of matrices hold the best scores, and the pieces between the cuts make up the best path."""
    lines = LINES * 3 + ["", "x y z"]
    whole, _ = T.decode(lines, model)
    parts = [lines[:3], lines[3:4], lines[4:11], lines[11:]]
    blanks = [False, *(not p[-1].strip() for p in parts)]
    mats = [T.matrix(p, model, b) for p, b in zip(parts, blanks)]
    product = mats[0]
    for m in mats[1:]:
        product = T.times(product, m)
    seen = T.observed(lines)
    assert math.isclose((product[T.START] + model["end"]).max(), value(whole, seen, model))
    got = []
    for p, blank, (before, last) in zip(parts, blanks, T.cuts(mats, T.START, None, model["end"])):
        got += T.decode(p, model, before, last, blank)[0]
    assert math.isclose(value(got, seen, model), value(whole, seen, model))


def written(conv, rows):
    """The whole transcript of one conversation: rows of (turn, role, text) in order."""
    style = zlib.crc32(str(conv).encode()) % T.STYLES
    bare = {k for k, (t, _, _) in enumerate(rows) if t % T.DROP == T.DROP - 1}
    return "\n".join(x for x, *_ in T.write_turns([(r, x) for _, r, x in rows], style, bare))


@pytest.mark.parametrize("piece", [3, 256])
def test_pieces_equal_whole_decoding(spark, turns, model, monkeypatch, piece):
    monkeypatch.setattr(T, "PIECE", piece)
    monkeypatch.setattr(T, "PIECE_MOST", 4 * piece)
    base = [(r.role, r.text) for r in turns.orderBy("conv_id", "turn").limit(1500).collect()]
    rows = [(name, k, *base[(7 * j + k) % len(base)]) for j, (name, n) in enumerate([("long é", 1400), ("b", 3), ("c", 700), ("d", 1)]) for k in range(n)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").withColumns({"rendered": F.lit(1), "range": F.lit(2), "piece": F.lit("z")})
    got = defaultdict(list)
    for r in T.recover_turns(df, model).orderBy("conv_id", "turn").collect():
        assert r.turn == len(got[r.conv_id]) and r.rendered == f"<|{r.role}|>\n{r.content}\n<|end|>"
        got[r.conv_id].append((r.role, r.content))
    own = defaultdict(list)
    for c, k, role, text in rows:
        own[c].append((k, role, text))
    assert dict(got) == {c: T.parse(written(c, v), model) for c, v in own.items()}


def test_roles_of_unseen_conversations(turns, model):
    """Exact role sequences; only a last turn without marker that no blank line parts from the one before can't be told."""
    convs = defaultdict(list)
    for r in turns.filter(held_out(F.col("conv_id"))).orderBy("conv_id", "turn").collect():
        convs[r.conv_id].append((r.role, r.text))
    exact = defaultdict(list)
    for rows in convs.values():
        for style in range(T.STYLES):
            bare = set(range(T.DROP - 1, len(rows), T.DROP))
            got = T.parse("\n".join(x for x, *_ in T.write_turns(rows, style, bare)), model)
            kind = "marked" if not bare else "last bare" if len(rows) - 1 in bare else "bare inside"
            exact[kind, style >= 4].append([r for r, _ in got] == [r for r, _ in rows])
    share = {k: float(np.mean(v)) for k, v in exact.items()}
    print(share, np.mean([x for v in exact.values() for x in v]))
    assert min(share["marked", False], share["marked", True], share["bare inside", True], share["last bare", True]) >= 0.98
    assert share["bare inside", False] >= 0.95
    assert np.mean([x for v in exact.values() for x in v]) >= 0.85


def test_parse(model):
    assert T.parse("", model) == [] and T.parse(None, model) == []
    assert T.parse("User: hi there\nAssistant: hello\nmore of it", model) == [("user", "hi there"), ("assistant", "hello\nmore of it")]


def test_odd_rows(spark, model):
    long = "word " * 60_000
    rows = [(None, 0, "user", "x"), (None, 0, "user", "x"), (1, None, None, None), (1, 700, "user", "z"), (1, 700, "user", "z"), (2, 0, "user", long), (3, 0, "other", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id or -1, r.turn, r.role, len(r.content)) for r in T.recover_turns(df, model).collect())
    assert got[:2] == [(-1, 0, "user", 1)] * 2
    ones = [g[1] for g in got if g[0] == 1]
    assert ones == [*range(len(ones))] and len(ones) >= 2 and (2, 0, "user", len(long) - 1) in got
    assert T.recover_turns(df.limit(0), model).collect() == []
    empty = T.fit(df.limit(0))
    assert len(T.parse("User: a\nAssistant: b", empty)) >= 1
    table = spark.createDataFrame([("User: a", "p", 1), (None, "p", 1), (None, "p", 1)], "transcript string, parsed string, n_turns int")
    assert [r.hmm_parsed.n_turns for r in T.parse_transcripts(table, model).collect()] == [1, 0, 0]
