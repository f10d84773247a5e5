"""The lattice: where it differs from longest match, clusters, both sources of its edges, and as the tokenizer of lines."""

import random
import re

import pytest

from krathong.operators import lattice as T
from krathong.operators import lines as N
from krathong.operators import segment as G
from krathong.operators import trie


def lexicon(spark, *entries):
    return spark.createDataFrame([(e, f"r{k}", 1) for k, e in enumerate(entries)], "thai string, translit string, priority int")


def words(spark, *w):
    return G.keyed(spark.createDataFrame([(x,) for x in w], "word string"))


def pieces(df):
    return {r.word: [(p.piece, p.tier != "rule") for p in r.pieces] for r in df.collect()}


def best(word, entries, window=8):
    """The least (unknown, pieces, lengths negated) of all paths, by memory of the rest."""
    nodes, at = {0}, 0
    for c in re.findall(T.CLUSTER.replace(r"(?s:.)", r"[\s\S]"), word):
        at += len(c)
        nodes.add(at)
    order, memo = sorted(nodes), {len(word): (0, 0, (), ())}
    for p in reversed(order[:-1]):
        step = order[order.index(p) + 1]
        edges = [(e, 0) for e in order if p < e <= p + window and word[p:e] in entries] + [(step, step - p)]
        memo[p] = min((memo[e][0] + u, memo[e][1] + 1, (p - e, *memo[e][2]), (u > 0, *memo[e][3])) for e, u in edges)
    out, at = [], 0
    for n, unknown in zip(memo[0][2], memo[0][3]):
        out.append((word[at : at - n], not unknown))
        at -= n
    return out


def test_differs_from_longest_match(spark):
    lex, w = lexicon(spark, "ตา", "ตาก", "กลม"), words(spark, "ตากลม")
    assert pieces(T.cut_lattice(w, lex)) == {"ตากลม": [("ตา", True), ("กลม", True)]}
    assert [p for p, known in pieces(G.cut(w, lex))["ตากลม"] if known] == ["ตาก"]


def test_fewer_pieces_then_the_longest_first(spark):
    lex = lexicon(spark, "กา", "มา", "กามา", "กามาดี", "ดี", "ดีใจ", "ใจ")
    got = pieces(T.cut_lattice(words(spark, "กามา", "กามาดีใจ"), lex))
    assert got == {"กามา": [("กามา", True)], "กามาดีใจ": [("กามาดี", True), ("ใจ", True)]}


def test_clusters_are_not_cut(spark):
    """An entry that would cut a consonant from its signs is no edge."""
    lex = lexicon(spark, "เก", "าม", "ก")
    assert pieces(T.cut_lattice(words(spark, "เกามก", "ab"), lex)) == {"เกามก": [("เกา", False), ("ม", False), ("ก", True)], "ab": [("a", False), ("b", False)]}


@pytest.mark.parametrize("by_join", [False, True])
def test_equals_all_paths(spark, monkeypatch, by_join):
    rng = random.Random(12)
    some = lambda n: "".join(rng.choice("กขมาะิเ่ab") for _ in range(n))
    entries, w = {some(rng.randrange(1, 6)) for _ in range(120)}, {some(rng.randrange(1, 30)) for _ in range(60)} | {some(3000)}
    if by_join:
        monkeypatch.setattr(trie, "ENTRIES", 5)
    assert pieces(T.cut_lattice(words(spark, *w, "", None), lexicon(spark, *sorted(entries)))) == {x: best(x, entries) for x in w}


def test_as_the_tokenizer_of_lines(spark):
    rows = spark.createDataFrame([("f", 1, "ตากลม ดี")], "file string, line_no int, text string")
    lex = lexicon(spark, "ตา", "ตาก", "กลม", "ดี").select("thai", "translit")
    empty = spark.createDataFrame([], "thai string, translit string, priority int")
    assert N.romanize_lines(rows, lex, empty, T.cut_lattice).first().roman == "r0 r2 r3"
    assert [r.token for r in N.tokens(rows.selectExpr("'ตากลมมม' AS word"), lex, cutter=T.cut_lattice).orderBy("pos").collect()] == ["ตา", "กลม", "มม"]
