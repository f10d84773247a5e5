"""The lexicon automaton against plain search, and against the join that serves larger lexicons."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from krathong.operators import segment as G
from krathong.operators import trie as T

LETTERS = "กขมาะิเแ่ab"


def plain(word, lexicon, window):
    """(length, translit, priority) at each place: the longest entry that does not leave exactly one consonant behind."""
    out = []
    for p in range(len(word)):
        best = None
        for n in range(1, min(window, len(word) - p) + 1):
            rest = word[p + n :]
            if word[p : p + n] in lexicon and not (len(rest) == 1 and "ก" <= rest <= "ฮ"):
                best = (n, *lexicon[word[p : p + n]])
        out.append(best)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(LETTERS, min_size=1, max_size=6), max_size=25, unique=True), st.lists(st.text(LETTERS + "x", min_size=1, max_size=14), min_size=1, max_size=12))
def test_walk_equals_plain_search(entries, words):
    lexicon = {e: (f"r{k}", k % 2) for k, e in enumerate(entries)}
    trie = T.Trie([(e, *v) for e, v in lexicon.items()])
    got = trie.hits(words).to_pylist()
    for word, places in zip(words, got):
        assert [p["pos"] for p in places] == list(range(1, len(word) + 1))
        assert [p["hit"] and (p["hit"]["len"], p["hit"]["translit"], p["hit"]["priority"]) for p in places] == plain(word, lexicon, 6)


def test_no_words_and_no_entries():
    assert T.Trie([]).hits(["ab"]).to_pylist() == [[{"pos": 1, "hit": None}, {"pos": 2, "hit": None}]]
    assert T.Trie([("ab", "r", 1)]).hits([]).to_pylist() == []


@pytest.fixture
def tables(spark):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    entries = {some(rng.randrange(1, 10)) for _ in range(150)}
    lex = spark.createDataFrame([(e, f"r{k}", k % 2) for k, e in enumerate(sorted(entries))] + [("ก", "twice", 0)], "thai string, translit string, priority int")
    words = spark.createDataFrame([(some(rng.randrange(1, 40)),) for _ in range(120)] + [("",), (None,), (some(5000),)], "word string")
    return words, lex


def test_automaton_equals_join(spark, tables, monkeypatch):
    words, lex = tables
    rows = lambda: sorted(map(tuple, G.segment(words, lex, whole=True).collect()), key=repr)
    by_walk = rows()
    monkeypatch.setattr(T, "ENTRIES", 10)
    assert T.trie_of(lex, 8) is None
    assert rows() == by_walk
    monkeypatch.undo()
    monkeypatch.setattr(T, "CELLS", 10)
    assert T.trie_of(lex, 8) is None


def test_walk_shuffles_nothing(spark, tables):
    words, lex = tables
    keyed = G.keyed(words).select("word", "key")
    plan = G.cut(keyed, lex)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == G.keyed(words)._jdf.queryExecution().executedPlan().toString().count("Exchange")
