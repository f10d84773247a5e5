"""The learned syllable tokenizer: held-out boundaries, weights by hand, odd words, its use for given syllables."""

import math

import pytest
from pyspark.sql import functions as F

from krathong.functions.syllables import extract_syllables
from krathong.operators import lines as N
from krathong.operators import tagger as L
from krathong.plans import fixtures as D

#: Syllables of the words of more than one; all others are one.
SYLLABLES = {"สลัก": ["ส", "ลัก"], "กลไก": ["กล", "ไก"], "กระบอง": ["กระ", "บอง"]}


@pytest.fixture(scope="module")
def parts():
    """(word, romanization, syllables) of all pairs of part words."""
    words = list(D.PART_ROMAN)
    return [(b + a, f"{D.PART_ROMAN[b]}-{D.PART_ROMAN[a]}", SYLLABLES.get(b, [b]) + SYLLABLES.get(a, [a])) for a in words for b in words if a != b]


def bounds(syllables):
    out, at = set(), 0
    for s in syllables[:-1]:
        at += len(s)
        out.add(at)
    return out


def accuracy(truth, got):
    """Share of the places between characters that are told right."""
    right = sum(len(set(range(1, len(w))) - (bounds(truth[w]) ^ bounds(got[w]))) for w in truth)
    return right / sum(len(w) - 1 for w in truth)


def test_held_out_boundaries(spark, parts):
    """Five folds: each word is cut by weights from the other words."""
    truth = {w: s for w, _, s in parts}
    got = {}
    for k in range(5):
        train = [(w, r) for i, (w, r, _) in enumerate(parts) if i % 5 != k]
        weights = L.fit(spark.createDataFrame(train, "thai string, translit string"))
        test = spark.createDataFrame([(w,) for i, (w, _, _) in enumerate(parts) if i % 5 == k], "word string")
        got |= {r.word: r.syllables for r in L.syllables(test, weights).collect()}
    rules = {r.word: r.s for r in spark.createDataFrame([(w,) for w in truth], "word string").select("word", extract_syllables(F.col("word")).alias("s")).collect()}
    assert all("".join(got[w]) == w for w in truth)
    learned, ruled = accuracy(truth, got), accuracy(truth, rules)
    print(f"held-out boundaries {learned:.4f}, rules {ruled:.4f}")
    assert learned > 0.88 and learned > ruled + 0.25


def test_weights_by_hand(spark):
    """One word of two syllables with one inner place, one of one syllable without any."""
    weights = {r.feature: r.weight for r in L.fit(spark.createDataFrame([("กามา", "gaa-maa"), ("ดี", "dii"), ("นานา", "naanaa"), ("กามา", "gaa-maa")], "thai string, translit string"), rounds=0).collect()}
    share = 2 / 3  # one place, a boundary: the prior counts one of each more
    seen = math.log((1 + share) / (1 - share))
    assert weights.keys() == {"", "l2กา", "r2มา", "l3_กา", "r3มา_", "l4__กา", "r4มา__"}
    assert all(math.isclose(w, math.log(share / (1 - share)) if f == "" else seen) for f, w in weights.items())


def test_odd_words(spark):
    weights = L.fit(spark.createDataFrame([], "thai string, translit string"))
    words = spark.createDataFrame([("",), (None,), ("ก",), ("เกา",), ("กามา",)], "word string")
    assert {r.word: r.syllables for r in L.syllables(words, weights).collect()} == {"ก": ["ก"], "เกา": ["เกา"], "กามา": ["กามา"]}


def test_gives_syllables_to_the_romanization(spark):
    """Weights are a table like any other: here one feature says where the second word begins."""
    weights = spark.createDataFrame([("", -1.0), ("r2จา", 20.0)], "feature string, weight double")
    table = spark.createDataFrame(list(D.PART_ROMAN.items()), "thai string, translit string")
    given = L.syllables(spark.createDataFrame([("แดงจาน",)], "word string"), weights)
    assert N.by_given_syllables(given, table, table.limit(0), table.selectExpr("thai", "translit", "1 AS priority")).first().roman == "dɛɛng-jaan"
