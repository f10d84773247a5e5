"""The pattern automaton against one regular expression a pattern."""

import random
import re

from pyspark.sql import functions as F

from krathong.functions import orthography as O
from krathong.functions import patterns as P
from krathong.functions import syllables as S

CONS = [chr(c) for c in range(ord("ก"), ord("ฮ") + 1)]


def by_regex(s):
    """(rank, onset, mark, final) of the first pattern, each pattern a regular expression of its own."""
    for rank, (pattern, _, _) in enumerate(S.RANKED, 1):
        kinds = {"K": "(?:" + "|".join(O.CLUSTERS) + ")", "C": "[ก-ฮ]", "T": f"[{O.TONE}]?"}
        letters = [i for i, c in enumerate(pattern) if c in "KC"]
        named = {letters[0]: "onset", pattern.find("T"): "mark"} | ({letters[-1]: "final"} if len(letters) > 1 else {})
        m = re.fullmatch("".join(f"(?P<{named[i]}>{kinds.get(c, c)})" if i in named else kinds.get(c, c) for i, c in enumerate(pattern)), s)
        if m:
            return (rank, *(m.groupdict().get(g) or "" for g in ("onset", "mark", "final")))
    return None, None, None, None


def syllables():
    rng = random.Random(8)
    out = ["", "ก\n", "ฟฟฟฟ", "abc"]
    for pattern, _, _ in S.RANKED:
        for _ in range(12):
            out.append("".join(rng.choice(list(O.CLUSTERS)) if c == "K" else rng.choice(CONS) if c == "C" else rng.choice(["", *O.TONE]) if c == "T" else c for c in pattern))
    signs = O.LEADING + O.VOWEL + O.TONE + "็รวยอ"
    out += ["".join(rng.choice(CONS if rng.random() < 0.5 else signs) for _ in range(rng.randrange(1, 7))) for _ in range(3000)]
    return sorted({s for s in out if "์" not in s})


def test_automaton_equals_regexes(spark):
    words = syllables()
    df = spark.createDataFrame([(w,) for w in words], "w string").coalesce(2)
    parts = S.pattern_parts(F.col("w"))
    got = {r.w: (r.rank, r.p.onset if r.p else None, r.p.mark if r.p else None, r.p.final if r.p else None) for r in df.select("w", S.match_pattern(F.col("w")).alias("rank"), parts.alias("p")).collect()}
    assert got == {w: by_regex(w) for w in words}
    assert sum(v[0] is not None for v in got.values()) > 1000


def test_table_is_small_and_whole():
    letters, table, ranks = P.automaton(tuple(p for p, _, _ in S.RANKED))
    assert len(table) == len(ranks) < 400 and all(len(row) == len(letters) + 1 and max(row) <= len(table) for row in table)
    assert set(table[P.DEAD - 1]) == {P.DEAD}
    # what two ranks accept alike goes to the first, so a rank may be without a state
    assert len({r for r in ranks if r}) > 100
