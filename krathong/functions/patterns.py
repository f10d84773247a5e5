"""The vowel patterns as one deterministic automaton: a syllable is walked once, letter by letter, whatever the number of patterns.

The patterns become one nondeterministic automaton (a cluster takes two letters, a tone mark may be missing), whose sets of states are the states of a
table over the letters that any pattern knows. The table and what each state accepts are array literals in the plan, so the walk is one fold with one
look-up a letter. Where a pattern has its onset, its tone mark and its final follows from the pattern and the length of the syllable.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import orthography as O

CONSONANTS = [chr(c) for c in range(ord(O.CONSONANT[0]), ord(O.CONSONANT[-1]) + 1)]
DEAD, BEGIN = 1, 2


def _reached(patterns: tuple, states: set) -> frozenset:
    """With what lies behind tone marks that are not there. A state: pattern, place, first letter of a cluster begun."""
    out = set(states)
    for i, j, half in states:
        while not half and j < len(patterns[i]) and patterns[i][j] == "T":
            j += 1
            out.add((i, j, ""))
    return frozenset(out)


def _step(patterns: tuple, states: frozenset, x: str) -> frozenset:
    out = set()
    for i, j, half in states:
        if half:
            if half + x in O.CLUSTERS:
                out.add((i, j + 1, ""))
        elif j < len(patterns[i]):
            sign = patterns[i][j]
            if sign == "K":
                if any(k[0] == x for k in O.CLUSTERS):
                    out.add((i, j, x))
            elif x in CONSONANTS if sign == "C" else x in O.TONE if sign == "T" else x == sign:
                out.add((i, j + 1, ""))
    return _reached(patterns, out)


@lru_cache
def automaton(patterns: tuple) -> tuple[str, list[list[int]], list[int]]:
    """(letters, next state by state and letter, rank by state) of patterns in order of rank; states from 1, the first is dead, the second the start; rank 0: none."""
    letters = "".join(sorted({*CONSONANTS, *O.TONE, *(c for p in patterns for c in p if c not in "KCT")}))
    first = _reached(patterns, {(i, 0, "") for i in range(len(patterns))})
    names, todo, table = {frozenset(): DEAD, first: BEGIN}, [first], {DEAD: [DEAD] * (len(letters) + 1)}
    while todo:
        now, row = todo.pop(), [DEAD]  # a letter that no pattern knows
        for x in letters:
            after = _step(patterns, now, x)
            if after not in names:
                names[after] = len(names) + 1
                todo.append(after)
            row.append(names[after])
        table[names[now]] = row
    rank = {n: min((i + 1 for i, j, half in s if not half and j == len(patterns[i])), default=0) for s, n in names.items()}
    return letters, [table[n] for n in sorted(table)], [rank[n] for n in sorted(rank)]


def _ints(values) -> str:
    """An array of numbers that the optimizer folds into one literal."""
    return f"CAST(split('{','.join(map(str, values))}', ',') AS ARRAY<INT>)"


def rank(syllable: Column, patterns: tuple) -> Column:
    """The place (from 1) of the first pattern that the whole syllable matches, null if none does."""
    letters, table, ranks = automaton(patterns)
    flat, width = F.expr(_ints(v for row in table for v in row)), len(letters) + 1
    walked = F.aggregate(
        F.split(syllable, ""), F.lit(BEGIN),
        lambda state, x: F.element_at(flat, (state - 1) * width + F.instr(F.lit(letters), x) + 1),
        lambda state: F.nullif(F.element_at(F.expr(_ints(ranks)), state), F.lit(0)),
    )
    return F.when(syllable != "", walked)


def groups(syllable: Column, at: Column, patterns: tuple) -> dict[str, Column]:
    """Onset, tone mark and final (empty where the pattern has none) of a syllable that matches the pattern at the place given."""
    places = []
    for p in patterns:
        wide = p.replace("K", "KK")
        onset = min(wide.find(c) for c in "KC" if c in wide)
        letters = [c for c in p if c in "KC"]
        assert len(letters) == 1 or p[-1] == "C"
        places.append((onset + 1, 2 if wide[onset] == "K" else 1, wide.find("T") + 1, len(wide), int(len(letters) > 1)))
    onset, length, mark, full, final = (F.element_at(F.expr(_ints(x)), at) for x in zip(*places))
    return {
        "onset": F.substr(syllable, onset, length),
        "mark": F.when((mark > 0) & (F.char_length(syllable) == full), F.substr(syllable, mark, F.lit(1))).otherwise(""),
        "final": F.when(final > 0, F.substring(syllable, -1, 1)).otherwise(""),
    }
