"""Syllables: boundaries, vowel patterns, parsing, tones. Column functions over one syllable or word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import orthography as O
from . import patterns
from .textnorm import nfc, remove_silent

C, L, V, T = f"[{O.CONSONANT}]", f"[{O.LEADING}]", f"[{O.VOWEL}]", f"[{O.TONE}]"
M = f"[{O.TONE}{O.OTHER_MARK}]"
MV = f"[{O.VOWEL}{O.TONE}{O.OTHER_MARK}]"
_PAIR = "(?:" + "|".join(sorted(O.CLUSTERS)) + f"|ห{C})"
#: One syllable: a leading vowel with its onset, an onset with a later vowel, a bare cluster, an onset with
#: its final, stray marks, or any one character. A final is taken only where the next syllable leaves it.
PLAIN = f"{L}(?>{_PAIR}|{C})?{MV}*(?:{C}(?![{O.LEADING}{O.CONSONANT}]))?|(?>{_PAIR}|{C})?{M}*{V}{MV}*(?:{C}(?!{V}))?|{_PAIR}{M}*|{C}{M}*{C}?|{M}+|(?s:.)"
#: Fixed shapes that come first in the full rules.
SHAPES = f"เ{C}ีย{C}?|เ{C}ือ{C}?|(?s:.)ร[ะา]{C}?"
FULL = f"{SHAPES}|{PLAIN}"


def extract_syllables(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit(f"({PLAIN})"), F.lit(1))


def syllable_at(rest: Column) -> Column:
    """The syllable with which ``rest`` begins, by the full rules."""
    return F.regexp_extract(rest, f"^(?:{FULL})", 0)


def sound_of(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def tone_class(initial: Column) -> Column:
    return F.when(initial.rlike(f"^[{O.HIGH}]"), "high").when(initial.rlike(f"^[{O.LOW}]"), "low").otherwise("mid")


_DOUBLED = "aa|ii|ʉʉ|uu|ee|ɛɛ|oo|ɔɔ"


def is_long(vowel: Column) -> Column:
    return vowel.rlike(f"{_DOUBLED}|əə|iia|ʉʉa|uua")


def is_live(vowel: Column, final: Column, engine: str) -> Column:
    """``final`` is a final sound; the three engines differ in what makes a syllable live."""
    glides = is_long(vowel) | vowel.rlike("ai|ao")
    if engine == "legacy":
        return final.isin("", "n", "m", "ng", "i", "o") | glides
    if engine == "build":
        return final.isin("", "n", "m", "ng") | vowel.rlike(_DOUBLED)
    return ~final.isin("p", "t", "k") & (glides | final.isin("", "n", "m", "ng", "i", "o"))


def tone_number(cls: Column, live: Column, mark: Column, long: Column, engine: str) -> Column:
    """0 mid, 1 low, 2 high, 3 falling, 4 rising; ``mark`` is the tone mark or the empty string."""
    low, mid, high = cls == "low", cls == "mid", cls == "high"
    dead_low = F.when(long, 3).otherwise(2) if engine == "pattern" else F.lit(2)
    plain = F.when(low & ~live, dead_low).when(high & live, 4).when(~live, 1).otherwise(0)
    return (
        F.when(mark == "่", F.when(low, 3).otherwise(1))
        .when(mark == "้", F.when(low, 2).otherwise(3))
        .when(mark == "๊", F.when(mid, 2).otherwise(0))
        .when(mark == "๋", F.when(mid, 4).otherwise(0))
        .otherwise(plain)
    )


def place_tone(roman: Column, tone: Column) -> Column:
    """The tone's mark goes on the first plain vowel letter; composed afterwards."""
    marks = F.array(F.lit(""), *map(F.lit, O.TONE_MARKS))
    put = F.regexp_replace(roman, F.lit(f"^([^{O.ROMAN_VOWEL}]*[{O.ROMAN_VOWEL}])"), F.concat(F.lit("$1"), F.element_at(marks, tone + 1)))
    return nfc(put)


# Vowel patterns (pattern, vowel, priority). K a cluster, C a consonant (the first initial, the last
# final), T an optional tone mark, all else itself.
PATTERNS = [
    ("เKียวC", "iao", 100), ("เCียวC", "iao", 99), ("เKือยC", "ʉʉai", 98), ("เCือยC", "ʉʉai", 97),
    ("เKียว", "iao", 95), ("เCียว", "iao", 94), ("เKือC", "ʉʉa", 93), ("เCือC", "ʉʉa", 92), ("เKียC", "iia", 91), ("เCียC", "iia", 90),
    ("เKิTC", "əə", 89), ("เCิTC", "əə", 88),
    ("เKีย", "iia", 85), ("เCีย", "iia", 84), ("เKือ", "ʉʉa", 83), ("เCือ", "ʉʉa", 82), ("เKาะ", "ɔ", 81), ("เCาะ", "ɔ", 80),
    ("เKอะ", "ə", 79), ("เCอะ", "ə", 78), ("เKิC", "əə", 77), ("เCิC", "əə", 76), ("เKาC", "ao", 75), ("เCาC", "ao", 74),
    ("KัวC", "ua", 73), ("CัวC", "ua", 72), ("Kาย", "aai", 71), ("Kาว", "aao", 70), ("แK็C", "ɛ", 69), ("แC็C", "ɛ", 68),
    ("แKCC", "ɛɛ", 67), ("โKCC", "oo", 66), ("KรรC", "a", 65), ("CรรC", "a", 64),
    ("KระC", "à", 68), ("CระC", "à", 67), ("Kระ", "à", 66), ("Cระ", "à", 65), ("KราC", "aa", 64), ("CราC", "aa", 63), ("Kรา", "aa", 62), ("Cรา", "aa", 61),
    ("เKอ", "əə", 60), ("เCอ", "əə", 59), ("เKา", "ao", 58), ("เCา", "ao", 57), ("เKย", "əəi", 56), ("เCย", "əəi", 55), ("เKว", "eeo", 54), ("เCว", "eeo", 53),
    ("เK็C", "e", 52), ("เC็C", "e", 51), ("เKC", "ee", 50), ("เCC", "ee", 49),
    ("แKะ", "ɛ", 48), ("แCะ", "ɛ", 47), ("แKC", "ɛɛ", 46), ("แCC", "ɛɛ", 45), ("แKว", "ɛɛo", 44), ("แCว", "ɛɛo", 43),
    ("โKะ", "o", 42), ("โCะ", "o", 41), ("โKC", "oo", 40), ("โCC", "oo", 39), ("โKย", "ooi", 38), ("โCย", "ooi", 37),
    ("ไKย", "ai", 36), ("ไCย", "ai", 35), ("ใKย", "ai", 34), ("ใCย", "ai", 33),
    ("Kัว", "ua", 32), ("Cัว", "ua", 31), ("Kวย", "uai", 32), ("Cวย", "uai", 31), ("Cาย", "aai", 28), ("Cาว", "aao", 27), ("Kรร", "an", 26), ("Cรร", "an", 25),
    ("KัC", "a", 24), ("KาC", "aa", 23), ("KิC", "i", 22), ("KีC", "ii", 21), ("KึC", "ʉ", 20), ("KืC", "ʉʉ", 19), ("KุC", "u", 18), ("KูC", "uu", 17), ("KอC", "ɔɔ", 16),
    ("เK", "ee", 15), ("เC", "ee", 14), ("แK", "ɛɛ", 13), ("แC", "ɛɛ", 12), ("โK", "oo", 11), ("โC", "oo", 10), ("ไK", "ai", 9), ("ไC", "ai", 8), ("ใK", "ai", 7), ("ใC", "ai", 6),
    ("Cะ", "a", 5), ("CัTC", "a", 4), ("CัC", "a", 3), ("Cา", "aa", 2), ("CาTC", "aa", 1), ("CาC", "aa", 0), ("Cำ", "am", -1),
    ("CิTC", "i", -2), ("CิC", "i", -3), ("Cิ", "i", -4), ("CีTC", "ii", -5), ("CีC", "ii", -6), ("Cี", "ii", -7),
    ("CึTC", "ʉ", -8), ("CึC", "ʉ", -9), ("Cึ", "ʉ", -10), ("CืC", "ʉʉ", -11), ("Cื", "ʉʉ", -12),
    ("CุTC", "u", -13), ("CุC", "u", -14), ("Cุ", "u", -15), ("CูTC", "uu", -16), ("CูC", "uu", -17), ("Cู", "uu", -18),
    ("CTอC", "ɔɔ", -19), ("CอTC", "ɔɔ", -20), ("CอC", "ɔɔ", -21), ("Cอ", "ɔɔ", -22), ("C็อC", "ɔ", -23), ("Cร", "ɔɔn", -24),
    ("CC", "o", -100), ("C", "ɔɔ", -101),
]
#: Longest first, then by priority, then as declared.
RANKED = sorted(PATTERNS, key=lambda p: (-len(p[0]), -p[2]))


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it; expressions stay small."""
    return F.element_at(F.transform(F.array(value), f), 1)


_RANKED = tuple(p for p, _, _ in RANKED)


def match_pattern(syllable: Column) -> Column:
    """Rank (1 is the first) of the first pattern that the whole syllable matches, silent letters removed; null if none does."""
    return bound(remove_silent(syllable), lambda s: patterns.rank(s, _RANKED))


def pattern_parts(syllable: Column) -> Column:
    """Onset, vowel, tone mark and final letter by the first pattern that matches, as a struct; null if none does."""
    vowels = F.array(*[F.lit(v) for _, v, _ in RANKED])

    def parts(s, rank):
        found = {"vowel": F.element_at(vowels, rank), **patterns.groups(s, rank, _RANKED)}
        return F.when(rank.isNotNull(), F.struct(*[c.alias(k) for k, c in found.items()]))

    return bound(remove_silent(syllable), lambda s: bound(patterns.rank(s, _RANKED), lambda rank: parts(s, rank)))


def from_parts(parts: Column) -> Column:
    """Romanization of what ``pattern_parts`` found; null for null."""

    def roman(m):
        onset, vowel = m["onset"], m["vowel"]
        sound = F.coalesce(sound_of(O.CLUSTERS, onset), sound_of(O.INITIAL, onset), F.lit(""))
        final = F.coalesce(sound_of(O.FINAL, m["final"]), F.lit(""))
        # before a sounded final the last letter of a long open o is written o
        written = F.when(vowel.endswith("ɔɔ") & (final != ""), F.regexp_replace(vowel, "ɔ$", "o")).otherwise(vowel)
        # a final letter without a sound leaves a short syllable dead, unlike no final at all
        live = is_live(vowel, F.when((m["final"] != "") & (final == ""), "mute").otherwise(final), "pattern")
        tone = tone_number(tone_class(onset), live, m["mark"], is_long(vowel), "pattern")
        return F.when(m.isNotNull(), place_tone(F.concat(sound, written, final), tone))

    return bound(parts, roman)


def parse(syllable: Column) -> dict[str, Column]:
    """Components by position: leading vowel, onset of one letter, a cluster or any letter with ร, vowels, tone mark, finals."""
    s = remove_silent(syllable)
    lead = F.regexp_extract(s, f"^{L}?", 0)
    onset = F.regexp_extract(s, f"^{L}?({'|'.join(sorted(O.CLUSTERS))}|{C}ร|{C}|)", 1)
    rest = F.substr(s, F.length(lead) + F.length(onset) + 1)
    return {"lead": lead, "onset": onset, "vowel": F.regexp_replace(rest, f"[^{O.VOWEL}]", ""), "tone": F.regexp_extract(rest, f"^(?s:.*)({T})", 1), "final": F.regexp_replace(rest, f"[^{O.CONSONANT}]", "")}


#: Vowels by their first written sign: alone, and after a leading vowel (the empty sign is the leading vowel alone).
PLAIN_VOWELS = {"ะ": "a", "ั": "a", "า": "aa", "ิ": "i", "ี": "ii", "ึ": "ʉ", "ื": "ʉʉ", "ุ": "u", "ู": "uu", "ำ": "am"}
LED_VOWELS = {"เ": "ee", "เา": "ao", "เิ": "əə", "แ": "ɛɛ", "แะ": "ɛ", "โ": "oo", "โะ": "o"}


def build(p: dict[str, Column]) -> Column:
    """Romanization from components: onset, vowel by the first of its written signs, final, tone."""

    def sounds(x):
        lead, onset, sign = x["lead"], x["onset"], F.substring(x["vowel"], 1, 1)
        f1, f2 = F.substring(x["final"], 1, 1), F.substring(x["final"], 2, 1)
        first = sound_of(O.INITIAL, F.substring(onset, 1, 1))
        # a letter with ร that is no cluster sounds only before ะ and า; before ะ the vowel is cut short
        loose = (F.length(onset) == 2) & ~onset.isin(*O.CLUSTERS)
        cut = loose & (sign == "ะ")
        initial = F.when(cut, F.concat(first, F.lit("rà~"))).when(loose & (sign == "า"), F.concat(first, F.lit("r"))).when(loose, "").when(F.length(onset) == 2, sound_of(O.CLUSTERS, onset)).otherwise(F.coalesce(first, F.lit("")))
        e = lead == "เ"
        iia, uea, oei = e & (sign == "ี") & (f1 == "ย"), e & (sign == "ื") & (f1 == "อ"), e & (sign == "") & (f1 == "ย")
        open_r = (lead == "") & (sign == "") & onset.startswith("ร")
        vowel = (
            F.when(cut, "").when(iia, "iia").when(uea, "ʉʉa").when(oei, "əəi")
            .when(lead.isin("ไ", "ใ"), "ai")
            .when(lead != "", sound_of(LED_VOWELS, F.concat(lead, sign)))
            .when(sign == "", F.when(open_r | f1.isin("", "ร"), "ɔɔ").otherwise("o"))
            .otherwise(sound_of(PLAIN_VOWELS, sign))
        )
        letter = F.when(cut, f1).when(iia, f2).when(oei, "").otherwise(f1)
        final = F.when(~cut & (uea | (open_r & (f1 == ""))), "n").otherwise(F.coalesce(sound_of(O.FINAL, letter), F.lit("")))
        return F.struct(initial.alias("initial"), F.coalesce(vowel, F.lit("")).alias("vowel"), final.alias("final"), onset.alias("onset"), x["tone"].alias("tone"))

    def roman(x):
        tone = tone_number(tone_class(x["onset"]), is_live(x["vowel"], x["final"], "build"), x["tone"], F.lit(False), "build")
        return F.when(x["onset"].isNotNull(), place_tone(F.concat(x["initial"], x["vowel"], x["final"]), tone))

    return bound(bound(F.struct(*[c.alias(k) for k, c in p.items()]), sounds), roman)
