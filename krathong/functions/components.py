"""The second syllable engine: components by position, a vowel from its written parts, its own tone rules.

It differs from the pattern engine in what it takes for an onset: up to two consonants, of which the second
counts as the final, or as the vowel if it is ว, where the two are no cluster.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import orthography as O
from .syllables import C, L, T, V, bound, is_live, is_long, place_tone, sound_of, tone_class, tone_number
from .textnorm import remove_silent

#: What the vowel marks say by themselves.
MARKS = {"ะ": "a", "ั": "a", "า": "aa", "ิ": "i", "ี": "ii", "ึ": "ʉ", "ื": "ʉʉ", "ุ": "u", "ู": "uu", "ำ": "am", "วั": "ua"}
#: What they say behind the leading vowel เ, where that differs.
MARKS_E = {"า": "ao", "ิ": "əə", "็": "e", "ะ": "e", "าะ": "ɔ"}


def components(syllable: Column) -> Column:
    """Struct of initial (sound), initial_thai (its first letter), lead, marks, tone_mark and final (letter); silent letters are gone."""

    def head_of(body):
        # อย before a vowel is y of the middle class; ส before วั stands alone
        return F.when(body.rlike(f"^อย{V}"), "y").when(body.startswith("สวั"), "w").otherwise("").alias("kind")

    def split(s):
        body = F.regexp_replace(s, f"^{L}", "")
        head = F.when(body.startswith("สวั"), "สวั").otherwise(F.regexp_extract(body, f"^{C}{{0,2}}", 0))
        return F.struct(F.regexp_extract(s, f"^{L}", 0).alias("lead"), head_of(body), head.alias("head"), F.substr(body, F.length(head) + 1).alias("rest"))

    def read(x):
        kind, head, rest = x["kind"], x["head"], x["rest"]
        first, second = F.substring(head, 1, 1), F.substring(head, 2, 1)
        loose = (kind == "") & (second != "") & ~head.isin(*O.CLUSTERS)
        initial = F.when(kind == "y", "y").when(kind == "w", "s").otherwise(F.coalesce(sound_of(O.CLUSTERS, head), sound_of(O.INITIAL, first), F.lit("")))
        marks = F.concat(F.when(kind == "w", "วั").when(loose & (second == "ว"), "ว").otherwise(""), F.regexp_replace(rest, f"[^{O.VOWEL}็]", ""))
        late = F.regexp_extract(rest, f"^(?s:.*)({C})", 1)
        final = F.when(late != "", late).when(loose & (second != "ว"), second).otherwise("")
        return F.when(x["lead"].isNotNull(), F.struct(initial.alias("initial"), first.alias("initial_thai"), x["lead"].alias("lead"), marks.alias("marks"), F.regexp_extract(rest, f"^(?s:.*)({T})", 1).alias("tone_mark"), final.alias("final")))

    return bound(bound(remove_silent(syllable), split), read)


def vowel_sound(lead: Column, marks: Column, final: Column) -> Column:
    short = marks.isin("ะ", "็")
    return (
        F.when((lead == "เ") & (marks == ""), F.when(final == "ย", "əəi").otherwise("ee"))
        .when((lead == "เ") & marks.isin(*MARKS_E), sound_of(MARKS_E, marks))
        .when(lead == "แ", F.when(short, "ɛ").otherwise("ɛɛ"))
        .when(lead == "โ", F.when(marks == "ะ", "o").otherwise("oo"))
        .when(lead.isin("ไ", "ใ"), "ai")
        .when(marks == "ว", F.when(final == "ย", "uai").otherwise("ua"))
        .when(marks == "", F.when(final == "", "ɔɔ").otherwise("o"))
        .otherwise(F.coalesce(sound_of(MARKS, marks), F.lit("")))
    )


def romanize(parts: Column) -> Column:
    """Romanization of what ``components`` found; null for null."""

    def sounds(c):
        final = F.coalesce(sound_of(O.FINAL, c["final"]), F.lit(""))
        return F.when(c.isNotNull(), F.struct(c.alias("c"), vowel_sound(c["lead"], c["marks"], c["final"]).alias("vowel"), final.alias("final")))

    def roman(x):
        c, vowel, final = x["c"], x["vowel"], x["final"]
        tone = tone_number(tone_class(c["initial_thai"]), is_live(vowel, final, "legacy"), c["tone_mark"], is_long(vowel), "legacy")
        return place_tone(F.concat(c["initial"], vowel, final), tone)

    return bound(bound(parts, sounds), roman)
