"""Text normalization as Column functions: everything stays inside Catalyst."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import orthography as O

WHITE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def contains_thai(c: Column) -> Column:
    """Any code point of the Thai block, the currency sign included."""
    return c.rlike(r"[\x{0E00}-\x{0E7F}]")


def contains_digit(c: Column) -> Column:
    return c.rlike("[0-9]")


def has_precomposed(c: Column) -> Column:
    return c.rlike("[èéêìíîòóôùúû]")


def strip_markers(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def fold_separators(c: Column) -> Column:
    return F.translate(c, "-~", "")


def strip_bom(c: Column) -> Column:
    return F.regexp_replace(c, r"^\x{FEFF}", "")


def nfc(c: Column) -> Column:
    """Canonical composition of any text, in the JVM. Characters below U+0300 are composed already, so most texts pass by one test."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    return F.when(c.rlike(r"[^\x{0}-\x{2FF}]"), composed).otherwise(c)


def strip_tones(c: Column) -> Column:
    """Drops tone marks, combining or precomposed; vowel letters stay."""
    marked = "".join(x + x.upper() for v in O.PRECOMPOSED.values() for x in v)
    plain = "".join((b + b.upper()) * 4 for b in O.PRECOMPOSED)
    return F.regexp_replace(F.translate(c, marked, plain), r"\p{Mn}", "")


def punctuation_to_space(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{P}\p{S}]", " ")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WHITE, " "))


def trim_space(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"^{WHITE}|{WHITE}\z", "")


def fold_particles(c: Column) -> Column:
    """Particles whose tone is written both ways lose it, after a space."""
    for word, plain in (("mǎi", "mai"), ("mái", "mai")):
        c = F.replace(c, F.lit(f" {word} "), F.lit(f" {plain} "))
    for word, plain in (("mǎi", "mai"), ("mái", "mai")):
        c = F.regexp_replace(c, f" {word}$", f" {plain}")
    for word in ("wà", "wâ"):
        c = F.replace(c, F.lit(f" {word} "), F.lit(" wa "))
    for word in ("wà", "wâ"):
        c = F.regexp_replace(c, f" {word}$", " wa")
    return c


def number_words(n: Column) -> Column:
    """Words of a digit string: one digit, a two-digit number, or digit by digit."""
    units, tens = F.array(*map(F.lit, O.UNITS)), F.array(*map(F.lit, O.TENS))
    at = lambda table, d: F.element_at(table, d.cast("int") + 1)
    t, u = F.substring(n, 1, 1), F.substring(n, 2, 1)
    two = F.concat(at(tens, t), F.when((u == "1") & (t != "0"), F.lit(f" {O.ELEVENTH}")).when(u != "0", F.concat(F.lit(" "), at(units, u))).otherwise(""))
    each = F.array_join(F.transform(F.split(n, ""), lambda d: F.when(d == "0", O.ZERO).otherwise(at(units, d))), " ")
    return F.when(n == "0", O.ZERO).when(F.length(n) == 1, at(units, n)).when(F.length(n) == 2, two).otherwise(each)


def normalize_numbers(c: Column) -> Column:
    """Each run of digits becomes words; a space goes before it unless one is there, none after it."""
    words = F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), number_words)
    gaps = F.split(c, "[0-9]+", -1)
    joined = F.zip_with(gaps, words, lambda g, w: F.struct(g.alias("g"), w.alias("w")))
    out = F.aggregate(joined, F.lit(""), lambda s, x: F.when(x["w"].isNull(), F.concat(s, x["g"])).otherwise(F.concat(s, x["g"], F.when((F.concat(s, x["g"]) == "") | F.concat(s, x["g"]).endswith(" "), "").otherwise(" "), x["w"])))
    return F.when(contains_digit(c), out).otherwise(c)


def normalize(c: Column) -> Column:
    c = F.lower(collapse(nfc(strip_bom(c))))
    folded = fold_particles(collapse(punctuation_to_space(c)))
    # numbers look at their input several times: bound as a lambda's variable it is computed once
    return F.element_at(F.transform(F.array(folded), normalize_numbers), 1)


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: (w != "") & (w != "-"))


def remove_silent(c: Column) -> Column:
    return F.regexp_replace(c, "(?s:.)์|[ก-ฮ][ะัาิีึืุูเแโใไๅำ]์", "")


def first_number(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, r"\d+", 0).try_cast("int"), F.lit(0))


def unescape_html(c: Column) -> Column:
    """Character references of all kinds, named and numbered. For vocabulary files, which are small; nulls stay null."""

    @F.pandas_udf("string")
    def unescaped(x: pd.Series) -> pd.Series:
        return x.map(lambda v: html.unescape(v) if isinstance(v, str) else None)

    return unescaped(c)


def verdict(a: Column, b: Column) -> Column:
    """OK or FAIL: whether two texts are equal; a null equals nothing."""
    return F.when(a == b, "OK").otherwise("FAIL")


def byte_and_char_length(c: Column) -> tuple[Column, Column]:
    return F.octet_length(c), F.char_length(c)
