"""The public text functions as SQL functions of a session: inlined where they are called, so the optimizer sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import orthography as O
from . import syllables as S
from . import textnorm as X


def _quoted(s: str) -> str:
    return "r\"" + s + "\""


def _marked() -> tuple[str, str]:
    return "".join(x + x.upper() for v in O.PRECOMPOSED.values() for x in v), "".join((b + b.upper()) * 4 for b in O.PRECOMPOSED)


#: name, type of the result, SQL over the parameter ``s``.
FUNCTIONS = [
    ("contains_thai", "BOOLEAN", f"s rlike {_quoted('[\\x{0E00}-\\x{0E7F}]')}"),
    ("contains_digit", "BOOLEAN", "s rlike '[0-9]'"),
    ("has_precomposed", "BOOLEAN", "s rlike '[èéêìíîòóôùúû]'"),
    ("strip_markers", "STRING", "regexp_replace(s, '<[^>]+>', '')"),
    ("fold_separators", "STRING", "translate(s, '-~', '')"),
    ("strip_tones", "STRING", f"regexp_replace(translate(s, '{_marked()[0]}', '{_marked()[1]}'), {_quoted('\\p{Mn}')}, '')"),
    ("compose", "STRING", f"IF(s rlike {_quoted('[^\\x{0}-\\x{2FF}]')}, reflect('com.ibm.icu.text.Normalizer', 'compose', s, false), s)"),
    ("collapse_space", "STRING", f"trim(regexp_replace(s, {_quoted(X.WHITE)}, ' '))"),
    ("remove_silent_consonants", "STRING", "regexp_replace(s, '(?s:.)์|[ก-ฮ][ะัาิีึืุูเแโใไๅำ]์', '')"),
    ("extract_syllables", "ARRAY<STRING>", f"regexp_extract_all(s, {_quoted(f'({S.PLAIN})')}, 1)"),
    ("first_number", "INT", f"coalesce(try_cast(regexp_extract(s, {_quoted('\\d+')}, 0) AS INT), 0)"),
]


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Registers the functions for the session; returns their names. Functions of these names are replaced."""
    for name, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(s STRING) RETURNS {kind} RETURN {body}")
    return [prefix + name for name, *_ in FUNCTIONS]


def register_lookup(spark: SparkSession, name: str, lexicon_view: str) -> None:
    """Registers ``name(word)``: the romanization that a view (thai, translit; each word once) has for a word, null if it lacks it."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(word STRING) RETURNS STRING RETURN (SELECT max(translit) FROM {lexicon_view} WHERE thai = word)")
