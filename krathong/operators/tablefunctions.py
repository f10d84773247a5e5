"""The public API as SQL table functions of a session: transliteration, its trace, layered lookup and the dictionary test."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.textnorm import strip_markers
from . import evaluate, lexicon, lines, segment
from .tables import materialize


def _function(spark: SparkSession, name: str, parameter: str, df: DataFrame, where: str) -> None:
    """A table function of one parameter over a result, which is kept as a table and read through a view."""
    kept = materialize(df)
    kept.createOrReplaceTempView(f"_{name}")
    columns = ", ".join(f"{c} {t}" for c, t in kept.dtypes)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameter} STRING) RETURNS TABLE({columns}) RETURN SELECT {', '.join(kept.columns)} FROM _{name} WHERE {where}")


def register_tables(spark: SparkSession, words_view: str, dictionary_view: str, lexicon_view: str, prefix: str = "") -> list[str]:
    """Registers table functions over views of the session; returns their names. Functions of these names are replaced.

    ``words_view`` (word), ``dictionary_view`` (thai, translit; each word once) and ``lexicon_view`` (thai, translit, priority: 0 marks exceptions). Words are worked on
    at once, when this is called, and called for one at a time or laterally from a table:

    - ``transliterate(w)``: (word, roman) by the lexicon and the rules;
    - ``romanize(w)``: (word, roman, tier), the dictionary first;
    - ``explain(w)``: (word, idx, piece, tier, roman), where each piece came from;
    - ``lookup_special(w)`` and ``lookup_syllable(w)``: (word, translit) of the exceptions and of all others;
    - ``dictionary_test(m)``: counts and classes of failures of the mode ``rules`` or ``dictionary``.

    A word that the view lacks, and a null, gives no row. Of the tests each entry counts by its key without markers.
    """
    words, entries, lex = spark.table(words_view).select("word"), spark.table(dictionary_view), spark.table(lexicon_view)
    distinct = words.filter("word is not null").distinct()
    special, other = lex.filter("priority = 0"), lex.filter("priority <> 0")
    keys = entries.select(strip_markers(F.col("thai")).alias("word"))
    tests = None
    for mode, roman in (("rules", segment.transliterate(keys, lex)), ("dictionary", lines.romanize_words(keys, entries, lex))):
        one = evaluate.dictionary_report(evaluate.dictionary_results(entries, roman)).select(F.lit(mode).alias("mode"), "*")
        tests = one if tests is None else tests.unionAll(one)
    found = lambda d: lexicon.layered(distinct, d).filter("translit is not null").select("word", "translit")
    functions = {
        "transliterate": segment.transliterate(words, lex),
        "romanize": lines.romanize_words(words, entries, lex),
        "explain": segment.explain(words, lex),
        "lookup_special": found(special),
        "lookup_syllable": found(other),
    }
    for name, df in functions.items():
        _function(spark, prefix + name, "w", df, "word = w")
    _function(spark, prefix + "dictionary_test", "m", tests, "mode = m")
    return [prefix + n for n in (*functions, "dictionary_test")]
