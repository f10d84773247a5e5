"""Lexicon tables: dedupe, layered lookup, syllable derivation, out-of-vocabulary words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(rows: DataFrame) -> DataFrame:
    """One translit for each key: the last by file name, then line."""
    return rows.groupBy("thai").agg(F.max_by("translit", F.struct("file", "line_no")).alias("translit"))


def lookup(words: DataFrame, lexicon: DataFrame, word_col: str = "word") -> DataFrame:
    """Adds ``translit``, null where the lexicon lacks the word. The planner broadcasts the lexicon while it is small."""
    lex = lexicon.select(F.col("thai").alias("_k"), F.col("translit"))
    return words.join(lex, F.col(word_col) == F.col("_k"), "left").drop("_k")


def layered(words: DataFrame, *lexicons: DataFrame, word_col: str = "word") -> DataFrame:
    """The first lexicon that has the word decides: one join against their union, each key once by priority."""
    union = None
    for i, lex in enumerate(lexicons):
        part = lex.select("thai", "translit", F.lit(i).alias("_p"))
        union = part if union is None else union.unionAll(part)
    return lookup(words, union.groupBy("thai").agg(F.min_by("translit", F.struct("_p", "translit")).alias("translit")), word_col)


def first_wins(pairs: DataFrame) -> DataFrame:
    """One roman for each syllable: from the first word in byte order, then the first position."""
    return pairs.groupBy("syllable").agg(F.min_by("roman", F.struct("thai", "pos")).alias("roman"))


def zip_syllables(rows: DataFrame) -> DataFrame:
    """(thai, pos, syllable, roman) where a word has as many syllables as romanized parts."""
    same = rows.filter(F.size("syllables") == F.size("parts"))
    return same.select("thai", F.posexplode(F.arrays_zip("syllables", "parts")).alias("pos", "z")).select("thai", "pos", F.col("z.syllables").alias("syllable"), F.col("z.parts").alias("roman"))


def syllable_union(loaded: DataFrame, derived: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Loaded entries, then derived ones of 2 to 6 characters, then exceptions; earlier ones win."""
    derived = derived.filter(F.char_length("thai").between(2, 6))
    exceptions = exceptions.filter((F.char_length("thai") <= 5) & ~F.col("translit").contains("-"))
    parts = [d.select("thai", "translit", F.lit(i).alias("p")) for i, d in enumerate((loaded, derived, exceptions))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("thai").agg(F.min_by("translit", F.struct("p", "translit")).alias("translit"))


def admit_syllable(thai, translit):
    """Whether a word counts as a syllable: short and without separators."""
    n = F.char_length(thai)
    return ~thai.contains(" ") & (((n <= 5) & ~translit.contains("-")) | (n <= 3))


def out_of_vocabulary(words: DataFrame, lexicon: DataFrame, word_col: str = "word") -> DataFrame:
    """Distinct words of two characters or more that the lexicon lacks; nothing wholly silent, no repetition mark."""
    from ..functions.textnorm import contains_thai, remove_silent

    w = F.col(word_col)
    kept = words.filter(contains_thai(w) & (F.char_length(w) >= 2) & (F.char_length(remove_silent(w)) > 0) & ~w.contains("ๆ"))
    return kept.select(word_col).distinct().join(lexicon.select(F.col("thai").alias(word_col)), word_col, "left_anti")
