"""Words by their syllables: given ones where they fit the word, else those of the boundary rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.components import components, romanize
from ..functions.syllables import extract_syllables
from .lexicon import layered, lookup


def assign(word: Column, syllables: Column) -> Column:
    """The syllables that spell the word from its start on; one that does not fit is passed over.

    Where none fits or the word is not covered, the boundary rules cut it instead; so they do for null syllables.
    """
    n = F.char_length(word)
    none = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<string>)").alias("out"))

    def step(s, x):
        fits = (s["at"] < n) & (F.substr(word, s["at"] + 1, F.char_length(x)) == x)
        return F.when(fits, F.struct((s["at"] + F.char_length(x)).alias("at"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s)

    own = F.aggregate(syllables, none, step, lambda s: F.when((s["at"] >= n) & (F.size(s["out"]) > 0), s["out"]))
    return F.coalesce(own, extract_syllables(word))


def by_syllables(words: DataFrame, dictionary: DataFrame, syllable_lexicon: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(word, syllables, roman) of each distinct word with its given syllables (column ``syllables``, may be null).

    The dictionary decides first; of other words each syllable goes by the syllable lexicon, then the
    exceptions, then the component rules. Rules run once for each distinct syllable. An empty word is
    romanized as empty, a null word is dropped.
    """
    words = words.select("word", "syllables").filter("word is not null").distinct()
    known = lookup(words, dictionary)
    todo = known.filter("translit is null").select("word", "syllables", F.posexplode_outer(assign(F.col("word"), F.col("syllables"))).alias("pos", "piece"))
    found = layered(todo.select("piece").filter("piece is not null").distinct(), syllable_lexicon, exceptions, word_col="piece")
    # the components are a column of their own, so that they are not copied into what uses them
    roman = found.withColumn("c", components(F.col("piece"))).select(F.col("piece").alias("p"), F.coalesce("translit", romanize(F.col("c"))).alias("roman"))
    ruled = todo.join(roman, F.col("piece") == F.col("p"), "left").groupBy("word", "syllables")
    ruled = ruled.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "roman"))), lambda x: x["roman"]), "").alias("roman"))
    return known.filter("translit is not null").select("word", "syllables", F.col("translit").alias("roman")).unionAll(ruled)
