"""A syllable tokenizer learned from the lexicon: hyphens of romanizations say how many syllables a word has, a tagger of boundaries learns where.

Words whose rule syllables are as many as their romanized parts give the first examples: each place between two character clusters, with the
characters around it, is a boundary or none. What is learned from them then finds the best places of every word, as many as the romanization asks for, and is learned
anew. The weight of a feature is its smoothed log odds, counted by aggregates; a place scores the mean of its
features' weights and is a boundary where that is positive. Clusters are never cut. Weights are a table, joined by feature.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.syllables import extract_syllables
from .lattice import CLUSTER
from .segment import keyed
from .tables import materialize

#: Examples that the prior counts for in each feature.
STRENGTH = 1.0
#: Rounds that learn from what the weights before say.
ROUNDS = 4
#: The feature of no place: its weight is the prior.
PRIOR = ""


def _starts(pieces: Column) -> Column:
    """Where each piece but the first begins, in characters from 1."""
    sums = F.aggregate(pieces, F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, x: F.struct((s["at"] + F.char_length(x)).alias("at"), F.concat(s["out"], F.array(s["at"] + F.char_length(x))).alias("out")), lambda s: s["out"])
    return F.slice(sums, 1, F.greatest(F.size(sums) - 1, F.lit(0)))


def places(words: DataFrame) -> DataFrame:
    """Each row of ``words`` (word, ...) with ``pos``, where a cluster but the first begins, and ``features``, what stands around it."""
    rows = words.withColumn("pos", F.explode(_starts(F.regexp_extract_all(F.col("word"), F.lit(f"({CLUSTER})"), F.lit(1)))))
    at = lambda d: F.coalesce(F.nullif(F.when(F.col("pos") + d > 0, F.substr("word", F.col("pos") + d, F.lit(1))), F.lit("")), F.lit("_"))
    sides = [F.concat(F.lit(f"{side}{n}"), *[at(d) for d in reach]) for n in (2, 3, 4) for side, reach in (("l", range(-n, 0)), ("r", range(n)))]
    return rows.withColumn("features", F.array(*sides))


def examples(entries: DataFrame) -> DataFrame:
    """(word, parts, pos, features, boundary) of each place of the entries (thai, translit): how many parts the romanization has between hyphens (the most of several), and
    what the rules say where they find as many syllables, else null."""
    rows = entries.filter("thai is not null and thai <> '' and translit is not null").groupBy(F.col("thai").alias("word")).agg(F.max(F.size(F.split("translit", "-"))).alias("parts"))
    rows = rows.withColumn("syllables", extract_syllables(F.col("word")))
    marked = places(rows.select("word", "parts", F.when(F.size("syllables") == F.col("parts"), _starts(F.col("syllables"))).alias("bounds")))
    return marked.select("word", "parts", "pos", "features", F.array_contains("bounds", F.col("pos")).alias("boundary"))


def _weights(rows: DataFrame) -> DataFrame:
    """(feature, weight) of the rows (features, boundary) that are not null; without examples of both kinds the prior counts one of each more."""
    n, b = rows.agg(F.count("boundary"), F.count_if("boundary")).first()
    share = (b + 1) / (n + 2) if b in (0, n) else b / n
    seen = rows.filter("boundary is not null").select(F.explode("features").alias("feature"), "boundary").groupBy("feature").agg(F.count("*").alias("n"), F.count_if("boundary").alias("b"))
    weight = F.log((F.col("b") + share * STRENGTH) / (F.col("n") - F.col("b") + (1 - share) * STRENGTH))
    prior = rows.sparkSession.createDataFrame([(PRIOR, math.log(share / (1 - share)))], "feature string, weight double")
    return materialize(seen.select("feature", weight.alias("weight")).unionAll(prior))


def fit(entries: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(feature, weight) after so many rounds: smoothed log odds of a boundary; the feature PRIOR has those of all places.

    The first round learns from the words that the rules cut in as many syllables as the romanization has parts. Each further one takes
    of every word the best places by the weights before, one less than there are parts, and learns from these.
    """
    rows = materialize(examples(entries))
    weights = _weights(rows)
    for _ in range(rounds):
        scored = scores(rows.withColumn("key", F.col("word")), weights)
        best = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), "pos")) < F.col("parts")
        again = rows.drop("boundary").join(scored.withColumnRenamed("key", "word"), ["word", "pos"]).withColumn("boundary", best)
        weights = _weights(materialize(again.select("features", "boundary")))
    return weights


def scores(at: DataFrame, weights: DataFrame) -> DataFrame:
    """(key, pos, score) of each place (key, pos, features); features that were never seen have the prior's weight."""
    prior = weights.filter(F.col("feature") == PRIOR).first().weight
    each = at.select("key", "pos", F.explode("features").alias("f")).join(weights, F.col("f") == F.col("feature"), "left")
    return each.groupBy("key", "pos").agg(F.round(F.avg(F.coalesce("weight", F.lit(prior))), 9).alias("score"))


def syllables(words: DataFrame, weights: DataFrame) -> DataFrame:
    """(word, syllables) of each distinct word: an array for ``syllabic.by_syllables`` or ``lines.by_given_syllables``. Null and empty words are dropped."""
    words = keyed(words)
    bounds = scores(places(words), weights).filter("score > 0").groupBy("key").agg(F.array_sort(F.collect_list("pos")).alias("b"))
    cut = "transform(concat(array(1), b), (p, i) -> substring(word, p, coalesce(get(b, i), char_length(word) + 1) - p))"
    return words.join(bounds, "key", "left").withColumn("b", F.coalesce("b", F.array().cast("array<int>"))).select("word", F.expr(cut).alias("syllables"))
