"""Accuracy of romanized lines and words, failure classes, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.textnorm import contains_digit, fold_separators, has_precomposed, normalize, split_words, strip_bom, strip_markers, strip_tones, trim_space, verdict


def greedy_matches(expected: Column, got: Column) -> Column:
    """Expected words found in order: each is sought from behind the last hit on; one that is missing uses up the line.

    One pass over what is got, with a place in what is expected: how far it comes is the number of hits. A null line has none.
    """
    hits = F.aggregate(got, F.lit(0), lambda at, w: F.when(F.get(expected, at) == w, at + 1).otherwise(at))
    return F.when(expected.isNotNull(), F.coalesce(hits, F.lit(0)))


def skip_reason(text: Column, expected: Column, by_rules: bool = False) -> Column:
    """Why a line does not count, null for one that does: empty, a subtitle header, digits, precomposed accents in the golden text, a repetition mark.

    White space of any kind around the input is not looked at. ``by_rules``: the shorter chain of the run without a dictionary, which keeps lines with
    such accents and marks; behind the white space a mark of byte order goes from the input.
    """
    inp = strip_bom(trim_space(text)) if by_rules else trim_space(text)
    why = F.when(F.coalesce(inp, F.lit("")) == "", "empty").when(F.coalesce(normalize(expected), F.lit("")) == "", "empty").when(is_header(inp), "header").when(contains_digit(inp), "digit")
    return why if by_rules else why.when(has_precomposed(expected), "precomposed").when(inp.contains("ๆ"), "repeat")


def usable(text: Column, expected: Column, by_rules: bool = False) -> Column:
    return skip_reason(text, expected, by_rules).isNull()


def is_header(inp: Column) -> Column:
    """The line a subtitle editor writes first."""
    return inp.startswith("#") & inp.contains("Aegisub")


def pair_lines(inputs: DataFrame, golden: DataFrame) -> DataFrame:
    """Lines of both sides by name and number, of names whose sides have equally many lines."""
    count = lambda d, n: d.groupBy("name").agg(F.count("*").alias(n))
    same = count(inputs, "a").join(count(golden, "b"), "name").filter("a = b").select("name")
    return inputs.join(golden, ["name", "line_no"]).join(same, "name", "left_semi")


def tone_blind_equal(a: Column, b: Column) -> Column:
    fold = lambda c: strip_tones(fold_separators(c))
    return (fold_separators(a) == fold_separators(b)) | (fold(a) == fold(b))


def accuracy(passed: Column) -> list[Column]:
    total, good = F.count("*"), F.count_if(passed)
    return [total.alias("total"), good.alias("passed"), (total - good).alias("failed"), F.round(good * 100.0 / total, 6).alias("accuracy")]


def dictionary_results(dictionary: DataFrame, romanized: DataFrame) -> DataFrame:
    """(thai, expected, got, passed, verdict) of each entry without a space; ``verdict`` says whether both are equal as written; ``romanized`` holds (word, roman) of the keys without markers."""
    d = dictionary.filter(~F.col("thai").contains(" ")).select("thai", F.col("translit").alias("expected"), strip_markers(F.col("thai")).alias("_w"))
    rows = d.join(romanized.select(F.col("word").alias("_w"), F.col("roman").alias("got")), "_w", "left")
    return rows.select("thai", "expected", "got", F.coalesce(tone_blind_equal(strip_markers(F.col("expected")), F.col("got")), F.lit(False)).alias("passed"), verdict(F.col("expected"), F.col("got")).alias("verdict"))


def dictionary_report(results: DataFrame, n: int = 50) -> DataFrame:
    """One row: counts and accuracy of all results, and classes of the first ``n`` failures in order of the word."""
    counts, classes = results.agg(*accuracy(F.col("passed"))), failure_classes(first_failures(results.filter("not passed"), n, "thai"))
    every = counts.unionByName(classes, allowMissingColumns=True)  # two rows, each null where the other counts
    names = [*counts.columns, *classes.columns]
    return every.agg(*[F.max(c).alias(c) for c in names])


def corpus_results(pairs: DataFrame, by_rules: bool = False) -> DataFrame:
    """(name, line_no, input, expected, got, correct, matched, words) of each usable line of (name, line_no, input, expected, got).

    ``got`` null: the line could not be romanized, a fallback; it counts as a line but its words do not.
    ``by_rules``: the run without a dictionary. A mark of byte order goes from the input first, the chain of
    filters is shorter, and lines that could not be romanized do not count at all.
    """
    rows = pairs.filter(usable(F.col("input"), F.col("expected"), by_rules))
    if by_rules:
        rows = rows.filter("got is not null")
    rows = rows.withColumn("e", normalize(F.col("expected"))).withColumn("g", normalize(F.col("got")))
    rows = rows.withColumn("ew", split_words(F.col("e"))).withColumn("gw", split_words(F.col("g")))
    return rows.select("name", "line_no", "input", "expected", "got", F.coalesce(F.col("e") == F.col("g"), F.lit(False)).alias("correct"), greedy_matches(F.col("ew"), F.col("gw")).alias("matched"), F.when(F.col("got").isNotNull(), F.size("ew")).alias("words"))


def corpus_report(results: DataFrame) -> DataFrame:
    """One row: lines, correct lines, fallbacks, words, matched words and both accuracies (null without lines or words)."""
    lines, good = F.count("*"), F.count_if("correct")
    words, hit = F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("matched"), F.lit(0))
    share = lambda a, b: F.round(a * 100.0 / F.nullif(b, F.lit(0)), 6)
    return results.agg(lines.alias("lines"), good.alias("lines_correct"), F.count_if(F.col("got").isNull()).alias("fallbacks"), words.alias("words"), hit.alias("matched"), share(good, lines).alias("line_accuracy"), share(hit, words).alias("word_accuracy"))


def first_failures(failures: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` failures; with an explicit order the plan is a bounded top-k."""
    return failures.orderBy(*order).limit(n)


def failure_classes(failures: DataFrame) -> DataFrame:
    """Of the failures given: byte lengths differ, equal but for tones, the rest."""
    length = F.octet_length("expected") != F.octet_length("got")
    tone = ~length & (strip_tones(F.col("expected")) == strip_tones(F.col("got")))
    return failures.agg(F.count_if(length).alias("length_errors"), F.count_if(tone).alias("tone_errors"), F.count_if(~length & ~tone).alias("other_errors"))


def repeat_mark(tokens: DataFrame, group: str, pos: str, roman: str) -> DataFrame:
    """A repetition mark takes the last non-empty roman before it in its group."""
    before = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    own = F.when((F.col("token") != "ๆ") & (F.col(roman) != ""), F.col(roman))
    return tokens.withColumn(roman, F.when(F.col("token") == "ๆ", F.coalesce(F.last(own, True).over(before), F.lit(""))).otherwise(F.col(roman)))


def ordered_concat(df: DataFrame, keys: list[str], pos: str, value: str, sep: str) -> DataFrame:
    """Values of each group joined in order of position."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda x: x[value]), sep).alias("joined"))
