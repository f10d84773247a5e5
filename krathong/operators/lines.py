"""Whole lines and words romanized: dictionary first, then syllables and rules.

All work is done on distinct lines, chunks and tokens, which are joined back by their text, so repeated lines
cost one join row each. Words are told apart by longest match against the dictionary, or by another
cutter that the caller gives; what lies between two dictionary words is one unknown word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.textnorm import WHITE, contains_thai, nfc, remove_silent, strip_bom, trim_space
from .lexicon import layered, lookup
from .segment import cut, key_of, keyed, transliterate
from .syllabic import by_syllables
from .tables import materialize


#: A tokenizer: (words with keys, entries with priorities, window) to (word, key, pieces). ``segment.cut`` and ``lattice.cut_lattice`` are two.
Cutter = Callable[[DataFrame, DataFrame, int], DataFrame]


def _joined(pairs: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """(key, parts): the non-empty values of each key in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda x: x[value])
    return pairs.groupBy(key).agg(F.filter(parts, lambda x: x.isNotNull() & (x != "")).alias("parts"))


def real_tokens(tokens: Column) -> Column:
    """Without those that hold nothing but white space."""
    return F.filter(tokens, lambda t: trim_space(t) != "")


#: Parts tokens while they are one string; a run without spaces holds none.
_SEP = "\n"


def token_arrays(words: DataFrame, dictionary: DataFrame, window: int | None = None, cutter: Cutter = cut) -> DataFrame:
    """(word, key, tokens) of each of the ``keyed`` words: runs without spaces, cut in words; see ``tokens``."""
    if window is None:
        window = dictionary.select(F.max(F.char_length("thai"))).first()[0] or 1
    entries = dictionary.select("thai", "translit", F.lit(1).alias("priority"))
    known = lookup(words, dictionary).withColumn("whole", F.col("translit").isNotNull() | ~contains_thai(F.col("word"))).drop("translit")
    # pieces by the rules that follow one another are one token
    joined = (
        f"element_at(transform(array(pieces), ps -> array_join(transform(ps, (x, i) -> concat(IF(i = 0 OR x.tier <> 'rule' OR get(ps, i - 1).tier <> 'rule', '{_SEP}', ''), x.piece)), '')), 1)"
    )
    run = cutter(known.filter("not whole").select("word", "key"), entries, window).select("word", "key", F.split(F.substring(F.expr(joined), 2, 2**31 - 1), _SEP, -1).alias("tokens"))
    return known.filter("whole").select("word", "key", F.array("word").alias("tokens")).unionAll(run)


def tokens(words: DataFrame, dictionary: DataFrame, window: int | None = None, cutter: Cutter = cut) -> DataFrame:
    """(word, pos, token) of each distinct ``word`` (a run without spaces).

    Words of the dictionary and foreign runs are one token. Null and empty words have none. ``window``: the
    longest dictionary word that is told apart inside a run; if not given, the longest that there is. ``cutter``: how
    runs are cut, longest match if not given.
    """
    return token_arrays(keyed(words), dictionary, window, cutter).select("word", F.posexplode_outer("tokens").alias("pos", "token"))


def romanize_words(words: DataFrame, dictionary: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, roman, tier) of each distinct word: the dictionary decides (composed), else the full rules. Nulls are dropped; an empty word is empty."""
    known = lookup(words.select("word").filter("word is not null").distinct(), dictionary)
    ruled = transliterate(known.filter("translit is null"), lexicon).select("word", "roman", F.lit("rules").alias("tier"))
    empty = known.filter("translit is null and word = ''").select("word", F.lit("").alias("roman"), F.lit("rules").alias("tier"))
    return known.filter("translit is not null").select("word", nfc(F.col("translit")).alias("roman"), F.lit("dictionary").alias("tier")).unionAll(ruled).unionAll(empty)


def _line_parts(texts: DataFrame, dictionary: DataFrame, roman, cutter: Cutter) -> DataFrame:
    """(text, parts) of distinct texts; ``roman`` gives (word, roman) of a table of words. Texts and chunks go by their keys."""
    texts = texts.select("text").withColumn("line", key_of(F.col("text")))
    chunks = materialize(texts.select("line", F.posexplode_outer(F.split(F.trim(F.regexp_replace("text", WHITE, " ")), " ")).alias("at", "word")).filter("word is not null"))
    by_key = chunks.withColumn("key", key_of(F.col("word"))).select("line", "at", "key")
    cut_ = materialize(token_arrays(keyed(chunks), dictionary, cutter=cutter).select("key", F.posexplode_outer("tokens").alias("pos", "token")))
    done = roman(cut_.select(F.col("token").alias("word")).distinct()).select(F.col("word").alias("token"), "roman")
    by_chunk = _joined(cut_.join(done, "token", "left").select("key", "pos", "roman"), "key", "pos", "roman").select("key", F.col("parts").alias("own"))
    back = by_key.join(by_chunk, "key").groupBy("line").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "own"))), lambda x: x["own"])).alias("parts"))
    return texts.join(back, "line").select("text", "parts")


def passes(text: Column) -> Column:
    """Lines that stay as they are: empty, a header, nothing Thai."""
    return (text == "") | text.startswith("#") | ~contains_thai(text)


def romanize_lines(lines: DataFrame, dictionary: DataFrame, lexicon: DataFrame, cutter: Cutter = cut) -> DataFrame:
    """(file, line_no, text, roman, fallback) of each row of ``lines`` (file, line_no, text).

    A mark of byte order goes from each file's first line. Empty lines, lines that begin with ``#`` and lines without Thai
    stay as they are, nulls stay null. Of others the words are romanized and joined by a space; where that leaves
    nothing, ``fallback`` is true and the line is romanized as one word. ``cutter``: how words are told apart, see ``Cutter``.
    """
    text = F.when(F.col("line_no") == 1, strip_bom(F.col("text"))).otherwise(F.col("text"))
    lines = lines.select("file", "line_no", text.alias("text"))
    todo = lines.filter(~passes(F.col("text"))).select("text").distinct()
    parts = materialize(_line_parts(todo, dictionary, lambda w: romanize_words(w, dictionary, lexicon), cutter)).withColumn("roman", F.array_join("parts", " "))
    whole = romanize_words(parts.filter("roman = ''").select(F.col("text").alias("word")), dictionary, lexicon).select(F.col("word").alias("w"), F.col("roman").alias("one"))
    done = parts.join(whole, F.col("text") == F.col("w"), "left").select(F.col("text").alias("t"), F.coalesce("one", F.when(F.col("roman") != "", F.col("roman")), F.lit("")).alias("r"), (F.col("roman") == "").alias("f"))
    return lines.join(done, F.col("text") == F.col("t"), "left").select("file", "line_no", "text", F.coalesce("r", "text").alias("roman"), F.coalesce("f", F.lit(False)).alias("fallback"))


def romanize_sentences(texts: DataFrame, dictionary: DataFrame, syllable_lexicon: DataFrame, exceptions: DataFrame, cutter: Cutter = cut) -> DataFrame:
    """(text, roman) of each distinct text: a dictionary entry as a whole, else word by word.

    Words are joined by a space if the text has one, else by a hyphen. Words that the dictionary lacks go by syllables.
    A null text is dropped; an empty one is empty.
    """
    known = lookup(texts.select("text").filter("text is not null").distinct(), dictionary, "text")
    of = lambda w: by_syllables(w.withColumn("syllables", F.lit(None).cast("array<string>")), dictionary, syllable_lexicon, exceptions)
    parts = _line_parts(known.filter("translit is null").select("text"), dictionary, of, cutter).select(F.col("text").alias("t"), "parts")
    joined = F.when(F.col("text").contains(" "), F.array_join("parts", " ")).otherwise(F.array_join("parts", "-"))
    return known.join(parts, F.col("text") == F.col("t"), "left").select("text", F.coalesce("translit", joined, F.lit("")).alias("roman"))


def by_given_syllables(words: DataFrame, syllable_lexicon: DataFrame, exceptions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, syllables, roman, fallback) of each distinct word with its syllables (may be null or empty).

    A syllable loses its silent signs, then goes by the syllable lexicon, the exceptions, the full rules; what is
    wholly silent or romanized as nothing leaves no part. A repetition mark takes the part before it, if any. Parts are
    joined by hyphens. Words without syllables go by the full rules as a whole: ``fallback``. Null words are dropped.
    """
    words = words.select("word", "syllables").filter("word is not null").distinct()
    bare = F.coalesce(F.size("syllables") < 1, F.lit(True))
    given = words.filter(~bare).select("word", "syllables", F.posexplode("syllables").alias("pos", "piece"))
    given = given.withColumn("clean", F.when(F.col("piece") == "ๆ", "ๆ").otherwise(remove_silent(F.col("piece"))))
    found = layered(given.select("clean").filter("clean not in ('', 'ๆ')").distinct(), syllable_lexicon, exceptions, word_col="clean")
    ruled = transliterate(found.filter("translit is null").select(F.col("clean").alias("word")).unionAll(words.filter(bare).select("word")), lexicon).select(F.col("word").alias("w"), F.col("roman").alias("r"))
    roman = found.join(ruled, F.col("clean") == F.col("w"), "left").select(F.col("clean").alias("c"), F.coalesce("translit", "r").alias("roman"))
    rows = given.join(roman, F.col("clean") == F.col("c"), "left").groupBy("word", "syllables").agg(F.array_sort(F.collect_list(F.struct("pos", "clean", "roman"))).alias("p"))
    walk = (
        "aggregate(p, CAST(array() AS array<string>), (s, x) -> CASE WHEN x.clean = 'ๆ' THEN IF(size(s) = 0, s, concat(s, array(try_element_at(s, -1))))"
        " WHEN coalesce(x.roman, '') = '' THEN s ELSE concat(s, array(x.roman)) END, s -> array_join(s, '-'))"
    )
    alone = words.filter(bare).join(ruled, F.col("word") == F.col("w"), "left").select("word", "syllables", F.coalesce("r", F.lit("")).alias("roman"), F.lit(True).alias("fallback"))
    return rows.select("word", "syllables", F.expr(walk).alias("roman"), F.lit(False).alias("fallback")).unionAll(alone)
