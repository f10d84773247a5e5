"""Longest-match segmentation and word transliteration over distinct words.

The longest entry at each place of a word comes from an automaton of the lexicon (``trie``) while that is small enough to be sent to
every task. Beyond, each place gives the characters that follow it, as many as the window holds; their beginnings are
equality-joined with the lexicon and the longest hit of each place is kept by partial aggregation. The walk along a
word is a fold over its places. What is exploded and shuffled carries a short key instead of the word, so the
work on a run of any length is linear in it. Only distinct words are worked on; callers join back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.orthography import CONSONANT
from ..functions.syllables import FULL, build, from_parts, parse, pattern_parts
from .tables import materialize
from .trie import trie_of, with_hits

WINDOW = 8
#: Characters that the rules are shown first; a syllable that might reach beyond is sought again in the whole rest.
SIGHT = 32
#: Characters of a block of a long word.
BLOCK = 256


def key_of(word):
    """The word itself, or a digest where it is longer than that."""
    return F.when(F.char_length(word) <= 64, word).otherwise(F.concat(F.lit("#"), F.sha2(word, 256)))


def views(word: str, n: int):
    """Of each place of the word the (at most) ``n`` characters from there on.

    A substring counts characters from the beginning, so long words are cut in blocks first.
    """
    blocks = f"transform(sequence(1, char_length({word}), {BLOCK}), i -> substring({word}, i, {BLOCK + n - 1}))"
    own = f"least({BLOCK}, char_length({word}) - {BLOCK} * k)"
    return F.expr(f"flatten(transform({blocks}, (b, k) -> transform(sequence(1, {own}), j -> substring(b, j, {n}))))")


def matches(words: DataFrame, lexicon: DataFrame, window: int = WINDOW, every: bool = False) -> DataFrame:
    """(key, pos, hit): for each place of each word the longest entry there (len, translit, priority), null if there is none.

    Of equal lengths the lower priority. ``words``: (word, key), no empty words. A hit may not leave exactly one consonant behind. With ``every``, (key, pos, hits): all
    entries that begin there, one of each length, whatever they leave behind.
    """
    # a column of its own, so that it is worked out before the word is left behind
    orphan = F.substring("word", -1, 1).rlike(f"^[{CONSONANT}]$") & F.lit(not every)
    words = words.withColumn("last", F.when(orphan, F.char_length("word") - 1).otherwise(-1))
    pos = words.select("key", "last", F.posexplode_outer(views("word", window)).alias("pos", "view"))
    sub = pos.select("key", (F.col("pos") + 1).alias("pos"), "view", "last", F.explode_outer(F.sequence(F.lit(1), F.char_length("view"))).alias("len"))
    sub = sub.select("key", "pos", "len", F.when(F.col("pos") + F.col("len") - 1 != F.col("last"), F.expr("substring(view, 1, len)")).alias("s"))
    lex = lexicon.select(F.col("thai").alias("s"), "translit", "priority")
    found = F.when(F.col("priority").isNotNull(), F.struct("len", (-F.col("priority")).alias("order"), "translit", "priority"))
    hit = sub.join(lex, "s", "left").groupBy("key", "pos")
    if not every:
        return hit.agg(F.max(found).alias("hit"))
    best = F.array_sort(F.collect_set(found))  # by length; of equal lengths the last is the one of lower priority
    return hit.agg(best.alias("b")).select("key", "pos", F.expr("filter(b, (x, i) -> i = size(b) - 1 OR x.len <> get(b, i + 1).len)").alias("hits"))


def keyed(words: DataFrame) -> DataFrame:
    """(word, key) of each distinct word that is neither null nor empty."""
    return words.select("word").filter("word is not null and word <> ''").distinct().withColumn("key", key_of(F.col("word")))


def cut(words: DataFrame, lexicon: DataFrame, window: int = WINDOW, whole: bool = False) -> DataFrame:
    """(word, key, pieces) of each of the ``keyed`` words: its pieces in order (piece, translit, tier)."""
    trie = trie_of(lexicon, window)
    if trie:
        at = with_hits(words, trie)
    else:
        hits = matches(words, lexicon, window).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "hit"))).alias("hits"))  # a row for each place
        at = words.join(hits, "key")
    at = at.withColumn("views", views("word", max(SIGHT, window)))
    walked = at.withColumn("places", F.expr(_places(max(SIGHT, window)))).withColumn("pieces", F.expr(WALK))
    if whole:
        entries = lexicon.groupBy(F.col("thai").alias("entry")).agg(F.max(F.struct((-F.col("priority")).alias("o"), "translit", "priority")).alias("x"))
        one = f"array(named_struct('piece', word, 'translit', x.translit, 'tier', {TIER.format('x')}))"
        walked = walked.join(entries, F.col("word") == F.col("entry"), "left").withColumn("pieces", F.expr(f"IF(x IS NULL, pieces, {one})"))
    return walked.select("word", "key", "pieces")


def segment(words: DataFrame, lexicon: DataFrame, window: int = WINDOW, whole: bool = False) -> DataFrame:
    """(word, idx, piece, translit, tier) of each distinct word: lexicon pieces, and rule syllables where no entry fits.

    ``whole``: a word that is itself in the lexicon is one piece, whatever its length. Null and empty words have no pieces.
    """
    # the outer form: for an inner one the optimizer infers a filter on the array and evaluates the walk again
    return cut(keyed(words), lexicon, window, whole).select("word", F.posexplode_outer("pieces").alias("idx", "p")).select("word", "idx", "p.*")


TIER = "IF({}.priority = 0, 'special', 'syllable')"


def _places(n: int) -> str:
    """SQL for the piece that begins at each place: the entry there, else the syllable by the rules, which first see ``n`` characters."""
    syllable = f"regexp_extract({{}}, '^(?:{FULL})', 0)"
    rule = f"element_at(transform(array({syllable.format('v')}), r -> IF(char_length(r) < {n - 1}, r, {syllable.format('substring(word, h.pos)')})), 1)"
    return (
        f"zip_with(hits, views, (h, v) -> IF(h.hit IS NULL, named_struct('pos', h.pos, 'piece', {rule}, 'translit', CAST(NULL AS STRING), 'tier', 'rule'),"
        f" named_struct('pos', h.pos, 'piece', substring(v, 1, h.hit.len), 'translit', h.hit.translit, 'tier', {TIER.format('h.hit')})))"
    )


#: SQL for the pieces along the ``places``: the next is the one behind the piece taken. An accumulator is copied in every
#: step, so what it gathers is one character for each place, block by block: whether a piece begins there.
_BLOCKS = f"transform(sequence(1, size(places), {BLOCK}), a -> named_struct('at', a, 'sizes', transform(slice(places, a, {BLOCK}), p -> char_length(p.piece))))"
_IN_BLOCK = (
    "aggregate(b.sizes, named_struct('next', s.next, 'at', b.at, 'out', ''), (t, n) -> named_struct("
    "'next', IF(t.at = t.next, t.at + n, t.next), 'at', t.at + 1, 'out', concat(t.out, IF(t.at = t.next, '1', '0'))))"
)
_FLAGS = f"aggregate({_BLOCKS}, named_struct('next', 1, 'out', ''), (s, b) -> element_at(transform(array({_IN_BLOCK}), t -> named_struct('next', t.next, 'out', concat(s.out, t.out))), 1), s -> split(s.out, ''))"
WALK = f"filter(zip_with(places, {_FLAGS}, (p, f) -> IF(f = '1', named_struct('piece', p.piece, 'translit', p.translit, 'tier', p.tier), NULL)), x -> x IS NOT NULL)"


def _romanized(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(key, idx, piece, tier, roman) of the ``keyed`` words. Rules run once for each distinct piece."""
    pieces = cut(words, lexicon, whole=True).select("key", F.posexplode_outer("pieces").alias("idx", "p")).select("key", "idx", "p.*")
    pieces = materialize(pieces)  # read twice below
    todo = pieces.filter("tier = 'rule'").select("piece").distinct()
    s = F.col("piece")
    # each step is a column of its own, so that no expression is copied into those that use it
    ruled = todo.withColumn("m", pattern_parts(s)).withColumns({k: c for k, c in parse(s).items()})
    parts = {k: F.col(k) for k in ("lead", "onset", "vowel", "tone", "final")}
    ruled = ruled.select(s.alias("p"), F.when(F.col("m").isNull(), "parse").otherwise("pattern").alias("t"), F.coalesce(from_parts(F.col("m")), build(parts)).alias("r"))
    out = pieces.join(ruled, (F.col("tier") == "rule") & (s == F.col("p")), "left")
    return out.select("key", "idx", "piece", F.coalesce("t", "tier").alias("tier"), F.coalesce("translit", "r").alias("roman"))


def transliterate(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, roman) of each distinct word: segments by lexicon, the rest by vowel patterns, else by parts."""
    words = keyed(words)
    roman = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "roman"))), lambda x: x["roman"]), "")
    return words.join(_romanized(words, lexicon).groupBy("key").agg(roman.alias("roman")), "key").select("word", "roman")


def explain(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, idx, piece, tier, roman): where each piece of a word came from.

    A word that is itself an entry is one piece, however long it is; only other words are cut within the window.
    """
    words = keyed(words)
    return words.join(_romanized(words, lexicon), "key").select("word", "idx", "piece", "tier", "roman")
