"""Words cut by the best path over a lattice: fewest unknown characters, then fewest pieces, then the longest piece first.

The nodes are the places between character clusters (a consonant with its leading vowel and its signs), which are never cut. An edge is a lexicon entry from one
node to another, or one cluster that no entry need cover. The best path is found from the end of a word by one fold over its places that keeps the costs of the
next places only, as many as the longest edge spans; the walk along the chosen pieces is that of longest match, and so is the form of the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import orthography as O
from .segment import TIER, WALK, WINDOW, matches, views
from .trie import trie_of, with_hits

_SIGNS = "".join(c for c in O.VOWEL + O.TONE + "็์ํ" if c not in O.LEADING)
#: One cluster; signs beyond the eighth, and all else, stand alone.
CLUSTER = f"[{O.LEADING}]?[{O.CONSONANT}][{_SIGNS}]{{0,8}}|(?s:.)"
#: Characters of the longest cluster.
LONGEST = 10

#: SQL: at each place the length of the cluster that begins there, 0 inside of one.
_CLUSTERS = f"flatten(transform(regexp_extract_all(word, r\"({CLUSTER})\", 1), c -> concat(array(char_length(c)), array_repeat(0, char_length(c) - 1))))"
#: SQL: the edges (length, unknown characters) from each place; an entry has to end where a cluster does.
_EDGES = (
    "zip_with(hits, clusters, (h, c) -> IF(c = 0, array(), concat(transform(filter(h.hits, x -> coalesce(get(clusters, h.pos + x.len - 1), 1) > 0), x -> named_struct('len', x.len, 'unknown', 0)),"
    " array(named_struct('len', c, 'unknown', c)))))"
)


def _path(width: int) -> str:
    """SQL for the piece that begins at each place on the best path from there: four characters, its length and whether an entry covers it."""
    best = "array_min(transform(e, x -> named_struct('u', get(s.costs, x.len - 1).u + x.unknown, 'w', get(s.costs, x.len - 1).w + 1, 'len', -x.len, 'known', x.unknown = 0)))"
    none = "named_struct('u', 0, 'w', 0, 'len', 0, 'known', false)"  # inside of a cluster, where no edge ends
    step = (
        f"element_at(transform(array(coalesce({best}, {none})), b -> named_struct('costs', slice(concat(array(named_struct('u', b.u, 'w', b.w)), s.costs), 1, {width}),"
        " 'out', concat(lpad(CAST(-b.len AS STRING), 3, '0'), IF(b.known, '=', '?'), s.out))), 1)"
    )
    return f"regexp_extract_all(aggregate(reverse(edges), named_struct('costs', array(named_struct('u', 0, 'w', 0)), 'out', ''), (s, e) -> {step}, s -> s.out), '(.{{4}})', 1)"


def every_hit(words: DataFrame, lexicon: DataFrame, window: int) -> DataFrame:
    """(word, key, hits): at each place (pos, hits) all entries that begin there, of the ``keyed`` words."""
    trie = trie_of(lexicon, window)
    if trie:
        return with_hits(words, trie, every=True)
    found = matches(words, lexicon, window, every=True).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "hits"))).alias("hits"))
    return words.join(found, "key").select("word", "key", "hits")


def cut_lattice(words: DataFrame, lexicon: DataFrame, window: int = WINDOW, whole: bool = False) -> DataFrame:
    """(word, key, pieces) of each of the ``keyed`` words, as ``segment.cut`` gives them; a cluster that no entry covers has the tier rule.

    A word that is itself an entry is one piece if no cluster is cut in it, since one piece is the fewest, within the window; with ``whole`` it is whatever its length.
    """
    width = max(window, LONGEST)
    at = every_hit(words, lexicon, window).withColumn("clusters", F.expr(_CLUSTERS)).withColumn("edges", F.expr(_EDGES)).withColumn("views", views("word", width))
    at = at.withColumn("path", F.expr(_path(width)))
    piece = (
        "zip_with(zip_with(hits, views, (h, v) -> named_struct('h', h, 'v', v)), path, (p, c) -> element_at(transform(array(IF(endswith(c, '='), get(filter(p.h.hits, x -> x.len = CAST(left(c, 3) AS INT)), 0), NULL)),"
        f" x -> named_struct('pos', p.h.pos, 'piece', substring(p.v, 1, greatest(CAST(left(c, 3) AS INT), 1)), 'translit', x.translit, 'tier', IF(x IS NULL, 'rule', {TIER.format('x')}))), 1))"
    )
    walked = at.withColumn("places", F.expr(piece)).withColumn("pieces", F.expr(WALK))
    if whole:
        entries = lexicon.groupBy(F.col("thai").alias("entry")).agg(F.max(F.struct((-F.col("priority")).alias("o"), "translit", "priority")).alias("x"))
        one = f"array(named_struct('piece', word, 'translit', x.translit, 'tier', {TIER.format('x')}))"
        walked = walked.join(entries, F.col("word") == F.col("entry"), "left").withColumn("pieces", F.expr(f"IF(x IS NULL, pieces, {one})"))
    return walked.select("word", "key", "pieces")
