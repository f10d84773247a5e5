"""The registered queries of the romanization engine and an independent SQL oracle for each."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import components as P
from ..functions import orthography as O
from ..functions import syllables as S
from ..functions import textnorm as X
from ..operators import evaluate as E
from ..operators import lattice as T
from ..operators import lexicon as K
from ..operators import lines as N
from ..operators import segment as G
from ..operators import syllabic as Y
from ..operators import tagger as L
from ..operators.tables import materialize, new_path
from ..sources import vocabulary as R
from . import fixtures as D
from . import oracles as Q

_QUERIES: dict = {}
_ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_ORACLES)


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _v(spark, sql):
    return spark.sql(f"SELECT * FROM {sql}")


def _orders(spark, d, sql):
    """Rows of a query over the table of orders; no view of the session is touched."""
    return spark.sql(re.sub(r"\b(FROM|JOIN) orders\b", r"\1 {orders}", sql), orders=_t(spark, d, "orders"))


def _lex(spark):
    return _v(spark, D.LEX_SQL)


def _halves(spark, d):
    """(p_partkey, p_size, a, b, word): Thai words of both halves of each part name, and both joined."""
    en = _v(spark, D.EN_SQL)
    p = _t(spark, d, "part").select("p_partkey", "p_size", F.split("p_name", " ").alias("h"))
    p = p.join(F.broadcast(en.select(F.col("en").alias("e1"), F.col("thai").alias("a"))), F.col("h")[0] == F.col("e1"))  # sixteen rows, fixed
    p = p.join(F.broadcast(en.select(F.col("en").alias("e2"), F.col("thai").alias("b"))), F.col("h")[1] == F.col("e2"))
    return p.select("p_partkey", "p_size", "a", "b", F.concat("b", "a").alias("word"))


_PARTS = f"""parts AS (SELECT p_partkey, p_size, a.thai AS a, b.thai AS b, b.thai || a.thai AS word FROM part
  JOIN (SELECT * FROM {D.EN_SQL}) a ON a.en = split_part(p_name, ' ', 1) JOIN (SELECT * FROM {D.EN_SQL}) b ON b.en = split_part(p_name, ' ', 2))"""
_LEX = f"lex AS (SELECT * FROM {D.LEX_SQL}), dict AS (SELECT thai, arg_max(translit, file || lpad(CAST(line_no AS VARCHAR), 9, '0')) AS translit FROM lex WHERE priority = 1 GROUP BY thai)"


def _dict(spark):
    return K.last_wins(_lex(spark).filter("priority = 1"))


# ---- lexicon -------------------------------------------------------------------------------------


@query(f"WITH {_PARTS}, {_LEX} SELECT p_partkey, a AS word, translit FROM parts LEFT JOIN dict ON thai = a")
def lexicon_lookup(spark, d):
    return K.lookup(_halves(spark, d).select("p_partkey", F.col("a").alias("word")), _dict(spark))


@query(f"WITH {_PARTS}, {_LEX} SELECT p_partkey, b AS word, coalesce((SELECT max(translit) FROM lex WHERE priority = 0 AND thai = b), translit) AS translit FROM parts LEFT JOIN dict ON thai = b")
def layered_lookup(spark, d):
    return K.layered(_halves(spark, d).select("p_partkey", F.col("b").alias("word")), _lex(spark).filter("priority = 0"), _dict(spark))


_ROWS = "SELECT concat('มา', CAST(o_custkey % 500 AS STRING)) AS thai, concat('r', CAST(o_orderkey AS STRING)) AS translit, concat('f', CAST(o_orderkey % 7 AS STRING), '.txt') AS file, o_orderkey AS line_no FROM orders"


@query(f"SELECT thai, translit FROM ({_ROWS}) QUALIFY row_number() OVER (PARTITION BY thai ORDER BY file DESC, line_no DESC) = 1")
def lexicon_dedupe_last_wins(spark, d):
    return K.last_wins(_orders(spark, d, _ROWS))


@query(
    """WITH o AS (SELECT o_orderkey % 97 AS k, CAST(o_orderkey AS VARCHAR) AS w FROM orders),
s AS (SELECT w AS thai, [CAST(k % 5 AS VARCHAR), CAST(k % 7 AS VARCHAR)] AS syl, CASE WHEN k % 4 = 0 THEN [w] ELSE [w || 'a', w || 'b'] END AS parts FROM o),
z AS (SELECT thai, unnest([0, 1]) AS pos, unnest(syl) AS syllable, unnest(parts) AS roman FROM s WHERE len(parts) = 2)
SELECT syllable, arg_min(roman, thai || chr(1) || CAST(pos AS VARCHAR)) AS roman FROM z GROUP BY syllable"""
)
def syllable_first_wins(spark, d):
    o = _t(spark, d, "orders").select((F.col("o_orderkey") % 97).alias("k"), F.col("o_orderkey").cast("string").alias("w"))
    rows = o.select(F.col("w").alias("thai"), F.array((F.col("k") % 5).cast("string"), (F.col("k") % 7).cast("string")).alias("syllables"), F.when(F.col("k") % 4 == 0, F.array("w")).otherwise(F.array(F.concat("w", F.lit("a")), F.concat("w", F.lit("b")))).alias("parts"))
    return K.first_wins(K.zip_syllables(rows))


@query(
    f"""WITH {_PARTS}, {_LEX}, u AS (SELECT thai, translit, 0 AS p FROM dict UNION ALL SELECT DISTINCT b, 'derived', 1 FROM parts WHERE length(b) BETWEEN 2 AND 6
  UNION ALL SELECT thai, translit, 2 FROM lex WHERE priority = 0 AND length(thai) <= 5 AND NOT contains(translit, '-'))
SELECT thai, arg_min(translit, CAST(p AS VARCHAR) || translit) AS translit FROM u GROUP BY thai"""
)
def syllable_union(spark, d):
    derived = _halves(spark, d).select(F.col("b").alias("thai"), F.lit("derived").alias("translit"))
    return K.syllable_union(_dict(spark), derived, _lex(spark).filter("priority = 0"))


#: Words of one to nine characters, some with a space, romanized in one part or two.
_SHORT = "SELECT o_orderkey AS k, substring('กามา ดีไปไหน ใจดี', CAST(1 + o_orderkey % 8 AS INT), CAST(1 + o_custkey % 9 AS INT)) AS thai, CASE WHEN o_custkey % 4 = 0 THEN 'a-b' ELSE 'ab' END AS translit FROM orders"


@query(f"SELECT k, thai, translit, NOT contains(thai, ' ') AND ((length(thai) <= 5 AND NOT contains(translit, '-')) OR length(thai) <= 3) AS syllable, NOT contains(thai, ' ') AS one_word FROM ({_SHORT})")
def syllable_admission(spark, d):
    return _orders(spark, d, _SHORT).select("k", "thai", "translit", K.admit_syllable(F.col("thai"), F.col("translit")).alias("syllable"), (~F.col("thai").contains(" ")).alias("one_word"))


@query(f"WITH {_PARTS}, {_LEX} SELECT DISTINCT word FROM parts WHERE word NOT IN (SELECT thai FROM dict) UNION SELECT DISTINCT b FROM parts WHERE b NOT IN (SELECT thai FROM dict)")
def oov_words_antijoin(spark, d):
    h = _halves(spark, d)
    return K.out_of_vocabulary(h.select("word").unionAll(h.select(F.col("b").alias("word"))), _dict(spark))


@query(f"WITH {_PARTS}, {_LEX} SELECT DISTINCT word || chr(9) AS line FROM parts WHERE word NOT IN (SELECT thai FROM dict) ORDER BY 1")
def draft_dictionary(spark, d):
    return K.out_of_vocabulary(_halves(spark, d), _dict(spark)).select(F.concat("word", F.lit("\t")).alias("line")).orderBy("line")


# ---- text functions ------------------------------------------------------------------------------


@query(f"WITH {_PARTS} SELECT DISTINCT w, regexp_matches(w, '[\\x{{0E00}}-\\x{{0E7F}}]') AS thai FROM (SELECT word AS w FROM parts UNION ALL SELECT p_name FROM part UNION ALL SELECT '฿')")
def thai_filter(spark, d):
    w = _halves(spark, d).select(F.col("word").alias("w")).unionAll(_t(spark, d, "part").select("p_name")).unionAll(spark.sql("SELECT '฿'")).distinct()
    return w.select("w", X.contains_thai(F.col("w")).alias("thai"))


@query("SELECT doc_id, regexp_matches(text, '[0-9]') AS digit FROM documents")
def digit_filter(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.contains_digit(F.col("text")).alias("digit"))


@query("SELECT doc_id, regexp_matches(text, '[èéêìíîòóôùúû]') AS precomposed FROM documents")
def precomposed_filter(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.has_precomposed(F.col("text")).alias("precomposed"))


#: White space around a text, by a number: none, a tab, a no-break space and a space, an ideographic space before a line feed.
_PADDED = "concat(CASE CAST({n} % 4 AS INT) WHEN 1 THEN '\t' WHEN 2 THEN '\u00a0 ' WHEN 3 THEN '\u3000\n' ELSE '' END, {x}, CASE CAST({n} % 3 AS INT) WHEN 1 THEN ' \u00a0' WHEN 2 THEN '\t' ELSE '' END)"
#: The characters of white space as a trim of DuckDB takes them.
_SPACES = " \t\n\x0b\x0c\r\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _trimmed(x: str) -> str:
    return f"trim({x}, '{_SPACES}')"


_FIRST = _PADDED.format(n="a.turn", x="CASE WHEN a.turn % 5 = 4 THEN '' WHEN a.turn % 5 = 3 THEN concat('# Aegisub ', a.text) ELSE a.text END")
_PAIRED = f"SELECT a.conv_id, a.turn, {_FIRST} AS inp, {_PADDED.format(n='b.turn', x='b.text')} AS golden FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


@query(
    f"""SELECT CASE WHEN t = '' OR regexp_full_match(golden, '[\\p{{P}}\\p{{S}}{_SPACES}]*') THEN 'empty' WHEN starts_with(t, '#') AND contains(t, 'Aegisub') THEN 'header' WHEN regexp_matches(t, '[0-9]') THEN 'digit'
  WHEN regexp_matches(golden, '[èéêìíîòóôùúû]') THEN 'precomposed' WHEN contains(t, 'ๆ') THEN 'repeat' ELSE 'kept' END AS reason, count(*) AS n FROM (SELECT {_trimmed('inp')} AS t, golden FROM ({_PAIRED})) GROUP BY 1"""
)
def skip_chain_counts(spark, d):
    p = spark.sql(re.sub(r"\bconversations\b", "{conversations}", _PAIRED), conversations=_t(spark, d, "conversations"))
    return p.groupBy(F.coalesce(E.skip_reason(F.col("inp"), F.col("golden")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS stripped FROM pages")
def strip_markers(spark, d):
    return _t(spark, d, "pages").select("page_id", X.strip_markers(F.col("html")).alias("stripped"))


@query("SELECT doc_id, replace(replace(text, '-', ''), '~', '') AS folded FROM documents")
def fold_separators(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.fold_separators(F.col("text")).alias("folded"))


_COMBINED = "SELECT o_orderkey AS k, concat(substr('bpdtk', CAST(o_orderkey % 5 AS INT) + 1, 1), substr('aeiou', CAST(o_orderkey % 5 AS INT) + 1, 1), substr('̀́̂̌', CAST(o_orderkey % 4 AS INT) + 1, 1), 'ng') AS x FROM orders"


@query(f"SELECT k, nfc_normalize(x) AS composed FROM ({_COMBINED.replace('substr(', 'substring(')})")
def nfc(spark, d):
    return _orders(spark, d, _COMBINED).select("k", X.nfc(F.col("x")).alias("composed"))


_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\\p{{P}}\\p{{S}}]', ' ', 'g'), '{_WS}', ' ', 'g')) AS cleaned FROM documents")
def punctuation_and_space(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.collapse(X.punctuation_to_space(F.col("text"))).alias("cleaned"))


def _sql_number(n: str) -> str:
    units = "[" + ", ".join(f"'{u}'" for u in O.UNITS) + "]"
    tens = "[" + ", ".join(f"'{u}'" for u in O.TENS) + "]"
    one = lambda c: f"CASE WHEN {c} = '0' THEN '{O.ZERO}' ELSE {units}[CAST({c} AS INT) + 1] END"
    return (
        f"CASE WHEN length({n}) = 1 THEN {one(n)} WHEN length({n}) = 2 THEN {tens}[CAST({n}[1] AS INT) + 1] || CASE WHEN {n}[2] = '1' AND {n}[1] <> '0' THEN ' {O.ELEVENTH}' WHEN {n}[2] <> '0' THEN ' ' || {units}[CAST({n}[2] AS INT) + 1] ELSE '' END"
        f" ELSE array_to_string(list_transform(string_split({n}, ''), lambda c: {one('c')}), ' ') END"
    )


@query(f"SELECT n, {_sql_number('n')} AS words FROM (SELECT DISTINCT CAST(CAST(l_quantity AS INT) AS VARCHAR) AS n FROM lineitem UNION SELECT DISTINCT CAST(p_partkey AS VARCHAR) FROM part UNION SELECT '07' UNION SELECT '00')")
def number_words(spark, d):
    n = _t(spark, d, "lineitem").select(F.col("l_quantity").cast("int").cast("string").alias("n")).union(_t(spark, d, "part").select(F.col("p_partkey").cast("string"))).unionAll(spark.sql("SELECT '07' UNION ALL SELECT '00'")).distinct()
    return n.select("n", X.number_words(F.col("n")).alias("words"))


@query(f"SELECT p_partkey, 'a' || ' ' || {_sql_number('n')} || 'b ' || {_sql_number('m')} AS spelled FROM (SELECT p_partkey, CAST(p_size AS VARCHAR) AS n, CAST(p_partkey AS VARCHAR) AS m FROM part)")
def normalize_numbers(spark, d):
    return _t(spark, d, "part").select("p_partkey", X.normalize_numbers(F.concat(F.lit("a"), F.col("p_size").cast("string"), F.lit("b "), F.col("p_partkey").cast("string"))).alias("spelled"))


def _duck_normalize(x: str) -> str:
    x = f"lower(trim(regexp_replace(nfc_normalize(regexp_replace({x}, '^\\x{{FEFF}}', '')), '{_WS}', ' ', 'g')))"
    x = f"trim(regexp_replace(regexp_replace({x}, '[\\p{{P}}\\p{{S}}]', ' ', 'g'), '{_WS}', ' ', 'g'))"
    for w in ("mǎi", "mái"):
        x = f"replace({x}, ' {w} ', ' mai ')"
    x = f"regexp_replace({x}, ' m(ǎ|á)i$', ' mai')"
    for w in ("wà", "wâ"):
        x = f"replace({x}, ' {w} ', ' wa ')"
    return f"regexp_replace({x}, ' w(à|â)$', ' wa')"


_ROMAN = f"SELECT o_orderkey AS k, concat(e.expected, CASE o_orderkey % 4 WHEN 0 THEN ' mǎi' WHEN 1 THEN ' wâ!' WHEN 2 THEN ' mái  (rɔ̌ɔk) mái ná' ELSE '...' END) AS x FROM orders JOIN (SELECT * FROM {D.PAIR_SQL}) e ON e.n = o_orderkey % 7 + 1"


@query(f"SELECT k, strip_accents(x) AS plain FROM ({_ROMAN} UNION ALL {_COMBINED.replace('substr(', 'substring(')})")
def strip_tones(spark, d):
    """Tone marks precomposed and combining."""
    return _orders(spark, d, _ROMAN).unionAll(_orders(spark, d, _COMBINED)).select("k", X.strip_tones(F.col("x")).alias("plain"))


@query(f"SELECT k, {_duck_normalize('x')} AS normalized FROM ({_ROMAN})")
def normalize_text(spark, d):
    return _orders(spark, d, _ROMAN).select("k", X.normalize(F.col("x")).alias("normalized"))


@query(f"WITH {_PARTS} SELECT word, regexp_replace(word, '(?s:.)์|[ก-ฮ][ะัาิีึืุูเแโใไๅำ]์', '', 'g') AS kept FROM (SELECT DISTINCT word FROM parts UNION SELECT word FROM {D.WORD_SQL})")
def silent_removal(spark, d):
    w = _halves(spark, d).select("word").unionAll(_v(spark, D.WORD_SQL)).distinct()
    return w.select("word", X.remove_silent(F.col("word")).alias("kept"))


@query("SELECT doc_id, CAST(strlen(text) AS INT) AS n_bytes, CAST(length(text) AS INT) AS n_points FROM documents")
def byte_vs_char_len(spark, d):
    b, n = X.byte_and_char_length(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", b.alias("n_bytes"), n.alias("n_points"))


@query("SELECT doc_id, list_filter(string_split(text, ' '), lambda w: w <> '' AND w <> '-') AS words FROM documents")
def split_words(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.split_words(F.col("text")).alias("words"))


@query("SELECT n_name, row_number() OVER (ORDER BY coalesce(TRY_CAST(regexp_extract(n_name, '\\d+') AS INT), 0), n_name) AS place FROM nation")
def natural_sort(spark, d):
    n = _t(spark, d, "nation")  # twenty-five rows
    return n.select("n_name", F.row_number().over(Window.orderBy(X.first_number(F.col("n_name")), "n_name")).cast("long").alias("place"))


@query(f"WITH {_PARTS}, c AS (SELECT unnest(string_split(word, '')) AS ch FROM parts) SELECT ch, CASE WHEN regexp_matches(ch, '[ก-ฮ]') THEN 'consonant' WHEN regexp_matches(ch, '[เแโใไ]') THEN 'leading' WHEN regexp_matches(ch, '[ะัาิีึืุูๅำ]') THEN 'vowel' WHEN regexp_matches(ch, '[่้๊๋]') THEN 'tone' ELSE 'other' END AS class, count(*) AS n FROM c GROUP BY ALL")
def char_class_histogram(spark, d):
    c = _halves(spark, d).select(F.explode(F.split("word", "")).alias("ch"))
    ch = F.col("ch")
    cls = F.when(ch.rlike(S.C), "consonant").when(ch.rlike(S.L), "leading").when(ch.rlike(S.V), "vowel").when(ch.rlike(S.T), "tone").otherwise("other")
    return c.groupBy("ch", cls.alias("class")).agg(F.count("*").alias("n"))


# ---- tones and syllables -------------------------------------------------------------------------

#: A class, mark, vowel and final for each order; all combinations come up.
_GRID = """(SELECT o_orderkey AS k, CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS cls, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN '' WHEN 1 THEN '่' WHEN 2 THEN '้' WHEN 3 THEN '๊' ELSE '๋' END AS mark,
  CASE CAST(o_custkey % 5 AS INT) WHEN 0 THEN 'a' WHEN 1 THEN 'aa' WHEN 2 THEN 'ai' WHEN 3 THEN 'əə' ELSE 'ɔ' END AS vowel, CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'k' WHEN 2 THEN 'n' ELSE 'i' END AS final FROM orders) AS g"""


def _grid_oracle() -> str:
    long = "regexp_matches(vowel, 'aa|ii|uu|ee|oo|ɔɔ|əə')"
    live = {
        "legacy": f"(final NOT IN ('k', 't', 'p') OR {long} OR vowel IN ('ai', 'ao'))",
        "build": "(final IN ('', 'n', 'm', 'ng') OR regexp_matches(vowel, 'aa|ii|uu|ee|oo|ɔɔ'))",
        "pattern": "(final NOT IN ('k', 't', 'p'))",
    }
    one = lambda e: f"""SELECT '{e}' AS engine, k, cls, mark, vowel, final, {live[e]} AS live, CASE mark WHEN '่' THEN CASE cls WHEN 'low' THEN 3 ELSE 1 END WHEN '้' THEN CASE cls WHEN 'low' THEN 2 ELSE 3 END
  WHEN '๊' THEN CASE cls WHEN 'mid' THEN 2 ELSE 0 END WHEN '๋' THEN CASE cls WHEN 'mid' THEN 4 ELSE 0 END
  ELSE CASE WHEN {live[e]} THEN CASE cls WHEN 'high' THEN 4 ELSE 0 END WHEN cls <> 'low' THEN 1 ELSE {f"CASE WHEN {long} THEN 3 ELSE 2 END" if e == 'pattern' else '2'} END END AS tone FROM {_GRID}"""  # noqa: E731
    return " UNION ALL ".join(map(one, live))


@query(_grid_oracle())
def tone_matrix(spark, d):
    g = _orders(spark, d, f"SELECT * FROM {_GRID}")
    out = None
    for e in ("legacy", "build", "pattern"):
        live = S.is_live(F.col("vowel"), F.col("final"), e)
        part = g.select(F.lit(e).alias("engine"), "k", "cls", "mark", "vowel", "final", live.alias("live"), S.tone_number(F.col("cls"), live, F.col("mark"), S.is_long(F.col("vowel")), e).alias("tone"))
        out = part if out is None else out.unionAll(part)
    return out


_UNTONED = "SELECT o_orderkey AS k, concat(CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'gaa' WHEN 1 THEN 'krʉʉ' WHEN 2 THEN 'ngɔɔng' WHEN 3 THEN 'pleeng' ELSE 'brt' END, CASE WHEN o_custkey % 2 = 0 THEN 'na' ELSE '' END) AS x, CAST(o_custkey % 5 AS INT) AS n FROM orders"


@query(f"SELECT k, nfc_normalize(regexp_replace(x, '^([^aeiouəɛɔʉ]*[aeiouəɛɔʉ])', '\\1' || ['', '̀', '́', '̂', '̌'][n + 1])) AS toned FROM ({_UNTONED})")
def tone_placement(spark, d):
    return _orders(spark, d, _UNTONED).select("k", S.place_tone(F.col("x"), F.col("n")).alias("toned"))


_ALL_WORDS = f"(SELECT DISTINCT word FROM parts UNION SELECT word FROM {D.WORD_SQL} UNION SELECT a FROM parts UNION SELECT b FROM parts)"


def _words(spark, d):
    h = _halves(spark, d)
    return h.select("word").unionAll(h.select("a")).unionAll(h.select("b")).unionAll(_v(spark, D.WORD_SQL)).distinct()


_PAIR_RX = "(?:" + "|".join(sorted(O.CLUSTERS)) + f"|ห{S.C})"
_LEN = f"length(regexp_extract(rest, '^(?:{S.L}(?:{_PAIR_RX}|{S.C})?{S.MV}*|(?:{_PAIR_RX}|{S.C})?{S.M}*{S.V}{S.MV}*|{_PAIR_RX}{S.M}*|{S.C}{S.M}*|{S.M}+|(?s:.))'))"


def _plain_length(rest: str = "rest") -> str:
    """DuckDB SQL for the length of the first syllable of ``rest``, without look-ahead: the part before the final, then the final's rule."""
    base = _LEN.replace("rest", rest)
    head = f"{rest}[1:{base}]"
    nxt, after = f"{rest}[{base} + 1]", f"{rest}[{base} + 2]"
    lead = f"regexp_matches({head}, '^{S.L}')"
    has_vowel = f"regexp_matches({head}, '{S.V}')"
    single = f"regexp_matches({head}, '^{S.C}{S.M}*$')"
    return f"""({base} + CASE WHEN NOT regexp_matches({nxt}, '^{S.C}$') THEN 0
  WHEN {has_vowel} THEN CASE WHEN regexp_matches({after}, '^{S.L}$') OR (NOT {lead} AND regexp_matches({after}, '^{S.V}$')) OR ({lead} AND regexp_matches({after}, '^{S.C}$')) THEN 0 ELSE 1 END
  WHEN {single} THEN 1 ELSE 0 END)"""


@query(
    f"""WITH RECURSIVE {_PARTS}, w AS (SELECT word FROM {_ALL_WORDS}),
r AS (SELECT word, word AS rest, CAST([] AS VARCHAR[]) AS syl FROM w UNION ALL SELECT word, rest[n + 1:], list_append(syl, rest[1:n]) FROM (SELECT *, {_plain_length()} AS n FROM r WHERE rest <> ''))
SELECT word, syl AS syllables FROM r WHERE rest = ''"""
)
def syllable_split(spark, d):
    return _words(spark, d).select("word", S.extract_syllables(F.col("word")).alias("syllables"))


@query(f"WITH {_PARTS}, a AS (SELECT word, {Q.silent('word')} AS s FROM {_ALL_WORDS}) SELECT word, CAST(min(rank) AS INT) AS rank FROM a LEFT JOIN (SELECT * FROM {Q.pattern_table()}) ON regexp_full_match(s, whole) GROUP BY word")
def vowel_pattern_match(spark, d):
    return _words(spark, d).select("word", S.match_pattern(F.col("word")).alias("rank"))


@query(f"""WITH {_PARTS}, s AS (SELECT word, regexp_replace(word, '(?s:.)์|[ก-ฮ][ะัาิีึืุูเแโใไๅำ]์', '', 'g') AS s FROM {_ALL_WORDS}),
p AS (SELECT word, s, regexp_extract(s, '^({S.L}?)', 1) AS lead, regexp_extract(s, '^{S.L}?({'|'.join(sorted(O.CLUSTERS))}|{S.C}ร)', 1) AS pair, regexp_extract(s, '^{S.L}?({S.C}?)', 1) AS one FROM s),
q AS (SELECT word, lead, CASE WHEN pair <> '' THEN pair ELSE one END AS onset, s FROM p), r AS (SELECT *, s[length(lead) + length(onset) + 1:] AS rest FROM q)
SELECT word, lead, onset, array_to_string(regexp_extract_all(rest, '{S.V}'), '') AS vowel, coalesce(regexp_extract_all(rest, '{S.T}')[-1], '') AS tone, array_to_string(regexp_extract_all(rest, '{S.C}'), '') AS final FROM r""")
def syllable_parse(spark, d):
    parts = S.parse(F.col("word"))
    return _words(spark, d).select("word", *[c.alias(k) for k, c in parts.items()])


@query(Q.query(_PARTS, f"todo AS (SELECT word AS piece FROM {_ALL_WORDS})", Q.components("todo", "c"), "SELECT piece AS word, initial, initial_thai, lead, marks, tone_mark, final FROM ccomp"))
def syllable_components(spark, d):
    return _words(spark, d).withColumn("c", P.components(F.col("word"))).select("word", "c.*")


@query(f"SELECT k, vowel, final, regexp_matches(vowel, 'aa|ii|uu|ee|oo|ɔɔ|əə') AS long, final NOT IN ('k', 't', 'p') AS live FROM {_GRID}")
def live_dead(spark, d):
    g = _orders(spark, d, f"SELECT * FROM {_GRID}")
    return g.select("k", "vowel", "final", S.is_long(F.col("vowel")).alias("long"), S.is_live(F.col("vowel"), F.col("final"), "pattern").alias("live"))


# ---- segmentation --------------------------------------------------------------------------------


def _segment_lexicon(spark):
    lex = _lex(spark)
    return lex.groupBy("thai").agg(F.min_by("translit", F.struct("priority", -F.col("line_no"))).alias("translit"), F.min("priority").alias("priority"))


_LX = f"lx AS (SELECT thai, arg_min(translit, priority * 100 - line_no) AS translit, min(priority) AS priority FROM {D.LEX_SQL} GROUP BY thai)"
_W = f"w AS (SELECT word FROM {_ALL_WORDS} WHERE word <> '')"
_ADMITTED = """adm AS (SELECT thai, arg_max(translit, file || lpad(CAST(line_no AS VARCHAR), 9, '0')) AS translit FROM lex
  WHERE priority = 1 AND NOT contains(thai, ' ') AND ((length(thai) <= 5 AND NOT contains(translit, '-')) OR length(thai) <= 3) GROUP BY thai),
lay AS (SELECT thai, translit FROM adm UNION ALL SELECT thai, translit FROM lex WHERE priority = 0 AND thai NOT IN (SELECT thai FROM adm))"""
#: Length of the longest word of the dictionary.
_REACH = max(len(thai) for thai, _, priority, *_ in D.LEXICON if priority == 1)


@query(Q.query(_PARTS, _LX, _W, Q.segments("w", "lx", "s", 8), "SELECT word, idx, piece, translit, tier FROM sseg"))
def longest_match_segment(spark, d):
    return G.segment(_words(spark, d), _segment_lexicon(spark))


#: Both halves of each part name, and the first halves with the beginning of the second: longest match takes these and is left with the rest.
_DECOYS = "dl AS (SELECT DISTINCT unnest([a, b]) AS thai, 1 AS priority FROM parts UNION SELECT DISTINCT b || a[1:k], k - 1 FROM parts, (VALUES (1), (2)) AS v(k))"


def _decoys(spark, d):
    h = _halves(spark, d)
    longer = h.select(F.concat("b", F.substring("a", 1, 1)).alias("thai"), F.lit(0).alias("priority")).unionAll(h.select(F.concat("b", F.substring("a", 1, 2)), F.lit(1)))
    return h.select(F.explode(F.array("a", "b")).alias("thai"), F.lit(1).alias("priority")).unionAll(longer).distinct().select("thai", F.concat(F.lit("r"), "thai").alias("translit"), "priority")


@query(Q.query(_PARTS, _W, _DECOYS, Q.lattice("w", "dl", "l", 8), "SELECT word, idx, piece, known FROM llat"))
def lattice_segment(spark, d):
    """Part words and others cut by the best path over all entries."""
    pieces = T.cut_lattice(G.keyed(_words(spark, d)), _decoys(spark, d)).select("word", F.posexplode_outer("pieces").alias("idx", "p"))
    return pieces.select("word", "idx", F.col("p.piece").alias("piece"), (F.col("p.tier") != "rule").alias("known"))


_SPELLED = f"""sp AS (SELECT DISTINCT word, rb.translit || '-' || ra.translit AS translit, (unicode(a) + unicode(b)) % 5 = 0 AS held FROM parts
  JOIN (SELECT * FROM {D.ROMAN_SQL}) ra ON ra.thai = a JOIN (SELECT * FROM {D.ROMAN_SQL}) rb ON rb.thai = b)"""


def _spelled(spark, d):
    """(word, translit, held) of the part words with their hyphenated romanizations; a fifth is held out."""
    roman = _v(spark, D.ROMAN_SQL)
    side = lambda c: F.broadcast(roman.select(F.col("thai").alias(f"t{c}"), F.col("translit").alias(f"r{c}")))  # noqa: E731  sixteen rows, fixed
    h = _halves(spark, d).join(side("a"), F.col("a") == F.col("ta")).join(side("b"), F.col("b") == F.col("tb"))
    return h.select("word", F.concat_ws("-", "rb", "ra").alias("translit"), ((F.ascii("a") + F.ascii("b")) % 5 == 0).alias("held")).distinct()


@query(Q.query(_PARTS, _SPELLED, "tw AS (SELECT word, translit FROM sp WHERE NOT held)", "dw AS (SELECT word FROM sp)", Q.tagged("tw", "dw", "g", L.ROUNDS), "SELECT sp.word, held, syllables FROM sp JOIN gtag USING (word)"))
def syllable_tagger(spark, d):
    """Syllables of all part words by weights learned from four fifths of them, spelled with hyphens."""
    h = materialize(_spelled(spark, d))
    weights = L.fit(h.filter("not held").select(F.col("word").alias("thai"), "translit"))
    return h.select("word", "held").join(L.syllables(h, weights), "word")


@query(Q.query(_PARTS, _LX, _W, Q.transliterated("w", "lx", "t"), "SELECT word, roman FROM ttr"))
def transliterate_words(spark, d):
    return G.transliterate(_words(spark, d), _segment_lexicon(spark))


@query(Q.query(_PARTS, _LX, _W, Q.transliterated("w", "lx", "t"), "SELECT word, idx, piece, tier, roman FROM tpc"))
def explain_word(spark, d):
    return G.explain(_words(spark, d), _segment_lexicon(spark))


@query(
    Q.query(
        _PARTS, _LEX, _ADMITTED, f"gv AS (SELECT DISTINCT word, [b, a] AS syl FROM parts), alone AS (SELECT DISTINCT word FROM {D.WORD_SQL})",
        # a syllable that does not spell the word on from where it stands is passed over
        "ga AS (SELECT word, syl, 0 AS j, 0 AS done, CAST([] AS VARCHAR[]) AS out FROM gv WHERE word NOT IN (SELECT thai FROM dict) UNION ALL SELECT word, syl, j + 1, CASE WHEN fits THEN done + length(x) ELSE done END, CASE WHEN fits THEN list_append(out, x) ELSE out END"
        " FROM (SELECT *, syl[j + 1] AS x, done < length(word) AND word[done + 1:done + length(syl[j + 1])] = syl[j + 1] AS fits FROM ga WHERE j < len(syl)))",
        "gd AS (SELECT word, syl, out, done >= length(word) AND len(out) > 0 AS covered FROM ga WHERE j = len(syl)), rest AS (SELECT word FROM alone UNION SELECT word FROM gd WHERE NOT covered)",
        Q.by_syllables("rest", "dict", "lay", "b"),
        "gp AS (SELECT word, unnest(out) AS piece, unnest(range(len(out))) AS idx FROM gd WHERE covered), gt AS (SELECT DISTINCT piece FROM gp)",
        Q.components("gt", "g"),
        "SELECT word, syl AS syllables, string_agg(coalesce(l.translit, c.roman), '' ORDER BY idx) AS roman FROM gd JOIN gp USING (word) LEFT JOIN lay l ON l.thai = piece LEFT JOIN gcomp c USING (piece) WHERE covered GROUP BY word, syl"
        " UNION ALL SELECT word, syl, roman FROM gd JOIN bbs USING (word) WHERE NOT covered UNION ALL SELECT word, syl, translit FROM gv JOIN dict ON thai = word UNION ALL SELECT word, NULL, roman FROM alone JOIN bbs USING (word)",
    )
)
def words_by_syllables(spark, d):
    """Both halves of each part name as the syllables given for the whole."""
    words = _halves(spark, d).select("word", F.array("b", "a").alias("syllables")).unionAll(_v(spark, D.WORD_SQL).select("word", F.lit(None).cast("array<string>").alias("syllables")))
    lex = _lex(spark)
    return Y.by_syllables(words, _dict(spark), K.last_wins(lex.filter("priority = 1").filter(K.admit_syllable(F.col("thai"), F.col("translit")))), lex.filter("priority = 0"))


@query(
    Q.query(
        _PARTS, _LEX, _LX, "hw AS (SELECT DISTINCT unnest([a, b]) AS word FROM parts), un AS (SELECT word FROM hw WHERE word NOT IN (SELECT thai FROM dict))", Q.transliterated("un", "lx", "t"),
        "rw AS (SELECT thai AS word, translit AS roman FROM dict UNION ALL SELECT word, roman FROM ttr)",
        "SELECT p_partkey, y.roman || '-' || x.roman AS roman FROM parts JOIN rw x ON x.word = a JOIN rw y ON y.word = b",
    )
)
def sentence_pipeline(spark, d):
    """Every part name romanized: distinct words once, joined back to all parts."""
    h = _halves(spark, d)
    tokens = h.select("p_partkey", F.posexplode(F.array("b", "a")).alias("pos", "word"))
    roman = materialize(K.layered(tokens.select("word").distinct(), _dict(spark)))  # read twice below
    known = roman.filter("translit is not null").select("word", F.col("translit").alias("roman"))
    ruled = G.transliterate(roman.filter("translit is null"), _segment_lexicon(spark))
    back = tokens.join(known.unionAll(ruled), "word")
    return E.ordered_concat(back, ["p_partkey"], "pos", "roman", "-").withColumnRenamed("joined", "roman")


_TOKENS = "SELECT o_custkey AS line, o_orderkey AS pos, CASE WHEN o_orderkey % 5 = 0 THEN 'ๆ' ELSE 'w' END AS token, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN '' ELSE concat('r', CAST(o_orderkey % 11 AS STRING)) END AS roman FROM orders"


@query(f"SELECT line, pos, token, CASE WHEN token = 'ๆ' THEN coalesce(last_value(CASE WHEN token <> 'ๆ' AND roman <> '' THEN roman END IGNORE NULLS) OVER (PARTITION BY line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE roman END AS roman FROM ({_TOKENS})")
def mai_yamok_repeat(spark, d):
    return E.repeat_mark(_orders(spark, d, _TOKENS), "line", "pos", "roman")


@query(f"SELECT line, string_agg(roman, '-' ORDER BY pos) AS joined FROM ({_TOKENS}) GROUP BY line")
def ordered_concat(spark, d):
    return E.ordered_concat(_orders(spark, d, _TOKENS), ["line"], "pos", "roman", "-")


# ---- evaluation ----------------------------------------------------------------------------------


def _greedy_oracle(pairs: str) -> str:
    return f"""RECURSIVE p AS ({pairs}), g AS (SELECT k, e, o, 0 AS j, 1 AS i, 0 AS m FROM p
  UNION ALL SELECT k, e, o, j + 1, CASE WHEN f IS NULL OR f = 0 THEN len(o) + 1 ELSE i + f END, m + CASE WHEN f > 0 THEN 1 ELSE 0 END FROM (SELECT *, list_position(o[i:], e[j + 1]) AS f FROM g WHERE j < len(e)))"""


_TURNS = "SELECT a.conv_id * 1000 + a.turn AS k, list_filter(string_split(lower(a.text), ' '), lambda w: w <> '' AND w <> '-') AS e, list_filter(string_split(lower(b.text), ' '), lambda w: w <> '' AND w <> '-') AS o FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def _turn_pairs(spark, d):
    c = _t(spark, d, "conversations")
    words = lambda x: X.split_words(F.lower(x))
    a = c.select("conv_id", "turn", words("text").alias("e"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), words("text").alias("o"))
    return a.join(b, ["conv_id", "turn"])


@query(f"WITH {_greedy_oracle(_TURNS)} SELECT sum(m) AS matched, sum(len(e)) AS words, round(sum(m) * 100.0 / sum(len(e)), 6) AS accuracy FROM g WHERE j = len(e)")
def word_accuracy(spark, d):
    p = _turn_pairs(spark, d).select(E.greedy_matches(F.col("e"), F.col("o")).alias("m"), F.size("e").alias("n"))
    return p.agg(F.sum("m").alias("matched"), F.sum("n").alias("words"), F.round(F.sum("m") * 100.0 / F.sum("n"), 6).alias("accuracy"))


#: A golden line and a rendering of it for each order, some with words before and behind.
_LINED = f"SELECT o_orderkey AS k, concat(e.expected, CASE WHEN o_custkey % 3 = 0 THEN ' ná' ELSE '' END) AS expected, concat(CASE WHEN o_custkey % 4 = 0 THEN 'a ' ELSE '' END, e.got, CASE WHEN o_custkey % 3 <> 1 THEN ' ná' ELSE '' END) AS got FROM orders JOIN (SELECT * FROM {D.PAIR_SQL}) e ON e.n = o_orderkey % 7 + 1"


@query(f"WITH {_greedy_oracle(f'SELECT k, string_split(expected, chr(32)) AS e, string_split(got, chr(32)) AS o FROM ({_LINED})')} SELECT k, m AS matched FROM g WHERE j = len(e)")
def greedy_word_match(spark, d):
    return _orders(spark, d, _LINED).select("k", E.greedy_matches(F.split("expected", " "), F.split("got", " ")).alias("matched"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE l_returnflag = l_linestatus OR l_linenumber = 1) AS passed, count(*) FILTER (WHERE NOT (l_returnflag = l_linestatus OR l_linenumber = 1)) AS failed, round(count(*) FILTER (WHERE l_returnflag = l_linestatus OR l_linenumber = 1) * 100.0 / count(*), 6) AS accuracy FROM lineitem")
def line_accuracy(spark, d):
    return _t(spark, d, "lineitem").agg(*E.accuracy((F.col("l_returnflag") == F.col("l_linestatus")) | (F.col("l_linenumber") == 1)))


@query(f"WITH e AS (SELECT *, replace(replace(expected, '-', ''), '~', '') AS a, replace(replace(got, '-', ''), '~', '') AS b FROM ({_LINED})) SELECT count(*) AS total, count(*) FILTER (WHERE strip_accents(a) = strip_accents(b)) AS passed, count(*) FILTER (WHERE strip_accents(a) <> strip_accents(b)) AS failed, round(count(*) FILTER (WHERE strip_accents(a) = strip_accents(b)) * 100.0 / count(*), 6) AS accuracy FROM e")
def dict_accuracy(spark, d):
    return _orders(spark, d, _LINED).agg(*E.accuracy(E.tone_blind_equal(F.col("expected"), F.col("got"))))


_FAILED = f"SELECT k, expected, CASE CAST(k % 4 AS INT) WHEN 0 THEN got WHEN 1 THEN replace(replace(expected, 'à', 'â'), 'â', 'à') WHEN 2 THEN replace(replace(expected, 'a', 'e'), 'à', 'á') ELSE expected END AS got FROM ({_LINED})"


@query(f"SELECT count(*) FILTER (WHERE strlen(expected) <> strlen(got)) AS length_errors, count(*) FILTER (WHERE strlen(expected) = strlen(got) AND strip_accents(expected) = strip_accents(got)) AS tone_errors, count(*) FILTER (WHERE strlen(expected) = strlen(got) AND strip_accents(expected) <> strip_accents(got)) AS other_errors FROM ({_FAILED} ORDER BY k LIMIT 50)")
def failure_classes(spark, d):
    """Of toned lines: the first fifty by class."""
    return E.failure_classes(E.first_failures(_orders(spark, d, _FAILED), 50, "k"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag <> l_linestatus ORDER BY l_orderkey, l_linenumber LIMIT 30")
def first_n_failures(spark, d):
    f = _t(spark, d, "lineitem").filter("l_returnflag <> l_linestatus").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return E.first_failures(f, 30, "l_orderkey", "l_linenumber")


@query("SELECT source AS name, count(*) AS n FROM documents GROUP BY ROLLUP (source)")
def per_file_rollup(spark, d):
    return _t(spark, d, "documents").select(F.col("source").alias("name")).rollup("name").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT CAST(conv_id AS VARCHAR) AS name, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS line_no FROM conversations),
i AS (SELECT name, line_no, text FROM n WHERE role = 'user'), g AS (SELECT name, line_no, text AS golden FROM n WHERE role = 'assistant'),
c AS (SELECT name FROM (SELECT name, count(*) AS n FROM i GROUP BY 1) JOIN (SELECT name, count(*) AS n FROM g GROUP BY 1) USING (name, n))
SELECT name, line_no, text, golden FROM i JOIN g USING (name, line_no) WHERE name IN (SELECT name FROM c)""")
def corpus_pairing(spark, d):
    """User and assistant turns as the two sides of a corpus; conversations with unequal sides do not pair."""
    c = _t(spark, d, "conversations")
    place = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).cast("long")
    n = c.select(F.col("conv_id").cast("string").alias("name"), "role", "text", place.alias("line_no"))
    side = lambda role, text: n.filter(F.col("role") == role).select("name", "line_no", F.col("text").alias(text))
    return E.pair_lines(side("user", "text"), side("assistant", "golden"))


_INPUT = "CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN '# Exported by Aegisub 3' WHEN 2 THEN 'ไป 7' WHEN 3 THEN 'มาๆ' ELSE concat('ไป', CASE WHEN o_custkey % 2 = 0 THEN ' มา' ELSE '' END) END"
_CORPUS = f"""SELECT o_orderpriority AS name, o_orderkey AS line_no, {_PADDED.format(n='o_custkey', x=_INPUT)} AS input,
  CASE o_custkey % 7 WHEN 0 THEN 'nâa' WHEN 1 THEN 'sà' WHEN 2 THEN 'nà kê' ELSE e.expected END AS expected, CASE WHEN o_orderkey % 11 = 0 THEN CAST(NULL AS STRING) WHEN o_custkey % 3 = 0 THEN e.expected ELSE e.got END AS got
FROM orders JOIN (SELECT * FROM {D.PAIR_SQL}) e ON e.n = o_orderkey % 7 + 1"""
_DUCK_WORDS = "list_filter(string_split({}, ' '), lambda w: w <> '' AND w <> '-')"


@query(
    f"""WITH RECURSIVE u AS (SELECT line_no AS k, {_duck_normalize('expected')} AS x, {_duck_normalize('got')} AS y FROM ({_CORPUS})
  WHERE {_trimmed('input')} <> '' AND {_duck_normalize('expected')} <> '' AND NOT (starts_with({_trimmed('input')}, '#') AND contains(input, 'Aegisub')) AND NOT regexp_matches(input, '[0-9]') AND NOT regexp_matches(expected, '[èéêìíîòóôùúû]') AND NOT contains(input, 'ๆ')),
{_greedy_oracle(f"SELECT k, {_DUCK_WORDS.format('x')} AS e, {_DUCK_WORDS.format('y')} AS o FROM u WHERE y IS NOT NULL").removeprefix('RECURSIVE ')},
w AS (SELECT sum(m) AS m, sum(len(e)) AS n FROM g WHERE j = len(e)), l AS (SELECT count(*) AS n, count(*) FILTER (WHERE x = y) AS ok, count(*) FILTER (WHERE y IS NULL) AS f FROM u)
SELECT l.n AS lines, ok AS lines_correct, f AS fallbacks, w.n AS words, m AS matched, round(ok * 100.0 / l.n, 6) AS line_accuracy, round(m * 100.0 / w.n, 6) AS word_accuracy FROM l, w"""
)
def corpus_report(spark, d):
    return E.corpus_report(E.corpus_results(_orders(spark, d, _CORPUS)))


# ---- whole lines ---------------------------------------------------------------------------------


def _lines_of_parts(spark, d):
    h = _halves(spark, d)
    k = F.col("p_partkey") % 6
    text = F.when(k == 0, F.concat(F.lit("# "), "a")).when(k == 1, F.concat_ws(" ", "b", "a")).when(k == 2, F.lit("")).when(k == 3, F.concat(F.lit("x"), F.col("p_size").cast("string"))).otherwise(F.concat("b", "a"))
    return h.select(F.col("p_size").cast("string").alias("file"), F.col("p_partkey").alias("line_no"), text.alias("text"))


_LINES = """lines AS (SELECT CAST(p_size AS VARCHAR) AS file, p_partkey AS line_no, CASE p_partkey % 6 WHEN 0 THEN '# ' || a WHEN 1 THEN b || ' ' || a WHEN 2 THEN '' WHEN 3 THEN 'x' || CAST(p_size AS VARCHAR) ELSE b || a END AS text FROM parts),
dictp AS (SELECT thai, translit, 1 AS priority FROM dict)"""
_CHUNKS = "ck AS (SELECT text, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS nth FROM todo), cw AS (SELECT DISTINCT word FROM ck)"


@query(
    Q.query(
        _PARTS, _LEX, _LX, _LINES, r"todo AS (SELECT DISTINCT text FROM lines WHERE text <> '' AND NOT starts_with(text, '#') AND regexp_matches(text, '[\x{0E00}-\x{0E7F}]'))", _CHUNKS, Q.tokenized("cw", "dictp", "k", _REACH),
        "tw AS (SELECT DISTINCT token AS word FROM ktok WHERE token NOT IN (SELECT thai FROM dict))", Q.transliterated("tw", "lx", "t"),
        "rw AS (SELECT thai AS token, nfc_normalize(translit) AS roman FROM dict UNION ALL SELECT word, roman FROM ttr), done AS (SELECT text, string_agg(roman, ' ' ORDER BY nth, pos) AS roman FROM ck JOIN ktok USING (word) JOIN rw USING (token) WHERE roman <> '' GROUP BY text)",
        "SELECT file, line_no, text, coalesce(done.roman, text) AS roman, false AS fallback FROM lines LEFT JOIN done USING (text)",
    )
)
def romanize_lines(spark, d):
    """Lines made of part names: headers and foreign lines stay, the rest goes word by word."""
    return N.romanize_lines(_lines_of_parts(spark, d), _dict(spark), _segment_lexicon(spark))


@query(
    Q.query(
        _PARTS, _LEX, _LINES, "todo AS (SELECT DISTINCT text FROM lines WHERE text NOT IN (SELECT thai FROM dict)), lay AS (SELECT thai, arg_min(translit, CASE priority WHEN 1 THEN '0' ELSE '1' END || translit) AS translit FROM lex GROUP BY thai)", _CHUNKS, Q.tokenized("cw", "dictp", "k", _REACH),
        "tw AS (SELECT DISTINCT token AS word FROM ktok)", Q.by_syllables("tw", "dict", "lay", "b"),
        "done AS (SELECT text, CASE WHEN contains(text, ' ') THEN string_agg(roman, ' ' ORDER BY nth, pos) ELSE string_agg(roman, '-' ORDER BY nth, pos) END AS roman FROM ck JOIN ktok USING (word) JOIN bbs ON bbs.word = token WHERE roman <> '' GROUP BY text)",
        "SELECT DISTINCT text, coalesce(d.translit, done.roman, '') AS roman FROM lines LEFT JOIN dict d ON d.thai = text LEFT JOIN done USING (text)",
    )
)
def romanize_sentences(spark, d):
    lex = _lex(spark)
    return N.romanize_sentences(_lines_of_parts(spark, d).select("text"), _dict(spark), lex.filter("priority = 1"), lex.filter("priority = 0"))


@query(
    Q.query(
        _PARTS, _LEX, _LX, _ADMITTED, f"pw AS (SELECT DISTINCT word, b, a FROM parts), cl AS (SELECT DISTINCT piece, {Q.silent('piece')} AS word FROM (SELECT unnest([a, b]) AS piece FROM pw)), un AS (SELECT DISTINCT word FROM cl WHERE word NOT IN (SELECT thai FROM lay) UNION SELECT word FROM {D.WORD_SQL})", Q.transliterated("un", "lx", "t"),
        "rp AS (SELECT piece, coalesce(lay.translit, ttr.roman, '') AS roman FROM cl LEFT JOIN lay ON thai = cl.word LEFT JOIN ttr ON ttr.word = cl.word)",
        # the repetition mark says the last part before it once more
        "SELECT word, [b, a, 'ๆ'] AS syllables, array_to_string(list_filter([y.roman, x.roman, coalesce(nullif(x.roman, ''), y.roman)], lambda r: r <> ''), '-') AS roman, false AS fallback FROM pw JOIN rp x ON x.piece = a JOIN rp y ON y.piece = b"
        f" UNION ALL SELECT word, NULL, roman, true FROM (SELECT DISTINCT word FROM {D.WORD_SQL}) JOIN ttr USING (word)",
    )
)
def words_by_given_syllables(spark, d):
    """Part names with their halves as syllables, a repetition mark behind them, and words without syllables."""
    words = _halves(spark, d).select("word", F.array("b", "a", F.lit("ๆ")).alias("syllables")).unionAll(_v(spark, D.WORD_SQL).select("word", F.lit(None).cast("array<string>").alias("syllables")))
    lex = _lex(spark)
    return N.by_given_syllables(words, K.last_wins(lex.filter("priority = 1").filter(K.admit_syllable(F.col("thai"), F.col("translit")))), lex.filter("priority = 0"), _segment_lexicon(spark))


def _fold(x: str) -> str:
    return f"strip_accents(replace(replace({x}, '-', ''), '~', ''))"


_BARE = "regexp_replace(expected, '<[^>]+>', '', 'g')"


@query(
    Q.query(
        _PARTS, _SPELLED, "dict AS (SELECT word || CASE WHEN length(word) % 2 = 0 THEN '<n>' ELSE '' END AS thai, translit FROM sp UNION ALL SELECT word || ' ' || word, translit FROM sp)", _LX, "ks AS (SELECT thai, translit AS expected, regexp_replace(thai, '<[^>]+>', '', 'g') AS word FROM dict WHERE NOT contains(thai, ' ')), kw AS (SELECT DISTINCT word FROM ks)", Q.transliterated("kw", "lx", "t"),
        "g AS (SELECT 'rules' AS mode, thai, expected, roman AS got FROM ks LEFT JOIN ttr USING (word) UNION ALL SELECT 'dictionary', ks.thai, expected, coalesce(nfc_normalize(dict.translit), roman) FROM ks LEFT JOIN dict ON dict.thai = word LEFT JOIN ttr USING (word))",
        f"e AS (SELECT *, coalesce({_fold(_BARE)} = {_fold('got')}, false) AS ok FROM g)",
        "f AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY thai) AS n FROM e WHERE NOT ok)",
        "c AS (SELECT mode, count(*) FILTER (WHERE strlen(expected) <> strlen(got)) AS length_errors, count(*) FILTER (WHERE strlen(expected) = strlen(got) AND strip_accents(expected) = strip_accents(got)) AS tone_errors, count(*) FILTER (WHERE strlen(expected) = strlen(got) AND strip_accents(expected) <> strip_accents(got)) AS other_errors FROM f WHERE n <= 50 GROUP BY mode)",
        "SELECT mode, count(*) AS total, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed, round(count(*) FILTER (WHERE ok) * 100.0 / count(*), 6) AS accuracy, coalesce(any_value(length_errors), 0) AS length_errors, coalesce(any_value(tone_errors), 0) AS tone_errors, coalesce(any_value(other_errors), 0) AS other_errors FROM e LEFT JOIN c USING (mode) GROUP BY mode",
    )
)
def dictionary_test(spark, d):
    """Part words, some with a marker or a space, against the rules alone and against themselves: counts and classes of the first fifty failures of each."""
    spelled, lex = materialize(_spelled(spark, d)), _segment_lexicon(spark)
    marked = F.concat("word", F.when(F.char_length("word") % 2 == 0, "<n>").otherwise(""))
    entries = materialize(spelled.select(marked.alias("thai"), "translit").unionAll(spelled.select(F.concat_ws(" ", "word", "word"), "translit")))
    keys = entries.select(X.strip_markers(F.col("thai")).alias("word"))
    modes = {"rules": G.transliterate(keys, lex), "dictionary": N.romanize_words(keys, entries, lex)}
    out = None
    for mode, roman in modes.items():
        rows = E.dictionary_results(entries, roman)
        one = E.dictionary_report(rows).select(F.lit(mode).alias("mode"), "*")
        out = one if out is None else out.unionAll(one)
    return out


# ---- files and lines -----------------------------------------------------------------------------

_VOCABULARY = f"""SELECT file, line_no, CASE line_no % 3 WHEN 0 THEN concat('to go, to come,', thai, ',', translit) WHEN 1 THEN concat('one | two,', thai, ',', translit, ',slang,n,a > b') ELSE concat('n&lt;x&gt;,&lt;n&gt;', thai, ',', translit) END AS line FROM {D.LEX_SQL}
UNION ALL SELECT 'orders.txt', CAST(o_orderkey AS INT), CASE o_orderkey % 3 WHEN 0 THEN 'no word here, none' WHEN 1 THEN concat('gloss ', CAST(o_orderkey AS STRING), ',มา', CAST(o_custkey % 10 AS STRING), ',maa') ELSE 'มา without comma' END FROM orders"""
_FIELDS = r"'(.*),(.*\p{Thai}.*)'"


@query(
    f"""SELECT file, line_no, gloss, replace(replace(cells[1], '&lt;', '<'), '&gt;', '>') AS thai, replace(replace(coalesce(cells[2], ''), '&lt;', '<'), '&gt;', '>') AS translit
FROM (SELECT file, line_no, regexp_extract(line, {_FIELDS}, 1) AS gloss, string_split(regexp_extract(line, {_FIELDS}, 2), ',') AS cells FROM ({_VOCABULARY}) WHERE regexp_matches(line, {_FIELDS}))"""
)
def vocabulary_scan(spark, d):
    return R.vocabulary_rows(_orders(spark, d, _VOCABULARY))


_SECONDARY = "SELECT 'o.tsv' AS file, o_orderkey AS line_no, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN '# note' WHEN 2 THEN concat(chr(9), 'มา', CAST(o_custkey AS STRING), '\u00a0', chr(9), ' maa', chr(9), 'x\u00a0', chr(9)) WHEN 3 THEN concat('นก', chr(9)) WHEN 4 THEN 'no tab' ELSE concat('นก', chr(9), 'nók') END AS line FROM orders"


@query(
    f"""SELECT thai, translit, file, line_no FROM (SELECT file, line_no, {_trimmed('line[:strpos(line, chr(9)) - 1]')} AS thai, {_trimmed('line[strpos(line, chr(9)) + 1:]')} AS translit
FROM (SELECT file, line_no, {_trimmed('line')} AS line FROM ({_SECONDARY})) WHERE line <> '' AND NOT starts_with(line, '#') AND contains(line, chr(9))) WHERE thai <> '' AND translit <> ''"""
)
def secondary_scan(spark, d):
    return R.secondary_rows(_orders(spark, d, _SECONDARY))


#: Lines with a mark of byte order in front and behind, and with written line breaks.
_SUBTITLES = "SELECT o_orderkey AS line_no, concat(CASE WHEN o_orderkey % 4 = 0 THEN '﻿' ELSE '' END, 'ไป', CASE WHEN o_orderkey % 3 = 0 THEN concat(chr(92), 'N', chr(92), 'N') ELSE ' ' END, 'มา', '﻿') AS line FROM orders"
_NO_MARK = "CASE WHEN starts_with(line, '﻿') THEN line[2:] ELSE line END"


@query(f"SELECT line_no, replace({_NO_MARK}, chr(92) || 'N', ' ') AS text FROM ({_SUBTITLES})")
def line_scan(spark, d):
    return _orders(spark, d, _SUBTITLES).select("line_no", R.subtitle_line(F.col("line")).alias("text"))


@query("SELECT concat(o_orderkey, ' ', o_orderpriority) AS line, row_number() OVER (PARTITION BY o_orderkey % 16 ORDER BY o_orderkey) AS line_no FROM orders")
def numbered_lines(spark, d):
    """Orders written as text files, read again by many tasks with the number of each line in its file."""
    path, key = new_path(spark), F.col("o_orderkey")
    rows = _t(spark, d, "orders").select((key % 16).alias("part"), key.alias("key"), F.concat_ws(" ", key, "o_orderpriority").alias("value"))
    rows.repartition(16, "part").sortWithinPartitions("part", "key").drop("key").write.partitionBy("part").text(path)
    return R.numbered_lines(spark, path).select("line", "line_no")


@query(f"SELECT line_no, {_NO_MARK} AS bare FROM ({_SUBTITLES})")
def strip_bom(spark, d):
    return _orders(spark, d, _SUBTITLES).select("line_no", X.strip_bom(F.col("line")).alias("bare"))


@query("SELECT '[' || p_brand || ':' || p_size || '] ' || p_name || chr(10) || '  Expected: ' || p_type || chr(10) || '  Got:      ' || p_brand || chr(10) AS value FROM part")
def failure_log(spark, d):
    p = _t(spark, d, "part")
    return R.failure_records(p.select(F.col("p_brand").alias("name"), F.col("p_size").alias("line_no"), F.col("p_name").alias("input"), F.col("p_type").alias("expected"), F.col("p_brand").alias("got")))


@query(f"SELECT doc_id, list_filter(string_split(replace(replace(text, '.', ' \t '), ',', ' \u00a0 '), ' '), lambda w: {_trimmed('w')} <> '') AS tokens FROM documents")
def token_filter(spark, d):
    return _t(spark, d, "documents").select("doc_id", N.real_tokens(F.split(F.replace(F.replace("text", F.lit("."), F.lit(" \t ")), F.lit(","), F.lit(" \u00a0 ")), " ")).alias("tokens"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = l_linestatus THEN 'OK' ELSE 'FAIL' END AS verdict FROM lineitem")
def verdicts(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.verdict(F.col("l_returnflag"), F.col("l_linestatus")).alias("verdict"))


@query("SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS text FROM pages")
def character_references(spark, d):
    return _t(spark, d, "pages").select("page_id", X.unescape_html(F.col("html")).alias("text"))


@query(
    f"""WITH RECURSIVE u AS (SELECT line_no AS k, {_duck_normalize('expected')} AS x, {_duck_normalize('got')} AS y FROM ({_CORPUS})
  WHERE {_trimmed('input')} <> '' AND {_duck_normalize('expected')} <> '' AND NOT (starts_with({_trimmed('input')}, '#') AND contains(input, 'Aegisub')) AND NOT regexp_matches(input, '[0-9]') AND got IS NOT NULL),
{_greedy_oracle(f"SELECT k, {_DUCK_WORDS.format('x')} AS e, {_DUCK_WORDS.format('y')} AS o FROM u").removeprefix('RECURSIVE ')},
w AS (SELECT sum(m) AS m, sum(len(e)) AS n FROM g WHERE j = len(e)), l AS (SELECT count(*) AS n, count(*) FILTER (WHERE x = y) AS ok FROM u)
SELECT l.n AS lines, ok AS lines_correct, CAST(0 AS BIGINT) AS fallbacks, w.n AS words, m AS matched, round(ok * 100.0 / l.n, 6) AS line_accuracy, round(m * 100.0 / w.n, 6) AS word_accuracy FROM l, w"""
)
def corpus_report_by_rules(spark, d):
    """The corpus as the run without a dictionary counts it: a shorter chain of filters."""
    return E.corpus_report(E.corpus_results(_orders(spark, d, _CORPUS), by_rules=True))
