"""DuckDB SQL for the composed operators, worked out apart from the engine: joins against tables of patterns and recursive walks.

Each function gives a list of common table expressions over one that is named; only the fixed values of the
orthography are shared with the engine.
"""

from __future__ import annotations

from ..functions import orthography as O
from ..functions.syllables import PATTERNS
from . import fixtures as D

CONS, LEAD, VOWEL, TONE = f"[{O.CONSONANT}]", f"[{O.LEADING}]", f"[{O.VOWEL}]", f"[{O.TONE}]"
_MARKS, _SIGNS = f"[{O.TONE}{O.OTHER_MARK}]", f"[{O.VOWEL}{O.TONE}{O.OTHER_MARK}]"
_CLUSTER = "|".join(O.CLUSTERS)
_ONSET = f"(?:(?:{_CLUSTER}|ห{CONS})|{CONS})"
_SHAPES = f"เ{CONS}ีย{CONS}?|เ{CONS}ือ{CONS}?|(?s:.)ร[ะา]{CONS}?"
_V = f"[{O.ROMAN_VOWEL}]"
_LONG = "aa|ii|uu|ee|oo|ʉʉ|ɛɛ|ɔɔ|əə|iia|ʉʉa|uua"
_DOUBLED = "aa|ii|uu|ee|oo|ʉʉ|ɛɛ|ɔɔ"


def silent(x: str) -> str:
    return f"regexp_replace({x}, '(?s:.)์|{CONS}{VOWEL}์', '', 'g')"


def look(table: dict[str, str], key: str) -> str:
    return f"map_from_entries([{', '.join(f'''('{k}', '{v}')''' for k, v in table.items())}])[{key}]"


def _one_group(pattern: str, which: str) -> str:
    """A regex of the whole pattern with one group: the onset, the tone mark or the final."""
    letters = [i for i, c in enumerate(pattern) if c in "KC"]
    place = {"onset": letters[0], "mark": pattern.find("T"), "final": letters[-1] if len(letters) > 1 else -1}[which]
    if place < 0:
        return ""
    kinds = {"K": f"(?:{_CLUSTER})", "C": CONS, "T": f"{TONE}?"}
    return "".join(f"({kinds.get(c, c)})" if i == place else kinds.get(c, c) for i, c in enumerate(pattern))


def pattern_table() -> str:
    """(rank, vowel, whole, onset, mark, final) of each vowel pattern: longer ones first, then by priority, then as listed."""
    order = sorted(range(len(PATTERNS)), key=lambda i: (-len(PATTERNS[i][0]), -PATTERNS[i][2], i))
    rows = [(k + 1, PATTERNS[i][1], _one_group(PATTERNS[i][0], "onset"), *(_one_group(PATTERNS[i][0], w) for w in ("onset", "mark", "final"))) for k, i in enumerate(order)]
    return D.values(rows, "pat", "rank", "vowel", "whole", "onset", "mark", "final")


def tone(cls: str, live: str, mark: str, dead_low: str) -> str:
    return (
        f"CASE {mark} WHEN '่' THEN CASE WHEN {cls} = 'low' THEN 3 ELSE 1 END WHEN '้' THEN CASE WHEN {cls} = 'low' THEN 2 ELSE 3 END WHEN '๊' THEN CASE WHEN {cls} = 'mid' THEN 2 ELSE 0 END"
        f" WHEN '๋' THEN CASE WHEN {cls} = 'mid' THEN 4 ELSE 0 END ELSE CASE WHEN {live} THEN CASE WHEN {cls} = 'high' THEN 4 ELSE 0 END WHEN {cls} = 'low' THEN {dead_low} ELSE 1 END END"
    )


def tone_class(letters: str) -> str:
    return f"CASE WHEN contains('{O.HIGH}', {letters}[1]) AND {letters} <> '' THEN 'high' WHEN contains('{O.LOW}', {letters}[1]) AND {letters} <> '' THEN 'low' ELSE 'mid' END"


def placed(roman: str, number: str) -> str:
    marks = ", ".join(f"'{m}'" for m in O.TONE_MARKS)
    return f"nfc_normalize(regexp_replace({roman}, '^([^{O.ROMAN_VOWEL}]*{_V})', '\\1' || ['', {marks}][{number} + 1]))"


def plain_length(rest: str) -> str:
    """Length of the first syllable of ``rest`` without look-ahead: the part before the final, then the final's rule."""
    base = f"length(regexp_extract({rest}, '^(?:{LEAD}{_ONSET}?{_SIGNS}*|{_ONSET}?{_MARKS}*{VOWEL}{_SIGNS}*|(?:{_CLUSTER}|ห{CONS}){_MARKS}*|{CONS}{_MARKS}*|{_MARKS}+|(?s:.))'))"
    head, nxt, after = f"{rest}[1:{base}]", f"{rest}[{base} + 1]", f"{rest}[{base} + 2]"
    led = f"regexp_matches({head}, '^{LEAD}')"
    return f"""({base} + CASE WHEN NOT regexp_matches({nxt}, '^{CONS}$') THEN 0
  WHEN regexp_matches({head}, '{VOWEL}') THEN CASE WHEN regexp_matches({after}, '^{LEAD}$') OR (NOT {led} AND regexp_matches({after}, '^{VOWEL}$')) OR ({led} AND regexp_matches({after}, '^{CONS}$')) THEN 0 ELSE 1 END
  WHEN regexp_matches({head}, '^{CONS}{_MARKS}*$') THEN 1 ELSE 0 END)"""


def split(words: str, p: str) -> list[str]:
    """{p}split(word, idx, piece): the syllables of each word by the plain rules."""
    return [
        f"{p}sp AS (SELECT word, word AS rest, 0 AS idx, '' AS piece FROM {words} UNION ALL SELECT word, rest[n + 1:], idx + 1, rest[1:n] FROM (SELECT *, {plain_length('rest')} AS n FROM {p}sp WHERE rest <> ''))",
        f"{p}split AS (SELECT word, idx - 1 AS idx, piece FROM {p}sp WHERE idx > 0)",
    ]


def segments(words: str, lexicon: str, p: str, window: int) -> list[str]:
    """{p}seg(word, idx, piece, translit, tier): longest match against ``lexicon`` (thai, translit, priority), else a syllable by the full rules."""
    rest = f"{p}r.word[{p}r.pos:]"
    return [
        f"""{p}h AS (SELECT word, pos, arg_max(translit, n) AS translit, arg_max(priority, n) AS priority, max(n) AS n FROM (SELECT word, pos, n, word[pos + n:] AS tail, l.translit, l.priority
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS pos FROM {words}) x, (SELECT unnest(range(1, {window + 1})) AS n) k JOIN {lexicon} l ON l.thai = x.word[x.pos:x.pos + k.n - 1] AND x.pos + k.n - 1 <= length(x.word))
  WHERE NOT (length(tail) = 1 AND regexp_matches(tail, '{CONS}')) GROUP BY word, pos)""",
        f"""{p}r AS (SELECT word, CAST(1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS idx, '' AS piece, CAST(NULL AS VARCHAR) AS translit, '' AS tier FROM {words}
  UNION ALL SELECT word, pos + n, idx + 1, word[pos:pos + n - 1], translit, CASE WHEN priority IS NULL THEN 'rule' WHEN priority = 0 THEN 'special' ELSE 'syllable' END
  FROM (SELECT {p}r.word, {p}r.pos, {p}r.idx, h.translit, h.priority, coalesce(h.n, CASE WHEN regexp_matches({rest}, '^(?:{_SHAPES})') THEN length(regexp_extract({rest}, '^(?:{_SHAPES})')) ELSE {plain_length(rest)} END) AS n
    FROM {p}r LEFT JOIN {p}h h ON h.word = {p}r.word AND h.pos = {p}r.pos WHERE {p}r.pos <= length({p}r.word)))""",
        f"{p}seg AS (SELECT word, CAST(idx - 1 AS INT) AS idx, piece, translit, tier FROM {p}r WHERE idx > 0)",
    ]


def rules(todo: str, p: str) -> list[str]:
    """{p}rule(piece, tier, roman): each piece by the first vowel pattern, else from its components."""
    live = f"fin NOT IN ('p', 't', 'k') AND (fin <> '' OR letter = '' OR regexp_matches(vowel, '{_LONG}') OR regexp_matches(vowel, 'ai|ao'))"
    return [
        f"{p}a AS (SELECT piece, {silent('piece')} AS s FROM {todo})",
        f"{p}b AS (SELECT piece, min(rank) AS rank FROM {p}a JOIN (SELECT * FROM {pattern_table()}) ON regexp_full_match(s, whole) GROUP BY piece)",
        f"""{p}c AS (SELECT piece, vowel, regexp_extract(s, '^' || onset || '$', 1) AS onset, CASE WHEN mark = '' THEN '' ELSE regexp_extract(s, '^' || mark || '$', 1) END AS mark,
  CASE WHEN final = '' THEN '' ELSE regexp_extract(s, '^' || final || '$', 1) END AS letter FROM {p}b JOIN {p}a USING (piece) JOIN (SELECT * FROM {pattern_table()}) USING (rank))""",
        f"{p}d AS (SELECT *, coalesce({look(O.CLUSTERS, 'onset')}, {look(O.INITIAL, 'onset')}, '') AS ini, coalesce({look(O.FINAL, 'letter')}, '') AS fin FROM {p}c)",
        f"{p}e AS (SELECT *, ini || CASE WHEN ends_with(vowel, 'ɔɔ') AND fin <> '' THEN vowel[:-2] || 'o' ELSE vowel END || fin AS plain, {tone(tone_class('onset'), f'({live})', 'mark', f'''CASE WHEN regexp_matches(vowel, '{_LONG}') THEN 3 ELSE 2 END''')} AS tone FROM {p}d)",
        f"{p}f AS (SELECT piece, {placed('plain', 'tone')} AS roman FROM {p}e)",
        # components: what the first written sign and the leading vowel say together
        f"""{p}g AS (SELECT piece, lead, onset, coalesce(regexp_extract_all(rest, '{TONE}')[-1], '') AS mark, array_to_string(regexp_extract_all(rest, '{VOWEL}'), '')[1] AS sign,
  array_to_string(regexp_extract_all(rest, '{CONS}'), '')[1] AS f1, array_to_string(regexp_extract_all(rest, '{CONS}'), '')[2] AS f2
  FROM (SELECT *, s[length(lead) + length(onset) + 1:] AS rest FROM (SELECT piece, s, regexp_extract(s, '^{LEAD}?') AS lead,
    CASE WHEN regexp_matches(s, '^{LEAD}?(?:{_CLUSTER}|{CONS}ร)') THEN regexp_extract(s, '^{LEAD}?(?:{_CLUSTER}|{CONS}ร)')[-2:] ELSE regexp_extract(s, '^{LEAD}?({CONS}?)', 1) END AS onset FROM {p}a)))""",
        f"{p}i AS (SELECT *, {look(O.INITIAL, 'onset[1]')} AS first, {look(O.CLUSTERS, 'onset')} AS pair, length(onset) = 2 AND {look(O.CLUSTERS, 'onset')} IS NULL AS loose FROM {p}g)",
        f"""{p}j AS (SELECT piece, onset, mark, loose AND sign = 'ะ' AS short, lead = 'เ' AND sign = 'ี' AND f1 = 'ย' AS iia, lead = 'เ' AND sign = 'ื' AND f1 = 'อ' AS uea, lead = 'เ' AND sign = '' AND f1 = 'ย' AS oei,
  lead = '' AND sign = '' AND onset[1] = 'ร' AS open_r, lead, sign, f1, f2, CASE WHEN loose THEN CASE sign WHEN 'ะ' THEN first || 'rà~' WHEN 'า' THEN first || 'r' ELSE '' END WHEN length(onset) = 2 THEN pair ELSE coalesce(first, '') END AS ini FROM {p}i)""",
        f"""{p}k AS (SELECT *, coalesce(CASE WHEN short THEN '' WHEN iia THEN 'iia' WHEN uea THEN 'ʉʉa' WHEN oei THEN 'əəi' WHEN lead IN ('ไ', 'ใ') THEN 'ai'
  WHEN lead <> '' THEN {look({"เ": "ee", "เา": "ao", "เิ": "əə", "แ": "ɛɛ", "แะ": "ɛ", "โ": "oo", "โะ": "o"}, 'lead || sign')}
  WHEN sign = '' THEN CASE WHEN open_r OR f1 IN ('', 'ร') THEN 'ɔɔ' ELSE 'o' END
  ELSE {look({"ะ": "a", "ั": "a", "า": "aa", "ิ": "i", "ี": "ii", "ึ": "ʉ", "ื": "ʉʉ", "ุ": "u", "ู": "uu", "ำ": "am"}, 'sign')} END, '') AS vowel,
  CASE WHEN NOT short AND (uea OR (open_r AND f1 = '')) THEN 'n' ELSE coalesce({look(O.FINAL, 'CASE WHEN NOT short AND iia THEN f2 WHEN NOT short AND oei THEN NULL ELSE f1 END')}, '') END AS fin FROM {p}j)""",
        f"{p}l AS (SELECT piece, ini || vowel || fin AS plain, {tone(tone_class('onset'), f'''(fin IN ('', 'n', 'm', 'ng') OR regexp_matches(vowel, '{_DOUBLED}'))''', 'mark', '2')} AS tone FROM {p}k)",
        f"{p}rule AS (SELECT piece, CASE WHEN {p}f.roman IS NULL THEN 'parse' ELSE 'pattern' END AS tier, coalesce({p}f.roman, {placed('plain', 'tone')}) AS roman FROM {p}l LEFT JOIN {p}f USING (piece))",
    ]


def transliterated(words: str, lexicon: str, p: str) -> list[str]:
    """{p}pc(word, idx, piece, tier, roman) and {p}tr(word, roman): an entry as a whole, else pieces within eight characters."""
    return [
        f"{p}some AS (SELECT word FROM {words} WHERE word <> '' AND word NOT IN (SELECT thai FROM {lexicon}))",
        *segments(f"{p}some", lexicon, p, 8),
        f"{p}todo AS (SELECT DISTINCT piece FROM {p}seg WHERE tier = 'rule')",
        *rules(f"{p}todo", p),
        f"""{p}pc AS (SELECT word, idx, piece, CASE WHEN s.tier = 'rule' THEN r.tier ELSE s.tier END AS tier, coalesce(translit, roman) AS roman FROM {p}seg s LEFT JOIN {p}rule r USING (piece)
  UNION ALL SELECT word, 0, word, CASE priority WHEN 0 THEN 'special' ELSE 'syllable' END, translit FROM {words} JOIN {lexicon} ON thai = word)""",
        f"{p}tr AS (SELECT word, string_agg(roman, '' ORDER BY idx) AS roman FROM {p}pc GROUP BY word)",
    ]


def components(todo: str, p: str) -> list[str]:
    """{p}comp(piece, initial, initial_thai, lead, marks, tone_mark, final, roman): the second engine."""
    short = {"า": "ao", "ิ": "əə", "็": "e", "ะ": "e", "าะ": "ɔ"}
    alone = {"ะ": "a", "ั": "a", "า": "aa", "ิ": "i", "ี": "ii", "ึ": "ʉ", "ื": "ʉʉ", "ุ": "u", "ู": "uu", "ำ": "am", "วั": "ua"}
    return [
        f"{p}ca AS (SELECT piece, {silent('piece')} AS s FROM {todo})",
        f"{p}cb AS (SELECT piece, regexp_extract(s, '^{LEAD}?') AS lead, regexp_replace(s, '^{LEAD}', '') AS body FROM {p}ca)",
        f"{p}cc AS (SELECT *, CASE WHEN regexp_matches(body, '^อย{VOWEL}') THEN 'y' WHEN starts_with(body, 'สวั') THEN 'w' ELSE '' END AS kind FROM {p}cb)",
        f"{p}cd AS (SELECT *, CASE kind WHEN 'y' THEN 'อย' WHEN 'w' THEN 'สวั' ELSE regexp_extract(body, '^{CONS}?{CONS}?') END AS head FROM {p}cc)",
        f"{p}ce AS (SELECT *, body[length(head) + 1:] AS rest, {look(O.CLUSTERS, 'head')} AS pair, {look(O.INITIAL, 'head[1]')} AS single FROM {p}cd)",
        f"""{p}cf AS (SELECT piece, CASE kind WHEN 'y' THEN 'y' WHEN 'w' THEN 's' ELSE coalesce(pair, single, '') END AS initial, head[1] AS initial_thai, lead,
  (CASE WHEN kind = 'w' THEN 'วั' WHEN kind = '' AND head[2] = 'ว' AND pair IS NULL THEN 'ว' ELSE '' END) || array_to_string(regexp_extract_all(rest, '[{O.VOWEL}็]'), '') AS marks,
  coalesce(regexp_extract_all(rest, '{TONE}')[-1], '') AS tone_mark, coalesce(regexp_extract_all(rest, '{CONS}')[-1], CASE WHEN kind = '' AND pair IS NULL AND head[2] <> 'ว' THEN head[2] END, '') AS final FROM {p}ce)""",
        f"""{p}cg AS (SELECT *, coalesce({look(O.FINAL, 'final')}, '') AS fin, CASE WHEN lead = 'เ' AND marks = '' THEN CASE final WHEN 'ย' THEN 'əəi' ELSE 'ee' END WHEN lead = 'เ' AND {look(short, 'marks')} IS NOT NULL THEN {look(short, 'marks')}
  WHEN lead = 'แ' THEN CASE WHEN marks IN ('ะ', '็') THEN 'ɛ' ELSE 'ɛɛ' END WHEN lead = 'โ' THEN CASE marks WHEN 'ะ' THEN 'o' ELSE 'oo' END WHEN lead IN ('ไ', 'ใ') THEN 'ai'
  WHEN marks = 'ว' THEN CASE final WHEN 'ย' THEN 'uai' ELSE 'ua' END WHEN marks = '' THEN CASE final WHEN '' THEN 'ɔɔ' ELSE 'o' END ELSE coalesce({look(alone, 'marks')}, '') END AS vowel FROM {p}cf)""",
        f"{p}ch AS (SELECT *, {tone(tone_class('initial_thai'), f'''(fin IN ('', 'n', 'm', 'ng', 'i', 'o') OR regexp_matches(vowel, '{_LONG}|ai|ao'))''', 'tone_mark', '2')} AS tone FROM {p}cg)",
        f"{p}comp AS (SELECT piece, initial, initial_thai, lead, marks, tone_mark, final, {placed('initial || vowel || fin', 'tone')} AS roman FROM {p}ch)",
    ]


def by_syllables(words: str, dictionary: str, layers: str, p: str) -> list[str]:
    """{p}bs(word, roman) of words without given syllables: the dictionary, else the syllables by the plain rules, ``layers``, the second engine."""
    return [
        f"{p}un AS (SELECT word FROM {words} WHERE word <> '' AND word NOT IN (SELECT thai FROM {dictionary}))",
        *split(f"{p}un", p),
        f"{p}pcs AS (SELECT DISTINCT piece FROM {p}split WHERE piece NOT IN (SELECT thai FROM {layers}))",
        *components(f"{p}pcs", p),
        f"{p}bs AS (SELECT word, string_agg(coalesce(l.translit, c.roman), '' ORDER BY idx) AS roman FROM {p}split s LEFT JOIN {layers} l ON l.thai = s.piece LEFT JOIN {p}comp c ON c.piece = s.piece GROUP BY word UNION ALL SELECT word, translit FROM {words} JOIN {dictionary} ON thai = word)",
    ]


def tokenized(words: str, dictionary: str, p: str, window: int) -> list[str]:
    """{p}tok(word, pos, token) of runs without spaces: dictionary words, and what lies between them."""
    return [
        f"{p}cut AS (SELECT word FROM {words} WHERE word <> '' AND word NOT IN (SELECT thai FROM {dictionary}) AND regexp_matches(word, '[\\x{{0E00}}-\\x{{0E7F}}]'))",
        *segments(f"{p}cut", dictionary, p, window),
        f"{p}gr AS (SELECT *, sum(CASE WHEN tier <> 'rule' OR before <> 'rule' THEN 1 ELSE 0 END) OVER (PARTITION BY word ORDER BY idx) AS pos FROM (SELECT *, lag(tier, 1, '') OVER (PARTITION BY word ORDER BY idx) AS before FROM {p}seg))",
        f"{p}tok AS (SELECT word, pos, string_agg(piece, '' ORDER BY idx) AS token FROM {p}gr GROUP BY word, pos UNION ALL SELECT word, 0, word FROM {words} WHERE word <> '' AND word NOT IN (SELECT word FROM {p}cut))",
    ]


def _clusters() -> str:
    return f"{LEAD}?{CONS}[{O.VOWEL.translate(str.maketrans('', '', O.LEADING))}{O.TONE}็์ํ]{{0,8}}|(?s:.)"


def tagged(entries: str, words: str, p: str, rounds: int) -> list[str]:
    """{p}tag(word, syllables): boundaries between clusters by the mean of the log odds of what stands around them, counted over ``entries`` (word, translit), of which the best places are counted anew in each round."""

    def places(src: str, name: str) -> list[str]:
        return [
            f"{name}a AS (SELECT word, list_transform(regexp_extract_all(word, '{_clusters()}'), lambda c: length(c)) AS sizes FROM (SELECT DISTINCT word FROM {src}))",
            f"{name}b AS (SELECT word, 1 + CAST(list_sum(sizes[1:i]) AS BIGINT) AS pos FROM (SELECT word, sizes, unnest(range(1, len(sizes))) AS i FROM {name}a))",
            f"{name} AS (SELECT word, pos, unnest(['l2' || pad[pos + 2:pos + 3], 'r2' || pad[pos + 4:pos + 5], 'l3' || pad[pos + 1:pos + 3], 'r3' || pad[pos + 4:pos + 6], 'l4' || pad[pos:pos + 3], 'r4' || pad[pos + 4:pos + 7]]) AS f FROM (SELECT word, pos, '____' || word || '____' AS pad FROM {name}b))",
        ]

    out = [
        f"{p}h AS (SELECT word, max(len(string_split(translit, '-'))) AS parts FROM {entries} GROUP BY word)",
        *split(f"{p}h", p),
        f"{p}ok AS (SELECT word FROM {p}split JOIN {p}h USING (word) GROUP BY word, parts HAVING count(*) = parts)",
        f"{p}bd AS (SELECT word, 1 + sum(length(piece)) OVER (PARTITION BY word ORDER BY idx) AS pos FROM {p}split WHERE word IN (SELECT word FROM {p}ok))",
        *places(f"{p}h", f"{p}x"),
        *places(words, f"{p}z"),
        f"{p}y0 AS MATERIALIZED (SELECT x.*, EXISTS (SELECT 1 FROM {p}bd b WHERE b.word = x.word AND b.pos = x.pos) AS boundary FROM {p}x x WHERE word IN (SELECT word FROM {p}ok))",
    ]
    for i in range(rounds + 1):
        out += [
            f"{p}s{i} AS (SELECT count(*) FILTER (WHERE boundary) / CAST(count(*) AS DOUBLE) AS share FROM {p}y{i})",
            f"{p}w{i} AS MATERIALIZED (SELECT f, ln((count(*) FILTER (WHERE boundary) + any_value(share)) / (count(*) FILTER (WHERE NOT boundary) + 1 - any_value(share))) AS weight FROM {p}y{i}, {p}s{i} GROUP BY f)",
        ]
        score = "round(avg(coalesce(weight, ln(share / (1 - share)))), 9)"
        if i < rounds:
            out += [
                f"{p}r{i} AS MATERIALIZED (SELECT word, pos, row_number() OVER (PARTITION BY word ORDER BY {score} DESC, pos) AS place FROM {p}x LEFT JOIN {p}w{i} USING (f), {p}s{i} GROUP BY word, pos)",
                f"{p}y{i + 1} AS MATERIALIZED (SELECT x.*, place < parts AS boundary FROM {p}x x JOIN {p}r{i} USING (word, pos) JOIN {p}h USING (word))",
            ]
    return [
        *out,
        f"{p}c AS (SELECT word, pos FROM {p}z LEFT JOIN {p}w{rounds} USING (f), {p}s{rounds} GROUP BY word, pos HAVING {score} > 0)",
        f"{p}e AS (SELECT word, pos, lead(pos, 1, length(word) + 1) OVER (PARTITION BY word ORDER BY pos) AS till FROM (SELECT DISTINCT word, 1 AS pos FROM {words} UNION ALL SELECT word, pos FROM {p}c))",
        f"{p}tag AS (SELECT word, list(substring(word, pos, till - pos) ORDER BY pos) AS syllables FROM {p}e GROUP BY word)",
    ]


def lattice(words: str, lexicon: str, p: str, window: int) -> list[str]:
    """{p}lat(word, idx, piece, known): all paths over the entries and clusters of each word, the best of which stays: fewest unknown characters, fewest pieces, the longest piece first."""
    return [
        f"{p}k AS (SELECT word, list_transform(regexp_extract_all(word, '{_clusters()}'), lambda c: length(c)) AS sizes FROM {words})",
        f"{p}n AS (SELECT word, n, CAST(list_sum(sizes[1:i]) AS BIGINT) - n + 1 AS pos FROM (SELECT word, sizes, unnest(sizes) AS n, unnest(range(1, len(sizes) + 1)) AS i FROM {p}k))",
        f"""{p}e AS (SELECT word, pos, n, n AS unknown FROM {p}n UNION ALL SELECT DISTINCT x.word, x.pos, k.n, 0 FROM {p}n x, (SELECT unnest(range(1, {window + 1})) AS n) k JOIN {lexicon} l ON l.thai = x.word[x.pos:x.pos + k.n - 1]
  WHERE x.pos + k.n - 1 <= length(x.word) AND (x.pos + k.n - 1 = length(x.word) OR EXISTS (SELECT 1 FROM {p}n y WHERE y.word = x.word AND y.pos = x.pos + k.n)))""",
        f"{p}p AS (SELECT word, CAST(1 AS BIGINT) AS done, CAST(0 AS BIGINT) AS u, 0 AS w, CAST([] AS BIGINT[]) AS lens, CAST([] AS BOOLEAN[]) AS known FROM {words} UNION ALL SELECT {p}p.word, done + e.n, u + unknown, w + 1, list_append(lens, -e.n), list_append(known, unknown = 0) FROM {p}p JOIN {p}e e ON e.word = {p}p.word AND e.pos = done)",
        f"{p}b AS (SELECT word, lens, known FROM {p}p WHERE done = length(word) + 1 QUALIFY row_number() OVER (PARTITION BY word ORDER BY u, w, lens, known DESC) = 1)",
        f"{p}lat AS (SELECT word, CAST(i - 1 AS INT) AS idx, substring(word, 1 - coalesce(CAST(list_sum(lens[1:i - 1]) AS BIGINT), 0), -lens[i]) AS piece, known[i] AS known FROM (SELECT *, unnest(range(1, len(lens) + 1)) AS i FROM {p}b))",
    ]


def query(*parts: list[str] | str) -> str:
    """WITH RECURSIVE of the expressions given, and the last part as what is selected."""
    *ctes, final = parts
    return "WITH RECURSIVE " + ",\n".join(c for part in ctes for c in ([part] if isinstance(part, str) else part)) + "\n" + final
