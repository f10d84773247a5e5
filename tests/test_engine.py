"""Every catalog query against its SQL oracle, and the traced behaviours of the text and syllable rules."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from krathong.functions import components as P
from krathong.functions import syllables as S
from krathong.functions import textnorm as X
from krathong.operators import evaluate as E
from krathong.operators import lines as N
from krathong.operators import segment as G
from krathong.operators import syllabic as Y
from krathong.plans import catalog
from krathong.sources import vocabulary

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _key(v):
    if isinstance(v, (list, tuple)):
        return repr([_key(x) for x in v])
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return v if isinstance(v, str) else f"{float(v):.6f}"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = duck.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(got.columns)
    a = sorted(tuple(_key(r[c]) for c in cols) for r in df.collect())
    at = [got.columns.index(c) for c in cols]
    b = sorted(tuple(_key(r[i]) for i in at) for r in got.fetchall())
    assert a == b


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("f", "x", "want"),
    [
        (X.remove_silent, "สันต์", "สัน"),
        (X.remove_silent, "พันธุ์", "พัน"),
        (X.number_words, "0", "sǔun"),
        (X.number_words, "11", "sìp èt"),
        (X.number_words, "20", "yîi sìp"),
        (X.number_words, "07", " jèt"),
        (X.number_words, "00", ""),
        (X.number_words, "100", "nʉ̀ng sǔun sǔun"),
        (X.normalize_numbers, "a5b", "a hâab"),
        (X.normalize_numbers, None, None),
        (X.contains_thai, "฿", True),
        (X.normalize, "", ""),
        (X.strip_tones, "nâa ɔ̌ɔ", "naa ɔɔ"),
        (lambda c: S.from_parts(S.pattern_parts(c)), "กอง", "gɔong"),
        (lambda c: S.build(S.parse(c)), "บ้า", "bâa"),
        (lambda c: S.build(S.parse(c)), "หก", "hòk"),
        (lambda c: S.build(S.parse(c)), "จระ", "jrà~"),
        (lambda c: S.build(S.parse(c)), "จริง", "ing"),
        (lambda c: S.build(S.parse(c)), "เพื่อน", "pʉ̂ʉan"),
        (lambda c: S.build(S.parse(c)), "เดี่ยว", "dìiao"),
        (lambda c: S.build(S.parse(c)), "ร", "rɔɔn"),
        (lambda c: S.build(S.parse(c)), "โต๊ะ", "dtó"),
        (lambda c: S.build(S.parse(c)), "", "ɔɔ"),
        (lambda c: S.build(S.parse(c)), None, None),
        (S.match_pattern, "ฟฟฟฟ", None),
        (lambda c: S.from_parts(S.pattern_parts(c)), "เรียน", "riian"),
        (lambda c: S.from_parts(S.pattern_parts(c)), "กระ", "gà"),
        (lambda c: S.from_parts(S.pattern_parts(c)), "มาก", "mâak"),
        (lambda c: S.from_parts(S.pattern_parts(c)), "แข็ง", "kɛ̌ng"),
        (lambda c: S.from_parts(S.pattern_parts(c)), "นก", "nók"),
        (lambda c: S.from_parts(S.pattern_parts(c)), None, None),
        (lambda c: P.romanize(P.components(c)), "อยู่", "yùu"),
        (lambda c: P.romanize(P.components(c)), "สวัส", "sùat"),
        (lambda c: P.romanize(P.components(c)), "ด้วย", "dôi"),
        (lambda c: P.romanize(P.components(c)), "หมา", "mǎa"),
        (lambda c: P.romanize(P.components(c)), "เลย", "ləəii"),
        (lambda c: P.romanize(P.components(c)), "", "ɔɔ"),
        (lambda c: P.romanize(P.components(c)), None, None),
    ],
)
def test_traced(spark, f, x, want):
    assert one(spark, f, x) == want


@pytest.mark.parametrize(("e", "g", "n"), [("a b c", "b c", 0), ("a b", "a x b", 2), ("a", "", 0)])
def test_greedy(spark, e, g, n):
    row = spark.createDataFrame([(e.split(), g.split())], "e array<string>, g array<string>")
    assert row.select(E.greedy_matches(F.col("e"), F.col("g"))).first()[0] == n


def test_segments_cover_their_word(spark):
    words = spark.createDataFrame([("แดงกอง",), ("",), (None,), ("แดงกอง",), ("abc",)], "word string")
    lex = spark.createDataFrame([("แดง", "dɛɛng", 1)], "thai string, translit string, priority int")
    got = {}
    for r in G.segment(words, lex).orderBy("word", "idx").collect():
        got.setdefault(r.word, []).append(r.piece)
    assert {w: "".join(p) for w, p in got.items()} == {"แดงกอง": "แดงกอง", "abc": "abc"}
    assert got["แดงกอง"] == ["แดง", "กอ", "ง"]  # after the entry the rules: without a vowel the next consonant is the final


def test_assigned_syllables(spark):
    rows = [("มากา", ["มา", "กา"]), ("มากา", ["x", "มา", "กา", "นก"]), ("มากา", ["มา"]), ("มากา", []), ("มากา", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "w string, s array<string>").coalesce(1).select(Y.assign(F.col("w"), F.col("s"))).collect()]
    assert got == [["มา", "กา"]] * 5


def test_words_by_syllables(spark):
    words = spark.createDataFrame([("มากา", ["มา", "กา"]), ("มากา", ["มา", "กา"]), ("ดี", None), ("", None), (None, None)], "word string, syllables array<string>")
    table = lambda *r: spark.createDataFrame(r, "thai string, translit string")
    got = Y.by_syllables(words, table(("ดี", "dii!")), table(("มา", "maa1")), table(("มา", "maa2"), ("กา", "gaa2"))).collect()
    assert sorted((r.word, r.roman) for r in got) == [("", ""), ("ดี", "dii!"), ("มากา", "maa1gaa2")]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a1.txt").write_text("big, large,ใหญ่,yài,,adj\nno thai here\n")
    (tmp_path / "t.tsv").write_text("# c\n\nมา\tmaa\nx\t\n")
    (tmp_path / "c1.txt").write_text("﻿a\\Nb\n\n")
    r = vocabulary.read_vocabulary(spark, str(tmp_path / "v")).collect()
    assert [(x.gloss, x.thai, x.translit, x.line_no) for x in r] == [("big, large", "ใหญ่", "yài", 1)]
    assert [(x.thai, x.translit) for x in vocabulary.read_secondary(spark, str(tmp_path / "t.tsv")).collect()] == [("มา", "maa")]
    assert vocabulary.read_corpus(spark, str(tmp_path / "c*.txt"), ".txt").orderBy("line_no").first().text == "a b"
    vocabulary.write_draft(spark.createDataFrame([("ข",), ("ก",)], "word string"), str(tmp_path / "out"))
    assert [x.value for x in spark.read.text(str(tmp_path / "out")).collect()] == ["ก\t", "ข\t"]


def test_stream(spark, tmp_path):
    from krathong.streaming import normalize

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Pai MǍI\n")
    normalize.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first().normalized == "pai mai"


def test_flagship_and_rows_only_queries(spark):
    rows = catalog.queries()["sentence_pipeline"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/part.parquet").count() and all(r.roman for r in rows)
    pieces = catalog.queries()["explain_word"](spark, SF)
    joined = {r.word: r.roman for r in catalog.queries()["transliterate_words"](spark, SF).collect()}
    again = {}
    for r in pieces.orderBy("word", "idx").collect():
        again[r.word] = again.get(r.word, "") + (r.roman or "")
    assert joined == again

def test_lines_and_sentences(spark):
    table = lambda *r: spark.createDataFrame(r, "thai string, translit string")
    words, lex = table(("แดง", "dɛɛng"), ("ฟ้า", "fáa"), ("แดง ฟ้า", "both")), spark.createDataFrame([("กา", "gaa", 1)], "thai string, translit string, priority int")
    rows = [("f", 1, "﻿แดงฟ้า"), ("f", 2, "# แดง"), ("f", 3, ""), ("f", 4, "plain"), ("f", 5, "แดง  ฟ้ากา"), ("f", 6, "กา แดงกา"), ("f", 5, "แดง  ฟ้ากา"), ("f", 7, None)]
    got = sorted((r.line_no, r.roman, r.fallback) for r in N.romanize_lines(spark.createDataFrame(rows, "file string, line_no int, text string"), words, lex).collect())
    assert got == [(1, "dɛɛng fáa", False), (2, "# แดง", False), (3, "", False), (4, "plain", False), (5, "dɛɛng fáa gaa", False), (5, "dɛɛng fáa gaa", False), (6, "gaa dɛɛng gaa", False), (7, None, False)]
    texts = spark.createDataFrame([("แดง ฟ้า",), ("แดงฟ้า",), ("แดง ฟ้ากา",), ("",), (None,)], "text string")
    got = {r.text: r.roman for r in N.romanize_sentences(texts, words, table(("กา", "gaa1")), table(("กา", "gaa2"))).collect()}
    assert got == {"แดง ฟ้า": "both", "แดงฟ้า": "dɛɛng-fáa", "แดง ฟ้ากา": "dɛɛng fáa gaa1", "": ""}
    assert N.romanize_lines(spark.createDataFrame([], "file string, line_no int, text string"), words, lex).collect() == []


def test_given_syllables(spark):
    rows = [("a", ["มา", "ๆ", "กา"]), ("b", ["ๆ", "ก์", "มา", "ก์", "ๆ", "ๆ"]), ("กา", []), ("กา", None), ("c", ["ก์"]), (None, ["มา"]), ("a", ["มา", "ๆ", "กา"])]
    table = lambda *r: spark.createDataFrame(r, "thai string, translit string")
    lex = spark.createDataFrame([("กา", "gaa", 1)], "thai string, translit string, priority int")
    got = N.by_given_syllables(spark.createDataFrame(rows, "word string, syllables array<string>"), table(("มา", "maa")), table(("มา", "no"), ("กา", "gaa!")), lex).collect()
    assert sorted((r.word, r.syllables is None, r.roman, r.fallback) for r in got) == [("a", False, "maa-maa-gaa!", False), ("b", False, "maa-maa-maa", False), ("c", False, "", False), ("กา", False, "gaa", True), ("กา", True, "gaa", True)]


def test_dictionary_results(spark):
    d = spark.createDataFrame([("มา<n>", "ma-a"), ("ไป ไหน", "x"), ("กา", "gáa"), ("นา", "naa")], "thai string, translit string")
    r = spark.createDataFrame([("มา", "maa"), ("กา", "gàa")], "word string, roman string")
    got = E.dictionary_results(d, r).collect()
    assert sorted((x.thai, x.got, x.passed) for x in got) == [("กา", "gàa", True), ("นา", None, False), ("มา<n>", "maa", True)]


def test_corpus_results(spark):
    rows = [("n", 1, " ไป มา ", "Bpai maa!", "bpai maa"), ("n", 2, "ไป", "bpai", None), ("n", 3, "# Aegisub x", "a", "a"), ("n", 4, "ไป 7", "a", "a"), ("n", 5, "ไปๆ", "a", "a"), ("n", 6, "ไป", "sà", "a"), ("n", 7, "ไป", "!", "a"), ("n", 8, "  ", "a", "a"), ("n", 9, "ไป มา", "a b", "x b"), ("n", 10, "# ไป", "sè", "a"), (None, 11, None, None, None)]
    got = E.corpus_results(spark.createDataFrame(rows, "name string, line_no int, input string, expected string, got string")).orderBy("line_no")
    assert [(r.line_no, r.correct, r.matched or 0, r.words) for r in got.collect()] == [(1, True, 2, 2), (2, False, 0, None), (6, False, 0, 1), (9, False, 0, 2)]
    r = E.corpus_report(got).first()
    assert (r.lines, r.lines_correct, r.fallbacks, r.words, r.matched, r.line_accuracy, r.word_accuracy) == (4, 1, 1, 5, 2, 25.0, 40.0)
    none = E.corpus_report(got.filter("false")).first()
    assert (none.lines, none.words, none.line_accuracy, none.word_accuracy) == (0, 0, None, None)


def test_discovery_and_failure_log(spark, tmp_path):
    for name, text in (("test2.txt", "ก\nข"), ("test2_gold.txt", "a\nb"), ("test10.txt", "ก\\Nค"), ("test10_gold.txt", "a b"), ("test3.txt", "ก"), ("test3_gold.txt", "a\nb"), ("test4.txt", "ก")):
        (tmp_path / name).write_text(text)
    got = vocabulary.discover_corpus(spark, str(tmp_path), ".txt", "_gold.txt").orderBy(X.first_number(F.col("name")), "name", "line_no").collect()
    assert [tuple(r) for r in got] == [("test2", 1, "ก", "a"), ("test2", 2, "ข", "b"), ("test10", 1, "ก ค", "a b")]
    vocabulary.write_failures(spark.createDataFrame([("n", 3, "ก", "a", "b")], "name string, line_no int, input string, expected string, got string"), str(tmp_path / "log"))
    assert "".join(p.read_text() for p in (tmp_path / "log").glob("part-*.txt")) == "[n:3] ก\n  Expected: a\n  Got:      b\n\n"


def test_long_entries_are_found_whole(spark):
    long, longer = "วิไกรโรจน์", "น้ำแข็งใหญ่ใหม่เย็นร้อนแดงจาน"
    assert len(long) > G.WINDOW and len(longer) > 24
    lex = spark.createDataFrame([(long, "syllable", 1), (long, "special", 0), ("มา", "maa", 1)], "thai string, translit string, priority int")
    words = spark.createDataFrame([(long,), ("มา",), (long + "มา",), (None,), ("",)], "word string")
    got = {(r.word, r.idx): (r.piece, r.tier, r.roman) for r in G.explain(words, lex).collect()}
    assert got[long, 0] == (long, "special", "special") and (long, 1) not in got and got["มา", 0] == ("มา", "syllable", "maa")
    assert got[long + "มา", 0][1] not in ("special", "syllable")
    assert {r.word: r.roman for r in G.transliterate(words, lex).collect()}[long] == "special"
    dictionary = spark.createDataFrame([(longer, "x"), ("มา", "maa")], "thai string, translit string")
    run = spark.createDataFrame([("มา" + longer + "มา",)], "word string")
    assert [r.token for r in N.tokens(run, dictionary).orderBy("pos").collect()] == ["มา", longer, "มา"]
    assert N.tokens(run, dictionary.limit(0)).count() == 1


def test_long_runs_are_cut_in_linear_time(spark):
    import time

    lex = spark.createDataFrame([("แดง", "dɛɛng", 1), ("ตลาด", "dta", 1)], "thai string, translit string, priority int")
    text = "แดงกองบ้าเรียนกระทะตลาดประเทศ"
    run, marks = text * (20_000 // len(text)), "ก" + "่" * 5000 + "า" * 100
    began = time.time()
    rows = G.segment(spark.createDataFrame([(run,), (marks,), (run,)], "word string"), lex).orderBy("word", "idx").collect()
    assert "".join(r.piece for r in rows if r.word == run) == run and [r.piece for r in rows if r.word == marks] == [marks]
    short = [r.piece for r in G.segment(spark.createDataFrame([(text * 3,)], "word string"), lex).orderBy("idx").collect()]
    assert [r.piece for r in rows if r.word == run][: len(short) - 8] == short[:-8]
    found = N.tokens(spark.createDataFrame([("ตลาดนก" * 3000,)], "word string"), lex.select("thai", "translit")).orderBy("pos").collect()
    assert [r.token for r in found] == ["ตลาด", "นก"] * 3000
    assert time.time() - began < 90


def test_sql_functions(spark):
    from krathong.functions import registry

    names = registry.register(spark, "th_")
    assert len(set(names)) == len(registry.FUNCTIONS)
    rows = spark.createDataFrame([("บ้า<x> é a-b~ 12",), ("พันธุ์กระทะ",), ("é  ǎ\u00a0x",), ("",), (None,)], "s string")
    rows.createOrReplaceTempView("th_rows")
    pairs = {"contains_thai": X.contains_thai, "contains_digit": X.contains_digit, "has_precomposed": X.has_precomposed, "strip_markers": X.strip_markers, "fold_separators": X.fold_separators, "strip_tones": X.strip_tones, "compose": X.nfc, "collapse_space": X.collapse, "remove_silent_consonants": X.remove_silent, "extract_syllables": S.extract_syllables, "first_number": X.first_number}
    for name, f in pairs.items():
        got = spark.sql(f"SELECT s, th_{name}(s) AS y FROM th_rows").collect()
        assert sorted(map(repr, got)) == sorted(map(repr, rows.select("s", f(F.col("s")).alias("y")).collect())), name
    spark.createDataFrame([("มา", "maa")], "thai string, translit string").createOrReplaceTempView("th_lexicon")
    registry.register_lookup(spark, "th_lookup", "th_lexicon")
    assert [r[0] for r in spark.sql("SELECT th_lookup(s) FROM VALUES ('มา'), ('x') AS t(s)").collect()] == ["maa", None]


def test_composition_of_any_text(spark):
    import unicodedata

    texts = ["é ǎ Å 가", "ạ̈ q̣̇", "กำ น้ำ", "plain", "", None, "\u1e9b\u0323", "A\u030a" * 3000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1).select(X.nfc(F.col("s"))).collect()]
    assert got == [t and unicodedata.normalize("NFC", t) for t in texts]


def test_character_references(spark, tmp_path):
    (tmp_path / "a1.txt").write_text("x,กา &lt;n&gt;&nbsp;&#3585;&hellip;&notanentity;,g&aacute;a&apos;,,n\n")
    r = vocabulary.read_vocabulary(spark, str(tmp_path)).first()
    assert (r.thai, r.translit) == ("กา <n>\u00a0ก…&notanentity;".replace("&not", "¬"), "gáa'")


def test_missing_secondary_lexicon_is_empty(spark, tmp_path):
    assert vocabulary.read_secondary(spark, str(tmp_path / "none.tsv")).collect() == []
    (tmp_path / "t.tsv").write_text("มา\tmaa\n")
    assert vocabulary.read_secondary(spark, str(tmp_path / "t.tsv")).columns == vocabulary.read_secondary(spark, str(tmp_path / "none.tsv")).columns


def test_rules_only_run_and_verdicts(spark):
    rows = [("n", 1, "\ufeffไป", "sà", "sà"), ("n", 2, "ไปๆ", "a b", "a"), ("n", 3, "ไป", "a", None), ("n", 4, "ไป 7", "a", "a"), ("n", 5, "\ufeff# Aegisub", "a", "a"), ("n", 6, "\ufeff", "a", "a")]
    df = spark.createDataFrame(rows, "name string, line_no int, input string, expected string, got string")
    got = E.corpus_results(df, by_rules=True).orderBy("line_no").collect()
    assert [(r.line_no, r.matched, r.words) for r in got] == [(1, 1, 1), (2, 1, 2)]
    assert [r.line_no for r in E.corpus_results(df).orderBy("line_no").collect()] == [1, 3, 5, 6]
    table = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a"), (None, None)], "x string, y string")
    assert [r[0] for r in table.coalesce(1).select(X.verdict(F.col("x"), F.col("y"))).collect()] == ["OK", "FAIL", "FAIL", "FAIL"]


def test_working_tables_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from krathong.operators import tables

    mark = tables.made()
    one, two = (tables.materialize(spark.range(3)) for _ in range(2))
    assert tables.release(spark, mark, but_last=1) == 1 and two.count() == 3 and tables.made() == mark + 1
    assert tables.release(spark, mark) == 1

    class Session:
        conf = {"spark.master": "spark://host:7077", "spark.sql.warehouse.dir": "/tmp/x"}

    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        Session.conf["spark.master"] = master
        with pytest.raises(RuntimeError):
            tables.shared_folder(Session)
    Session.conf["spark.checkpoint.dir"] = "hdfs:///shared/"
    assert tables.shared_folder(Session) == "hdfs:///shared"
