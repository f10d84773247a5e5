"""The table functions called from SQL give what the DataFrame calls give."""

import pytest

from krathong.operators import evaluate as E
from krathong.operators import lines as N
from krathong.operators import segment as G
from krathong.operators import tablefunctions as T


@pytest.fixture(scope="module")
def tables(spark):
    lex = [("มา", "maa", 1), ("ดี", "dii", 1), ("ไม้", "máai", 0), ("ดี", "dii!", 0)]
    spark.createDataFrame(lex, "thai string, translit string, priority int").createOrReplaceTempView("tf_lex")
    spark.createDataFrame([("มาดี", "maa-dii"), ("กองมา", "gɔɔng-maa"), ("นก <ตัว>", "nók"), ("แดง", "dɛɛng")], "thai string, translit string").createOrReplaceTempView("tf_dict")
    spark.createDataFrame([("มาดี",), ("กองมา",), ("ไม้",), ("ดี",), ("มา",), ("",), (None,), ("มา",)], "word string").createOrReplaceTempView("tf_words")
    names = T.register_tables(spark, "tf_words", "tf_dict", "tf_lex", prefix="x_")
    assert names == ["x_transliterate", "x_romanize", "x_explain", "x_lookup_special", "x_lookup_syllable", "x_dictionary_test"]
    return spark.table("tf_words"), spark.table("tf_dict"), spark.table("tf_lex")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_calls_equal_the_operators(spark, tables):
    words, entries, lex = tables
    each = "SELECT t.* FROM (SELECT DISTINCT word FROM tf_words) v, LATERAL {}(v.word) t"
    assert rows(spark.sql(each.format("x_transliterate"))) == rows(G.transliterate(words, lex)) != []
    assert rows(spark.sql(each.format("x_romanize"))) == rows(N.romanize_words(words, entries, lex)) != []
    assert rows(spark.sql(each.format("x_explain"))) == rows(G.explain(words, lex)) != []
    assert rows(spark.sql(each.format("x_lookup_special"))) == [("ดี", "dii!"), ("ไม้", "máai")]
    assert rows(spark.sql(each.format("x_lookup_syllable"))) == [("ดี", "dii"), ("มา", "maa")]


def test_one_word_and_none(spark, tables):
    words, entries, lex = tables
    assert spark.sql("SELECT roman FROM x_transliterate('มา')").collect()[0].roman == "maa"
    assert spark.sql("SELECT * FROM x_explain('ที่ไม่มี')").collect() == [] == spark.sql("SELECT * FROM x_romanize(NULL)").collect()


def test_dictionary_test(spark, tables):
    words, entries, lex = tables
    keys = entries.selectExpr("regexp_replace(thai, '<[^>]+>', '') AS word")
    want = E.dictionary_report(E.dictionary_results(entries, G.transliterate(keys, lex)))
    got = spark.sql("SELECT * FROM x_dictionary_test('rules')")
    assert [r[1:] for r in rows(got)] == rows(want) and got.first().total == 3
    assert spark.sql("SELECT accuracy FROM x_dictionary_test('dictionary')").first().accuracy == 100.0
