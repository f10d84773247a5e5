"""The bucketed lexicon: same rows as the plain joins, no shuffle of its side, bits that tell most missing words."""

import pytest

from krathong.operators import largelexicon as B
from krathong.operators import lexicon as K


@pytest.fixture(scope="module")
def kept(spark):
    lex = spark.range(3000).selectExpr("concat('ก', id * 7 % 5000) AS thai", "concat('r', id) AS translit").unionAll(spark.sql("SELECT CAST(NULL AS STRING), 'x' UNION ALL SELECT 'twice', 'b' UNION ALL SELECT 'twice', 'a'"))
    yield B.keep(lex, "kept_lexicon", 8), lex
    B.drop(spark, "kept_lexicon")


def words(spark):
    return spark.range(4000).selectExpr("concat('ก', id) AS word").unionAll(spark.sql("SELECT CAST(NULL AS STRING) UNION ALL SELECT 'twice' UNION ALL SELECT 'ก7'"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_equals_the_plain_joins(spark, kept):
    table, lex = kept
    bits = B.bits_of(table)
    w = words(spark)
    one = lex.groupBy("thai").agg({"translit": "min"}).toDF("thai", "translit")
    assert rows(B.lookup(w, table, bits)) == rows(K.lookup(w.distinct(), one).select("word", "translit"))
    assert rows(B.lacking(w, table, bits)) == rows(w.filter("word is not null").distinct().join(one, w.word == one.thai, "left_anti"))
    assert ("twice", "a") in rows(B.lookup(w, table, bits)) and ("ก100",) in rows(B.lacking(w, table, bits))


def test_bits_tell_most_missing_words(spark, kept):
    table, _ = kept
    marked = B.with_maybe(words(spark).distinct(), B.bits_of(table))
    held = {r.thai for r in table.collect()}
    got = {r.word: r.maybe for r in marked.collect()}
    assert all(m for w, m in got.items() if w in held) and not got[None]
    assert sum(m for w, m in got.items() if w not in held) < 5
    assert rows(B.lacking(words(spark), table.limit(0), B.bits_of(table.limit(0)))) == rows(words(spark).filter("word is not null").distinct())


@pytest.mark.parametrize("call", [B.lookup, B.lacking])
def test_the_lexicon_is_not_shuffled(spark, kept, call):
    table, _ = kept
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = call(words(spark), table, B.bits_of(table))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert "hashpartitioning(word" in plan and "hashpartitioning(thai" not in plan
