"""Lookups in a lexicon that is too large to broadcast: a table bucketed by its key, and bits that say which words it can't have.

The table is written once in buckets, sorted, so a join with it shuffles the words only. Before the join each word's hash is held against a table of bits of
at most 16 MB, which is broadcast whatever the lexicon's size: most words that the lexicon lacks are told there and never shuffled. Bits that several words
share let some through, which the join then drops; a lexicon of more words than there are bits lets all through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the table: 4,096 rows of 4 KB at most.
BITS = 1 << 27


def keep(lexicon: DataFrame, name: str, buckets: int | None = None) -> DataFrame:
    """Writes (thai, translit), each word once, as the bucketed table ``name`` of the session's catalog and returns it.

    As many buckets as shuffle partitions if not given: with fewer, Spark may shuffle the table again to have more tasks.
    """
    buckets = buckets or int(lexicon.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = lexicon.filter("thai is not null").groupBy("thai").agg(F.min("translit").alias("translit"))
    one.repartition(buckets, "thai").write.mode("overwrite").bucketBy(buckets, "thai").sortBy("thai").saveAsTable(name)
    return lexicon.sparkSession.table(name)


def _bit(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BITS))


def bits_of(table: DataFrame) -> DataFrame:
    """(k, bits): the bits that the words of a lexicon set."""
    return table.select(_bit(F.col("thai")).alias("m")).groupBy(F.bitmap_bucket_number("m").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("m")).alias("bits"))


def with_maybe(words: DataFrame, bits: DataFrame, word_col: str = "word") -> DataFrame:
    """Adds ``maybe``: false where the lexicon surely lacks the word, null words included."""
    m = _bit(F.col(word_col))
    at = F.bitmap_bit_position(m).cast("int")
    rows = words.join(F.broadcast(bits), F.bitmap_bucket_number(m) == F.col("k"), "left")  # at most 4,096 rows of 4 KB
    byte = F.conv(F.hex(F.substr("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("maybe", F.coalesce(F.col(word_col).isNotNull() & (F.getbit(byte, at % 8) == 1), F.lit(False))).drop("k", "bits")


def lookup(words: DataFrame, table: DataFrame, bits: DataFrame) -> DataFrame:
    """(word, translit) of each distinct word, null where the table lacks it; a null word is a word that it lacks."""
    rows = with_maybe(words.select("word").distinct(), bits)
    found = rows.filter("maybe").join(table.hint("merge"), F.col("word") == F.col("thai"), "left").select("word", "translit")
    return found.unionAll(rows.filter("not maybe").select("word", F.lit(None).cast("string").alias("translit")))


def lacking(words: DataFrame, table: DataFrame, bits: DataFrame) -> DataFrame:
    """(word) of each distinct word that the table lacks; null is none."""
    rows = with_maybe(words.select("word").filter("word is not null").distinct(), bits)
    rest = rows.filter("maybe").join(table.hint("merge"), F.col("word") == F.col("thai"), "left_anti").select("word")
    return rest.unionAll(rows.filter("not maybe").select("word"))


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
