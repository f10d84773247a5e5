"""Readers and sinks of vocabulary, secondary lexicon, corpus and draft files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.textnorm import strip_bom, trim_space, unescape_html
from ..operators.evaluate import pair_lines
from ..operators.tables import materialize


#: Up to so many splits are broadcast, a row each: at 128 MB a split, 500 TB.
SPLITS = 4_000_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, numbers from 1; a file of any size is shared by many tasks.

    The text reader deals each file in splits, whose lines keep their order. How many lines each split has is counted first; the lines before a
    split are the prefix sum of its file's splits, and a line's place within its split is how far its running row number is from the split's least. So lines are
    read twice but never shuffled; what is joined back is one row a split. Lines end at line feeds, a carriage return before one goes, and
    nothing follows a last line feed.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select("value", F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))).alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    splits = materialize(rows.groupBy("path", "at").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    shift = splits.select(F.col("path").alias("p"), F.col("at").alias("a"), (F.coalesce(before, F.lit(0)) - F.col("least") + 1).alias("shift"))
    if splits.count() <= SPLITS:
        shift = F.broadcast(shift)
    placed = rows.join(shift, (F.col("path") == F.col("p")) & (F.col("at") == F.col("a")))
    return placed.select("file", (F.col("id") + F.col("shift")).alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line"))


def vocabulary_rows(lines: DataFrame) -> DataFrame:
    """(file, line_no, gloss, thai, translit) of every line ``gloss,thai,translit,...`` of (file, line_no, line); the gloss may hold commas."""
    rows = lines.withColumn("tail", F.regexp_extract("line", r"(.*),(.*\p{IsThai}.*)", 2)).filter("tail <> ''")
    cells = F.split("tail", ",")
    return rows.select("file", "line_no", F.regexp_extract("line", r"(.*),(.*\p{IsThai}.*)", 1).alias("gloss"), unescape_html(F.get(cells, F.lit(0))).alias("thai"), unescape_html(F.coalesce(F.get(cells, F.lit(1)), F.lit(""))).alias("translit"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return vocabulary_rows(numbered_lines(spark, path))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def read_secondary(spark: SparkSession, path: str) -> DataFrame:
    """(thai, translit, file, line_no) of tab-separated lines; blank lines, # comments and half-empty rows are dropped.

    A file that is not there is an empty lexicon.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], "thai string, translit string, file string, line_no long")
    return secondary_rows(numbered_lines(spark, path))


def secondary_rows(lines: DataFrame) -> DataFrame:
    """(thai, translit, file, line_no) of tab-separated lines (file, line_no, line), white space of any kind trimmed from the line and from both sides."""
    lines = lines.select(trim_space(F.col("line")).alias("line"), "file", "line_no").filter("line <> '' and not startswith(line, '#')")
    cells = F.split("line", "\t", 2)
    return lines.select(trim_space(F.get(cells, F.lit(0))).alias("thai"), trim_space(F.get(cells, F.lit(1))).alias("translit"), "file", "line_no").filter("thai <> '' and translit <> ''")


def subtitle_line(line):
    """A written line break becomes a space, a mark of byte order goes."""
    return F.replace(strip_bom(line), F.lit("\\N"), F.lit(" "))


def read_corpus(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(name, line_no, text) of files ``<name><suffix>``; a written line break becomes a space, a BOM goes."""
    rows = numbered_lines(spark, path).filter(F.col("file").endswith(suffix))
    return rows.select(F.expr(f"substring(file, 1, char_length(file) - {len(suffix)})").alias("name"), "line_no", subtitle_line(F.col("line")).alias("text"))


def discover_corpus(spark: SparkSession, path: str, input_suffix: str, golden_suffix: str) -> DataFrame:
    """(name, line_no, input, expected) of all pairs ``<name><input_suffix>`` and ``<name><golden_suffix>`` under a folder.

    A name with one side only, or with unequally many lines, is left out. Names in natural order:
    ``orderBy(first_number(name), name, line_no)``.
    """
    at = path.rstrip("/")
    inputs = read_corpus(spark, f"{at}/*{input_suffix}", input_suffix)
    if input_suffix.endswith(golden_suffix) or golden_suffix.endswith(input_suffix):
        inputs = inputs.filter(~F.concat("name", F.lit(input_suffix)).endswith(golden_suffix)) if len(golden_suffix) > len(input_suffix) else inputs
    golden = read_corpus(spark, f"{at}/*{golden_suffix}", golden_suffix)
    pairs = pair_lines(inputs, golden.withColumnRenamed("text", "expected"))
    return pairs.select("name", "line_no", F.col("text").alias("input"), "expected")


def failure_records(failures: DataFrame) -> DataFrame:
    """(value) of each failure (name, line_no, input, expected, got): three lines and an empty one."""
    return failures.select(F.format_string("[%s:%d] %s\n  Expected: %s\n  Got:      %s\n", "name", "line_no", "input", "expected", "got").alias("value"))


def write_failures(failures: DataFrame, path: str) -> None:
    failure_records(failures).write.text(path)


def write_draft(words: DataFrame, path: str) -> None:
    """A draft dictionary: each word and a tab, in byte order."""
    words.select(F.concat("word", F.lit("\t")).alias("value")).orderBy("value").write.text(path)
