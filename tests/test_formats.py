"""The data source formats: equal to the plain readers, ranges and filters, a log that comes whole or not at all."""

import pytest
from pyspark.sql import functions as F

from krathong.sources import formats as S
from krathong.sources import vocabulary as R


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    assert S.register(spark) == ["vocabulary", "secondary_lexicon", "failure_log"]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a1.txt").write_text("to go, to come,มา,maa,slang\nno word, here\nn&lt;x&gt;,&lt;n&gt;ดี,dii\r\n\nมา without\nlast,ไป", encoding="utf-8")
    (tmp_path / "b2.txt").write_text("".join(f"gloss {i},คำ{i},r{i}\n" for i in range(400)), encoding="utf-8")
    (tmp_path / "c3.txt").write_text("")
    (tmp_path / "_hidden.txt").write_text("x,ก,y\n")
    return tmp_path


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_vocabulary_equals_the_plain_reader(spark, folder, split):
    rows = spark.read.format("vocabulary").option("splitBytes", split).load(str(folder))
    want = sorted((r.file, r.gloss, r.thai, r.translit) for r in R.read_vocabulary(spark, str(folder)).collect())
    got = rows.collect()
    assert sorted((r.file, r.gloss, r.thai, r.translit) for r in got) == want and len(got) == 403
    order = [r.gloss for r in sorted(got, key=lambda r: r.at) if r.file == "b2.txt"]
    assert order == [f"gloss {i}" for i in range(400)]


def test_ranges_share_all_lines(tmp_path):
    text = "ab\n\nก\r\nlonger line\n\n\nx"
    (tmp_path / "t").write_bytes(text.encode())
    size = len(text.encode())
    want = list(S.lines_of(S.Range(str(tmp_path / "t"), 0, size)))
    assert [x for _, x in want] == ["ab", "", "ก", "longer line", "", "", "x"]
    for step in range(1, size + 1):
        assert [x for a in range(0, size, step) for x in S.lines_of(S.Range(str(tmp_path / "t"), a, min(a + step, size)))] == want


def test_filters_reach_the_reader(spark, folder):
    rows = spark.read.format("vocabulary").option("splitBytes", 512).load(str(folder))
    every = rows.rdd.getNumPartitions()
    assert rows.filter(F.col("file") == "a1.txt").rdd.getNumPartitions() < every
    assert [(r.file, r.translit) for r in rows.filter("file like 'b%' AND thai IN ('คำ7', 'มา')").collect()] == [("b2.txt", "r7")]
    assert rows.filter("length(thai) = 2 AND file = 'a1.txt'").count() == 2
    reader = S.LineReader({"path": str(folder)}, S.Vocabulary.columns, S.vocabulary_cells)
    left = list(reader.pushFilters([S.EqualTo(("file",), "a1.txt"), S.In(("thai",), ("มา",)), S.StringStartsWith(("gloss",), "to"), S.EqualTo(("x", "y"), 1)]))
    assert len(left) == 1 and [r[3] for p in reader.partitions() for r in reader.read(p)] == ["มา"]


def test_secondary(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# note\n\tมา\tmaa\nมา \t maa2\t\nไป\t\n\nดี\tdii\tx\n", encoding="utf-8")
    at = str(tmp_path / "t.tsv")
    got = spark.read.format("secondary_lexicon").option("splitBytes", 9).load(at)
    assert sorted((r.thai, r.translit) for r in got.collect()) == sorted((r.thai, r.translit) for r in R.read_secondary(spark, at).collect()) == [("ดี", "dii\tx"), ("มา", "maa"), ("มา", "maa2")]
    assert spark.read.format("secondary_lexicon").load(str(tmp_path / "none.tsv")).collect() == []


def failures(spark, n):
    return spark.range(n).selectExpr("'f' AS name", "id AS line_no", "concat('ก', id) AS input", "'a' AS expected", "'b' AS got")


def read(path):
    return "".join(p.read_text() for p in sorted(path.glob("*.txt")))


def test_log_round_trip(spark, tmp_path):
    out = tmp_path / "log"
    failures(spark, 50).repartition(4).write.format("failure_log").mode("append").save(str(out))
    text = read(out)
    assert text.count("\n\n") == 50 and "[f:7] ก7\n  Expected: a\n  Got:      b\n\n" in text
    assert sorted(p.name[0] for p in out.iterdir()) == ["p"] * 4
    failures(spark, 3).write.format("failure_log").mode("overwrite").save(str(out))
    assert read(out).count("\n\n") == 3


def test_failed_job_leaves_nothing(spark, tmp_path):
    out = tmp_path / "log"
    failures(spark, 5).write.format("failure_log").mode("append").save(str(out))
    before = read(out)

    @F.udf("string")
    def broken(i):
        if i == 37:
            raise ValueError("task fails")
        return "x"

    with pytest.raises(Exception, match="task fails"):
        failures(spark, 60).repartition(4).withColumn("got", broken("line_no")).write.format("failure_log").mode("overwrite").save(str(out))
    assert read(out) == before  # what a task that outlives the job may still write stays hidden
    failures(spark, 2).write.format("failure_log").mode("overwrite").save(str(out))
    assert read(out).count("\n\n") == 2
