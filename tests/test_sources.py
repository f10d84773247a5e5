"""Line numbers over splittable files."""

import pytest
from pyspark.sql import functions as F

from krathong.sources import vocabulary as R


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_numbers_over_many_tasks(spark, tmp_path, small_splits):
    """Lines of all lengths, empty ones, carriage returns, files with and without a last line feed, one of many splits, one longer than a split."""
    files = {
        "a.txt": "".join(f"บรรทัด {i} {'x' * (i % 70)}\n" for i in range(3000)),
        "b +%b.txt": "\n\n\r\none\r\n\ntwo",
        "c.txt": "",
        "ง.txt": "z" * 5000 + "\n" + "y\n" * 900,
        "e.txt": "only",
    }
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    rows = R.numbered_lines(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 50
    want = set()
    for name, text in files.items():
        lines = text.split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        want |= {(name, i + 1, x.removesuffix("\r")) for i, x in enumerate(lines)}
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len(want) and set(got) == want


def test_lines_are_not_shuffled(spark, tmp_path, small_splits):
    (tmp_path / "a.txt").write_text("".join(f"{i}\n" for i in range(2000)))
    plan = R.numbered_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_pairs_count_lines_alike(spark, tmp_path):
    """A last line feed makes no line, so sides with and without it pair."""
    (tmp_path / "test1.txt").write_text("ไป\nมา\n")
    (tmp_path / "test1_gold.txt").write_text("bpai\nmaa")
    got = R.discover_corpus(spark, str(tmp_path), ".txt", "_gold.txt").orderBy("line_no")
    assert [(r.name, r.line_no, r.input, r.expected) for r in got.collect()] == [("test1", 1, "ไป", "bpai"), ("test1", 2, "มา", "maa")]
    assert got.filter(F.col("line_no") > 2).count() == 0
