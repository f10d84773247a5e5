"""The corpus pipeline: quality rules, near-dedup, decontamination, secret redaction, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from krathong.llm import common, decontaminate, mixing, quality_rules, secret_scan, simhash_dedup


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject: null and empty texts, and what the field finds mostly boilerplate.

    Here and below: null ids and sources are kept like others, repeated rows are judged alike, whole texts are
    read, extra columns of any name come along, an empty table gives an empty one.
    """
    model = quality_rules.fit(docs, common.table(spark, sf_dir, "labels"))
    return common.pack(docs).withColumn("rules", quality_rules.rule_column(model, F.col("row.text"))).filter("rules.kept").select("row.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: the least (id, text hash), null ids last; of repeated rows one."""
    return simhash_dedup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item; null texts and null or empty items hold nothing and are not held."""
    return decontaminate.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in the texts; a null text stays null, no row goes."""
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the mix takes no copy of and says how many copies it takes of the rest.

    Rows of one id, and all rows without an id, are taken alike; a null source is one of its own, the last.
    """
    return mixing.mixed_rows(docs)


STAGES = [("quality rules", quality_stage), ("simhash near-dedup", dedup_stage), ("benchmark decontamination", decontaminate_stage), ("secret scans", secrets_stage), ("mixing sources", mixing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written and read again; the working tables before its own go once a stage is written."""
    docs, start = common.table(spark, sf_dir, "documents"), common.made()
    for _, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir))
        common.release(spark, start, but_last=1)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
