"""The row-wise operators on a stream: every text function runs unchanged on ``readStream``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.textnorm import normalize


def normalize_stream(lines: DataFrame, text_col: str = "value") -> DataFrame:
    return lines.withColumn("normalized", normalize(F.col(text_col)))


def start(spark: SparkSession, source: str, sink: str, checkpoint: str):
    """Normalizes text files as they arrive; one pass over what is there, restartable from the checkpoint."""
    return normalize_stream(spark.readStream.text(source)).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start()
