"""Working tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of the working tables written so far, oldest first.
_MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset, a folder under the warehouse in local mode, as in
    tests; a cluster without the setting is an error, as its machines may share no other folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path for a working table, which ``release`` deletes with the others."""
    _MADE.append(f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}")
    return _MADE[-1]


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` and reads it back: what is used several times is worked out once, and lost executors lose nothing."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many working tables there are: a mark for ``release``."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0, but_last: int = 0) -> int:
    """Deletes the working tables written after the mark ``since``, but for the last so many; returns how many went.

    For when nothing lazy reads them any more: what a query returned has been written or collected.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = _MADE[since : len(_MADE) - but_last]
    for p in gone:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    del _MADE[since : len(_MADE) - but_last]
    return len(gone)
