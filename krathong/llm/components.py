"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import common as C


#: Tasks that share the links of one node.
SALT = 16
#: Links of a file that a round writes, and the least number of files.
ROWS, FILES = 200_000, 8


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node points its larger (large) or its smaller (small) neighbours at the least node around it.

    The minimum is partially aggregated before its shuffle. Joined back it would meet all links of a node in one task, so it is
    repeated ``SALT`` times and the links of a node are dealt over as many tasks by their other end. The hint keeps it from
    being broadcast by a size measured before it is repeated.
    """
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    dealt = low.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    at = both.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int")).join(dealt.hint("merge"), (F.col("u") == F.col("c")) & (F.col("s") == F.col("k")))
    out = at.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = at.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _written(links: DataFrame, files: int | None = None) -> tuple[DataFrame, int]:
    """The links as a table, and into how many files those of the next round fit: a round makes no more links than it has found.

    Rounds are many and mostly small; a file for each of hundreds of partitions would cost more than the links in it.
    """
    seen = Observation()
    table = C.materialize((links.coalesce(files) if files else links).observe(seen, F.count(F.lit(1)).alias("n")))
    return table, max(FILES, -(-seen.get["n"] // ROWS))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in a link; ``root`` is the least node of its component.

    ``edges`` has columns u and v of one orderable type. Self links, repeated and reversed links are
    fine; a null end drops the link. Every round is written to the shared folder. Rounds go on until every link
    points to a node that points to none: each round points nodes to lesser ones, so they end; in practice their number
    is logarithmic.
    """
    now, files = _written(edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(now):
        now, files = _written(_star(_star(now, True), False), files)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _settled(links: DataFrame) -> bool:
    """Whether no node has two links to lesser ones and none that is linked to links on: each node is counted by how it stands."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(links.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").limit(1).count() == 0
