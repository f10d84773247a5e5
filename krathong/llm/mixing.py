"""Mixing sources to target weights by hash-threshold histograms.

A document's place in its source's order is a hash of its id. For each source the words are summed
by source and leading hash digits; running sums over those bounded histograms find the bucket in
which the budget ends; only the documents of that boundary bucket are summed again by the next
digits, and so on, until the boundary is one hash. Documents are then chosen by comparing their
hash with their source's threshold: nothing is sorted. Thresholds of larger budgets are larger, so
what a smaller budget takes, a larger one takes too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Weights of the sources in code-point order, repeating; the budget as a share of all words; most copies of a document.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Hash digits (hex) in all, and as many as each histogram resolves: 4096 buckets for each source at most.
DIGITS, STEP = 15, 3


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, h): words and hash digits of each row."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(C.WORD)), F.lit(0)).cast("long").alias("size"),
        F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, DIGITS).alias("h"),
    )


def ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``place``, the rank of each source by code point, null last.

    Sources are dealt by ranges and counted in their range; how many stand in the ranges before is a table of one row for
    each range. So no task sees all sources, of which there may be as many as there are hosts.
    """
    order = [F.col("source").isNull(), F.col("source")]
    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = C.materialize(sizes.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("range").agg(F.count("*").alias("n")).select(F.col("range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return parts.withColumn("own", own).join(F.broadcast(base), F.col("range") == F.col("r")).select(*sizes.columns, (F.col("base") + F.col("own") - 1).alias("place"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target): weighted shares of the budget, capped, the excess dealt again by weight.

    Dealing the excess until no target is above its cap ends at min(cap, level * weight) with one level
    for all sources. It is dealt as told: the level of the open sources is worked out from sums over all sources, those above
    their cap are closed, until none is. Each round is an aggregate of four numbers; sources never meet in one task.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place"), F.lit(len(weights))).cast("int") + 1).cast("double")
    s = C.materialize(ranked(sizes).withColumn("w", w).withColumn("cap", F.col("source_size") * float(cap)).drop("place"))
    level, closed = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("w") * level > F.col("cap")
        r = s.agg(F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)).alias("kept"), F.sum(F.when(~over, F.col("w"))).alias("w"), F.count_if(over).alias("closed")).first()
        if r.closed == closed or not r.w:
            break
        closed, level = r.closed, (r["all"] * float(share) - r.kept) / r.w
    # sources that are closed in the last round stay so, as the level never falls
    target = F.col("cap") if not r.w else F.least(F.col("cap"), F.col("w") * level)
    return s.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, last): each document is taken ``whole`` times, once more if its hash is up to ``last``.

    ``last`` is null where nothing more is taken. The boundary hash itself is taken if that leaves the sum
    nearer to the budget; a tie leaves it out. Rows of one id have one hash and stand or fall together: the sum misses the
    target by at most half the words of one id in the source, which is much only where one id, or a null one, has much.
    """
    goal = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    edge = goal.select(F.col("source").alias("s"), F.lit("").alias("prefix"), F.col("rest"))
    done = []
    for n in range(STEP, DIGITS + 1, STEP):
        hist = (
            rows.join(edge, same("source", "s") & (F.substring("h", 1, n - STEP) == F.col("prefix")))
            .groupBy("s", F.substring("h", 1, n).alias("b"))
            .agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        )
        upto = Window.partitionBy("s").orderBy("b")
        # the boundary is the first bucket with which the running sum passes the rest
        at = hist.withColumn("cum", F.sum("n").over(upto)).withColumn("below", F.col("cum") - F.col("n"))
        at = at.groupBy("s").agg(
            F.max(F.when(F.col("cum") <= F.col("rest"), F.col("b"))).alias("full"),
            F.min(F.when(F.col("cum") > F.col("rest"), F.struct("b", "below", "n", "rest", "lo", "hi"))).alias("x"),
        )
        at = C.materialize(at)
        done.append(at.select("s", F.rpad("full", DIGITS, "f").alias("last")))
        one = at.filter("x.lo = x.hi")  # the boundary bucket is down to one hash
        done.append(one.filter(F.col("x.below") + F.col("x.n") - F.col("x.rest") < F.col("x.rest") - F.col("x.below")).select("s", F.col("x.lo").alias("last")))
        more = at.filter("x.lo <> x.hi")
        if not more.limit(1).count():
            break
        edge = more.select("s", F.col("x.b").alias("prefix"), (F.col("x.rest") - F.col("x.below")).alias("rest"))
    last = done[0]
    for d in done[1:]:
        last = last.unionAll(d)
    last = last.groupBy("s").agg(F.max("last").alias("last"))
    return goal.join(last, same("source", "s"), "left").select("source", "source_size", "target", "whole", F.when(F.col("rest") > 0, F.col("last")).alias("last"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of each row; the same on every run.

    A null or empty text has size 0 and takes nothing. Rows without a source are a source of their own,
    the last. Repeated rows have one hash and are taken alike; a null id hashes as the empty string, so all rows without an
    id are taken alike. Sources without words have target 0. Other columns are not read. An empty table gives none.
    """
    rows = C.materialize(sized(docs, id_col, text_col, source_col))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    cut = C.materialize(thresholds(rows, C.materialize(targets(sizes, weights, share, cap)))).withColumnRenamed("source", "s")
    copies = (F.col("whole") + F.coalesce((F.col("h") <= F.col("last")).cast("int"), F.lit(0))).cast("long")
    return rows.join(cut, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the mix takes, with columns size and copies, as ``mix`` has them.

    Where the names are taken, ``mix_`` goes before them until they are not. Null and empty texts have size 0 and are taken
    like others of their hash; null ids and sources are as in ``mix``; repeated rows stay. An empty table gives none.
    """
    rows = C.materialize(sized(docs, "doc_id", "text", "source"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    cut = C.materialize(thresholds(rows, C.materialize(targets(sizes)))).select(F.col("source").alias("_s"), "whole", "last")
    own = ["size", "copies"]
    while set(own) & set(docs.columns):
        own = [f"mix_{n}" if n in docs.columns else n for n in own]
    at = C.pack(docs).withColumns({"h": F.substring(F.md5(F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))), 1, DIGITS), "n": F.coalesce(F.regexp_count(F.col("row.text"), F.lit(C.WORD)), F.lit(0)).cast("long")})
    copies = (F.col("whole") + F.coalesce((F.col("h") <= F.col("last")).cast("int"), F.lit(0))).cast("long")
    return at.join(cut, F.col("row.source").eqNullSafe(F.col("_s"))).withColumn("copies", copies).filter("copies > 0").select("row.*", F.col("n").alias(own[0]), F.col("copies").alias(own[1]))


def op8_mix_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(C.table(spark, sf_dir, "documents"))


def oracle(docs: str = "documents") -> str:
    """The same by sorting: DuckDB SQL over the table or subquery named."""
    return f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {DIGITS}) AS h FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS w, source_size * CAST({CAP} AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * CAST({SHARE} AS DOUBLE) - coalesce(sum(cap) OVER r, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER r, 0)) AS level
  FROM w WINDOW r AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM l WHERE level <= cap / w), 1e300) * w) AS target FROM l),
g AS (SELECT *, CAST(CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS BIGINT) AS whole FROM t),
b AS (SELECT *, target - whole * source_size AS rest FROM g),
c AS (SELECT doc_id, d.source, size, h, source_size, target, whole, rest, sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS cum,
  sum(size) OVER (PARTITION BY d.source, h) AS own FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
k AS (SELECT *, whole + CASE WHEN rest > 0 AND (cum <= rest OR (cum - own <= rest AND cum - rest < rest - (cum - own))) THEN 1 ELSE 0 END AS copies FROM c)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM k"""


ORACLE = oracle()
