"""Vector code compression: product quantization in integers, screened by float32 matrix products.

Each component x becomes the integer floor(1024 x), each vector is cut into ``PARTS`` consecutive parts, and each
part is replaced by the index of its nearest entry in a codebook of its part position. Codebooks
begin as the parts of the vectors of the smallest ids; a round assigns all parts and moves each entry to the floored mean of
what it got.

The nearest entry is exact. For a block of parts one float32 matrix product gives all products x.c, each of which is off by at most
``gamma * |x| * |c|`` whatever the order of summation, so each distance lies in an interval; only entries whose interval
reaches below the best upper end can be nearest. Where more than one is left, those are evaluated again in int64 and the
lowest index of the least distance wins. Of equal entries only the first can win, so the others are left out.

A round sends the codebooks (bounded: ``ENTRIES`` entries for each part) to the tasks. Each task adds up its rows by part and entry,
so what is shuffled is one row for each task, part and entry, whatever the number of vectors and however often one is repeated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integers beyond this would overflow exact distances in int64.
LARGEST = 1 << 24
#: Vectors compared at once, and pairs evaluated again at once.
BLOCK, PAIRS = 2048, 1 << 16
#: Tasks that share the rows of one label when its sum is joined back.
SALT = 16


def integers(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, kept, fit) of a list column: integer components of the ``fit`` rows, which rows are kept (no null, all
    finite) and which of these have ``width`` components within LARGEST."""
    n = len(vectors)
    length = np.asarray(vectors.value_lengths().fill_null(-1))
    flat = vectors.flatten().cast(pa.float64())
    bad = np.asarray(flat.is_null()) | ~np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False))
    values = np.floor(np.where(bad, 0.0, flat.fill_null(0.0).to_numpy(zero_copy_only=False)) * SCALE)
    owner = np.repeat(np.arange(n), np.maximum(length, 0))
    kept = length >= 0
    kept[owner[bad]] = False
    fit = kept & (length == width)
    fit[owner[np.abs(values) > LARGEST]] = False
    return values[fit[owner]].astype(np.int64).reshape(int(fit.sum()), width), kept, fit


def cuts(width: int) -> list[tuple[int, int]]:
    return [(width * i // PARTS, width * (i + 1) // PARTS) for i in range(PARTS)]


def screen(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, entry) pairs of all entries whose distance interval reaches the best: the nearest one of each row is among them."""
    n, u = x.shape[1] + 2, 2.0**-24
    gamma = n * u / (1 - n * u)
    product = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    norm_x, norm_c = (np.sqrt((a.astype(np.float64) ** 2).sum(1)) * (1 + 2.0**-40) for a in (x, c))
    square = (c.astype(np.float64) ** 2).sum(1)
    middle = square - 2 * product
    # what float64 rounds here is far below the second term
    half = 2 * gamma * norm_x[:, None] * norm_c + (square + 2 * np.abs(product)) * 2.0**-40
    return np.nonzero(middle - half <= (middle + half).min(1, keepdims=True))


def distances(x: np.ndarray, c: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
    out = np.empty(len(row), np.int64)
    for a in range(0, len(row), PAIRS):
        out[a : a + PAIRS] = ((x[row[a : a + PAIRS]] - c[entry[a : a + PAIRS]]) ** 2).sum(1)
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Index of each row's nearest entry by squared distance, the lowest of equals."""
    out = np.zeros(len(x), np.int64)
    first = np.sort(np.unique(c, axis=0, return_index=True)[1]) if c.shape[1] else np.zeros(1, np.int64)
    own = c[first]
    for a in range(0, len(x), BLOCK):
        part = x[a : a + BLOCK]
        row, entry = screen(part, own)
        best = np.zeros(len(part), np.int64)
        starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        alone = np.diff(np.concatenate((starts, [len(row)]))) == 1
        best[row[starts[alone]]] = entry[starts[alone]]
        many = ~np.repeat(alone, np.diff(np.concatenate((starts, [len(row)]))))
        if many.any():
            row, entry = row[many], entry[many]
            order = np.lexsort((entry, distances(part, own, row, entry), row))
            row, entry = row[order], entry[order]
            at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            best[row[at]] = entry[at]
        out[a : a + BLOCK] = first[best]
    return out


def seeds(vectors: DataFrame, id_col: str, vector_col: str) -> list[np.ndarray]:
    """The first codebooks: the parts of the kept vectors of the smallest ids, each id once. Empty without any.

    All vectors have the width of that of the smallest id. Rows without an id give no entry; of rows that share one, the least vector does.
    """
    v = F.col("v")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE <= LARGEST))
    rows = vectors.select(F.col(id_col).alias("i"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("i").isNotNull() & usable)
    found = rows.orderBy("i", "v").limit(ENTRIES).collect()  # a bounded top-k
    if not found:
        return []
    width = len(found[0].v)
    if len({r.i for r in found}) < len(found) or any(len(r.v) != width for r in found):
        found = rows.filter(F.size("v") == width).groupBy("i").agg(F.min("v").alias("v")).orderBy("i").limit(ENTRIES).collect()
    at = np.floor(np.array([r.v for r in found]) * SCALE).astype(np.int64)
    return [at[:, a:b] for a, b in cuts(width)]


def _sums(books: list[np.ndarray], width: int):
    """For mapInArrow: (part, entry, n, sums) of a task's vectors."""

    def run(batches):
        count = [np.zeros(len(c), np.int64) for c in books]
        total = [np.zeros(c.shape, np.int64) for c in books]
        for b in batches:
            x = integers(b.column(0), width)[0]
            for p, (lo, hi) in enumerate(cuts(width)):
                code = nearest(x[:, lo:hi], books[p])
                order = np.argsort(code, kind="stable")
                at, starts, n = np.unique(code[order], return_index=True, return_counts=True)
                if len(at):
                    count[p][at] += n
                    total[p][at] += np.add.reduceat(x[order, lo:hi], starts, axis=0)
        rows = [(p, k, int(count[p][k]), total[p][k].tolist()) for p in range(PARTS) for k in np.flatnonzero(count[p]).tolist()]
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "entry", "n", "s"), r)) for r in rows], pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))

    return run


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part position after so many rounds, as int64 arrays; an empty list where no vector can give one."""
    books = seeds(vectors, id_col, vector_col)
    if not books:
        return books
    width = sum(c.shape[1] for c in books)
    for _ in range(rounds):
        parts = vectors.select(F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(_sums(books, width), "part int, entry int, n long, s array<long>")
        longest = max(c.shape[1] for c in books)
        added = [F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(longest)]
        new = [c.copy() for c in books]
        for r in parts.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():  # at most PARTS * ENTRIES rows
            new[r.part][r.entry] = [r[f"s{i}"] // r.n for i in range(new[r.part].shape[1])]
        books = new
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components as decimals, by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(v) for c in books for v in c.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error) of each kept vector: code joins the indexes of its parts as two hex digits each, error is the summed squared distance.

    Kept vectors that the codebooks don't fit (another width, components beyond LARGEST) have neither code nor error.
    """
    width = sum(c.shape[1] for c in books)
    src = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    schema = f"vec_id {src.schema['vec_id'].dataType.simpleString()}, label {src.schema['label'].dataType.simpleString()}, code string, error long"

    def run(batches):
        for b in batches:
            x, kept, fit_ = integers(b.column(2), width)
            code, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            for p, (lo, hi) in enumerate(cuts(width) if books else []):
                at = nearest(x[:, lo:hi], books[p])
                code[:, p] = at
                error += ((x[:, lo:hi] - books[p][at]) ** 2).sum(1)
            has = fit_ & bool(books)
            codes, errors = np.full(b.num_rows, None, object), np.full(b.num_rows, None, object)
            if books:
                codes[fit_], errors[fit_] = [r.tobytes().hex() for r in code], error
            keep = pa.array(kept)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(codes[kept], pa.string()), pa.array(errors[kept], pa.int64())], ["vec_id", "label", "code", "error"])

    return src.mapInArrow(run, schema)


def decode(codes, books: list[np.ndarray]) -> np.ndarray:
    """The vectors that codes stand for: each part's entry over SCALE, taken at the middle of its step."""
    at = np.array([list(bytes.fromhex(c)) for c in codes], np.int64).reshape(-1, PARTS)
    return (np.concatenate([books[p][at[:, p]] for p in range(PARTS)], axis=1) + 0.5) / SCALE


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``: the error summed over equal labels, nulls together. Sums are repeated ``SALT`` times, so that no task has to take all rows of a label."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("l"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("k"))
    rows = coded.withColumn("s", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALT)).cast("int"))
    return rows.join(sums.hint("merge"), F.col("label").eqNullSafe(F.col("l")) & (F.col("s") == F.col("k"))).drop("l", "k", "s")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of all vectors.

    Null vectors and those with a null or non-finite component are dropped; a table without any other gives no rows. Rows without an id are coded
    but give no entry, repeated rows are repeated; an id that is repeated gives one entry, that of its least vector. Vectors of another width than that of
    the smallest id have a null code. Other columns are not read.
    """
    vectors = C.table(spark, sf_dir, "embeddings")
    books = fit(vectors)
    coded = C.materialize(encode(vectors, books))
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


#: Components of each part, and the distance of a part to an entry, in DuckDB.
_DISTANCE = "CAST(list_sum(list_transform(list_zip(e.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"


def _oracle() -> str:
    """All rounds as SQL: the part's distances to all entries, the least of (distance, index), floored means by component."""
    parts = [
        f"kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"e AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS x FROM kept, (SELECT unnest(range({PARTS})) AS p))",
        f"c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x FROM e WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, label, p, x, near % {ENTRIES} AS k, near // {ENTRIES} AS d FROM (SELECT e.vec_id, any_value(e.label) AS label, e.p, any_value(e.x) AS x, min({_DISTANCE} * {ENTRIES} + c.k) AS near FROM e JOIN c{i} c ON c.p = e.p GROUP BY e.vec_id, e.p))")
        if i < ROUNDS:
            mean = "(s - ((s % n) + n) % n) // n"
            parts.append(f"m{i} AS (SELECT p, k, list({mean} ORDER BY j) AS x FROM (SELECT p, k, j, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, k, unnest(x) AS y, unnest(range(len(x))) AS j FROM a{i}) GROUP BY p, k, j) GROUP BY p, k)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.p, c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.p = c.p AND m.k = c.k)")
    parts.append(f"o AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)")
    parts.append(f"h AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, k, j)) AS codebooks_sha256 FROM (SELECT p, k, unnest(x) AS y, unnest(range(len(x))) AS j FROM c{ROUNDS}))")
    return "WITH " + ",\n".join(parts) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, h"


ORACLE = _oracle()
