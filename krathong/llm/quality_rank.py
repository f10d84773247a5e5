"""Quality classifier: Bradley-Terry ranking of documents learned from preference pairs.

Each document gets a linear score of its features; a pair (better, worse) has the logistic loss of
the score difference, so only feature differences matter. The fit takes every pair of a good and a bad
document among all labelled rows outside the held-out fold: what a row adds to the gradient depends on its score
alone, through the scores of the other label, so each round lays the rows on a grid of scores, in tasks, and the driver
solves for the next weights from the sums of the grid points. The decision threshold is a quantile of the
scores of all these rows, and the score is shifted so that this quantile stands at ``CUT``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .quality_rules import duplicate_lines, repeat_words

#: Weight of the squared weights in the loss; with features of at most 2 it bounds the scores, and so the grid.
RIDGE = 1e-3
#: Distance of grid points: for the gradient (each pair's probability is within 1e-4), and for the curvature, which only steers the rounds.
STEP, WIDE = 1 / 16, 1.0
#: Rounds end when no weight moves by more than this.
ENOUGH, ROUNDS = 1e-6, 60
#: Bins for a unit of score, between which the threshold is sought.
BINS = 1024
CUT = 0.3
DIM = 20
_UP = np.triu_indices(DIM)


def features(texts: list[str]) -> np.ndarray:
    """Bounded features of each text; all zero for texts without words."""
    parts = []
    for a, b in C.slices(texts):
        run = texts[a:b]
        x = C.Lines(run)
        dup = duplicate_lines(run)
        words = x.by_doc(x.n_words)
        w, ch, letters = np.maximum(words, 1), np.maximum(x.by_doc(x.n_chars - x.n_ws), 1), np.maximum(x.by_doc(x.n_letter), 1)
        share = lambda mask: x.by_doc(x.n_words * mask) / w  # noqa: E731  of the words, in such lines
        line_w, line_l = np.maximum(x.n_words, 1), np.maximum(x.n_letter, 1)
        kinds = np.array([len(set(t.split())) for t in run]) / w
        rep = np.array([repeat_words(t) for t in run]) / w
        parts.append(
            np.column_stack(
                [
                    np.minimum(x.by_doc(x.n_symbol) / ch * 4, 2),
                    np.minimum(x.by_doc(x.n_symbol) / w, 2),
                    x.by_doc(x.n_upper) / letters,
                    np.minimum(x.by_doc(x.n_digit) / ch * 4, 2),
                    np.minimum(x.by_doc(x.n_pipe) / w * 2, 2),
                    np.minimum(x.by_doc(x.n_bang) / w * 2, 2),
                    np.minimum(x.by_doc(x.n_stop) / w * 4, 2),
                    np.minimum(ch / w / 8, 2),
                    np.minimum(np.log1p(words) / 5, 2),
                    words < 50,
                    words < 20,
                    share(x.n_upper / line_l > 0.5),
                    share(x.n_symbol / line_w > 0.3),
                    share(x.n_pipe / line_w > 0.2),
                    share(dup),
                    share(x.n_words < 4),
                    rep,
                    rep > 0.3,
                    kinds,
                    np.maximum(0, 0.5 - kinds) * 2,
                ]
            ).astype(np.float64)
            * (words > 0)[:, None]
        )
    return np.concatenate(parts) if parts else np.zeros((0, DIM))


def laid(s: np.ndarray, z: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Grid points and the sums of the rows ``z`` at each: a row is shared by the two points beside its score, by nearness."""
    k = np.floor(s / step)
    part = (s / step - k)[:, None]
    at, own = np.unique(np.concatenate([k, k + 1]).astype(np.int64), return_inverse=True)
    total = np.zeros((len(at), z.shape[1]))
    np.add.at(total, own, np.concatenate([z * (1 - part), z * part]))
    return at, total


def grid_sums(rows: DataFrame, w: np.ndarray) -> dict:
    """By (fine, label): first grid point, and for each point from there on the rows, the sums of their features and, if not fine, of the products of two."""

    def sums(batches):
        for b in batches:
            x, y = np.stack(b.x.to_numpy()), b.y.to_numpy()
            one = np.column_stack([np.ones(len(x)), x])
            for label in np.unique(y):
                own, mine = one[y == label], x[y == label]
                for fine, step, z in ((True, STEP, own), (False, WIDE, np.column_stack([own, mine[:, _UP[0]] * mine[:, _UP[1]]]))):
                    at, total = laid(mine @ w, z, step)
                    n = z.shape[1]
                    yield pd.DataFrame({"y": label, "fine": fine, "k": np.repeat(at, n), "i": np.tile(np.arange(n), len(at)), "v": total.ravel()})

    got = rows.mapInPandas(sums, "y int, fine boolean, k long, i int, v double").groupBy("y", "fine", "k", "i").agg(F.sum("v").alias("v")).toArrow().to_pandas()
    out = {}
    for (fine, label), g in got.groupby(["fine", "y"]):
        k = g.k.to_numpy() - g.k.min()
        table = np.zeros((k.max() + 1, g.i.max() + 1))
        table[k, g.i] = g.v
        out[bool(fine), int(label)] = int(g.k.min()), table
    return out


def pair_loss(sums: dict, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss over all pairs with its ridge, gradient and curvature, from the sums of the grid points."""
    (a1, one), (a0, nil) = sums[True, 1], sums[True, 0]
    n = one[:, 0].sum() * nil[:, 0].sum()
    # differences of all pairs of grid points, as one run of multiples of the step
    d = np.clip(STEP * (np.arange(1 - len(nil), len(one)) + a1 - a0), -700, 700)
    p = 1 / (1 + np.exp(d))
    over = lambda kernel: np.convolve(nil[:, 0], kernel)[len(nil) - 1 :][: len(one)]  # noqa: E731  for each point of the good, over all bad
    under = np.convolve(one[:, 0], p[::-1])[len(one) - 1 :][: len(nil)]
    loss = over(np.logaddexp(0, -d)) @ one[:, 0] / n + RIDGE / 2 * w @ w
    g = (under @ nil[:, 1:] - over(p) @ one[:, 1:]) / n + RIDGE * w
    (a1, one), (a0, nil) = sums[False, 1], sums[False, 0]
    p = 1 / (1 + np.exp(np.clip(WIDE * ((a1 + np.arange(len(one)))[:, None] - (a0 + np.arange(len(nil)))), -700, 700)))
    h = p * (1 - p)
    square = np.zeros((DIM, DIM))
    square[_UP] = (h @ nil[:, 0]) @ one[:, DIM + 1 :] + (one[:, 0] @ h) @ nil[:, DIM + 1 :]
    cross = one[:, 1 : DIM + 1].T @ h @ nil[:, 1 : DIM + 1]
    return loss, g, (square + np.triu(square, 1).T - cross - cross.T) / n + RIDGE * np.eye(DIM)


def weights(rows: DataFrame) -> np.ndarray:
    """Weights of the least loss over all pairs of rows (y, x) with y 1 and 0; zeros without both.

    Sums come in any order: rounded weights keep reruns alike.
    """
    w, move, least = np.zeros(DIM), np.zeros(DIM), np.inf
    for _ in range(ROUNDS):
        sums = grid_sums(rows, w)
        if len(sums) < 4:
            return w
        loss, g, h = pair_loss(sums, w)
        if loss > least + 1e-4:  # too far: half the way back
            move = move / 2
            w = np.round(w + move, 8)
            continue
        least = min(loss, least)
        move = np.linalg.solve(h, g)
        w = np.round(w - move, 8)
        if np.abs(move).max() < ENOUGH:
            break
    return w


def threshold(bins: list[tuple[int, int, int]]) -> float:
    """Of (label, bin of the score, rows): the edge of a bin that tells the labels apart best, the middle of the first such run."""
    y, k, n = np.array(bins, np.int64).T
    count = np.zeros((2, k.max() - k.min() + 2))
    np.add.at(count, (y, k - k.min()), n)
    below = np.cumsum(count, 1) - count
    gain = below[0] / count[0].sum() - below[1] / count[1].sum()
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    run = best[best - best[0] == np.arange(len(best))]
    return float(k.min() + run.mean()) / BINS


def dot(w: np.ndarray):
    """The score of the column ``x``."""
    return F.aggregate(F.zip_with("x", F.lit([float(v) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def fitted(seen: DataFrame, labels: DataFrame) -> dict:
    """Weights, scale and threshold from all labelled rows of ``measured`` outside the held-out fold, repeated ones as often as they stand;
    without both labels, a model that scores every text alike."""
    known = labels.select(F.col("doc_id").alias("i"), F.col("quality").cast("int").alias("y")).filter("i is not null and y in (0, 1)").filter(~held_out(F.col("i")))
    rows = C.materialize(seen.join(known, F.col("doc_id") == F.col("i")).select("y", "x"))
    w = weights(rows)
    s = rows.select("y", dot(w).alias("s"))
    bins = s.groupBy("y", F.floor(F.col("s") * BINS).alias("k")).agg(F.count("*").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s")).alias("q")).orderBy("y", "k").collect()
    if len({r.y for r in bins}) < 2:
        return {"w": np.zeros(DIM), "scale": 1.0, "at": -1.0}
    n, total, squares = (sum(r[f] for r in bins) for f in ("n", "s", "q"))
    spread = max(squares / n - (total / n) ** 2, 0) ** 0.5
    return {"w": w, "scale": round(1 / max(spread, 1e-6), 8), "at": threshold([(r.y, r.k, r.n) for r in bins])}


def score(texts: list[str], model: dict) -> np.ndarray:
    z = (features(texts) @ model["w"] - model["at"]) * model["scale"] * 3 + np.log(CUT / (1 - CUT))
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def held_out(doc_id):
    """Whether the id is in the held-out fold: crc32 of its decimal text divides by 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    return fitted(C.materialize(measured(docs)), labels)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the features of each row."""

    @F.pandas_udf("array<double>")
    def seen(t: pd.Series) -> pd.Series:
        return pd.Series(list(features(C.clean(t))), dtype=object)

    return docs.select(F.col(id_col).alias("doc_id"), seen(F.col(text_col)).alias("x"))


def ranked(seen: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted) of rows (doc_id, x)."""
    z = (dot(model["w"]) - model["at"]) * (model["scale"] * 3) + float(np.log(CUT / (1 - CUT)))
    value = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))
    return seen.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def rank_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row.

    Null and empty texts have all-zero features and get that score. Only the text is scored. Repeated rows
    give repeated results; a null id stays null and is not held out. An empty table gives none.
    """
    return ranked(measured(docs, id_col, text_col), model)


def op5_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are measured once, into a narrow table from which the model and the result are made."""
    seen = C.materialize(measured(C.table(spark, sf_dir, "documents")))
    return ranked(seen, fitted(seen, C.table(spark, sf_dir, "labels")))
