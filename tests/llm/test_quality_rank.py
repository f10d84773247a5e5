"""The fit of the quality ranking: all labelled rows count, all pairs are weighed, any order of the rows gives the same model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from krathong.llm import quality_rank as Q

GOOD, BAD = "This is a plain sentence of ordinary words, one after another. ", "BUY!! NOW!! $$$ | HOME | %%% ### "


def tables(spark, rows):
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([r[::2] for r in rows], "doc_id long, quality int")


def brute(x, y, w):
    """Mean loss over all pairs and its gradient."""
    d = (x[y == 1][:, None] - x[y == 0][None]).reshape(-1, x.shape[1])
    p = 1 / (1 + np.exp(d @ w))
    return np.logaddexp(0, -d @ w).mean() + Q.RIDGE / 2 * w @ w, -(d * p[:, None]).mean(0) + Q.RIDGE * w


def test_long_texts_teach(spark):
    """Labels that only texts of over 30,000 characters have."""
    docs, labels = tables(spark, [(i, (GOOD if i % 2 else BAD) * (600 if i % 2 else 1200), i % 2) for i in range(40)])
    model = Q.fit(docs, labels)
    good, bad = Q.score([GOOD * 20, BAD * 20], model)
    assert good >= Q.CUT > bad


def test_rows_beyond_the_first_thousands_teach(spark):
    """All bad documents come after 4,100 good ones in hash order."""
    ids = [r.id for r in spark.range(5300).filter(~Q.held_out(F.col("id"))).orderBy(F.xxhash64("id")).collect()]
    assert len(ids) > 4150
    docs, labels = tables(spark, [(i, (GOOD if k < 4100 else BAD) * (1 + k % 3), int(k < 4100)) for k, i in enumerate(ids)])
    model = Q.fit(docs, labels)
    rows = Q.rank_quality(docs, model).join(labels, "doc_id").collect()
    assert len(rows) == len(ids) and all(r.predicted == r.quality for r in rows)


def test_held_out_labels_do_not_teach(spark):
    rows = [(i, (GOOD if i % 2 else BAD) * 9, i % 2) for i in range(60)]
    docs, labels = tables(spark, rows)
    turned = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert labels.exceptAll(turned).count() > 3
    a, b = Q.fit(docs, labels), Q.fit(docs, turned)
    assert a["w"].tolist() == b["w"].tolist() and (a["at"], a["scale"]) == (b["at"], b["scale"])


@pytest.mark.parametrize("apart", [0.3, 3.0])
def test_weights_are_those_of_all_pairs(spark, apart):
    rng = np.random.default_rng(4)
    y = (rng.random(300) < 0.8).astype(int)
    x = np.clip(rng.normal(0.8, 0.4, (300, Q.DIM)) + apart * 0.2 * y[:, None] * (np.arange(Q.DIM) < 4), 0, 2)
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, x)], "y int, x array<double>")
    w = Q.weights(rows)
    for at in (w, rng.normal(size=Q.DIM)):
        loss, g, h = Q.pair_loss(Q.grid_sums(rows, at), at)
        want, slope = brute(x, y, at)
        assert abs(loss - want) < 1e-3 and np.abs(g - slope).max() < 5e-4
        assert np.linalg.eigvalsh(h).min() > 0
    assert np.abs(brute(x, y, w)[1]).max() < 5e-4
    assert Q.weights(rows.repartition(7)).tolist() == w.tolist()
    assert Q.weights(rows.union(rows)).tolist() == pytest.approx(w.tolist(), abs=1e-5)
    assert Q.weights(rows.filter("y = 1")).tolist() == [0.0] * Q.DIM == Q.weights(rows.limit(0)).tolist()


def test_threshold_equals_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(30):
        y = np.concatenate([[0, 1], rng.integers(0, 2, 40)])
        k = rng.integers(-30, 30, 42) + 9 * y
        gain = lambda e: (k[y == 1] >= e).mean() + (k[y == 0] < e).mean()  # noqa: B023, E731
        at = Q.threshold([(int(a), int(b), 1) for a, b in zip(y, k)]) * Q.BINS
        assert np.isclose(gain(at), max(gain(e) for e in range(k.min(), k.max() + 2)))
    assert Q.threshold([(0, 0, 5), (1, 10, 5)]) * Q.BINS == 5.5


def test_odd_labels(spark):
    """Null, repeated and other labels, null and repeated ids, null texts."""
    docs, labels = tables(spark, [(i, (GOOD if i % 2 else BAD) * 9, i % 2) for i in range(40)] + [(None, GOOD, 1), (41, None, 0), (42, "", 0), (43, GOOD, None), (44, GOOD, 7), (3, GOOD * 9, 1)])
    model = Q.fit(docs, labels)
    rows = Q.rank_quality(docs, model).collect()
    assert len(rows) == 46 and all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id is not None and r.doc_id < 40)
    texts = [r.text for r in docs.collect()]
    assert sorted(r.score for r in rows) == pytest.approx(sorted(Q.score([t or "" for t in texts], model)))
