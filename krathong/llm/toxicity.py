"""Toxicity: a convolutional text classifier trained in numpy.

Words are hashed to embeddings; filters of several widths run over the embedded words. Each filter is
max-pooled over equal parts of about ``SEGMENT`` words of the text and rectified; the largest of these maxima, which
says how bad the worst place is, and their mean, which says how much of the text is like that, are weighed into
one logit. A word's embedding is the sum of those of its own hash and of its prefixes' hashes, so
inflected forms share what was learned. One coordinate starts at the log-odds of its bucket in the sample,
the rest at random; all are then trained.

The decision threshold is calibrated for each language, which is guessed from the text's own function words,
never from a column. It is set on labelled rows that the scoring model has not seen: the sample's by
cross-fitting, and all beyond the sample. Each language's own best cut counts by the number of its toxic
rows against ``SHRINK``, the cut over all languages counts for the rest, so that no language falls back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .quality_rank import held_out
from .quality_rules import labelled_sample

#: Bounds of the training sample: documents and characters of each.
TRAIN_DOCS, TRAIN_CHARS = 5000, 20_000
#: Parts of the sample that are scored by a model trained on the others, and the weight of the cut over all languages.
FOLDS, SHRINK = 3, 10
#: Width of the bins of the histograms of logits.
STEP = 0.05
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 8
#: Words of a part of a text that is pooled by itself.
SEGMENT = 32
#: Function words by language.
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "in", "that", "is", "for", "with", "was"],
    "fr": ["le", "la", "les", "des", "et", "que", "une", "pour", "dans", "qui"],
    "de": ["der", "die", "und", "das", "den", "von", "mit", "ist", "zu", "ein"],
    "es": ["el", "los", "las", "del", "que", "una", "por", "con", "para", "y"],
}
LANGS = ["other", *FUNCTION_WORDS]
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x3000)], np.uint64)
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


#: Lengths of the prefixes that are hashed beside the whole word.
PREFIXES = (4, 5, 7)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(40)).astype(np.int64) % BUCKETS


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of each word and its prefixes, number of words of each text); letters only, in lower case."""
    x = C.Lines(texts)
    start = np.flatnonzero(x.word_at)
    n = x.by_doc(x.n_words)
    if not len(start):
        return np.zeros((0, 1 + len(PREFIXES)), np.int64), n
    letter = (x.cls & C.LETTER) != 0
    place = np.cumsum(letter, dtype=np.int64)
    first = place[start] - letter[start]
    length = np.diff(np.concatenate((start, [len(x.cp)])))
    at = (place - 1)[start[0] :] - np.repeat(first, length)
    c = x.cp[start[0] :]
    low = np.where(c < 0x3000, _LOWER[np.minimum(c, 0x2FFF)], c.astype(np.uint64))
    value = np.where(letter[start[0] :], (low + np.uint64(1)) * _POWERS[at & 63], np.uint64(0))
    at0 = start - start[0]
    kinds = [_bucket(np.add.reduceat(value, at0), 0)] + [_bucket(np.add.reduceat(np.where(at < k, value, np.uint64(0)), at0), k) for k in PREFIXES]
    return np.column_stack(kinds), n


_MARK = np.zeros(BUCKETS, np.uint8)
for _i, _l in enumerate(LANGS[1:]):
    _MARK[hashed_words([" ".join(FUNCTION_WORDS[_l])])[0][:, 0]] |= 1 << _i


def languages(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Index into LANGS of the language with most function words in each text; 0 without any."""
    doc = np.repeat(np.arange(len(n)), n)
    marks = _MARK[ids[:, 0]]
    hits = np.column_stack([np.bincount(doc, (marks >> i) & 1, len(n)) for i in range(len(LANGS) - 1)])
    return np.where(hits.max(1) > 0, hits.argmax(1) + 1, 0)


def _segments(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each segment, segments of each text): equal parts of at most SEGMENT words."""
    per = -(-n // SEGMENT)
    doc = np.repeat(np.arange(len(n)), per)
    j = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    return (np.cumsum(n) - n)[doc] + n[doc] * j // np.maximum(per[doc], 1), per


def _activations(ids, n, emb, filters):
    """(word vectors, value of each filter at each word): minus infinity where a filter would run into the next text."""
    vec = emb[ids[:, 0]]
    for i in range(1, ids.shape[1]):
        vec += emb[ids[:, i]]
    ends, values = np.cumsum(n), []
    for j, k in enumerate(WIDTHS):
        z = vec @ filters[j][0]
        for i in range(1, k):
            z[:-i] += vec[i:] @ filters[j][i]
        for i in range(1, k):
            z[ends[n >= i] - i] = -np.inf
        values.append(z)
    return vec, np.concatenate(values, 1)


def _pooled(ids, n, emb, filters, with_arg=False):
    """Features of each text: the largest and the mean of the rectified maxima over its segments; on request what training needs."""
    width = len(WIDTHS) * FILTERS
    out = np.zeros((len(n), 2 * width), np.float32)
    if not len(ids):
        return (out, None) if with_arg else out
    vec, z = _activations(ids, n, emb, filters)
    starts, per = _segments(n)
    best = np.maximum(np.maximum.reduceat(z, starts, axis=0), 0)
    some = per > 0
    at = (np.cumsum(per) - per)[some]
    out[some, :width] = np.maximum.reduceat(best, at, axis=0)
    out[some, width:] = np.add.reduceat(best, at, axis=0) / per[some, None]
    if not with_arg:
        return out
    ends = np.append(starts[1:], len(ids))
    arg = np.array([a + z[a:b].argmax(0) for a, b in zip(starts.tolist(), ends.tolist())])
    return out, (vec, best, arg, per)


def train(texts: list[str], toxic: list[int], seed: int = 11, epochs: int = 6, batch: int = 64, rate: float = 0.03) -> dict:
    """Embeddings, filters and output weights; without both labels, a model that scores every text alike."""
    rng = np.random.default_rng(seed)
    y = np.array(toxic, np.float32)
    width = len(WIDTHS) * FILTERS
    emb = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
    filters = [rng.normal(0, 0.2, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
    out, bias = np.repeat(np.array([0.1, 0.3], np.float32), width), -2.0
    model = {"emb": emb, "filters": filters, "out": out, "bias": bias, "cut": np.zeros(len(LANGS))}
    if len(set(toxic)) < 2:
        return model
    runs = [hashed_words(texts[a:b]) for a, b in C.slices(texts)]
    ids, n = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
    ends = np.cumsum(n)
    words = lambda docs: np.concatenate([ids[ends[d] - n[d] : ends[d]] for d in docs])
    # log-odds of each bucket, by documents, drawn towards the base rate
    doc = np.repeat(np.arange(len(n)), n)
    pairs = np.unique((doc[:, None] * BUCKETS + ids).ravel())
    has = lambda mask: np.bincount(pairs[mask[pairs // BUCKETS]] % BUCKETS, minlength=BUCKETS)
    pos, neg, base = has(y == 1), has(y == 0), y.mean()
    emb[:, 0] = np.clip(np.log((pos + 5 * base) / (pos + neg + 5) / base), -2, 3) / 3
    for f in filters:
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.3 / len(f)
    memory = {"emb": np.full_like(emb, 1e-3), "out": np.full_like(out, 1e-3), "f": [np.full_like(f, 1e-3) for f in filters], "b": 1e-3}
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), batch):
            docs = order[a : a + batch]
            w = words(docs)
            if not len(w):
                continue
            p, (vec, best, arg, per) = _pooled(w, n[docs], emb, filters, True)
            delta = (1 / (1 + np.exp(-np.clip(p @ out + bias, -30, 30))) - y[docs]).astype(np.float32) / len(docs)
            g_out = p.T @ delta + 1e-4 * out
            g_bias = float(delta.sum())
            # of each segment's maximum: its share of the mean, and of the largest if it is that
            seg = np.repeat(np.arange(len(docs)), per)
            back = delta[seg, None] * (out[None, width:] / np.maximum(per[seg], 1)[:, None] + out[None, :width] * (best == p[seg, :width])) * (best > 0)
            for j, k in enumerate(WIDTHS):
                d, f = np.nonzero(back[:, j * FILTERS : (j + 1) * FILTERS])
                at, b = arg[d, f + j * FILTERS], back[d, f + j * FILTERS].astype(np.float32)
                for i in range(k):
                    g = np.column_stack([np.bincount(f, b * vec[at + i, c], FILTERS) for c in range(DIM)]).astype(np.float32)
                    step = b[:, None] * filters[j][i].T[f]
                    names, inv = np.unique(w[at + i], return_inverse=True)
                    inv = inv.reshape(len(at), -1)
                    total = np.zeros((len(names), DIM), np.float32)
                    for c in range(DIM):
                        total[:, c] = np.bincount(inv.ravel(), np.repeat(step[:, c], inv.shape[1]), len(names))
                    memory["emb"][names] += total**2
                    emb[names] -= rate * 0.2 * total / np.sqrt(memory["emb"][names])
                    memory["f"][j][i] += g.T**2
                    filters[j][i] -= rate * g.T / np.sqrt(memory["f"][j][i])
            memory["out"] += g_out**2
            out -= rate * g_out / np.sqrt(memory["out"])
            memory["b"] += g_bias**2
            bias -= rate * g_bias / np.sqrt(memory["b"])
    return model | {"bias": float(bias)}


def logits(texts: list[str], model: dict) -> tuple[np.ndarray, np.ndarray]:
    z, lang = [np.zeros(0)], [np.zeros(0, int)]
    for a, b in C.slices(texts):
        ids, n = hashed_words(texts[a:b])
        z.append(_pooled(ids, n, model["emb"], model["filters"]) @ model["out"] + model["bias"])
        lang.append(languages(ids, n))
    return np.concatenate(z), np.concatenate(lang)


def score(texts: list[str], model: dict) -> np.ndarray:
    z, lang = logits(texts, model)
    return 1 / (1 + np.exp(-np.clip(z - model["cut"][lang], -40, 40)))


def _bins(z: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(z, -40, 40) / STEP).astype(np.int32)


def cross_fit(texts: list[str], toxic: list[int], seed: int = 11) -> list[tuple[int, int, int, int]]:
    """(language, bin of the logit, label, rows) of the sample, each row scored by a model that was trained without it."""
    y, fold = np.array(toxic, int), np.arange(len(texts)) % FOLDS
    z, lang = np.zeros(len(y)), np.zeros(len(y), int)
    for k in range(FOLDS):
        own = np.flatnonzero(fold == k)
        model = train([texts[i] for i in np.flatnonzero(fold != k)], y[fold != k].tolist(), seed + k)
        z[own], lang[own] = logits([texts[i] for i in own], model)
    keys, rows = np.unique(np.column_stack([lang, _bins(z), y]), axis=0, return_counts=True) if len(y) else (np.zeros((0, 3), int), [])
    return [(*k, n) for k, n in zip(keys.tolist(), map(int, rows))]


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model of the bounded sample, with the cut of each language set on all labelled rows outside the held-out fold."""
    model, hist = _trained(docs, labels)
    return model | {"cut": cuts(hist + beyond(raw(docs, model), labels))}


def _trained(docs: DataFrame, labels: DataFrame) -> tuple[dict, list]:
    texts, toxic = labelled_sample(docs, labels, "toxic", TRAIN_DOCS, TRAIN_CHARS, lambda i: ~held_out(i))
    return train(texts, toxic), cross_fit(texts, toxic)


def raw(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, z, lang): logit and guessed language of each row, before any cut."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS x DIM floats and the filters

    @F.pandas_udf("z double, lang int")
    def scored(t: pd.Series) -> pd.DataFrame:
        z, lang = logits(C.clean(t), sent.value)
        return pd.DataFrame({"z": z, "lang": lang.astype(np.int32)})

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), scored(F.col(f"`{text_col}`")).alias("r")).select("doc_id", "r.z", "r.lang")


def beyond(scored: DataFrame, labels: DataFrame) -> list[tuple[int, int, int, int]]:
    """(language, bin of the logit, label, rows) of all labelled rows that are neither held out nor in the sample.

    Logits are joined with labels, never texts; only this histogram, of bounded size, reaches the driver.
    """
    known = labels.select(F.col("doc_id").alias("i"), F.col("toxic").cast("int").alias("y"))
    known = known.filter("i is not null and y is not null").filter(~held_out(F.col("i")))
    # the sample is the first rows in hash order
    last = known.select(F.xxhash64("i").alias("h")).orderBy("h").limit(TRAIN_DOCS).agg(F.max("h")).first()[0]
    at = F.floor(F.greatest(F.least("z", F.lit(40.0)), F.lit(-40.0)) / STEP).cast("int")
    rows = scored.select("doc_id", "lang", at.alias("bin")).join(known.filter(F.xxhash64("i") > F.lit(last)), F.col("doc_id") == F.col("i"))
    return [(r.lang, r.bin, r.y, r.n) for r in rows.groupBy("lang", "bin", "y").agg(F.count("*").alias("n")).orderBy("lang", "bin", "y").collect()]


def cuts(hist: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The cut of each language: its own best one, drawn towards the one over all by the number of its toxic rows; zeros without both labels."""
    h = np.array(hist, float).reshape(-1, 4)
    lang, z, y, n = h[:, 0], (h[:, 1] + 0.5) * STEP, h[:, 2], h[:, 3]
    if not n[y == 1].sum() or not n[y == 0].sum():
        return np.zeros(len(LANGS))
    every = _best_cut(z, y, n)
    out = np.full(len(LANGS), every)
    for i in range(len(LANGS)):
        mine = lang == i
        toxic = n[mine & (y == 1)].sum()
        if toxic and n[mine & (y == 0)].sum():
            out[i] = (toxic * _best_cut(z[mine], y[mine], n[mine]) + SHRINK * every) / (toxic + SHRINK)
    return out


def _best_cut(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The middle of the logits with the best F1, over bins of n rows with the label y."""
    at = np.unique(z)[::-1]
    hit = np.cumsum([n[(z == x) & (y == 1)].sum() for x in at])
    f1 = 2 * hit / (np.cumsum([n[z == x].sum() for x in at]) + n[y == 1].sum())
    k = int(f1.argmax())
    return float((at[k] + (at[k + 1] if k + 1 < len(at) else at[k] - 1)) / 2)


def rated(scored: DataFrame, cut: np.ndarray) -> DataFrame:
    """(doc_id, held_out, score, predicted) of rows (doc_id, z, lang)."""
    z = F.col("z") - F.element_at(F.array(*[F.lit(float(c)) for c in cut]), F.col("lang") + 1)
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def rate_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row.

    Null and empty texts pool to zero and get that score. Only the text is scored. Repeated rows give repeated
    results; a null id stays null and is not held out. Other columns are not read. An empty table gives none.
    """
    return rated(raw(docs, model, id_col, text_col), model["cut"])


def op6_text_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are scored once, into a narrow table from which the cuts are set and the result is made."""
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    model, hist = _trained(docs, labels)
    scored = C.materialize(raw(docs, model))
    return rated(scored, cuts(hist + beyond(scored, labels)))
