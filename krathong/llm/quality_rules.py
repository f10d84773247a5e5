"""Quality rules: a linear-chain conditional random field labels each line content or boilerplate.

Viterbi decoding marks the lines; the share of a text's words that stand in content lines decides
whether the text is kept. The field is trained here, by likelihood on line labels that start from
``labels.quality`` and are then re-decoded (hard expectation-maximisation): lines of good
documents are content, lines of bad documents are whatever the field says, with at least one boilerplate line.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Bound of the training sample: so many labelled documents, of at most so many characters each.
TRAIN_DOCS, TRAIN_CHARS = 1500, 20_000
KEEP_SHARE = 0.5
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
_WORD = re.compile(C.WORD)


def line_features(x: C.Lines, dup: np.ndarray) -> np.ndarray:
    """One row of bounded features for each line."""
    w, ch = np.maximum(x.n_words, 1), np.maximum(x.n_chars - x.n_ws, 1)
    letters = np.maximum(x.n_letter, 1)
    upper = x.n_upper / letters
    return np.column_stack(
        [
            np.ones(len(w)),
            x.n_words == 0,
            np.minimum(np.log1p(x.n_words) / 4, 1),
            x.n_words < 4,
            np.minimum(x.n_symbol / ch * 4, 2),
            np.minimum(x.n_symbol / w, 2),
            upper,
            upper > 0.5,
            np.minimum(x.n_digit / ch * 4, 2),
            np.minimum(x.n_pipe / w * 2, 2),
            np.minimum(x.n_bang / w * 2, 2),
            np.minimum(x.n_stop / w * 4, 2),
            np.minimum(ch / w / 8, 2),
            x.n_letter / ch,
            dup,
        ]
    ).astype(np.float64)


def duplicate_lines(texts: list[str]) -> np.ndarray:
    """1 for each line with a word that equals an earlier line of its text."""
    out = []
    for t in texts:
        seen: set[str] = set()
        for line in t.split("\n"):
            out.append(line in seen and _WORD.search(line) is not None)
            seen.add(line)
    return np.array(out, bool)


def repeat_words(text: str) -> int:
    """Words in 3-word windows that the text has twice or more."""
    w = text.encode("utf-8", "surrogatepass").split()
    tri = list(zip(w, w[1:], w[2:]))
    seen, twice = set(), set()
    if len(set(tri)) == len(tri):
        return 0
    for g in tri:
        (twice if g in seen else seen).add(g)
    total = reach = 0
    for i, g in enumerate(tri):
        if g in twice:
            total += i + 3 - max(i, reach)
            reach = i + 3
    return total


def viterbi(score: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels of one chain; ``score`` has a row for each line, ties go to content (1)."""
    (a, b), (t00, t01), (t10, t11) = score[0].tolist(), trans[0].tolist(), trans[1].tolist()
    back = []
    for s0, s1 in score[1:].tolist():
        x, y = a + t00, b + t10
        u, v = a + t01, b + t11
        back.append((int(y >= x), int(v >= u)))
        a, b = max(x, y) + s0, max(u, v) + s1
    at = int(b >= a)
    out = [at]
    for step in reversed(back):
        at = step[at]
        out.append(at)
    return np.array(out[::-1], bool)


def train(texts: list[str], good: list[int], rounds: int = 3, steps: int = 120) -> dict:
    """Weights of the field; with no usable labels, weights that keep every line."""
    dim = 15
    if not texts or len(set(good)) < 2:
        return {"w": np.eye(1, dim)[0] * 5, "trans": np.zeros((2, 2))}
    x = C.Lines(texts)
    feats = line_features(x, duplicate_lines(texts))
    order = np.argsort(-x.per, kind="stable")
    per, first = x.per[order], x.first[order]
    good_line = np.repeat(np.array(good, bool), x.per)
    y = good_line.copy()
    w, trans = np.zeros(dim), np.zeros((2, 2))
    active = [int((per > t).sum()) for t in range(int(per[0]))]
    for _ in range(rounds):
        m, v = np.zeros(dim + 4), np.zeros(dim + 4)
        for step in range(1, steps + 1):
            s = feats @ w
            score = np.column_stack([np.zeros_like(s), s])
            gy, gt = _gradient(score, trans, y, per, first, active)
            g = np.concatenate([feats.T @ gy, gt.ravel()]) / len(s) + 1e-4 * np.concatenate([w, trans.ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            w, trans = w - move[:dim], trans - move[dim:].reshape(2, 2)
        s = feats @ w
        for i, ok in enumerate(good):
            a, b = x.first[i], x.first[i] + x.per[i]
            if not ok:
                y[a:b] = viterbi(np.column_stack([np.zeros(b - a), s[a:b]]), trans)
    return {"w": w, "trans": trans}


def _gradient(score, trans, y, per, first, active):
    """Of the negative log-likelihood, by forward-backward over all chains at once (longest chains first)."""
    n, steps = len(per), len(active)
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    soft = lambda z, axis: (k := z.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(z - k).sum(axis))
    alpha[first] = score[first]
    for t in range(1, steps):
        at = first[: active[t]] + t
        alpha[at] = soft(alpha[at - 1][:, :, None] + trans[None], 1) + score[at]
    for t in range(steps - 2, -1, -1):
        at = first[: active[t + 1]] + t
        beta[at] = soft(trans[None] + (score[at + 1] + beta[at + 1])[:, None, :], 2)
    by_line = np.argsort(first)
    z = np.repeat(soft(alpha[first + per - 1], 1)[by_line], per[by_line])
    gy = np.exp(alpha[:, 1] + beta[:, 1] - z) - y
    gt = np.zeros((2, 2))
    inner = np.ones(len(y), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    if len(at):
        joint = np.exp(alpha[at - 1][:, :, None] + trans[None] + (score[at] + beta[at])[:, None, :] - z[at][:, None, None])
        gt = joint.sum(0)
        np.subtract.at(gt, (y[at - 1].astype(int), y[at].astype(int)), 1)
    return gy, gt


def measure(texts: list[str], model: dict, keep_share: float = KEEP_SHARE) -> pd.DataFrame:
    """The rule values of each text."""
    parts = []
    for a, b in C.slices(texts):
        run = texts[a:b]
        x = C.Lines(run)
        dup = duplicate_lines(run)
        feats = line_features(x, dup)
        s = feats @ model["w"]
        score = np.column_stack([np.zeros_like(s), s])
        words = x.by_doc(x.n_words)
        content = np.empty(len(run))
        for i, (at, n) in enumerate(zip(x.first.tolist(), x.per.tolist())):
            own = x.n_words[at : at + n]
            content[i] = own[viterbi(score[at : at + n], model["trans"])].sum() / max(words[i], 1)
        rep = np.array([repeat_words(t) for t in run], np.int64)
        failed = (words < 50) | (100 * rep > 50 * words)
        parts.append(pd.DataFrame({"n_words": words, "word_chars": x.by_doc(x.n_chars - x.n_ws), "n_symbols": x.by_doc(x.n_symbol), "n_dup_lines": x.by_doc(dup.astype(np.int64)), "n_repeat_words": rep, "base_failed": failed, "content_share": content, "kept": ~failed & (content >= keep_share)}))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c.split()[0]: [] for c in SCHEMA.split(", ")})


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, n: int, chars: int, keep=None) -> tuple[list, list]:
    """At most ``n`` labelled texts of at most ``chars`` characters, in a fixed hash order.

    Only the ids of the sample are broadcast; duplicate labels of one document count once each.
    """
    lab = labels.select(F.col("doc_id").alias("_i"), F.col(label).cast("int").alias("_y")).filter("_i is not null and _y is not null")
    ids = lab if keep is None else lab.filter(keep(F.col("_i")))
    ids = ids.orderBy(F.xxhash64("_i"), "_i", "_y").limit(n)
    rows = (
        docs.select(F.col("doc_id").alias("_d"), F.col("text").alias("_t"))
        .join(F.broadcast(ids), F.col("_d") == F.col("_i"))
        .filter(F.length("_t").between(1, chars))
        .select("_i", "_t", "_y")
        .orderBy(F.xxhash64("_i"), "_i", "_y", "_t")
        .limit(2 * n)
        .collect()
    )
    return [r._t for r in rows], [r._y for r in rows]


def fit(docs: DataFrame, labels: DataFrame, n: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> dict:
    return train(*labelled_sample(docs, labels, "quality", n, chars))


def rule_column(model: dict, text, keep_share: float = KEEP_SHARE):
    """A struct column of the rule values (SCHEMA) of the text column."""

    @F.pandas_udf(SCHEMA)
    def rules(t: pd.Series) -> pd.DataFrame:
        return measure(C.clean(t), model, keep_share)

    return rules(text)


def quality_rules(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rule values and verdict of each row.

    Null and empty texts have no words: base_failed, not kept. Repeated rows give repeated results;
    a null id stays null. Columns besides the id and the text are not read. An empty table gives none.
    """
    return docs.select(F.col(id_col).alias("doc_id"), rule_column(model, F.col(text_col)).alias("_q")).select("doc_id", "_q.*")


def op2_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return quality_rules(docs, fit(docs, C.table(spark, sf_dir, "labels")))
