"""Shared helpers of the training-data operators: tables, working tables and Arrow plumbing."""

from __future__ import annotations

import base64
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from krathong.operators.tables import made, materialize, release  # noqa: F401

#: Words of a text wherever a contract speaks of words: runs without space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _coded(x):
    if isinstance(x, np.ndarray):
        return {"type": str(x.dtype), "shape": x.shape, "data": base64.b64encode(np.ascontiguousarray(x).tobytes()).decode()}
    return [_coded(v) for v in x] if isinstance(x, (list, tuple)) else {k: _coded(v) for k, v in x.items()} if isinstance(x, dict) else x.item() if isinstance(x, np.generic) else x


def _decoded(x):
    if isinstance(x, dict) and set(x) == {"type", "shape", "data"}:
        return np.frombuffer(base64.b64decode(x["data"]), x["type"]).reshape(x["shape"]).copy()
    return [_decoded(v) for v in x] if isinstance(x, list) else {k: _decoded(v) for k, v in x.items()} if isinstance(x, dict) else x


def save_model(spark: SparkSession, model: dict, path: str) -> None:
    """Keeps a fitted model (arrays, numbers and lists of them) as a one-row table, so that later runs need not fit again."""
    spark.createDataFrame([(json.dumps(_coded(model)),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> dict:
    return _decoded(json.loads(spark.read.parquet(path).first()[0]))


def pack(df: DataFrame) -> DataFrame:
    """Each row as one struct column ``row``: what is added beside it cannot clash with the table's own columns."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def slices(texts: list[str], limit: int = 1 << 20):
    """Cuts a batch into runs of about ``limit`` characters, so that numpy buffers stay small."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def clean(texts) -> list[str]:
    """Null texts count as empty."""
    return [t if isinstance(t, str) else "" for t in texts]


_TOP = 0x3000
WS, UPPER, DIGIT, SYMBOL, LETTER, STOP, PIPE, BANG = (1 << i for i in range(8))


def _class_table() -> np.ndarray:
    out = np.zeros(_TOP + 1, np.uint8)
    for c in range(_TOP):
        s = chr(c)
        out[c] = (
            WS * (c == 32 or 9 <= c <= 13)
            | UPPER * s.isupper()
            | DIGIT * (48 <= c <= 57)
            | SYMBOL * (s in "#*$%&|<>")
            | LETTER * s.isalpha()
            | STOP * (s in ".?")
            | PIPE * (s == "|")
            | BANG * (s == "!")
        )
    out[_TOP] = LETTER
    return out


CLASSES = _class_table()


class Lines:
    """Character-class counts of every \\n-split line of a run of texts, computed on one code-point buffer."""

    def __init__(self, texts: list[str]):
        cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        self.cp = cp
        cls = self.cls = CLASSES[np.minimum(cp, _TOP)]
        ends = np.flatnonzero(cp == 10)
        starts = np.concatenate(([0], ends[:-1] + 1))
        self.starts, self.ends = starts, ends
        per = np.array([t.count("\n") + 1 for t in texts], np.int64)
        self.doc = np.repeat(np.arange(len(texts)), per)
        self.first = np.concatenate(([0], np.cumsum(per)[:-1])).astype(np.int64)
        self.per = per
        self.n_chars = (ends - starts).astype(np.int64)
        ws = (cls & WS) != 0
        at = np.empty(len(ws), bool)
        at[0], at[1:] = not ws[0], ~ws[1:] & ws[:-1]
        self.word_at = at
        add = lambda m: np.add.reduceat(m, starts, dtype=np.int64)
        self.n_words, self.n_ws = add(at), add(ws) - 1
        self.n_upper, self.n_digit, self.n_symbol, self.n_letter, self.n_stop, self.n_pipe, self.n_bang = (add((cls & b) != 0) for b in (UPPER, DIGIT, SYMBOL, LETTER, STOP, PIPE, BANG))

    def by_doc(self, per_line: np.ndarray) -> np.ndarray:
        return np.add.reduceat(per_line, self.first)
