"""Transcript parsing: a hidden Markov model over speaker markers and line features.

A state is a role and how many lines of its turn came before (none, one, two, more). Each line shows a
speaker marker or none, a length class, a number of sentences, whether it ends in a question mark and whether
a blank line stands before it; their probabilities, the transitions and the ends are counted on labelled transcripts. Viterbi decoding
recovers the role of every line, also where markers are missing, and the turns are rendered in one form.

A conversation of any length is decoded as a whole, though no task holds the whole of it: rows are dealt by
ranges of (conversation, turn), a task cuts what it streams into pieces, and the best scores from each state
before a piece to each state at its end form a max-plus matrix. Products of the matrices, first inside a
range and then over ranges, give the states at which the best path enters and leaves each piece, and between
those two every piece is decoded by itself.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .quality_rank import held_out

ROLES = ["system", "user", "assistant"]
#: Speaker names by role.
NAMES = {"system": 0, "instructions": 0, "user": 1, "human": 1, "customer": 1, "assistant": 2, "ai": 2, "bot": 2, "agent": 2}
#: Bounds of the training sample: conversations, turns of each, characters of a turn.
TRAIN_CONVS, TRAIN_TURNS, TRAIN_CHARS = 2000, 32, 2000
#: Turns and characters after which a piece ends before the next marker, and turns after which it ends anyway.
PIECE, PIECE_CHARS, PIECE_MOST = 256, 1 << 19, 1024
#: Every so many turns of a written transcript lack their marker.
DROP = 5
STYLES = 6
_MARK = re.compile(r"^\s*(?:#{1,4}\s*(\w+)\s*:?|\[(\w+)\]\s*:?|<\|(\w+)\|>|\*\*(\w+):?\*\*\s*:?|(\w+)\s*:)(?:\s+|$)")
_WORDS, _SENTENCES = (0, 3, 8, 14, 22, 32, 42, 50, 65, 90), (1, 2, 3, 5, 8)
DEPTH = 4
N = DEPTH * len(ROLES)  # state DEPTH * role + lines of the turn before, at most DEPTH - 1
START = N


def marker(line: str) -> tuple[int, str]:
    """(role + 1 or 0 without marker, the line without it)."""
    m = _MARK.match(line)
    if m and (role := NAMES.get(next(g for g in m.groups() if g).lower())) is not None:
        return role + 1, line[m.end() :]
    return 0, line


def observe(line: str, blank: bool) -> tuple[int, int, int, int, int, str]:
    """What a line shows, given whether a blank one stands before it, and the line without its marker."""
    mark, rest = marker(line)
    n, stops = len(rest.split()), rest.count(".") + rest.count("?") + rest.count("!")
    return mark, sum(n > b for b in _WORDS), sum(stops > b for b in _SENTENCES), int(rest.rstrip().endswith("?")), int(blank), rest


def observed(lines: list[str], blank: bool = False) -> list[tuple]:
    return [observe(x, b) for x, b in zip(lines, [blank, *(not x.strip() for x in lines)])]


_SIZES = (len(ROLES) + 1, len(_WORDS) + 1, len(_SENTENCES) + 1, 2, 2)
_OFTEN = (0.01, 5, 5, 5, 0.5)


def write_turns(turns: list[tuple[str, str]], style: int, bare=()) -> list[tuple[str, str, bool]]:
    """Lines (text, role, opens a turn) of a transcript in one of six styles: four markers, the last two also with a blank
    line after each turn. The turns in ``bare`` lack their marker."""
    out, style = [], style % STYLES
    for i, (role, text) in enumerate(turns):
        name = {"user": ("User", "Human", "user", "User"), "assistant": ("Assistant", "AI", "assistant", "Assistant")}.get(role, ("System", "System", "system", "System"))[style % 4]
        lines = (text or "").split("\n")
        head = "" if i in bare else (f"{name}: ", f"### {name}:\n", f"[{name}] ", f"**{name}:** ")[style % 4]
        for j, line in enumerate((head + lines[0]).split("\n") + lines[1:] + [""] * (style >= 4)):
            out.append((line, role, j == 0))
    return out


def train(transcripts: list[list[tuple[str, str, bool]]]) -> dict:
    """Log-probabilities by counting, every event seen beforehand: rarely for markers, more often for the vaguer features, so
    that one odd line does not outweigh a marker. ``trans`` has a last row for the start; ``end`` by state."""
    trans, end = np.full((N + 1, N), 0.1), np.full(N, 0.1)
    emit = [np.full((N, k), often) for k, often in zip(_SIZES, _OFTEN)]
    for lines in transcripts:
        before, depth = START, 0
        for seen, (_, role, first) in zip(observed([x for x, *_ in lines]), lines):
            depth = 0 if first else min(depth + 1, DEPTH - 1)
            s = DEPTH * (ROLES.index(role) if role in ROLES else 0) + depth
            for e, v in zip(emit, seen):
                e[s, v] += 1
            trans[before, s] += 1
            before = s
        if before != START:
            end[before] += 1
    for s in range(N):
        for b in range(N + 1):  # a turn opens anew or goes on by one line
            if s % DEPTH and (b == START or b // DEPTH != s // DEPTH or s % DEPTH != min(b % DEPTH + 1, DEPTH - 1)):
                trans[b, s] = 0
    total = trans.sum(1, keepdims=True) + np.append(end, 0)[:, None]
    with np.errstate(divide="ignore"):
        return {"trans": np.log(trans / total), "end": np.log(end / total[:N, 0]), "emit": [np.log(e / e.sum(1, keepdims=True)) for e in emit]}


def _scores(seen: list[tuple], model: dict) -> np.ndarray:
    return sum(e[:, [o[i] for o in seen]].T for i, e in enumerate(model["emit"]))


def decode(lines: list[str], model: dict, before: int = START, last: int | None = None, blank: bool = False) -> tuple[list[int], list[str]]:
    """(states, lines without markers) of the likeliest path from the state ``before`` to the state ``last`` (any, if that
    is None: the end is scored); ties go to the lower state. ``blank``: what stands before, if anything, ends in a blank line."""
    if not lines:
        return [], []
    seen = observed(lines, blank and before != START)
    score, trans = _scores(seen, model), model["trans"][:N]
    best = model["trans"][before] + score[0]
    back = np.zeros((len(lines), N), np.int8)
    for t in range(1, len(lines)):
        step = best[:, None] + trans
        back[t] = step.argmax(0)
        best = step.max(0) + score[t]
    s = int((best + model["end"]).argmax()) if last is None else last
    path = [s]
    for t in range(len(lines) - 1, 0, -1):
        s = int(back[t, s])
        path.append(s)
    return path[::-1], [o[-1] for o in seen]


def matrix(lines: list[str], model: dict, blank: bool) -> np.ndarray:
    """Best score from each state before the lines (START last) to each state of the last line."""
    score, trans = _scores(observed(lines, blank), model), model["trans"][:N]
    out = model["trans"] + score[0]
    out[START] = model["trans"][START] + _scores(observed(lines[:1]), model)[0]
    for row in score[1:]:
        out = (out[:, :, None] + trans[None]).max(1) + row
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: ``a``, then ``b``, which does not begin at the start."""
    return (a[:, :, None] + b[None, :N]).max(1)


def cuts(mats: list[np.ndarray], before: int, last: int | None, end: np.ndarray) -> list[tuple[int, int]]:
    """(state before, last state) of each of the pieces with these matrices on the best path from ``before`` to ``last``."""
    best, back = mats[0][before], []
    for m in mats[1:]:
        step = best[:, None] + m[:N]
        back.append(step.argmax(0))
        best = step.max(0)
    s = int((best + end).argmax()) if last is None else last
    at = [s]
    for b in reversed(back):
        s = int(b[s])
        at.append(s)
    at.reverse()
    return list(zip([before, *at], at))


def turns_of(states: list[int], lines: list[str]) -> list[tuple[str, str]]:
    """(role, lines) of each turn; lines that go on with a turn before the first are a turn's rest and stand first."""
    turns: list[tuple[str, list[str]]] = []
    for s, line in zip(states, lines):
        if s % DEPTH == 0 or not turns:
            turns.append((ROLES[s // DEPTH], [line]))
        else:
            turns[-1][1].append(line)
    return [(role, "\n".join(x)) for role, x in turns]


def parse(text: str, model: dict) -> list[tuple[str, str]]:
    """(role, content) of each turn of a transcript; a null or empty one has none."""
    return [(role, x.strip()) for role, x in turns_of(*decode(text.split("\n"), model))] if text else []


def render(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"<|{role}|>\n{content}\n<|end|>" for role, content in turns)


def parse_transcripts(df: DataFrame, model: dict, text_col: str = "transcript") -> DataFrame:
    """``df`` with ``parsed`` (``hmm_parsed`` where that name is taken): struct of n_turns, roles (comma-joined) and rendered.

    For transcripts that fit in a cell. Null and empty texts have no turns; rows, repeated ones too, stay as they are.
    """

    @F.pandas_udf("n_turns long, roles string, rendered string")
    def parsed(t: pd.Series) -> pd.DataFrame:
        got = [parse(x, model) for x in C.clean(t)]
        return pd.DataFrame({"n_turns": [len(g) for g in got], "roles": [",".join(r for r, _ in g) for g in got], "rendered": [render(g) for g in got]})

    return df.withColumn("hmm_parsed" if "parsed" in df.columns else "parsed", parsed(F.col(f"`{text_col}`")))


def pieces(turns: DataFrame, model: dict, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, range, piece, transcript, blank, scores): conversations written out with markers, in pieces of bounded size.

    ``scores`` is the piece's matrix, null where the piece is surely a whole conversation.
    """
    t = turns.select(F.col(conv_col).alias("conv_id"), F.coalesce(F.col(turn_col), F.lit(0)).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the row's number parts ties, so that no range is longer than others however often a row repeats
    order = ["conv_id", "turn", "role", "h", "i"]
    t = t.withColumn("h", F.xxhash64("text")).withColumn("i", F.monotonically_increasing_id())
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = t.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", F.spark_partition_id().alias("range"), "turn", "role", "text")
    kind = t.schema["conv_id"].dataType.simpleString()

    def run(batches):
        held, size, no, first = [], 0, 0, True  # rows of the piece, its characters, its number, whether nothing was emitted yet
        out = None
        own, at = None, 0

        def flush(whole):
            nonlocal held, size, no
            style = zlib.crc32(str(own).encode("utf-8", "surrogatepass")) % STYLES
            bare = {k for k, (turn, _, _) in enumerate(held) if turn % DROP == DROP - 1}
            lines = "\n".join(x for x, *_ in write_turns([(r, x) for _, r, x in held], style, bare))
            scores = None if whole else matrix(lines.split("\n"), model, style >= 4).ravel().tolist()
            row = pa.RecordBatch.from_arrays([pa.array([own], arrow), pa.array([at], pa.int32()), pa.array([no], pa.int64()), pa.array([lines], pa.string()), pa.array([style >= 4]), pa.array([scores], pa.list_(pa.float64()))], names)
            held, size, no = [], 0, no + 1
            return row

        names, arrow = ["conv_id", "range", "piece", "transcript", "blank", "scores"], None
        for b in batches:
            arrow = b.schema.field(0).type
            for conv, at_, turn, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if held and (conv != own or conv is None):
                    # neither the first conversation of the range nor one in several pieces: whole; without a conversation, each row is one
                    yield flush(own is None or not first and no == 0)
                    no, first = 0, False if own is not None else first
                elif held and (len(held) >= PIECE_MOST or (len(held) >= PIECE or size >= PIECE_CHARS) and turn % DROP != DROP - 1):
                    yield flush(False)
                own, at = conv, at_
                held.append((turn, role, text))
                size += len(text)
        if held:
            yield flush(own is None)  # the last may go on in the next range

    return t.mapInArrow(run, f"conv_id {kind}, range int, piece long, transcript string, blank boolean, scores array<double>")


def _states(found: DataFrame, model: dict) -> DataFrame:
    """(conv_id, range, piece, before, last): the states around each piece of the conversations in several pieces."""
    some = found.filter("scores is not null").select("conv_id", "range", "piece", "scores")
    kind = some.schema["conv_id"].dataType.simpleString()
    shape, end = (N + 1, N), model["end"]

    def ordered(t, key):
        t = t.sort_by(key)
        return t, [np.array(x.as_py()).reshape(shape) for x in t.column("scores")]

    def product(key, t):
        t, mats = ordered(t, "piece")
        out = mats[0]
        for m in mats[1:]:
            out = times(out, m)
        return pa.table({"conv_id": t.column("conv_id").slice(0, 1), "range": t.column("range").slice(0, 1), "scores": pa.array([out.ravel().tolist()])})

    def over_ranges(key, t):
        t, mats = ordered(t, "range")
        before, last = zip(*cuts(mats, START, None, end))
        return pa.table({"c": t.column("conv_id"), "r": t.column("range"), "b": pa.array(before, pa.int32()), "l": pa.array(last, pa.int32())})

    def inside(key, t):
        t, mats = ordered(t, "piece")
        before, last = zip(*cuts(mats, t.column("b")[0].as_py(), t.column("l")[0].as_py(), end))
        return pa.table({"conv_id": t.column("conv_id"), "range": t.column("range"), "piece": t.column("piece"), "before": pa.array(before, pa.int32()), "last": pa.array(last, pa.int32())})

    by_range = some.groupBy("conv_id", "range").applyInArrow(product, f"conv_id {kind}, range int, scores array<double>")
    around = by_range.groupBy("conv_id").applyInArrow(over_ranges, f"c {kind}, r int, b int, l int")  # at most a row for each range
    both = some.join(around, (F.col("conv_id") == F.col("c")) & (F.col("range") == F.col("r"))).select("conv_id", "range", "piece", "scores", "b", "l")
    return both.groupBy("conv_id", "range").applyInArrow(inside, f"conv_id {kind}, range int, piece long, before int, last int")


def recover_turns(turns: DataFrame, model: dict, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, content, rendered): the turns that are recovered from the written transcript of each conversation.

    ``turn`` counts them from 0. Conversations of any length are decoded as a whole, and a hot one by many tasks.
    Each row without a conversation is one of its own. A null turn number counts as 0, a null text or role is
    empty, equal turns are ordered by role and a hash of the text, repeated rows are turns of their own. A turn, not a
    conversation, has to fit in a cell. The id may have any type that sorts. Other columns are not read. An empty table gives none. Where paths are equally
    likely, the choice may depend on where ranges end.
    """
    found = C.materialize(pieces(turns, model, conv_col, turn_col, role_col, text_col))
    known = _states(found, model).select(F.col("conv_id").alias("c"), F.col("range").alias("r"), F.col("piece").alias("p"), "before", "last")

    @F.pandas_udf("array<struct<role:string,content:string,opens:boolean,edge:boolean>>")
    def decoded(text: pd.Series, before: pd.Series, last: pd.Series, blank: pd.Series) -> pd.Series:
        out = []
        for t, b, x, k in zip(text, before, last, blank):
            several = not pd.isna(x)
            states, lines = decode(t.split("\n"), model, int(b) if several else START, int(x) if several else None, bool(k))
            turns, rest = turns_of(states, lines), bool(states[0] % DEPTH)
            edge = lambda i: several and (i == len(turns) - 1 or i == 0 and rest)  # noqa: B023, E731  may be a part of a turn
            out.append([{"role": role, "content": content if edge(i) else content.strip(), "opens": i > 0 or not rest, "edge": edge(i)} for i, (role, content) in enumerate(turns)])
        return pd.Series(out, dtype=object)

    @F.pandas_udf("string")
    def joined(parts: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(p["content"] for p in x).strip() for x in parts], dtype=object)

    got = found.join(known, (F.col("conv_id") == F.col("c")) & (F.col("range") == F.col("r")) & (F.col("piece") == F.col("p")), "left")
    got = C.materialize(got.select("conv_id", "range", "piece", decoded("transcript", "before", "last", "blank").alias("t"), F.col("scores").isNotNull().alias("several")))
    # how many turns open before each piece: over the ranges of a conversation, then over the pieces of a range
    count = got.filter("several").select(F.col("conv_id").alias("c"), F.col("range").alias("r"), F.col("piece").alias("p"), F.expr("CAST(size(filter(t, x -> x.opens)) AS BIGINT)").alias("n"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    ranges = count.groupBy("c", "r").agg(F.sum("n").alias("n")).select(F.col("c").alias("c2"), F.col("r").alias("r2"), F.coalesce(F.sum("n").over(before("c", "r")), F.lit(0)).alias("base"))
    offset = count.withColumn("own", F.coalesce(F.sum("n").over(before("c", "r", "p")), F.lit(0))).join(ranges, (F.col("c") == F.col("c2")) & (F.col("r") == F.col("r2"))).select("c", "r", "p", (F.col("base") + F.col("own")).alias("offset"))
    rows = got.join(offset, (F.col("conv_id") == F.col("c")) & (F.col("range") == F.col("r")) & (F.col("piece") == F.col("p")), "left")
    rows = rows.select("conv_id", "range", "piece", F.coalesce("offset", F.lit(0)).alias("o"), F.expr("IF(t[0].opens, 0, 1)").alias("rest"), F.posexplode("t").alias("k", "x"))
    rows = rows.select("conv_id", "range", "piece", (F.col("o") + F.col("k") - F.col("rest")).cast("long").alias("turn"), "x.*")
    inner = rows.filter("not edge").select("conv_id", "turn", "role", "content")
    # the parts of the turns that an end of a piece may cut; those of one turn have one role
    parts = rows.filter("edge").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.sort_array(F.collect_list(F.struct("range", "piece", "content"))).alias("parts"))
    every = inner.unionAll(parts.select("conv_id", "turn", "role", joined("parts").alias("content")))
    return every.withColumn("rendered", F.format_string("<|%s|>\n%s\n<|end|>", "role", "content"))


def fit(turns: DataFrame, keep=lambda c: ~held_out(c)) -> dict:
    """The model of at most TRAIN_CONVS conversations (fixed hash order, outside the held-out fold), written in two styles each.

    Of each the first TRAIN_TURNS turns count, and of a turn the first TRAIN_CHARS characters: bounds of what reaches the driver.
    """
    ids = turns.filter("conv_id is not null").filter(keep(F.col("conv_id"))).select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(TRAIN_CONVS).withColumnRenamed("conv_id", "_c")
    rows = turns.filter(f"turn < {TRAIN_TURNS}").select("conv_id", "turn", "role", F.substring("text", 1, TRAIN_CHARS).alias("text")).join(F.broadcast(ids), F.col("conv_id") == F.col("_c"))
    rows = rows.select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn", "role", "text").limit(TRAIN_CONVS * TRAIN_TURNS).collect()
    convs: dict = {}
    for r in rows:
        convs.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    bare = set(range(DROP - 1, TRAIN_TURNS * 2, DROP))
    return train([write_turns(x, style, bare) for i, x in enumerate(convs.values()) for style in (i % STYLES, (i + STYLES // 2) % STYLES)])


def op9_transcript_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = C.table(spark, sf_dir, "conversations")
    return recover_turns(turns, fit(turns))
