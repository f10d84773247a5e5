"""Conversation structure repair: cheapest edits to a legal order of roles, by lazy weighted determinisation.

The edits form a weighted automaton of four states (nothing yet, after a system turn, after a user's, after an assistant's) that reads one symbol for
each row: its role, whether it has to go, whether it is truncated. The costs of reaching the four states after some rows,
less the least of them, are one state of a deterministic automaton; these states and their transitions are
made when first met and kept in a table, so that reading a row is one look-up. The sum of what was taken off gives the cost, a trace
of tight arcs from the end backward marks all states on cheapest paths, and a walk along the marks that takes the ASCII-least letter
each time spells the audit.

Nothing is gathered by conversation but what the result itself holds. Rows without their texts are sorted over all tasks by conversation and
turn and cut into pieces of bounded length. A piece is summed up by the costs from each of its four entry states to each exit state;
the pieces of a conversation are composed from both sides, then each piece is traced by itself, for each entry state a cheapest path may come
through. Last, one pass over the rows kept, in order, picks the paths that meet and hashes the texts, of which it holds one at a time
(SHA-256 of a conversation can't be taken in parts, and its audit is one cell).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common as C

#: Costs of the edits; a truncated row that stays adds one more.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Rows of a piece.
PIECE = 8192
INF = 1 << 60
BLANKS = " \t\n\x0b\x0c\r"
#: States: nothing yet, system, user, assistant; which state the next user's or assistant's turn leads to from each.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
SYMBOLS = 9


def arcs(symbol: int) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of what may be done with a row. 0: it has to go; else 1 + 2 * (0 system, 1 user, 2 assistant, 3 other) + truncated."""
    out = [("D", q, q, DELETE) for q in range(4)]
    if symbol:
        role, cut = divmod(symbol - 1, 2)
        if role == 0:
            out.append(("K", START, SYSTEM, TRUNCATED * cut))
        for q, r in enumerate(NEXT):
            own = role == r - 1
            out.append(("K" if own else "R", q, r, TRUNCATED * cut + (0 if own else REROLE)))
    return out


def closed(costs: list[int]) -> list[int]:
    """Costs with turns inserted wherever that is cheaper."""
    costs = list(costs)
    for _ in range(2):
        for q in (START, SYSTEM, ASSISTANT, USER):
            costs[NEXT[q]] = min(costs[NEXT[q]], costs[q] + INSERT)
    return [min(c, INF) for c in costs]


class Table:
    """The deterministic automaton, as far as it has been met."""

    def __init__(self):
        self.vectors: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.go: dict[tuple, tuple] = {}
        self.marks: dict[tuple, int] = {}
        self.moves: dict[tuple, tuple] = {}

    def state(self, costs) -> tuple[int, int]:
        """(state, least cost). What can't be on a cheapest path goes, which keeps the number of states small: an assistant's turn can be followed by
        whatever follows a system's, and by what follows none if a system's turn is deleted."""
        costs = list(costs)
        if costs[SYSTEM] > costs[ASSISTANT]:
            costs[SYSTEM] = INF
        if costs[START] > costs[ASSISTANT] + DELETE:
            costs[START] = INF
        low = min(costs)
        v = tuple(c - low if c < INF else INF for c in costs)
        if v not in self.ids:
            self.ids[v] = len(self.vectors)
            self.vectors.append(v)
        return self.ids[v], low

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, cost taken off)."""
        if (state, symbol) not in self.go:
            v, out = self.vectors[state], [INF] * 4
            for _, q, r, cost in arcs(symbol):
                out[r] = min(out[r], v[q] + cost)
            self.go[state, symbol] = self.state(closed(out))
        return self.go[state, symbol]

    def scan(self, costs, runs) -> tuple[list[int], list[int]]:
        """States along the ``runs`` (symbol, times) from the ``costs`` given, and the costs at the end. Only rows that have to go come more than once."""
        state, total = self.state(costs)
        states = [state]
        for symbol, times in runs:
            state, low = self.step(state, symbol)
            total += low * times
            states.append(state)
        return states, [min(total + c, INF) for c in self.vectors[state]]

    def back(self, state: int, symbol: int, mask: int) -> int:
        """States (as bits) before a row from which tight arcs lead to those in ``mask`` behind it."""
        key = state, symbol, mask
        if key not in self.marks:
            v, (after, low), out = self.vectors[state], self.step(state, symbol), 0
            u = self.vectors[after]
            for _, q, r, cost in arcs(symbol):
                if mask >> r & 1 and v[q] < INF and v[q] + cost == u[r] + low:
                    out |= 1 << q
            for _ in range(3):
                for q, r in enumerate(NEXT):
                    if out >> r & 1 and v[q] < INF and v[q] + INSERT == v[r]:
                        out |= 1 << q
            self.marks[key] = out
        return self.marks[key]

    def move(self, state: int, symbol: int, here: int, mask: int, at: int) -> tuple[str, int]:
        """(letter, next) of the least tight letter at a state: I stays before the row, the others pass it."""
        key = state, symbol, here, mask, at
        if key not in self.moves:
            v, (after, low) = self.vectors[state], self.step(state, symbol)
            u = self.vectors[after]
            tight = [(letter, r) for letter, q, r, cost in arcs(symbol) if q == at and mask >> r & 1 and v[q] + cost == u[r] + low]
            r = NEXT[at]
            if here >> r & 1 and v[at] + INSERT == v[r]:
                tight.append(("I", r))
            self.moves[key] = min(tight)
        return self.moves[key]

    def trace(self, runs, before, after, best: int, last: bool) -> dict[int, tuple[int, str, list, str]]:
        """Of each entry state on a cheapest path: exit state, letters, (run, inserted roles before it, state) of the rows that stay, roles inserted behind.

        ``before``: costs of reaching the entry states, ``after``: costs from the exit states to the end, ``best``: their least sum.
        """
        states, costs = self.scan(before, runs)
        masks = [sum(1 << q for q in range(4) if costs[q] + after[q] == best)]
        for state, (symbol, _) in zip(states[-2::-1], runs[::-1]):
            masks.append(self.back(state, symbol, masks[-1]))
        masks.reverse()
        out = {}
        for entry in range(4):
            if not masks[0] >> entry & 1:
                continue
            q, letters, kept, put = entry, [], [], ""
            for i, (symbol, times) in enumerate(runs):
                while True:
                    letter, q = self.move(states[i], symbol, masks[i], masks[i + 1], q)
                    letters.append(letter * times)
                    if letter != "I":
                        break
                    letters[-1] = "I"
                    put += "ua"[q == ASSISTANT]
                if letter in "KR":
                    kept.append((i, put, letter, q))
                    put = ""
            while last and (q not in (START, ASSISTANT) or costs[q] != best):
                q = NEXT[q]
                letters.append("I")
                put += "ua"[q == ASSISTANT]
            out[entry] = q, "".join(letters), kept, put
        return out


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): faults planted by the checksum of ``conv_id:turn``; nulls of each column count as one space.

    0 of 20 drops the row, 1 empties its text, 2 takes its ends of sentences, 3 repeats it, 4 makes it the user's.
    """
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", spelled("role").alias("role"), spelled("text").alias("text"), F.pmod(F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn")).cast("binary")), F.lit(20)).alias("c"))
    return rows.filter("c <> 0").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(F.col("c") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("c") == 1, "").when(F.col("c") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), F.when(F.col("c") == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, has_turn, turn, role, digest, times, blank, symbol): a row for each different one, without its text.

    Counting goes by conversation, turn, role and digest; only the first turn of a role and digest is no duplicate. The join that
    marks it has the turn in its key, so a text that fills a conversation meets no single task.
    """
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.select("conv_id", F.col("turn").isNotNull().alias("has_turn"), "turn", "role", _digest(F.col("text")).alias("digest"), "times", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).cast("int").alias("cut"))
    each = rows.groupBy("conv_id", "has_turn", "turn", "role", "digest").agg(F.sum("times").alias("times"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    first = each.filter("not blank").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct("has_turn", "turn")).alias("f"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")) & (F.col("has_turn") == F.col("f.has_turn")) & F.col("turn").eqNullSafe(F.col("f.turn"))
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1)).cast("int"), F.lit(0))
    kind = F.when(kind == 0, 3).otherwise(kind - 1)
    symbol = F.when(F.col("f").isNotNull() & ~F.col("blank"), 1 + 2 * kind + F.col("cut")).otherwise(0).cast("int")
    return each.join(first, same, "left").select("conv_id", "has_turn", "turn", "role", "digest", "times", "blank", symbol.alias("symbol"))


_ORDER = ("conv_id", "has_turn", "turn", "role", "digest")
_PIECE = "pid int, k int, lo long, hi long, turns long, head string, tail string, blank long, duplicate long, truncated long, illegal long, costs array<long>, symbols array<int>, times array<long>, roles array<string>, digests array<string>"


def _runs(symbols, times) -> tuple[list, list]:
    """Runs (symbol, times) of the rows, and the row of each run: what comes more than once has to go after the first."""
    runs, row = [], []
    for i, (s, n) in enumerate(zip(symbols, times)):
        for run in ([(s, 1), (0, n - 1)] if s and n > 1 else [(s, n)]):
            runs.append(run)
            row.append(i)
    return runs, row


def _pieces(kind: pa.DataType):
    """For mapInArrow over rows in order: (conv_id, ...) of each piece of a conversation, numbered within its partition."""

    def run(batches):
        table, pid, k, now, held = Table(), TaskContext.get().partitionId(), 0, None, []

        def piece():
            nonlocal k
            turns = [r[2] for r in held if r[2] is not None]
            symbols, times = [r[7] for r in held], [r[5] for r in held]
            runs, _ = _runs(symbols, times)
            initials = [r[3][:1] or " " for r in held]
            units = [closed([0 if q == p else INF for q in range(4)]) for p in range(4)]
            k += 1
            return (
                held[0][0], pid, k, turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), initials[0], initials[-1],
                sum(r[5] for r in held if r[6]), sum(r[5] - (r[7] > 0) for r in held if not r[6]), sum(r[7] > 0 and r[7] % 2 == 0 for r in held),
                sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])) + sum(times) - len(times),
                [c for u in units for c in table.scan(u, runs)[1]], symbols, times, [r[3] if r[7] else None for r in held], [r[4] if r[7] else None for r in held],
            )

        fields = ["conv_id", *[f.split()[0] for f in _PIECE.split(", ")]]
        types = [kind, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], fields)
        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if held and (r[0] != now or len(held) >= PIECE):
                    out.append(piece())
                    held = []
                now = r[0]
                held.append(r)
            if out:
                yield batch(out)
        if held:
            yield batch([piece()])

    return run


_BOUNDS = "pid int, k int, before array<long>, after array<long>, best long, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long"


def _bounds(batches):
    """For mapInArrow over pieces in order, all of a conversation: costs at both ends of each, and on the first the conversation's counts."""
    held = []

    def add(a, m):
        return [min(min(a[q] + m[4 * q + r] for q in range(4)), INF) for r in range(4)]

    def done():
        before = [closed([0, INF, INF, INF])]
        for p in held:
            before.append(add(before[-1], p["costs"]))
        after = [closed_end()]
        for p in reversed(held):
            after.append([min(min(p["costs"][4 * q + r] + after[-1][r] for r in range(4)), INF) for q in range(4)])
        after.reverse()
        best = min(before[-1][START], before[-1][ASSISTANT])
        turns = [p for p in held if p["lo"] is not None]
        distinct = sum(p["turns"] for p in turns) - sum(a["hi"] == b["lo"] for a, b in zip(turns, turns[1:]))
        gaps = turns[-1]["hi"] - turns[0]["lo"] + 1 - distinct if turns else 0
        total = {c: sum(p[c] for p in held) for c in ("blank", "duplicate", "truncated", "illegal")}
        total["illegal"] += sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        for i, p in enumerate(held):
            yield (p["pid"], p["k"], before[i], after[i + 1], best, i == len(held) - 1, gaps, *total.values())

    fields = [f.split()[0] for f in _BOUNDS.split(", ")]
    types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.bool_(), *[pa.int64()] * 5]
    batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], fields)
    for b in batches:
        out = []
        for p in b.to_pylist():
            if held and p["conv_id"] != held[0]["conv_id"]:
                out.extend(done())
                held = []
            held.append(p)
        if out:
            yield batch(out)
    if held:
        yield batch(list(done()))


def closed_end() -> list[int]:
    """Costs of an end at each state: turns are inserted until an assistant has spoken, or nobody has."""
    return [0, INSERT * 2, INSERT, 0]


_PATHS = "pid int, k int, seq int, role string, digest string, how array<string>, exits array<int>, letters array<string>, puts array<string>, best long, gaps long, blank long, duplicate long, truncated long, illegal long"


def _paths(kind: pa.DataType):
    """For mapInArrow over pieces with their bounds: a row (seq -1) with what each entry state comes to, and one for each row that stays from any of them.

    ``how`` of a row and an entry state: the roles inserted before it (u, a), a bar, its role; null where it goes.
    """
    fields = ["conv_id", *[f.split()[0] for f in _PATHS.split(", ")]]
    types = [kind, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.int64()] * 6]

    def run(batches):
        table = Table()
        for b in batches:
            for p in b.to_pylist():
                runs, row = _runs(p["symbols"], p["times"])
                found = table.trace(runs, p["before"], p["after"], p["best"], p["last"])
                key = (p["conv_id"], p["pid"], p["k"])
                of = lambda i: [found[q][i] if q in found else None for q in range(4)]  # noqa: B023, E731
                out = [(*key, -1, None, None, None, of(0), of(1), of(3), p["best"], p["gaps"], p["blank"], p["duplicate"], p["truncated"], p["illegal"])]
                how: dict[int, list] = {}
                for q, (_, _, kept, _) in found.items():
                    for i, put, letter, r in kept:
                        role = p["roles"][row[i]]
                        how.setdefault(row[i], [None] * 4)[q] = f"{put}|{role if letter == 'K' else ROLE[r]}"
                out += [(*key, i, p["roles"][i], p["digests"][i], h, None, None, None, *[None] * 6) for i, h in sorted(how.items())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], fields)

    return run


_ITEMS = "conv_id, pid, k, seq, how, exits, letters, puts, best, gaps, blank, duplicate, truncated, illegal"


def _items(rows: DataFrame) -> DataFrame:
    """All that the last pass reads: a row for each conversation, each piece and each row that may stay with its text; sorted, a conversation in one task."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)
    symbols = C.materialize(_symbols(rows))
    dealt = symbols.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in _ORDER]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in _ORDER])
    pieces = C.materialize(dealt.mapInArrow(_pieces(arrow), f"conv_id {kind.simpleString()}, {_PIECE}"))
    narrow = pieces.drop("symbols", "times", "roles", "digests").repartition(n, "conv_id").sortWithinPartitions("conv_id", "pid", "k")
    bounds = narrow.mapInArrow(_bounds, _BOUNDS).withColumnsRenamed({"pid": "p", "k": "n"})
    whole = pieces.select("conv_id", "pid", "k", "symbols", "times", "roles", "digests").join(bounds, (F.col("pid") == F.col("p")) & (F.col("k") == F.col("n"))).drop("p", "n")
    paths = C.materialize(whole.mapInArrow(_paths(arrow), f"conv_id {kind.simpleString()}, {_PATHS}"))
    texts = rows.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), _digest(F.col("text")).alias("d"), "text").groupBy("c", "r", "d").agg(F.first("text").alias("text"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    names = [c.strip() for c in _ITEMS.split(",")]
    stay = paths.filter("seq >= 0").join(texts, same).select(*names, "text")
    return stay.unionAll(paths.filter("seq < 0").select(*names, F.lit(None).cast("string").alias("text")))


def _sorted(items: DataFrame) -> DataFrame:
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return items.repartition(n, "conv_id").sortWithinPartitions("conv_id", "pid", "k", "seq")


class _Walk:
    """Follows one conversation: from piece to piece by the state that the one before ended in."""

    def __init__(self):
        self.state, self.audit, self.put, self.counts = START, [], "", (0,) * 6

    def piece(self, r: dict) -> list[tuple[str, str]]:
        out = self.tail()
        self.entry, self.put = self.state, r["puts"][self.state]
        self.audit.append(r["letters"][self.state])
        self.state = r["exits"][self.state]
        self.counts = tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "best"))
        return out

    def row(self, r: dict) -> list[tuple[str, str]]:
        how = r["how"][self.entry]
        if how is None:
            return []
        put, role = how.split("|", 1)
        return [*[("user" if x == "u" else "assistant", "") for x in put], (role, r["text"])]

    def tail(self) -> list[tuple[str, str]]:
        """What is inserted behind the last row of the piece."""
        out, self.put = [("user" if x == "u" else "assistant", "") for x in self.put], ""
        return out


def _walked(batches):
    """(conversation, walk, messages) for each row in order; the walk is None once the conversation has ended."""
    now, walk = None, None
    for b in batches:
        for r in b.to_pylist():
            if walk is None or r["conv_id"] != now:
                if walk is not None:
                    yield now, walk, walk.tail(), True
                now, walk = r["conv_id"], _Walk()
            if r["pid"] >= 0:
                yield now, walk, walk.piece(r) if r["seq"] < 0 else walk.row(r), False
    if walk is not None:
        yield now, walk, walk.tail(), True


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of the repaired conversations of (conv_id, turn, role, text, times), in order of place from 0."""
    kind = rows.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)

    def run(batches):
        place, out = 0, []
        for conv, _, messages, end in _walked(batches):
            for role, text in messages:
                out.append((conv, place, role, text))
                place += 1
            place = 0 if end else place
            if len(out) > 1000:
                yield emit(out)
                out = []
        if out:
            yield emit(out)

    emit = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (arrow, pa.int64(), pa.string(), pa.string()))], ["conv_id", "place", "role", "text"])
    return _sorted(_items(rows)).mapInArrow(run, f"conv_id {kind.simpleString()}, place long, role string, text string")


def report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Counts, cost, audit and hash of each conversation of ``conversations`` (conv_id), repaired from ``rows`` (conv_id, turn, role, text, times).

    Rows go by turn (nulls first), those of one turn by role and the digest of the text. Nulls in role or text count as one space (``damage``), a role
    without letters as another role. A null conv_id is a conversation like any other. Repeated rows are duplicates of the
    first. A conversation without rows: zeros, an empty audit, the hash of the empty string. Columns beyond those named are not read; empty tables give no rows.
    """
    kind = rows.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)
    items = _items(rows)
    names = items.columns
    every = conversations.select("conv_id").distinct().select("conv_id", *[F.lit(-1 if c in ("pid", "k", "seq") else None).cast(items.schema[c].dataType).alias(c) for c in names if c != "conv_id"])
    fields = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches):
        out, sha, begun = [], hashlib.sha256(), False
        for conv, walk, messages, end in _walked(batches):
            for role, text in messages:
                sha.update(("\n" if begun else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                begun = True
            if end:
                out.append((conv, *walk.counts, "".join(walk.audit), sha.hexdigest()))
                sha, begun = hashlib.sha256(), False
                if len(out) > 1000:
                    yield emit(out)
                    out = []
        if out:
            yield emit(out)

    emit = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (arrow, *[pa.int64()] * 6, pa.string(), pa.string()))], fields)
    schema = f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _sorted(items.unionAll(every)).mapInArrow(run, schema)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = C.table(spark, sf_dir, "conversations")
    return report(damage(conversations), conversations)


def _oracle() -> str:
    """The whole of it in DuckDB: the checksum bit by bit, faults by windows, and for each order of roles so far the least (cost, letters) with its messages, row by row.

    A state is one string: its cost in nine digits, its letters, a line feed and a mark, its messages; the least string has the least cost, then the ASCII-least letters.
    """
    crc = "list_reduce([CAST(4294967295 AS BIGINT), *]::BIGINT[], lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    crc = crc.replace("[CAST(4294967295 AS BIGINT), *]::BIGINT[]", f"list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({key}, ''), lambda x: CAST(unicode(x) AS BIGINT)))")
    add = lambda state, cost, letter, said="''": f"CASE WHEN {state} <> '' THEN lpad(CAST(CAST({state}[1:9] AS INT) + {cost} AS VARCHAR), 9, '0') || split_part({state}[10:], chr(1), 1) || '{letter}' || chr(1) || {state}[strpos({state}, chr(1)) + 1:] || {said} END"
    says = lambda role, text="''": f"chr(10) || {role} || ':' || {text}"
    least = lambda *x: f"coalesce(least({', '.join(f'nullif({v}, {chr(39) * 2})' for v in x)}), '')"

    def closed(names, src):
        """Two rounds of inserted turns."""
        o, s, u, a = names
        put_u = least(u, *(add(q, 2, "I", says("'user'")) for q in (o, s, a)))
        one = f"SELECT *, {put_u} AS u1 FROM ({src})"
        two = f"SELECT *, {least(a, add('u1', 2, 'I', says(chr(39) + 'assistant' + chr(39))))} AS a1 FROM ({one})"
        return two

    step = (
        f"SELECT conv_id, n + 1 AS n, {least(add('o', 3, 'D'))} AS o, "
        f"{least(add('s', 3, 'D'), f'CASE WHEN NOT must AND i = {chr(39)}s{chr(39)} THEN ' + add('o', 'cut', 'K', says('role', 'text')) + ' END')} AS s, "
        + least(add("u1", 3, "D"), *(f"CASE WHEN NOT must THEN CASE WHEN i = 'u' THEN {add(q, 'cut', 'K', says('role', 'text'))} ELSE {add(q, '2 + cut', 'R', says(chr(39) + 'user' + chr(39), 'text'))} END END" for q in ("o", "s", "a1")))
        + " AS u, "
        + least(add("a1", 3, "D"), f"CASE WHEN NOT must THEN CASE WHEN i = 'a' THEN {add('u1', 'cut', 'K', says('role', 'text'))} ELSE {add('u1', '2 + cut', 'R', says(chr(39) + 'assistant' + chr(39), 'text'))} END END")
        + " AS a"
    )
    white = "[^\\x20\\x09-\\x0D]"
    parts = [
        f"d AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({crc}, 4294967295) % 20 AS c FROM conversations)",
        "m AS (SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role, CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE c WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE c <> 0)",
        "x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n, coalesce(nullif(role[1], ''), ' ') AS i FROM m)",
        f"""f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, NOT regexp_matches(text, '{white}') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS short,
  lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair FROM x)""",
        "g AS MATERIALIZED (SELECT conv_id, n, role, i, text, blank OR again AS must, CASE WHEN short AND NOT blank AND NOT again THEN 1 ELSE 0 END AS cut FROM f)",
        f"""r AS (SELECT conv_id, CAST(1 AS BIGINT) AS n, '000000000' || chr(1) AS o, '' AS s, '' AS u, '' AS a FROM (SELECT DISTINCT conv_id FROM g)
  UNION ALL {step} FROM ({closed(('o', 's', 'u', 'a'), 'SELECT r.*, g.role, g.i, g.text, g.must, g.cut FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.n = r.n')}))""",
        "z AS (SELECT r.conv_id, o, s, u, a FROM r JOIN (SELECT conv_id, max(n) + 1 AS n FROM g GROUP BY conv_id) k ON k.conv_id IS NOT DISTINCT FROM r.conv_id AND k.n = r.n)",
        f"y AS (SELECT conv_id, {least('o', 'a1')} AS best FROM ({closed(('o', 's', 'u', 'a'), 'SELECT * FROM z')}))",
        """k AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND again) AS duplicate,
  count(*) FILTER (WHERE NOT blank AND NOT again AND short) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)""",
    ]
    return (
        "WITH RECURSIVE " + ",\n".join(parts) + """
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(best[1:9] AS BIGINT), 0) AS cost,
  coalesce(split_part(best[10:], chr(1), 1), '') AS audit, sha256(coalesce(best[strpos(best, chr(1)) + 2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM c.conv_id"""
    )


ORACLE = _oracle()
