"""Conversation repair: whole results by brute force, the table against plain costs, long and odd conversations."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from krathong.llm import conversation_repair as R

COLS = "conv_id long, turn long, role string, text string, digest string, times int, symbol string, k int, seq int"
NOT_BLANK = re.compile(r"[^\x20\x09-\x0D]")


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", 3, "s", 1, 2) for r in rows], COLS)


def cheapest(rows):
    """(cost, audit, messages) by keeping, for each order of roles so far, the least (cost, letters): rows are (role, text, must go, truncated)."""

    def ends(best):
        grown = dict(best)
        for _ in range(3):
            for q, (c, a, m) in list(grown.items()):
                r = {"": "u", "s": "u", "a": "u", "u": "a"}[q]
                new = (c + 2, a + "I", [*m, ({"u": "user", "a": "assistant"}[r], "")])
                if r not in grown or new[:2] < grown[r][:2]:
                    grown[r] = new
        return grown

    best = {"": (0, "", [])}
    for role, text, must, cut in rows:
        after = {}

        def offer(q, new):
            if q not in after or new[:2] < after[q][:2]:
                after[q] = new

        for q, (c, a, m) in ends(best).items():
            offer(q, (c + 3, a + "D", m))
            if must:
                continue
            follow = {"": "su", "s": "u", "a": "u", "u": "a"}[q]
            if role[:1] in follow and role:
                offer(role[0], (c + cut, a + "K", [*m, (role, text)]))
            for name in ("user", "assistant"):
                if name[0] in follow:
                    offer(name[0], (c + 2 + cut, a + "R", [*m, (name, text)]))
        best = after
    c, a, m = min((v for q, v in ends(best).items() if q in ("", "a")), key=lambda v: v[:2])
    return c, a, m


def brute(table_rows):
    convs = {}
    for conv, turn, role, text in table_rows:
        rows = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        rows += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, marked, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            chars = NOT_BLANK.findall(text)
            fault = "blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum((a[1][:1] or " ") + (b[1][:1] or " ") not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, messages = cheapest(marked)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest()
        out.append((conv, gaps, *n.values(), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def result(spark, rows):
    t = table(spark, rows)
    return sorted(map(tuple, R.report(R.damage(t), t).collect()), key=repr)


def some(rng, n, convs):
    words = ["One.", "Two!", "three", "", "  ", "Four? ", None, "five. six", "é "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "uncle"]
    return [(rng.choice(convs), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(words)) for _ in range(n)]


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = some(rng, 900, [None, *range(70)])
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []
    real = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(spark, real) == brute(real)


def test_pieces_of_long_conversations(spark, monkeypatch):
    """Conversations over many pieces and partitions, one with most of the rows, many of them alike."""
    monkeypatch.setattr(R, "PIECE", 5)
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"{rng.randrange(60)}{rng.choice(['.', '', '!'])}") for t in range(700)]
    rows += [(1, 800 + t, "user", "again.") for t in range(150)] + [(1, 990, "assistant", "same.")] * 90 + some(rng, 200, [2, 3, None])
    assert result(spark, rows) == brute(rows)


def test_messages(spark):
    rows = [(7, 0, "system", "Be brief."), (7, 1, "assistant", "Hello."), (7, 2, "assistant", "Hello."), (8, 0, "user", "")]
    t = table(spark, rows).select("conv_id", "turn", "role", "text").selectExpr("*", "1L AS times")
    got = [(r.conv_id, r.place, r.role, r.text) for r in R.repaired(t).orderBy("conv_id", "place").collect()]
    assert got == [(7, 0, "system", "Be brief."), (7, 1, "user", ""), (7, 2, "assistant", "Hello.")]
    gone = table(spark, [(5, k, "user", "x.") for k in range(300) if zlib.crc32(f"5:{k}".encode()) % 20 == 0][:1])
    assert [tuple(r) for r in R.report(R.damage(gone), gone).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=9), st.integers(0, 9))
def test_table_equals_plain_costs(symbols, cut):
    """The composed pieces have the cost of the whole, and the letters are the least ones."""
    table, cut = R.Table(), min(cut, len(symbols))
    names = ["system", "user", "assistant", "tool"]
    rows = [("user", "", True, 0) if s == 0 else (names[(s - 1) // 2], "x", False, (s - 1) % 2) for s in symbols]
    cost, audit, _ = cheapest(rows)
    parts = [[(s, 1) for s in p] for p in (symbols[:cut], symbols[cut:])]
    start = R.closed([0, R.INF, R.INF, R.INF])
    middle, end = table.scan(start, parts[0])[1], None
    end = table.scan(middle, parts[1])[1]
    assert min(end[R.START], end[R.ASSISTANT]) == cost
    units = [table.scan(R.closed([0 if q == p else R.INF for q in range(4)]), parts[1])[1] for p in range(4)]
    after = [min(min(u[r] + R.closed_end()[r] for r in range(4)), R.INF) for u in units]
    assert min(a + b for a, b in zip(middle, after)) == cost
    first = table.trace(parts[0], start, after, cost, False)[R.START]
    second = table.trace(parts[1], middle, R.closed_end(), cost, True)[first[0]]
    assert first[1] + second[1] == audit


def test_few_states_are_ever_made():
    table, rng = R.Table(), random.Random(9)
    for _ in range(300):
        table.scan(R.closed([0, R.INF, R.INF, R.INF]), [(rng.randrange(9), 1) for _ in range(200)])
    assert len(table.vectors) < 100 and len(table.go) < 9 * len(table.vectors) + 1


@pytest.mark.parametrize("symbol", range(9))
def test_arcs_lead_to_legal_orders(symbol):
    assert all(r == q or r in (R.SYSTEM, R.NEXT[q]) for _, q, r, _ in R.arcs(symbol))
