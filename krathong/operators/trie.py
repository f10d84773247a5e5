"""The lexicon as an automaton: all longest matches of a word in one walk.

Entries are written backward into a trie with failure links, completed to a table of next states. A word is walked from its end; the state at
a place then knows the longest entry that begins there, and the next shorter ones. The words of a batch are walked side by side, a character of each at a
time, so a word costs one look-up a character and nothing is exploded, joined or shuffled.

The table goes to every task, so it is built only for a lexicon within ``ENTRIES`` and ``CELLS``; ``segment.matches`` is the way for larger ones.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.orthography import CONSONANT

#: Largest lexicon that becomes a table: entries, and states times letters (four bytes each).
ENTRIES, CELLS = 200_000, 1 << 24

_HIT = "struct<len:int,order:int,translit:string,priority:int>"


class Trie:
    """Longest entries at each place of a word; of (thai, translit, priority) each word once."""

    def __init__(self, entries: list[tuple]):
        self.letters = np.array(sorted({ord(c) for e in entries for c in e[0]}), np.int64)
        code = {chr(c): i + 1 for i, c in enumerate(self.letters.tolist())}
        children: list[dict] = [{}]
        own = [-1]
        for k, (thai, *_) in enumerate(entries):
            at = 0
            for c in reversed(thai):
                if code[c] not in children[at]:
                    children[at][code[c]] = len(children)
                    children.append({})
                    own.append(-1)
                at = children[at][code[c]]
            own[at] = k
        self.size = len(children) * (len(code) + 1)
        if self.size > CELLS:
            return
        go = np.zeros((len(children), len(code) + 1), np.int32)
        fail, self.longest = [0] * len(children), np.full(len(children), -1, np.int32)
        shorter = np.full(max(len(entries), 1), -1, np.int32)
        todo = deque([0])
        while todo:
            at = todo.popleft()
            below = int(self.longest[fail[at]]) if at else -1
            self.longest[at] = below if own[at] < 0 else own[at]
            if own[at] >= 0:
                shorter[own[at]] = below
            if at:
                go[at] = go[fail[at]]
            for c, child in children[at].items():
                fail[child] = int(go[fail[at], c]) if at else 0
                go[at, c] = child
                todo.append(child)
        self.go, self.shorter = go, shorter
        self.length = np.array([len(e[0]) for e in entries] or [0], np.int32)
        self.priority = np.array([e[2] for e in entries] or [0], np.int32)
        self.translit = [e[1] for e in entries]

    def find(self, words: list[str], orphans: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(length of each word, entry at each place of each word in turn, -1 for none). Without ``orphans`` an entry may not leave exactly one consonant behind."""
        n = np.array([len(w) for w in words], np.int64)
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.letters, text), max(len(self.letters) - 1, 0))
        code = np.where(self.letters[at] == text, at + 1, 0) if len(self.letters) else np.zeros(len(text), np.int64)
        ends = np.cumsum(n)
        out = np.full(len(text), -1, np.int32)
        order = np.argsort(-n, kind="stable")
        left, states = np.searchsorted(-n[order], -np.arange(int(n.max(initial=0))), side="left"), np.zeros(len(words), np.int32)
        last = ends[order] - 1
        for t, m in enumerate(left.tolist()):  # the first m words, by length, have a character there
            place = last[:m] - t
            states[:m] = self.go[states[:m], code[place]]
            out[place] = self.longest[states[:m]]
        if orphans:
            return n, out
        first, final = ord(CONSONANT[0]), ord(CONSONANT[-1])
        orphan = (text[ends - 1] >= first) & (text[ends - 1] <= final) if len(text) else np.zeros(0, bool)
        place = np.arange(len(text))
        behind = np.repeat(ends - 1, n)
        bad = (out >= 0) & np.repeat(orphan, n) & (place + self.length[out] == behind)
        out[bad] = self.shorter[out[bad]]
        return n, out

    def _structs(self, entry: np.ndarray) -> pa.StructArray:
        at = np.maximum(entry, 0)
        priority = self.priority[at]
        translit = pa.array(self.translit or [""], pa.string()).take(pa.array(at))
        return pa.StructArray.from_arrays([pa.array(self.length[at]), pa.array(-priority), translit, pa.array(priority)], ["len", "order", "translit", "priority"], mask=pa.array(entry < 0))

    def hits(self, words: list[str], every: bool = False) -> pa.ListArray:
        """At each place (pos, hit) of each word the longest entry; with ``every``, (pos, hits): all entries, one of each length, whatever they leave behind."""
        n, entry = self.find(words, orphans=every)
        ends = np.cumsum(n)
        pos = np.arange(len(entry)) - np.repeat(ends - n, n) + 1
        hit = self._structs(entry)
        if every:
            count, chains = np.zeros(len(entry), np.int64), []
            while (entry >= 0).any():
                chains.append(entry)
                count += entry >= 0
                entry = np.where(entry >= 0, self.shorter[np.maximum(entry, 0)], -1)
            flat = np.stack(chains, axis=1).ravel() if chains else np.zeros(0, np.int32)
            hit = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), self._structs(flat[flat >= 0]))
        place = pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), hit], ["pos", "hits" if every else "hit"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), place)


def trie_of(lexicon: DataFrame, window: int) -> Trie | None:
    """The automaton of the entries within the window, the lowest priority of each (then the last translit); None where the lexicon is too large for one."""
    entries = lexicon.filter("thai is not null and thai <> ''").filter(F.char_length("thai") <= window).groupBy("thai").agg(F.max(F.struct((-F.col("priority")).alias("o"), "translit", "priority")).alias("x"))
    found = entries.select("thai", "x.translit", "x.priority").limit(ENTRIES + 1).collect()
    if len(found) > ENTRIES:
        return None
    trie = Trie(sorted((r.thai, r.translit, r.priority) for r in found)) if found else Trie([])
    return trie if trie.size <= CELLS else None


def with_hits(words: DataFrame, trie: Trie, every: bool = False) -> DataFrame:
    """(word, key, hits) of each row of ``words`` (word, key): the longest entry at each place, or all of them."""

    def run(batches):
        for b in batches:
            step = 2000
            for a in range(0, b.num_rows, step):
                part = b.slice(a, step)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), trie.hits(part.column(0).to_pylist(), every)], ["word", "key", "hits"])

    return words.select("word", "key").mapInArrow(run, f"word string, key string, hits array<struct<pos:int,{f'hits:array<{_HIT}>' if every else f'hit:{_HIT}'}>>")
