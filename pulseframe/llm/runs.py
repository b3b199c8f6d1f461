"""Periodic runs of words, from a Re-Pair grammar of the word ids.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
max(``LEAST``, ``TIMES`` * q), which no neighbouring word extends. In a run every word after the first q repeats an earlier one.

1. Stretches: a run holds two equal windows of ``WINDOW`` words, q apart, that cover it together with those next to them. So
   only words under a window that its text holds twice matter; each unbroken stretch of them is searched on its own. Windows
   are compared by 64 bits of hash, where a chance match only adds words to a stretch.
2. Grammar: a stretch's words are compressed by Re-Pair: the most frequent pair of neighbours becomes a nonterminal, until no
   pair is left twice; among equally frequent pairs the older one goes first, which keeps the grammar shallow. The symbols
   that remain are joined by a balanced tree.
3. Boundaries: a run lies in some smallest nonterminal and crosses the boundary of its two parts, so each nonterminal is
   searched at its boundary alone, once, however often it is derived. A run across a boundary has two whole periods on one side
   of it: prefix hashes find all q for which that side begins (or ends) with a square, and the words themselves decide. A q
   whose squares lie within a run of a smaller period is a multiple of it.
4. Derivations: the runs of a nonterminal are moved to all places where it is derived, top down, along those nonterminals that
   hold any; equal, touching and contained intervals of one period are merged into maximal ones.

Defined cases: NULL, empty and blank texts have no words and no runs; rows are kept one by one, also repeated ones and those
without a doc_id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pulseframe.llm.units import chunks
from pulseframe.llm.words import split_words, word_bytes

LEAST, TIMES, WINDOW = 6, 4, 5
_WORD = word_bytes([(0x20, 0x20), (0x09, 0x0D)], lower=False)
_CHUNK = 8 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Numbers to evenly spread 64-bit ones."""
    x = (x.astype(np.uint64) + np.uint64(1)) * _BASE
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def stretches(index: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Unbroken stretches [start, end) of words under windows that their text holds more than once."""
    n = len(index) - WINDOW + 1
    if n <= 0:
        return []
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    inside = np.flatnonzero(text[:n] == text[WINDOW - 1:])
    mixed = _mix(index)
    key = _mix(text[inside])
    for k in range(WINDOW):
        key = (key ^ mixed[inside + k]) * _BASE
        key ^= key >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(inside), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(index) + 1, np.int64)
    np.add.at(change, inside[twice], 1)
    np.add.at(change, inside[twice] + WINDOW, -1)
    covered = np.cumsum(change) > 0
    # Two texts' stretches do not meet.
    first = covered[:-1] & np.concatenate(([True], ~covered[:-2] | (text[1:] != text[:-1])))
    last = covered[:-1] & np.concatenate((~covered[1:-1] | (text[1:] != text[:-1]), [True]))
    return list(zip(np.flatnonzero(first).tolist(), (np.flatnonzero(last) + 1).tolist()))


class Grammar:
    """A Re-Pair grammar: ``rules`` (left, right, place of one derivation, length), and the symbols that remain with their places.

    Symbols below ``words`` are words, ``words + k`` is the k-th rule. A rule uses only earlier ones.
    """

    def __init__(self, ids: list[int], words: int):
        n = len(ids)
        self.words, self.rules = words, []
        symbol, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[tuple[int, int], list[int]] = {}
        for i in range(n - 1):
            places.setdefault((symbol[i], symbol[i + 1]), []).append(i)
        queue = [(-len(p), k, pair) for k, (pair, p) in enumerate(places.items()) if len(p) > 1]
        heapq.heapify(queue)
        born = len(places)
        while queue:
            many, age, pair = heapq.heappop(queue)
            a, b = pair
            found, busy = [], -1
            for i in places[pair]:
                j = after[i]
                if symbol[i] == a and j < n and symbol[j] == b and i != busy:
                    found.append(i)
                    busy = j
            if len(found) < 2:
                continue
            if len(found) < -many and queue and queue[0][0] < -len(found):
                places[pair] = found
                heapq.heappush(queue, (-len(found), age, pair))
                continue
            new = words + len(self.rules)
            self.rules.append((a, b, found[0], self.length(a) + self.length(b)))
            fresh: dict[tuple[int, int], list[int]] = {}
            for i in found:
                j = after[i]
                symbol[i], symbol[j] = new, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    fresh.setdefault((new, symbol[k]), []).append(i)
                if before[i] >= 0:
                    fresh.setdefault((symbol[before[i]], new), []).append(before[i])
            del places[pair]
            for other, at in fresh.items():
                if len(at) > 1:
                    places[other] = at
                    heapq.heappush(queue, (-len(at), born, other))
                    born += 1
        self.rest = []
        i = 0
        while i < n:
            self.rest.append((symbol[i], i))
            i = after[i]

    def length(self, symbol: int) -> int:
        return 1 if symbol < self.words else self.rules[symbol - self.words][3]


class Squares:
    """Runs across boundaries in a sequence of words."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(ids), _BASE, np.uint64))))
            self.upto = np.concatenate(([np.uint64(0)], np.cumsum(_mix(ids) * self.power[:len(ids)])))

    def across(self, low: int, at: int, high: int) -> list[tuple[int, int, int]]:
        """(period, start, end) of the runs within [low, high) that have words on both sides of ``at``."""
        most = (high - low) // TIMES
        upto, power, out = self.upto, self.power, []
        right, left = np.zeros(most + 1, bool), np.zeros(most + 1, bool)
        q = np.arange(1, min(most, (high - at) // 2) + 1)
        right[q] = (upto[at + q] - upto[at]) * power[q] == upto[at + 2 * q] - upto[at + q]
        q = np.arange(1, min(most, (at - low) // 2) + 1)
        left[q] = (upto[at - q] - upto[at - 2 * q]) * power[q] == upto[at] - upto[at - q]
        todo = np.flatnonzero(right | left)
        while len(todo):
            q, todo = int(todo[0]), todo[1:]
            differ = np.flatnonzero(self.ids[low:high - q] != self.ids[low + q:high])
            for begin in [at] * int(right[q]) + [at - 2 * q] * int(left[q]):
                k = int(np.searchsorted(differ, begin - low))
                if k < len(differ) and differ[k] == begin - low:
                    continue
                start = low + (int(differ[k - 1]) + 1 if k else 0)
                end = low + (int(differ[k]) if k < len(differ) else high - low - q) + q
                if start < at < end and end - start >= max(LEAST, TIMES * q) and not any(
                        s <= start and end <= e for _, s, e in out):
                    out.append((q, start, end))
                    held_right, held_left = end >= at + 2 * todo, start <= at - 2 * todo
                    todo = todo[(right[todo] & ~held_right) | (left[todo] & ~held_left)]
        return out


def maximal(found: list[tuple[int, np.ndarray, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal intervals among (period, starts, length), by start, then period."""
    by_period: dict[int, list[tuple[int, int]]] = {}
    for q, starts, length in found:
        by_period.setdefault(q, []).extend((s, s + length) for s in starts.tolist())
    out = []
    for q, intervals in by_period.items():
        start, end = None, -1
        for s, e in sorted(intervals):
            if start is not None and s + q <= end:  # they share a period
                end = max(end, e)
                continue
            if start is not None:
                out.append((start, end - start, q))
            start, end = s, e
        out.append((start, end - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start, then period."""
    if len(ids) < LEAST:
        return []
    distinct, ids = np.unique(ids, return_inverse=True)
    grammar, squares = Grammar(ids.tolist(), len(distinct)), Squares(ids)
    words, rules = grammar.words, grammar.rules
    found: list[tuple[int, np.ndarray, int]] = []
    own: list[list] = []  # by rule: its runs, as (period, start from the rule's first word, length)
    holds = []            # whether a rule or one that it is made of has any
    for a, b, at, length in rules:
        middle = at + grammar.length(a)
        across = squares.across(at, middle, at + length) if length >= LEAST else []
        own.append([(q, s - at, e - s) for q, s, e in across])
        holds.append(bool(across) or any(c >= words and holds[c - words] for c in (a, b)))
    places: list[list] = [[] for _ in rules]
    for symbol, at in grammar.rest:
        if symbol >= words and holds[symbol - words]:
            places[symbol - words].append(np.array([at]))
    for k in range(len(rules) - 1, -1, -1):
        if not places[k]:
            continue
        at = np.concatenate(places[k])
        found += [(q, at + s, length) for q, s, length in own[k]]
        a, b, _, _ = rules[k]
        for symbol, offset in ((a, 0), (b, grammar.length(a))):
            if symbol >= words and holds[symbol - words]:
                places[symbol - words].append(at + offset)
    starts = [at for _, at in grammar.rest] + [len(ids)]
    spans = [(0, len(grammar.rest))]
    while spans:
        i, j = spans.pop()
        if j - i < 2 or starts[j] - starts[i] < LEAST:
            continue
        middle = (i + j) // 2
        found += [(q, np.array([s]), e - s) for q, s, e in squares.across(starts[i], starts[middle], starts[j])]
        spans += [(i, middle), (middle, j)]
    return maximal(found)


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, ``runs`` (start, length and period of each, by start, then period), and ``collapsed``: the words, joined
    by one space, without those that a run holds after its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        for batch in batches:
            first = 0
            for part in chunks(pc.fill_null(batch["text"], "").cast(pa.large_string()), _CHUNK):
                words, index, ends = split_words(part, _WORD)
                begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
                kept, rows = np.ones(len(index), bool), [[] for _ in range(len(part))]
                for start, end in stretches(index, ends):
                    runs = runs_of(index[start:end])
                    text = int(np.searchsorted(ends, start, side="right"))
                    for s, length, q in runs:
                        kept[start + s + q:start + s + length] = False
                        rows[text].append({"start": int(start + s - begins[text]), "length": length, "period": q})
                upto = np.concatenate(([0], np.cumsum(kept)))
                lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], upto[ends]))),
                                                      words.take(pa.array(index[kept])))
                yield pa.record_batch(
                    [batch["doc_id"].slice(first, len(part)), pa.array(ends - begins), pa.array(rows, pa.list_(fields)),
                     pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"])
                first += len(part)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
