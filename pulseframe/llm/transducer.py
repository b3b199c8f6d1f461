"""Token counts from a piece vocabulary compiled to a finite-state transducer.

The vocabulary (a sentencepiece model of byte-pair merges with byte fallback) encodes a text as one string in which spaces are
pieces' first characters. Two pieces may stand side by side only if encoding their concatenation gives just these two, and a
string has exactly one sequence of pieces of which all neighbours may. Hence the last piece of every prefix follows from
those of shorter prefixes, and no longer ago than the longest piece reaches: a finite memory.

* **State**: for each place from which a piece may still be under way, the node of the vocabulary's trie that the characters
  since then lead to, the piece that ends at the place, and how many more pieces end there than at the first such place.
  Transitions carry the number of pieces that have become certain. States and transitions are compiled when first met, into a
  hash table of numbers; a table that has grown to ``MOST_STATES`` is started anew, which changes no result.
* **Chunks**: a text is cut where no piece can span two characters, at about every ``CHUNK`` characters; there the state is
  known. All chunks of a slice of texts advance together, one character a step. Where a text has no such place for long, it is
  cut anyway: such a chunk has a map from entry states to (exit state, count), begun with the state that a run over the
  characters before it ends in, and extended by the states that really arrive.
* **Scan**: the counts and maps of a text's chunks are composed in order; chunks with a constant map just add up.

Work is linear in the text, memory is bounded by a slice (``SLICE`` bytes, or one longer text) and the table.

Defined cases: NULL and empty texts have no tokens; rows with any doc_id are kept as they are, repeated ones too; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.units import chunks

CHUNK, SLICE, MOST_STATES, WARM_UP = 256, 4 << 20, 400_000, 64
_SPACE = "▁"
_EMPTY = np.int64(-1)
#: A state's entries (trie node, piece that ends before it, pieces more than at the first entry); the last one is the root.
FRESH = ((0, -1, 0),)
_MACHINES: dict[str, Transducer] = {}


class Vocabulary:
    """The pieces of a model file, and how they merge."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        norm, train = model.normalizer_spec, model.trainer_spec
        if (train.model_type != train.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix
                or norm.remove_extra_whitespaces or norm.precompiled_charsmap or not norm.escape_whitespaces
                or not norm.add_dummy_prefix or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces)):
            raise ValueError("the model is not a plain byte-pair vocabulary with byte fallback")
        self.pieces = [p.piece for p in model.pieces if p.type == kinds.NORMAL]
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        missing = {c for p in self.pieces for c in p} - set(self.score)
        if missing:
            raise ValueError("a character of a piece is no piece itself")

    def merge(self, text: str) -> list[str]:
        """The pieces of a short string of known characters: best score first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                value = score.get(parts[i] + parts[i + 1])
                if value is not None and (best is None or value > best):
                    best, at = value, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts


class Transducer:
    """Counts the tokens of many texts at once."""

    def __init__(self, path: str, most_states: int = MOST_STATES):
        self.words, self.most = Vocabulary(path), most_states
        pieces = self.words.pieces
        chars = sorted({c for p in pieces for c in p})
        # Classes of characters: the known ones, then unknown ones by the bytes that they fall back to.
        self.known = len(chars)
        self.classes = self.known + 4
        number = {c: i for i, c in enumerate(chars)}
        self.of_char = np.empty(0x110000, np.int32)
        for bytes_, (first, last) in enumerate([(0, 0x80), (0x80, 0x800), (0x800, 0x10000), (0x10000, 0x110000)]):
            self.of_char[first:last] = self.known + bytes_
        self.of_char[[ord(c) for c in chars]] = range(self.known)
        self.of_char[ord(" ")] = self.space = number[_SPACE]
        self.child: dict[tuple[int, int], int] = {}
        self.piece, self.inner = [-1], [True]  # by node: the piece that ends there; whether a longer one goes on
        self.joined = np.zeros((self.classes, self.classes), bool)  # neighbours within some piece
        for k, piece in enumerate(pieces):
            node, codes = 0, [number[c] for c in piece]
            for a, b in zip(codes, codes[1:]):
                self.joined[a, b] = True
            for c in codes:
                self.inner[node] = True
                following = self.child.get((node, c))
                if following is None:
                    following = self.child[node, c] = len(self.piece)
                    self.piece.append(-1)
                    self.inner.append(False)
                node = following
            self.piece[node] = k
        self.alone: dict[int, bool] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self._clear()
        self.start = self._run_one(FRESH, self.space)[0]

    # --- states and transitions
    def _clear(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.final = np.zeros(1 << 12, np.int32)
        self._table(1 << 14)

    def _table(self, size: int) -> None:
        self.keys, self.next = np.full(size, _EMPTY), np.zeros(size, np.int32)
        self.emit, self.used = np.zeros(size, np.int32), 0
        self.shift = np.uint64(64 - size.bit_length() + 1)

    def intern(self, state: tuple) -> int:
        found = self.number.get(state)
        if found is None:
            found = self.number[state] = len(self.states)
            self.states.append(state)
            if found >= len(self.final):
                self.final = np.concatenate((self.final, np.zeros_like(self.final)))
            self.final[found] = state[-1][2]
        return found

    def _reachable(self, piece: int) -> bool:
        found = self.alone.get(piece)
        if found is None:
            text = self.words.pieces[piece]
            found = self.alone[piece] = self.words.merge(text) == [text]
        return found

    def _compatible(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        found = self.fits.get((left, right))
        if found is None:
            a, b = self.words.pieces[left], self.words.pieces[right]
            if len(self.fits) > 4 * self.most:
                self.fits.clear()
            found = self.fits[left, right] = self.words.merge(a + b) == [a, b]
        return found

    def _run_one(self, state: tuple, code: int) -> tuple[tuple, int]:
        """The next state, and the pieces that have become certain."""
        if code >= self.known:
            return FRESH, state[-1][2] + code - self.known + 1
        met = [(self.child[node, code], last, many) for node, last, many in state if (node, code) in self.child]
        if len(met) == 1:  # nothing reaches over the character's left edge, so what ends there does not matter
            met = [(met[0][0], -1, met[0][2])]
        ends = [(self.piece[node], many + 1) for node, last, many in met
                if self.piece[node] >= 0 and self._reachable(self.piece[node]) and self._compatible(last, self.piece[node])]
        (piece, many), = ends
        alive = [e for e in met if self.inner[e[0]]]
        alive.append((0, piece if alive else -1, many))
        base = alive[0][2]
        return tuple((node, last, m - base) for node, last, m in alive), base

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The table's places of keys, which are compiled where they are new."""
        mask = len(self.keys) - 1
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        held = self.keys[slot]
        wrong = np.flatnonzero(held != keys)
        while len(wrong):
            if (held[wrong] == _EMPTY).any():
                self._compile(np.unique(keys[wrong[held[wrong] == _EMPTY]]))
                return self._slots(keys)
            slot[wrong] = (slot[wrong] + 1) & mask
            held[wrong] = self.keys[slot[wrong]]
            wrong = wrong[held[wrong] != keys[wrong]]
        return slot

    def _compile(self, keys: np.ndarray) -> None:
        if 2 * (self.used + len(keys)) > len(self.keys):
            full = self.keys != _EMPTY
            old = self.keys[full], self.next[full], self.emit[full]
            size = len(self.keys)
            while 2 * (len(old[0]) + len(keys)) > size:
                size *= 2
            self._table(2 * size)
            self._put(*old)
        found = []
        for key in keys.tolist():
            state, code = divmod(key, self.classes)
            following, emitted = self._run_one(self.states[state], code)
            found.append((self.intern(following), emitted))
        following, emitted = zip(*found)
        self._put(keys, np.array(following, np.int32), np.array(emitted, np.int32))

    def _put(self, keys: np.ndarray, following: np.ndarray, emitted: np.ndarray) -> None:
        """Distinct new keys into the table."""
        mask = len(self.keys) - 1
        left = np.arange(len(keys))
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        while len(left):
            free = left[self.keys[slot[left]] == _EMPTY]
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[slot[won]], self.next[slot[won]], self.emit[slot[won]] = keys[won], following[won], emitted[won]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & mask
        self.used += len(keys)

    # --- runs
    def run(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, entry: list[tuple] | tuple,
            which: np.ndarray | None = None) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """Chunks [start, end) of character classes side by side: exit states, pieces certain, and pieces in the exit state.

        ``entry`` has the states that chunks enter with, ``which`` the one of each chunk.
        """
        order = np.argsort(start - end, kind="stable")
        start, length = start[order], (end - start)[order]
        entered = np.array([self.intern(s) for s in entry], np.int32)
        state = entered[which[order]]
        counts = np.zeros(len(order), np.int64)
        ending = np.bincount(length, minlength=1)
        alive = len(order)
        for step in range(int(length[0]) if len(length) else 0):
            alive -= int(ending[step])
            if len(self.states) > self.most:
                state = self._renew(state)
            slot = self._slots(state[:alive].astype(np.int64) * self.classes + codes[start[:alive] + step])
            counts[:alive] += self.emit[slot]
            state[:alive] = self.next[slot]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], counts[back], self.final[state][back]

    def _renew(self, state: np.ndarray) -> np.ndarray:
        """Starts the table anew with the states that are in use."""
        used, place = np.unique(state, return_inverse=True)
        kept = [self.states[s] for s in used.tolist()]
        self._clear()
        return np.array([self.intern(s) for s in kept], np.int32)[place]

    def _long(self, codes: np.ndarray, start: int, end: int, entry: tuple) -> int:
        """Tokens of a stretch in which the state is known at its start only: by maps of its chunks."""
        cuts = np.append(np.arange(start, end, CHUNK), end)
        maps: list[dict] = [{} for _ in cuts[1:]]

        def extend(first: int, last: int, states: list[tuple], which: np.ndarray) -> None:
            left, certain, pending = self.run(codes, cuts[first:last], cuts[first + 1:last + 1], states, which)
            for j, s in enumerate(left.tolist()):
                maps[first + j][states[which[j]]] = (self.states[s], int(certain[j]), int(pending[j]))

        inner = cuts[1:-1]
        guesses, _, _ = self.run(codes, np.maximum(inner - WARM_UP, start), inner, [FRESH], np.zeros(len(inner), np.int64))
        distinct, which = np.unique(guesses, return_inverse=True)
        extend(0, len(maps), [entry, *(self.states[s] for s in distinct.tolist())], np.concatenate(([0], which + 1)))
        state, total, pending, j, asked, width = entry, 0, 0, 0, 0, 1
        while j < len(maps):
            if state not in maps[j]:
                # As many chunks as before get this entry too; twice as many if all of those were used.
                width = 2 * width if j == asked else 1
                asked = min(j + width, len(maps))
                extend(j, asked, [state], np.zeros(asked - j, np.int64))
            state, certain, pending = maps[j][state]
            total += certain
            j += 1
        return total + pending

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(len(texts), np.int64)
        codes = self.of_char[points]
        ends = np.cumsum(sizes)
        first = (ends - sizes)[sizes > 0]
        free = ~self.joined[codes[:-1], codes[1:]]
        places = np.flatnonzero(np.concatenate(([True], free)))
        cuts = places[np.minimum(np.searchsorted(places, np.arange(0, len(codes), CHUNK)), len(places) - 1)]
        start = np.unique(np.concatenate((first, cuts)))
        end = np.append(start[1:], len(codes))
        begins = np.isin(start, first).astype(np.int64)  # a text's first chunk is entered with a space read
        long = end - start > 8 * CHUNK
        counts = np.empty(len(start), np.int64)
        _, certain, pending = self.run(codes, start[~long], end[~long], [FRESH, self.start], begins[~long])
        counts[~long] = certain + pending
        for i in np.flatnonzero(long).tolist():
            counts[i] = self._long(codes, int(start[i]), int(end[i]), self.start if begins[i] else FRESH)
        upto = np.concatenate(([0], np.cumsum(counts)))
        return upto[np.searchsorted(start, ends)] - upto[np.searchsorted(start, ends - sizes)]


def machine(path: str) -> Transducer:
    """The worker's compiled vocabulary, kept for its later tasks."""
    if path not in _MACHINES:
        _MACHINES[path] = Transducer(path)
    return _MACHINES[path]


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(path)
        for batch in batches:
            texts = pc.fill_null(batch["text"], "").cast(pa.large_string())
            counts = [own.count(part.to_pylist()) for part in chunks(texts, SLICE)]
            yield pa.record_batch([batch["doc_id"], pc.binary_length(texts).cast(pa.int64()),
                                   pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]))],
                                  ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
