"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens are encoded many at a time. Each is a linked list of its bytes, and all of them share one queue: every
neighbouring pair that has a merge rank lies in the bucket of that rank, as the place of its left part. A bitmap of two
levels marks the buckets that are not empty, so that find-first-set yields the lowest rank in a few steps whatever the
number of places. Its bucket is merged from left to right, unless a merge makes a pair of a lower rank, which comes first:
so each pre-token sees its own merges in order of rank and place. A merge changes the pairs to its left and right; what
their old entries say no longer holds, and they are skipped when they come up. The cost is O(n log n) for n bytes, so very
long pre-tokens are no special case.

A Python worker reads the vocabulary once and keeps what it remembers of frequent pre-tokens and units, which is bounded,
for the tasks that it runs afterwards.

Defined cases: NULL and empty texts have no ids; repeated rows give repeated results; an empty table gives an empty one;
other columns are ignored. A byte that is no token of the vocabulary is an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulseframe.llm.units import Bounded, encode_texts, pretokens

#: Distinct pre-tokens and units in a generation of what a worker remembers.
PRETOKENS, UNITS = 500_000, 400_000
#: Bytes of pre-tokens that share a queue, few enough for a processor cache; a longer pre-token has one of its own.
_TOGETHER = 1 << 13
_NONE = -2  # in place of the id of a byte that is no token; -1: merged into the token before it
_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


_BITS = tuple(1 << i for i in range(256))


class Codec:
    """Encodes and decodes by the merge ranks of a vocabulary; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self._ranks = ranks
        self._bytes = {i: b for b, i in ranks.items()}
        self._decimal = {i: str(i) for i in self._bytes}
        # Bitmap of the buckets that hold something, 256 ranks a word. Above it, local to each call, a bitmap of the
        # words that are not zero. All words are zero between calls.
        self._words = [0] * ((max(ranks.values(), default=0) >> 8) + 1)
        self._byte = np.array([ranks.get(bytes([b]), _NONE) for b in range(256)], np.int32)
        self._pair = np.full(1 << 16, -1, np.int32)  # rank of each pair of bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self._pair[token[0] << 8 | token[1]] = rank
        self._split = pretokens(pattern)
        self._known = Bounded(lambda token: self._shared([token])[0], PRETOKENS, self._shared)
        self._ids = list(range(max(ranks.values(), default=-1) + 1))  # one object of each id is remembered

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def encode_pretoken(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        return self._merge([data])[0]

    def encode_pretokens(self, tokens: Iterable[bytes]) -> Iterator[list[int]]:
        """The ids of each of many pre-tokens."""
        held, size = [], 0
        for data in tokens:
            if held and size + len(data) > _TOGETHER:
                yield from self._merge(held)
                held, size = [], 0
            held.append(data)
            size += len(data)
        if held:
            yield from self._merge(held)

    def _merge(self, tokens: list[bytes]) -> list[list[int]]:
        whole = [self._ranks.get(t) for t in tokens]
        parts = [t for t, rank in zip(tokens, whole) if rank is None and t]
        merged = iter(self._merged(parts) if parts else [])
        return [[rank] if rank is not None else next(merged) if t else [] for t, rank in zip(tokens, whole)]

    def _merged(self, parts: list[bytes]) -> list[list[int]]:
        """The ids of pre-tokens, none of them empty, by one queue."""
        data, rank_of, words, top, buckets, bits = b"".join(parts), self._ranks.get, self._words, 0, {}, _BITS
        n, own, ends = len(data), np.frombuffer(data, np.uint8), np.cumsum([len(p) for p in parts])
        border = bytearray(n + 1)  # where a pre-token begins, and behind the last
        np.frombuffer(border, np.uint8)[[0, *ends]] = 1
        ranks = np.full(n, -1, np.int32)
        ranks[:-1] = self._pair[own[:-1].astype(np.int32) << 8 | own[1:]]
        ranks[ends - 1] = -1
        pair, ids = ranks.tolist(), self._byte[own].tolist()  # rank of the pair that begins here, to tell stale ones
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0):]
        begin = np.flatnonzero(np.diff(ranks[order], prepend=-1)).tolist()
        places = order.tolist()
        for a, b in zip(begin, [*begin[1:], len(places)]):
            rank = pair[places[a]]
            buckets[rank] = places[a:b]
            words[rank >> 8] |= bits[rank & 255]
            top |= 1 << (rank >> 8)
        while top:
            # find first set, on either level
            word = (top & -top).bit_length() - 1
            held = words[word]
            rank = (word << 8) + (held & -held).bit_length() - 1
            words[word] = held = held & (held - 1)
            if not held:
                top &= top - 1
            bucket = buckets.pop(rank)  # a heap; no merge adds to it, since what it makes is longer than this pair
            while bucket:
                i = heappop(bucket)
                if pair[i] != rank:
                    continue
                gone = after[i]
                end = after[i] = after[gone]
                ids[i], ids[gone], pair[gone] = rank, -1, -1
                low = rank
                if border[end]:
                    pair[i] = -1
                else:
                    before[end] = i
                    new = pair[i] = rank_of(data[i:after[end]], -1)
                    if new in buckets:
                        heappush(buckets[new], i)
                    elif new >= 0:
                        buckets[new] = [i]
                        words[new >> 8] |= bits[new & 255]
                        top |= 1 << (new >> 8)
                    if 0 <= new < low:
                        low = new
                if not border[i]:
                    i = before[i]
                    new = pair[i] = rank_of(data[i:end], -1)
                    if new in buckets:
                        heappush(buckets[new], i)
                    elif new >= 0:
                        buckets[new] = [i]
                        words[new >> 8] |= bits[new & 255]
                        top |= 1 << (new >> 8)
                    if 0 <= new < low:
                        low = new
                if low < rank and bucket:
                    buckets[rank] = bucket
                    words[rank >> 8] |= bits[rank & 255]
                    top |= 1 << (rank >> 8)
                    break
        found = np.array(ids, np.int32)
        if _NONE in found:
            raise KeyError("a byte that is no token of the vocabulary")
        kept = found >= 0
        left, found = np.cumsum(kept)[ends - 1].tolist(), found[kept].tolist()
        return [found[a:b] for a, b in zip([0, *left], left)]

    def _shared(self, tokens: list[str]) -> list[tuple[int, ...]]:
        own = self._ids.__getitem__
        return [tuple(map(own, ids)) for ids in self.encode_pretokens(t.encode() for t in tokens)]

    def _pretokens(self, text: str) -> list[str]:
        if text.isalpha() or text[:1] == " " and text[1:].isalpha():
            return [text]  # letters alone, after one space at most, are one pre-token
        return self._split(text)

    def encode_many(self, texts: list[str]) -> list[tuple[int, ...]]:
        """The ids of each text; pre-tokens that are not remembered are encoded together."""
        split, known = list(map(self._pretokens, texts)), self._known
        known.ahead(chain.from_iterable(split))
        return [known[p[0]] if len(p) == 1 else tuple(chain.from_iterable(map(known.__getitem__, p))) for p in split]

    def encode(self, text: str) -> tuple[int, ...]:
        return self.encode_many([text])[0]

    def listed(self, ids: Iterable[int]) -> str:
        """The ids in decimal, joined by commas."""
        return ",".join(map(self._decimal.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> Codec:
    return Codec.from_file(path, pattern)


@lru_cache(maxsize=2)
def _units(path: str, pattern: str) -> Bounded:
    """The ids of a unit."""
    codec = _codec(path, pattern)
    return Bounded(codec.encode, UNITS, codec.encode_many)


def _ids(text: pa.Array, path: str, pattern: str) -> Iterator[list[int]]:
    """The ids of each text."""
    units = _units(path, pattern)
    for parts in encode_texts(text, units.__getitem__, units.ahead):
        yield list(chain.from_iterable(parts))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``ids``, the token ids of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = list(_ids(batch["text"], path, pattern))
            yield pa.record_batch([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def encoding_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document the number of ids, the hash of their decimal list, and the hash of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            rows = [(len(ids), hashlib.sha256(codec.listed(ids).encode()).hexdigest(),
                     hashlib.sha256(codec.decode(ids)).hexdigest()) for ids in _ids(batch["text"], path, pattern)]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.record_batch(
                [batch["doc_id"], pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()),
                 pa.array(columns[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, _DIGESTS)
