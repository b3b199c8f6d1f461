"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents are tokenised whole and end with a separator id. The added tokens of the vocabulary file are matched in the text,
the leftmost and longest first, as its library does. Those longer than a sequence are cut into full pieces, the
first of which may be shorter.

The pieces are packed by best fit, longest first, in supersteps, but not by range-sorted tables of documents and gaps that
sweep against each other. Lengths and gaps are at most the size of a sequence (2,048 tokens), so all that a superstep has to
know of the corpus is how many pieces each length has. With tables, 2,048 lengths would be as many rounds of shuffles; with counts
they are one loop over runs of equal pieces and equal gaps on the driver, whose memory is bounded by the square of
the sequence size, whatever the number of documents:

* A superstep takes all pieces of one length together, longest first, and goes over the gaps in ascending order from that
  length on (its successors). The piece of rank r goes to the r-th gap, so there is no conflict to resolve. What finds no gap
  opens new sequences. The result is that of placing the pieces one by one.
* The pieces themselves never come to the driver: Spark ranks them within their length and places each by its rank in the
  runs, which are broadcast. A length that holds a large share of all pieces is dealt over many salts, whose counts are
  summed up to offsets, so no task ranks it alone.

Defined cases: NULL and empty texts are the separator alone; repeated rows (same doc_id) are packed each on its own; an
empty table gives an empty result; a NULL doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.shared import store
from pulseframe.llm.units import Bounded, encode_texts

SEQUENCE = 2048
#: Pieces of one length and salt that a task ranks together, on average at most.
_PER_SALT = 100_000
_UNITS = 300_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def load_encoding(path: str) -> tiktoken.Encoding:
    """The encoding of a byte-level BPE vocabulary file (json), whose ids must be in the order of its merges."""
    import public_tokenizers

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    value = byte_values()
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if [model["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))):
        raise ValueError("the ids of the vocabulary are not in the order of its merges")
    ranks = {bytes(value[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(merged)}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def added_tokens(path: str) -> dict[str, int]:
    """The tokens that a vocabulary file adds to its model, each of which stands in a text as it is and within one unit."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file).get("added_tokens") or []
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or " " in t["content"] or not t["content"] for t in found):
        raise ValueError("an added token of the vocabulary holds a space, or depends on what is around it")
    return {t["content"]: t["id"] for t in found}


def text_encoder(path: str, added: bool) -> Callable[[str], array]:
    """The function that gives the ids of a unit; ``added`` as in ``tokenise``."""
    encoding, tokens = load_encoding(path), added_tokens(path) if added else {}
    if not tokens:
        return lambda text: array("I", encoding.encode_ordinary(text))
    split = regex.compile("(" + "|".join(map(regex.escape, sorted(tokens, key=len, reverse=True))) + ")").split

    def encode(text: str) -> array:
        ids = array("I")
        for i, part in enumerate(split(text)):
            ids.extend([tokens[part]] if i % 2 else encoding.encode_ordinary(part))
        return ids

    return encode


def tokenise(docs: DataFrame, path: str, separator: int = 0, size: int = SEQUENCE, added: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and ``ids`` (little-endian unsigned 32-bit).

    With ``added``, the file's added tokens are matched in the text, which is what its library does by default; without, they
    are text like any other, as with the library's ``encode_special_tokens``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(path, added)
        units = Bounded(lambda text: encode(text).tobytes(), _UNITS)
        end = array("I", [separator]).tobytes()
        for batch in batches:
            rows, held = [], 0
            for doc_id, parts in zip(batch["doc_id"].to_pylist(), encode_texts(batch["text"], units.__getitem__)):
                ids = b"".join(parts) + end
                cut = (len(ids) // 4 - 1) % size + 1  # what the first piece has, so that all others are full
                bounds = [0, *range(4 * cut, len(ids) + 1, 4 * size)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    rows.append((doc_id, k, a // 4, (b - a) // 4, zlib.crc32(ids[a:b]), ids[a:b]))
                held += len(ids)
                if held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES + ", ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                           ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])


def plan_runs(counts: dict[int, int], size: int = SEQUENCE) -> np.ndarray:
    """Best fit over runs of equal pieces: rows of (length, first rank, pieces, first sequence, offset).

    The pieces of a run go one each to consecutive sequences, at the same offset.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, how many) that have it
    sizes: list[int] = []  # the gaps that occur, ascending
    sequences = 0

    def leave(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                gap, first, many = size, sequences, -(-left // (size // length))
                sequences += many
            each = gap // length  # what the gap takes of this length, one after the other
            full = min(many, left // each)
            if full:
                for k in range(each):
                    runs.append((length, rank + k * full, full, first, size - gap + k * length))
                rank, left = rank + each * full, left - each * full
                leave(gap - each * length, first, full)
            if full < many:
                if left:  # fewer than a gap takes: they go into one more
                    for k in range(left):
                        runs.append((length, rank + k, 1, first + full, size - gap + k * length))
                    leave(gap - left * length, first + full, 1)
                    full, left = full + 1, 0
                leave(gap, first + full, many - full)
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``, from 0 within each length, dense and by salt."""
    total = pieces.count()
    salts = max(1, -(-total // _PER_SALT)) * 4
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("many"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return (salted.withColumn("own", F.row_number().over(own) - 1).join(offsets, ["length", "salt"])
            .withColumn("rank", F.col("own") + F.col("offset")).drop("own", "offset", "salt"))


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces (doc_id, piece, start, length, ids_crc32).

    The driver holds the number of pieces of each length, at most ``size`` numbers, and the runs made from them.
    """
    counts = {r["length"]: r["many"] for r in pieces.groupBy("length").agg(F.count("*").alias("many")).collect()}
    runs = pieces.sparkSession.sparkContext.broadcast(plan_runs(counts, size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, sequence, offset = runs.value.T
        key = length * (1 << 50) + first
        for batch in batches:
            own, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(key, own * (1 << 50) + rank, side="right") - 1
            yield pa.record_batch(
                [*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long")).mapInArrow(
        place, _PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, separator: int = 0, size: int = SEQUENCE) -> DataFrame:
    """Tokenises and packs every document; one row per piece."""
    return pack(store(tokenise(docs, path, separator, size, added=True).drop("ids")), size)
