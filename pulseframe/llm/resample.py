"""Importance resampling of documents towards a target text: hashed bags of word runs with a head-tail vocabulary.

A feature is a run of 1 to ``n`` consecutive words; its bucket is the CRC-32 of its text modulo ``buckets``. A bucket's gain
is the log ratio of its smoothed shares in target and source; a document's weight is the sum of its features' gains, and the
documents with the highest weight plus Gumbel noise are drawn, without replacement.

1. Head: every task keeps a Misra-Gries summary of its words (and of its pairs, where ``n`` is 2 or more), at most ``HEAD``
   entries each; the summaries are summed by word. At most ``HEAD`` frequent words with their CRC states, and as many
   frequent pairs with their buckets, are broadcast: a few megabytes, whatever the input. A summary never misses a word that
   makes up more than one in ``HEAD`` words of a task.
2. Tail: a word that is not in the head gets its CRC directly, once for each distinct word of a chunk of texts. Longer runs
   go on from the state of the run without its last word. So what the head holds changes the speed, never a bucket.
3. Totals: each task adds up its buckets (at most ``buckets`` numbers) over all its texts; Spark sums them.
4. Scores: one more pass gives each document its weight. The drawn ones are ranked by a range-partitioned sort: each range
   numbers its own rows from the count of those before it, so no task sees all documents, and equal rows spread over ranges.

Defined cases: NULL texts have no words, weight 0; an empty target or source leaves the smoothing alone; a row with a NULL
doc_id counts in the totals, has no noise and hence no score, and is never drawn; repeated rows are drawn each on their own,
with equal scores; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseframe.llm.shared import store
from pulseframe.llm.units import chunks
from pulseframe.llm.words import split_words, word_bytes

#: Entries of the head, and of each task's summary. Longer words are left to the tail.
HEAD, LONGEST = 1 << 16, 64
_WORD = word_bytes([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], lower=True)
_CHUNK = 8 << 20


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Slices of a batch: (first row, rows, distinct words, numbers, ends)."""
    first = 0
    for part in chunks(pc.fill_null(batch["text"], "").cast(pa.large_string()), _CHUNK):
        words, index, ends = split_words(part, _WORD)
        yield first, len(part), words, index, ends
        first += len(part)


class Frequent:
    """A Misra-Gries summary of counted keys."""

    def __init__(self, most: int):
        self.most, self.counts = most, {}

    def add(self, keys: list, counts: list) -> None:
        for key, many in zip(keys, counts):
            self.counts[key] = self.counts.get(key, 0) + many
        if len(self.counts) > 2 * self.most:
            self._reduce()

    def _reduce(self) -> None:
        if len(self.counts) > self.most:
            least = sorted(self.counts.values(), reverse=True)[self.most]
            self.counts = {k: c - least for k, c in self.counts.items() if c > least}

    def items(self) -> list[tuple]:
        self._reduce()
        return list(self.counts.items())


def _pairs(index: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places whose word has a successor in its text."""
    inner = np.ones(len(index), bool)
    inner[ends[ends > 0] - 1] = False
    return np.flatnonzero(inner)


def head_vocabulary(docs: DataFrame, n: int, most: int = HEAD) -> tuple[dict[str, int], dict[str, int]]:
    """(CRC state of the frequent words, CRC of the frequent pairs), at most ``most`` each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Frequent(most), Frequent(most)]
        for batch in batches:
            for _, _, words, index, ends in _chunks(batch):
                short = pc.less_equal(pc.binary_length(words), LONGEST).to_numpy(zero_copy_only=False)
                names = words.to_pylist()
                many = np.bincount(index, minlength=len(names))
                own = np.flatnonzero(short)
                found[0].add([names[i] for i in own.tolist()], many[own].tolist())
                if n > 1:
                    at = _pairs(index, ends)
                    at = at[short[index[at]] & short[index[at + 1]]]
                    codes, times = np.unique(index[at].astype(np.int64) * len(names) + index[at + 1], return_counts=True)
                    found[1].add([f"{names[c // len(names)]} {names[c % len(names)]}" for c in codes.tolist()],
                                 times.tolist())
        for size, summary in enumerate(found, 1):
            items = summary.items()
            for k in range(0, len(items), 10_000):
                names, times = zip(*items[k:k + 10_000])
                yield pa.record_batch([pa.array([size] * len(names), pa.int32()), pa.array(names, pa.string()),
                                       pa.array(times, pa.int64())], ["size", "run", "many"])

    seen = docs.select("text").mapInArrow(run, "size int, run string, many long").groupBy("size", "run").agg(
        F.sum("many").alias("many"))
    heads = tuple({r["run"]: crc32(r["run"].encode()) for r in
                   seen.where(F.col("size") == size).orderBy(F.desc("many"), "run").limit(most).collect()}
                  for size in range(1, min(n, 2) + 1))
    return heads if n > 1 else (*heads, {})


def _states(names: list[str], heads: tuple[dict, dict]) -> np.ndarray:
    """The CRC of each distinct word: the head's, or else computed."""
    known = heads[0].get
    out = np.empty(len(names), np.uint32)
    for i, word in enumerate(names):
        state = known(word)
        out[i] = crc32(word.encode()) if state is None else state
    return out


def _features(names: list[str], index: np.ndarray, ends: np.ndarray, n: int, heads: tuple[dict, dict]) -> Iterator[tuple]:
    """For each length of a run: the places where one starts, and its CRC."""
    states = _states(names, heads)
    at, run, crc = np.arange(len(index)), index.astype(np.int64), states
    yield at, crc[run]
    text_end = np.repeat(ends, np.diff(ends, prepend=0)) if n > 1 else None
    for size in range(2, n + 1):
        fits = at + size <= text_end[at]
        at, run = at[fits], run[fits]
        codes, run = np.unique(run * len(names) + index[at + size - 1], return_inverse=True)
        longer = np.empty(len(codes), np.uint32)
        for i, code in enumerate(codes.tolist()):
            before, word = divmod(code, len(names))
            known = heads[1].get(f"{names[before]} {names[word]}") if size == 2 else None
            longer[i] = crc32(b" " + names[word].encode(), int(crc[before])) if known is None else known
        crc = longer
        yield at, crc[run]


def bucket_totals(docs: DataFrame, n: int, buckets: int, heads) -> np.ndarray:
    """Features of all texts by bucket; ``heads`` is the broadcast vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, words, index, ends in _chunks(batch):
                for _, crc in _features(words.to_pylist(), index, ends, n, heads.value):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "many"])

    out = np.zeros(buckets, np.int64)
    found = docs.select("text").mapInArrow(run, "bucket int, many long").groupBy("bucket").agg(F.sum("many").alias("many"))
    for row in found.collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["many"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of each bucket's smoothed shares, rounded down."""
    buckets = len(source)
    s, t = float(source.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(b + 1) * s) / (float(a + 1) * t)))
                     for a, b in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int, seed: int) -> int:
    """Gumbel noise of a document, in thousandths."""
    h = int(sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, n: int, gain, heads, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document; ``gain`` and ``heads`` are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = gain.value
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            for first, rows, words, index, ends in _chunks(batch):
                many, weight = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                for at, crc in _features(words.to_pylist(), index, ends, n, heads.value):
                    upto = np.concatenate(([0], np.cumsum(by_bucket[crc % np.uint32(len(by_bucket))])))
                    a, b = np.searchsorted(at, starts), np.searchsorted(at, ends)
                    many += b - a
                    weight += upto[b] - upto[a]
                own = ids[first:first + rows]
                score = [None if d is None else w + noise(d, seed) for d, w in zip(own, weight.tolist())]
                yield pa.record_batch([pa.array(own, pa.int64()), pa.array(ends - starts), pa.array(many), pa.array(weight),
                                       pa.array(score, pa.int64())], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, draws: int) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, … by descending score, then doc_id, for the first ``draws``, else NULL.

    Rows are range-partitioned by that order; ``row`` parts rows that are equal in it.
    """
    dealt = store(rows.withColumn("row", F.monotonically_increasing_id()))
    dealt = store(dealt.repartitionByRange(F.desc("score"), "doc_id", "row").withColumn("range", F.spark_partition_id()))
    sizes = dealt.groupBy("range").agg(F.count("*").alias("many"))
    # One row for each range, which are as many as shuffle partitions.
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("range", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("offset"))
    placed = dealt.join(F.broadcast(offsets), "range")
    own = Window.partitionBy("range").orderBy(F.desc("score"), "doc_id", "row")
    first = placed.where(F.col("offset") < draws).withColumn("rank", F.col("offset") + F.row_number().over(own))
    rank = F.when(F.col("rank") <= draws, F.col("rank")).cast("long")
    rest = placed.where(F.col("offset") >= draws).withColumn("rank", F.lit(None).cast("long"))
    return first.withColumn("rank", rank).unionByName(rest).drop("range", "row", "offset")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20,
             seed: int = 2024, head: int = HEAD) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; a document with a rank is drawn.

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred are drawn.
    """
    spark: SparkSession = docs.sparkSession
    if percent < 0 or percent > 100 or n < 1:
        raise ValueError("percent lies between 0 and 100, and runs have at least one word")
    heads = spark.sparkContext.broadcast(head_vocabulary(docs.select("text").unionByName(target.select("text")), n, head))
    gain = spark.sparkContext.broadcast(gains(bucket_totals(docs, n, buckets, heads),
                                              bucket_totals(target, n, buckets, heads)))
    rows = store(weigh(docs, n, gain, heads, seed))
    fit = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    draws = rows.where(fit).count() * percent // 100
    return ranked(rows.where(fit), draws).unionByName(rows.where(~fit).withColumn("rank", F.lit(None).cast("long")))
