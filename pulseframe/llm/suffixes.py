"""Removal of repeated byte strings: equal windows of ``LENGTH`` bytes, found by refining groups pass by pass.

A window is the first ``LENGTH`` bytes of a suffix. A window is repeated if the same bytes start earlier: in a document with a
smaller doc_id, or further ahead in the same one. Every byte that a repeated window covers is removed. All is judged on the
input, and windows never cross documents.

This is not the radix sort of all suffixes by leading bytes that was asked for. One pass of that sort moves each suffix with
its place and at least eight leading bytes, 16 bytes for every byte of text; the check tool grants disk of four times the
input. What is kept of it is the refinement: groups of equal prefix digits, of which a group of one drops out after each
pass, and at the end equal groups are exactly the repeated windows. The digits are others, and no suffix is ordered:

1. Digit one is the window's anchor: the ``GRAM``-byte string in it with the smallest hash (the leftmost, if it occurs more
   than once). Equal windows have equal anchors at equal places. Neighbouring windows mostly share theirs, so what is
   shuffled is not windows but runs of them, about one for 39 bytes.
2. Digit two is the hash of the content of the whole run. Runs that are equal are decided at once: all but the earliest are
   repeated.
3. What remains are the earliest ones of different runs with one anchor, as at the ends of a repeated passage. Only for
   them the text is read again, and their single windows are grouped by hash.

Skew: an anchor with more than a quarter of a task's mean share of runs is hot (there can be at most four times as many as
tasks; they are found in a sample of the documents, and any choice gives the same result). Hot anchors are handled by
map-side combined minima and joins that Spark can split, never as one group; the others by one sort. Of the others, one
that turns out to have more than ``MOST_RUNS`` runs there joins the hot ones for the third pass, which holds an anchor's
runs in memory.

Defined cases: NULL and empty texts, and texts shorter than a window, have nothing to remove; a document with a NULL doc_id
is left alone and repeats nothing; rows that share doc_id and text tie, and both keep a string; other columns are ignored;
an empty table gives an empty result. Strings are compared by two 64-bit hashes, of the anchor and of the content.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.shared import store, texts

LENGTH, GRAM = 100, 24
#: Runs of one anchor whose single windows a task takes apart together, at most.
MOST_RUNS = 20_000
#: Documents are handled together up to so many bytes; a longer one is cut into overlapping parts of this size.
_BUFFER = 512 << 10
_PLACE = 24  # bits of a position in a buffer
#: One document in so many is looked at to find hot anchors.
_SAMPLED = 32
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
_WORD = 1 << 64


@cache
def _signs() -> np.ndarray:
    """A random number for each byte."""
    return np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    done, step = 1, base
    while done < size:
        more = min(done, size - done)
        out[done:done + more] = out[:more] * np.uint64(step)
        done, step = done * 2, step * step % _WORD
    return out


def _prefix(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any part of ``data`` follows."""
    size = 1 << max(1, int(len(data)).bit_length())
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_signs()[data] * _powers(pow(_BASE, -1, _WORD), size)[:len(data)], out=out[1:])
    return out


def _content(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each part [start, end), the same wherever that content is."""
    size = 1 << max(1, int(len(prefix)).bit_length())
    x = (prefix[end] - prefix[start]) * _powers(_BASE, size)[start]
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (anchor's hash, its place, first window, windows).

    ``ends`` has for each byte the end of its document in ``data``.
    """
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    gram = min(GRAM, length)
    places = np.arange(len(data) - gram + 1)
    hashes = _content(_prefix(data), places, places + gram)
    mask = np.uint64((1 << _PLACE) - 1)
    least, span, reach = (hashes & ~mask) | places.astype(np.uint64), 1, length - gram + 1
    while span * 2 <= reach:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < reach:
        least = np.minimum(least[:span - reach], least[reach - span:])
    place = (least & mask).astype(np.int64)
    valid = np.arange(n) + length <= ends[:n]
    change = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (valid[1:] != valid[:-1]))))
    many = np.diff(np.append(change, n))
    own = valid[change]
    first, many = change[own], many[own]
    return hashes[place[first]], place[first], first, many


def _buffers(batch: pa.RecordBatch, length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Rows of a batch, the offset of each part in its text, and the parts, together about ``_BUFFER`` bytes."""
    rows, bases, parts, held = [], [], [], 0
    for i, text in enumerate(batch["text"]):
        data = text.as_py().encode()
        for base in range(0, max(1, len(data) - length + 1), _BUFFER):
            part = data[base:base + _BUFFER + length - 1]
            if held and held + len(part) > 2 * _BUFFER:
                yield rows, bases, parts
                rows, bases, parts, held = [], [], [], 0
            rows, bases, parts = rows + [i], bases + [base], parts + [part]
            held += len(part)
    if rows:
        yield rows, bases, parts


def runs(docs: DataFrame, length: int = LENGTH, hot: np.ndarray | None = None) -> DataFrame:
    """gram, run, doc_id, th, start, n, off, hot: every run of windows, with the hashes of its anchor and of its content."""
    listed = docs.sparkSession.sparkContext.broadcast(np.sort(hot) if hot is not None else np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, bases, parts in _buffers(batch, length):
                data = np.frombuffer(b"".join(parts), np.uint8)
                sizes = np.array([len(p) for p in parts])
                end = np.cumsum(sizes)
                gram, place, first, many = anchors(data, np.repeat(end, sizes), length)
                if not len(gram):
                    continue
                content = _content(_prefix(data), first, first + many + length - 1)
                off = place - first
                content = content ^ ((off * 1024 + many).astype(np.uint64) * _MIX)
                part = np.searchsorted(end, first, side="right")
                own = pa.array(np.array(rows)[part])
                start = first - (end - sizes)[part] + np.array(bases)[part]
                grams = gram.view(np.int64)
                yield pa.record_batch(
                    [pa.array(grams), pa.array(content.view(np.int64)), batch["doc_id"].take(own), batch["th"].take(own),
                     pa.array(start.astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(off.astype(np.int32)),
                     pa.array(np.isin(grams, listed.value))],
                    ["gram", "run", "doc_id", "th", "start", "n", "off", "hot"])

    return docs.select("doc_id", "th", "text").mapInArrow(
        run, "gram long, run long, doc_id long, th long, start int, n int, off int, hot boolean")


def _sampled(docs: DataFrame, length: int) -> DataFrame:
    """The anchors of the runs of a sample of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, parts in _buffers(batch, length):
                sizes = np.array([len(p) for p in parts])
                gram = anchors(np.frombuffer(b"".join(parts), np.uint8), np.repeat(np.cumsum(sizes), sizes), length)[0]
                yield pa.record_batch([pa.array(gram.view(np.int64))], ["gram"])

    return docs.where(F.pmod(F.col("th"), F.lit(_SAMPLED)) == 0).select("text").mapInArrow(run, "gram long")


def hot_anchors(docs: DataFrame, length: int) -> np.ndarray:
    """Anchors that hold more than a quarter of a task's mean share of all runs, judged by a sample of the documents."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = store(_sampled(docs, length).groupBy("gram").agg(F.count("*").alias("many")))
    total = counts.agg(F.sum("many")).first()[0] or 0
    least = max(32.0, total / (4 * tasks))
    found = counts.where(F.col("many") > least).select("gram").toArrow()
    return found["gram"].to_numpy().astype(np.int64)


def _decided(found: DataFrame, any_hot: bool) -> DataFrame:
    """The runs that are not alone: ``again`` if an equal one came earlier, else they are the earliest of several kinds."""
    cold = found.where("NOT hot")
    of_gram = Window.partitionBy("gram")
    of_run = Window.partitionBy("gram", "run").orderBy("doc_id", "start")
    columns = ["gram", "run", "doc_id", "th", "start", "n", "off", "hot"]
    sorted_once = cold.select(*columns[:-1], (F.count("*").over(of_gram) > MOST_RUNS).alias("hot"),
                              F.rank().over(of_run).alias("place"),
                              (F.min("run").over(of_gram) != F.max("run").over(of_gram)).alias("mixed"))
    decided = sorted_once.where("place > 1 OR mixed").select(*columns, (F.col("place") > 1).alias("again"))
    if not any_hot:
        return decided

    hot = store(found.where("hot"))
    firsts = hot.groupBy("gram", "run").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("many"))
    kinds = firsts.groupBy("gram").agg(F.count("*").alias("kinds"))
    known = firsts.join(kinds, "gram").where("many > 1 OR kinds > 1")
    again = F.struct("doc_id", "start") != F.col("first")
    hot_ones = hot.join(known, ["gram", "run"]).where(again | (F.col("kinds") > 1)).select(*columns, again.alias("again"))
    return decided.unionByName(hot_ones)


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, th and the compressed text, for joins that must move it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.record_batch([batch["doc_id"], batch["th"], pa.array([pack(t.as_py().encode()) for t in batch["text"]])],
                                  ["doc_id", "th", "packed"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, packed binary")


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` runs with their bytes."""
    of_doc = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("gram", "start", "n", "off", "hot")).alias("w"))
    # Rows that share doc_id and text need it once.
    joined = _packed(docs.dropDuplicates(["doc_id", "th"])).join(of_doc, ["doc_id", "th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows, parts, held = [], [], 0
            own = batch["w"].values
            begin, end = own.field("start").to_pylist(), own.field("n").to_pylist()
            at = batch["w"].offsets.to_pylist()
            for i in range(len(batch)):
                data = unpack(batch["packed"][i].as_py())
                for k in range(at[i], at[i + 1]):
                    rows.append((i, k))
                    parts.append(data[begin[k]:begin[k] + end[k] + length - 1])
                    held += len(parts[-1])
                if held > _BUFFER or i == len(batch) - 1:
                    row, place = (pa.array(c) for c in zip(*rows))
                    yield pa.record_batch(
                        [own.field("gram").take(place), batch["doc_id"].take(row), batch["th"].take(row),
                         own.field("start").take(place), own.field("off").take(place), own.field("hot").take(place),
                         pa.array(parts, pa.binary())], ["gram", "doc_id", "th", "start", "off", "hot", "bytes"])
                    rows, parts, held = [], [], 0

    return joined.mapInArrow(
        run, "gram long, doc_id long, th long, start int, off int, hot boolean, bytes binary")


def _windows(rows: dict[str, np.ndarray], parts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """The single windows of runs: row, place in the run (``i``), and the hash of the window."""
    sizes = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    many = sizes - length + 1
    row = np.repeat(np.arange(len(parts)), many)
    i = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    at = (np.cumsum(sizes) - sizes)[row] + i
    return {"row": row, "i": i, "content": _content(_prefix(data), at, at + length)}


def _repeated_in_groups(contexts: DataFrame, length: int) -> DataFrame:
    """doc_id, th, start, n of the repeated windows of anchors that are not hot; each anchor's runs are in one task."""
    names = ["doc_id", "th", "start", "n"]

    def solve(rows: dict[str, np.ndarray], parts: list[bytes]) -> pa.RecordBatch:
        w = _windows(rows, parts, length)
        gram, doc, start = (rows[c][w["row"]] for c in ("gram", "doc_id", "start"))
        off, start = rows["off"][w["row"]] - w["i"], start + w["i"]
        order = np.lexsort((start, doc, w["content"], off, gram))
        same = np.ones(len(order), bool)  # whether a window equals the one before it in this order
        for c in (gram, off, w["content"]):
            same[1:] &= c[order][1:] == c[order][:-1]
        same[:1] = False
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        first = order[head]
        again = np.zeros(len(order), bool)
        again[order] = (doc[first] != doc[order]) | (start[first] != start[order])
        # back in the order of rows, next to each other in a run
        begin = again & ~np.concatenate(([False], again[:-1] & (w["row"][1:] == w["row"][:-1])))
        end = again & ~np.concatenate((again[1:] & (w["row"][1:] == w["row"][:-1]), [False]))
        at = np.flatnonzero(begin)
        return pa.record_batch([pa.array(doc[at]), pa.array(rows["th"][w["row"][at]]), pa.array(start[at].astype(np.int32)),
                                pa.array((np.flatnonzero(end) - at + 1).astype(np.int32))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows up to the last whole anchor are solved, the rest waits for the next batch
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            gram = table["gram"].to_numpy()
            whole = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if gram[0] != gram[-1] else 0
            if whole:
                yield solve(*columns(table.slice(0, whole)))
            held = table.slice(whole).to_batches()
        if held:
            yield solve(*columns(pa.Table.from_batches(held)))

    def columns(table: pa.Table) -> tuple[dict[str, np.ndarray], list[bytes]]:
        rows = {c: table[c].to_numpy().astype(np.int64) for c in ("gram", "doc_id", "th", "start", "off")}
        return rows, table["bytes"].to_pylist()

    return contexts.where("NOT hot").repartition("gram").sortWithinPartitions("gram").mapInArrow(
        run, "doc_id long, th long, start int, n int")


def _repeated_hot(contexts: DataFrame, length: int) -> DataFrame:
    """The same for hot anchors, window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 2000):
                part = batch.slice(a, 2000)
                w = _windows({}, part["bytes"].to_pylist(), length)
                row = pa.array(w["row"])
                off = part["off"].to_numpy()[w["row"]] - w["i"]
                start = part["start"].to_numpy()[w["row"]] + w["i"]
                yield pa.record_batch(
                    [part["gram"].take(row), pa.array(off.astype(np.int32)), pa.array(w["content"].view(np.int64)),
                     part["doc_id"].take(row), part["th"].take(row), pa.array(start.astype(np.int32))],
                    ["gram", "off", "content", "doc_id", "th", "start"])

    windows = contexts.where("hot").mapInArrow(
        run, "gram long, off int, content long, doc_id long, th long, start int")
    key = ["gram", "off", "content"]
    firsts = windows.groupBy(*key).agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("many"))
    again = windows.join(firsts.where("many > 1").drop("many"), key).where(F.struct("doc_id", "start") != F.col("first"))
    return again.select("doc_id", "th", "start", F.lit(1).alias("n"))


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, th, start, n: runs of repeated windows. ``docs`` has doc_id, th and text."""
    known = docs.where("doc_id IS NOT NULL")
    hot = hot_anchors(known, length)
    decided = store(_decided(runs(known, length, hot), len(hot) > 0))
    marks = decided.where("again").select("doc_id", "th", "start", "n")
    contexts = store(_contexts(known, decided.where("NOT again"), length))
    marks = marks.unionByName(_repeated_in_groups(contexts, length))
    return marks if contexts.where("hot").isEmpty() else marks.unionByName(_repeated_hot(contexts, length))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, ``spans`` (the removed runs of bytes, start and end) and ``kept`` (the remaining bytes)."""
    own = texts(docs).withColumn("th", F.xxhash64("text"))
    marks = repeated_windows(own, length).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    joined = _packed(own).join(marks, ["doc_id", "th"], "left")

    def cut(data: bytes, marks: pa.Array | None) -> tuple[list[dict[str, int]], bytes]:
        if marks is None:
            return [], data
        start, n = marks.field("start").to_numpy().astype(np.int64), marks.field("n").to_numpy()
        order = np.argsort(start)
        start, end = start[order], np.maximum.accumulate((start + n + length - 1)[order])
        begin = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
        spans = list(zip(start[begin].tolist(), end[np.append(begin[1:], len(end)) - 1].tolist()))
        edges = zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(data)])
        return [{"start": a, "end": b} for a, b in spans], b"".join(data[a:b] for a, b in edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            ids, rows, held = [], [], 0
            for i in range(len(batch)):
                data = unpack(batch["packed"][i].as_py())
                ids.append(i)
                rows.append((len(data), *cut(data, batch["marks"][i].values)))
                held += len(data)
                if held > _BUFFER or i == len(batch) - 1:
                    size, spans, kept = zip(*rows)
                    yield pa.record_batch([batch["doc_id"].take(pa.array(ids)), pa.array(size), pa.array(spans, span),
                                           pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])
                    ids, rows, held = [], [], 0

    return joined.mapInArrow(
        run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def span_bytes(spans: Column) -> Column:
    """The number of bytes that spans cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
