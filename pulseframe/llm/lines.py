"""Line de-duplication by a deletion-neighbourhood join.

A line is removed if an earlier one, in the order of (doc_id, line number), differs from it in at most one inserted,
deleted or replaced character. Lines shorter than ``MIN_CHARS`` are removed only if an earlier one equals them: among
them, one character makes another line. Blank lines stay. What counts is each line as it stands in the input, also if that
earlier line is removed itself.

1. Equal lines of any length are reduced to the earliest, by a map-side combined minimum; a very common line is one row per
   task.
2. Which distinct lines can have a neighbour at all: two lines within one edit agree in the first half or in the last half
   (taken by the length of the shorter), so each line is grouped by both, once for neighbours of its own length and once
   as the longer one of a pair. A line that is alone everywhere has no neighbour and goes no further.
3. The others emit their deletion variants as hashed keys, on the side where the edit must be. Lines of one length that are
   equal without position p differ there only; a line that equals a variant of another lacks just that character.
   All of a key's lines are thus neighbours of each other (or of the whole line), and the key's earliest stands for them: a
   minimum and a join, not pairs, however many lines share a key.
4. Every pair found is verified by its edit distance.

Defined cases: NULL and empty texts have no line to remove; rows with a NULL doc_id stay as they are and play no part;
rows that share doc_id and line number tie, and both keep an equal line; lines end at ``\\n``, a final one leaves an empty
last line; an empty table gives an empty one; other columns are kept by
``dedup_documents``, but for one named ``n_lines_removed``, which it sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.shared import store

MIN_CHARS = 20
#: Two primes below 2**31 and a base for each: a key joins both residues of a polynomial hash.
_PRIMES, _BASES = (2147483647, 2147483629), (911382323, 972663749)
_SEPARATOR = "\n"
_NOT_BLANK = r"\P{IsWhite_Space}"


def _both(line: Column) -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")]


def _lines(docs: DataFrame) -> DataFrame:
    """The lines that take part: doc_id, th (hash of the whole text), no, line, h1, h2."""
    whole = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), "text")
    rows = whole.select("doc_id", "th", F.posexplode(F.split("text", _SEPARATOR)).alias("no", "line"))
    return rows.where(F.col("line").rlike(_NOT_BLANK)).select("*", *_both(F.col("line")))


def _halves() -> Column:
    """The keys of a line's four groups: by first and by last half, as one of equal length and then as the longer one."""
    n = F.length("line")
    out = []
    for longer in (False, True):
        m = n - 1 if longer else n
        half = F.floor(m / 2).cast("int")
        for side, part in (("head", F.substring("line", F.lit(1), half)),
                           ("tail", F.substring("line", n - (m - half) + 1, m - half))):
            out.append(F.xxhash64(F.lit(side), m, part))
    return F.array(*out)


def _candidates(firsts: DataFrame) -> DataFrame:
    """The distinct lines that may have a neighbour, with what they must emit."""
    keyed = firsts.select("h1", "h2", F.posexplode("halves").alias("i", "key")).select(
        "h1", "h2", "key", (F.col("i") >= 2).alias("longer"), (F.col("i") % 2 == 0).alias("head"))
    sizes = keyed.groupBy("key").agg(F.count_if(~F.col("longer")).alias("same"), F.count_if("longer").alias("longers"))
    sizes = sizes.where("same > 1 OR (same > 0 AND longers > 0)")
    met = keyed.join(sizes, "key")
    return met.groupBy("h1", "h2").agg(
        F.max(~F.col("longer") & F.col("head") & (F.col("same") > 1)).alias("replace_tail"),
        F.max(~F.col("longer") & ~F.col("head") & (F.col("same") > 1)).alias("replace_head"),
        F.max(F.col("longer") & F.col("head") & (F.col("same") > 0)).alias("delete_tail"),
        F.max(F.col("longer") & ~F.col("head") & (F.col("same") > 0)).alias("delete_head"),
        F.max(~F.col("longer") & (F.col("longers") > 0)).alias("whole"))


def deletion_keys(line: str) -> tuple[np.ndarray, int]:
    """The keys of a line without each of its characters, and its own key."""
    codes = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    n, out, own = len(codes), np.zeros(len(codes), np.uint64), 0
    for prime, base in zip(_PRIMES, _BASES):
        p = np.uint64(prime)
        powers = np.ones(n, np.uint64)
        if n > 1:  # powers by doubling
            done, step = 1, base % prime
            while done < n:
                more = min(done, n - done)
                powers[done:done + more] = powers[:more] * np.uint64(step) % p
                done, step = done * 2, step * step % prime
        terms = codes % p * powers % p
        sums = np.cumsum(terms)
        after = (sums[-1] - sums) % p * np.uint64(pow(base, -1, prime)) % p
        without = ((sums - terms) + after) % p
        out = (out << np.uint64(31)) | without
        own = (own << 31) | int(sums[-1] % p)
    return out, own


_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def _mixed(keys: np.ndarray, tag: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (keys ^ (np.asarray(tag, np.uint64) * _MIX)) * _MIX
        return (x ^ (x >> _SHIFT)).view(np.int64)


def _variants(candidates: DataFrame) -> DataFrame:
    """key, doc_id, no, whole: the hashed deletion variants of each candidate, and its own text where that is asked for."""
    flags = ["replace_head", "replace_tail", "delete_head", "delete_tail", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, whole, held = [], [], [], 0
            columns = [batch[c].to_pylist() for c in ("line", *flags)]
            for i, (line, r_head, r_tail, d_head, d_tail, own) in enumerate(zip(*columns)):
                n = len(line)
                without, full = deletion_keys(line)
                parts = []
                if r_head or r_tail:  # a replaced character: the place is part of the key
                    a, b = (0 if r_head else n // 2), (n if r_tail else n // 2)
                    parts.append(_mixed(without[a:b], np.arange(a, b) * 2 + 3))
                if d_head or d_tail:  # what the shorter one is, whatever the place
                    a, b = (0 if d_head else (n - 1) // 2), (n if d_tail else (n - 1) // 2)
                    parts.append(np.unique(_mixed(without[a:b], (n - 1) * 2)))
                many = sum(map(len, parts))
                if own:
                    parts.append(_mixed(np.array([full], np.uint64), n * 2))
                keys += parts
                at += [np.full(many + bool(own), i)]
                whole += [np.arange(many + bool(own)) >= many]
                held += many
                if held > 500_000:
                    yield _rows(batch, keys, at, whole)
                    keys, at, whole, held = [], [], [], 0
            if keys:
                yield _rows(batch, keys, at, whole)

    return candidates.select("doc_id", "no", "line", *flags).mapInArrow(run, "key long, doc_id long, no int, whole boolean")


def _rows(batch: pa.RecordBatch, keys: list, at: list, whole: list) -> pa.RecordBatch:
    index = pa.array(np.concatenate(at))
    return pa.record_batch([pa.array(np.concatenate(keys)), batch["doc_id"].take(index), batch["no"].take(index),
                            pa.array(np.concatenate(whole))], ["key", "doc_id", "no", "whole"])


def _near(firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """h1, h2 of the distinct lines that have an earlier neighbour."""
    wanted = _candidates(firsts).join(firsts.select("h1", "h2", "doc_id", "no"), ["h1", "h2"])
    whole = docs.where("text IS NOT NULL").select("doc_id", "text")
    of_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct(
        "no", "h1", "h2", "replace_head", "replace_tail", "delete_head", "delete_tail", "whole")).alias("wanted"))
    found = whole.join(of_doc, "doc_id").select("doc_id", F.split("text", _SEPARATOR).alias("lines"), "wanted").select(
        "doc_id", F.explode(F.transform("wanted", lambda w: F.struct(
            F.get("lines", w["no"]).alias("line"), w.alias("w")))).alias("r")).select("doc_id", "r.line", "r.w.*")
    # Two rows may share a doc_id: the line must be the one that was asked for, once.
    candidates = store(found.where(F.col("line").isNotNull() & (F.xxhash64("line") == F.col("h1"))).dropDuplicates(
        ["h1", "h2"]))
    variants = _variants(candidates)
    rank = F.struct("doc_id", "no")
    groups = variants.groupBy("key").agg(
        F.min(F.when(~F.col("whole"), rank)).alias("first"), F.min(F.when(F.col("whole"), rank)).alias("own"),
        F.count("*").alias("many")).where("many > 1")
    # A key of replaced characters holds variants only, and all are neighbours. In a key of deleted ones only a whole line
    # and the variants that equal it are; whichever of the two came first is tried, the rest is left to verification.
    met = variants.join(groups, "key").select("doc_id", "no", F.explode(F.array("first", "own")).alias("other"))
    pairs = met.where(F.col("other").isNotNull() & (F.col("other") < rank)).distinct()
    text = candidates.select("doc_id", "no", "line")
    other = text.select(F.struct("doc_id", "no").alias("other"), F.col("line").alias("other_line"))
    close = F.levenshtein("line", "other_line", 1).between(0, 1)
    return pairs.join(text, ["doc_id", "no"]).join(other, "other").where(close).select(*_both(F.col("line"))).distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, th and no of every line that an earlier one makes redundant."""
    lines = _lines(docs)
    halves = F.when(F.length("line") >= MIN_CHARS, _halves())
    firsts = store(lines.withColumn("halves", halves).groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "no")).alias("first"), F.count("*").alias("many"), F.first("halves").alias("halves"))
        .select("h1", "h2", "first.doc_id", "first.no", "many", "halves"))
    near = _near(firsts.where("halves IS NOT NULL"), docs).withColumn("near", F.lit(True))
    verdicts = firsts.select("h1", "h2", F.struct("doc_id", "no").alias("first"), "many").join(
        near, ["h1", "h2"], "left").where("many > 1 OR near").select("h1", "h2", "first", "near")
    return (lines.select("doc_id", "th", "no", "h1", "h2").join(verdicts, ["h1", "h2"])
            .where(F.col("near") | (F.struct("doc_id", "no") != F.col("first"))).select("doc_id", "th", "no"))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The documents without their removed lines, and ``n_lines_removed``; all other columns are kept."""
    drops = removed_lines(docs).groupBy("doc_id", "th").agg(F.collect_set("no").alias("drops"))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", "text",
                        F.xxhash64("text").alias("th"))
    joined = whole.join(drops, ["doc_id", "th"], "left").withColumn("lines", F.split("text", _SEPARATOR))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    text = F.when(F.col("drops").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("lines", i)), _SEPARATOR))
    return joined.select(
        *[(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns if c != "n_lines_removed"],
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_lines_removed"))
