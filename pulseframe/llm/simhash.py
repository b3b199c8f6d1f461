"""SimHash near-duplicates through covering locality-sensitive hashing.

Fingerprint: bit i of 64 is set if over half of the document's shingle hashes have it set. Two documents are linked if
their fingerprints differ in at most ``RADIUS`` bits, and linked documents share a component.

Covering: each bit position gets a non-zero label of RADIUS + 1 bits. Each non-zero vector v of that length makes one
table, whose mask has the positions whose label has an odd product with v. The labels of at most RADIUS differing
positions never span the whole space, so some v is orthogonal to all of them: in that table the two fingerprints agree
under the mask. Every pair within the radius thus collides in one of the 7 tables, and each mask has about 37 bits.

A bucket of up to ``SMALL`` fingerprints compares its pairs. A larger one would have too many: its fingerprints are
linked through balls instead. Two fingerprints differ in at most two bits exactly if some centre is within one bit of
both, so each of them goes to its 65 centres, and each centre links what it holds to its smallest member. No pair is lost
and rows stay proportional to the fingerprints, of which copies of a text have one.

Defined cases: NULL, empty and blank texts have fingerprint zero and are linked like any other; fewer words than a
shingle make one shingle; repeated rows share everything; a NULL doc_id is kept and never names a component unless all
its links are NULL too; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.components import components
from pulseframe.llm.shared import releasing, store

BITS, RADIUS, SHINGLE, SEED, SMALL = 64, 2, 3, 42, 8
_BLOCK = 1 << 16


def masks() -> list[int]:
    """The covering masks, as signed 64-bit numbers; labels go round the non-zero vectors."""
    labels = [1 + i % (2 ** (RADIUS + 1) - 1) for i in range(BITS)]
    found = []
    for v in range(1, 2 ** (RADIUS + 1)):
        mask = sum(1 << i for i, label in enumerate(labels) if (label & v).bit_count() % 2)
        found.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return found


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text. Memory beyond the text is bounded by a block of hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    total = len(words) - size + 1
    first, last = starts[:total].tolist(), ends[size - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, total, _BLOCK):
        hashes = [digest(joined[a:b], seed) for a, b in zip(first[k:k + _BLOCK], last[k:k + _BLOCK])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keys`` of each row, all long, and its fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch["text"]), np.uint64, len(batch))
            yield pa.record_batch([*(batch[k] for k in keys), pa.array(found.view(np.int64))], [*keys, "fp"])

    kind = ", ".join(f"{k} long" for k in (*keys, "fp"))
    return docs.select(*keys, "text").mapInArrow(releasing(run), kind)


def near_links(prints: DataFrame, small: int = SMALL) -> DataFrame:
    """Links (a, b) that connect all distinct ``fp`` within the radius, directly or through others within it."""
    tables = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                       for i, m in enumerate(masks())])
    keyed = prints.select("fp", F.explode(tables).alias("t")).select("fp", "t.table", "t.key")
    sizes = keyed.groupBy("table", "key").agg(F.count("*").alias("size")).where("size > 1")
    full = store(keyed.join(sizes, ["table", "key"]))

    few = full.where(F.col("size") <= small)
    other = few.select("table", "key", F.col("fp").alias("b"))
    pairs = (few.select("table", "key", F.col("fp").alias("a")).join(other, ["table", "key"]).where("a > b")
             .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b"))

    many = full.where(F.col("size") > small).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < BITS - 1 else -(1 << i)) for i in range(BITS)])
    balls = many.select("fp", F.explode(flips).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    centres = balls.groupBy("centre").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top")
    star = balls.join(centres, "centre").where("fp > b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(star).distinct()


def clusters(prints: DataFrame) -> DataFrame:
    """Each ``fp`` of ``prints``, the smallest doc_id that has it (first), and its component, the smallest ``fp`` that links reach."""
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(near_links(firsts.select("fp")))
    return firsts.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach."""
    prints = store(fingerprints(docs, shingle, seed))
    named = clusters(prints)
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = named.join(least, "component").select("fp", "component_id")
    return prints.join(ids, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
