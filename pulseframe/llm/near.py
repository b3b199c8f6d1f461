"""Near copies by the Jaccard similarity of word shingles: MinHash bands propose, exact counts decide, crowds included.

Two documents are linked if their sets of five-word shingles have a similarity of 0.8 or more; linked ones share a component.
Links that another method has found, such as `simhash`, may be given and count alike.

1. Documents with one set of shingles are one node, so copies of a text count once from here on.
2. Each of 25 bands joins five minima into a key. A pair of similarity 0.8 shares no key with a chance of (1 - 0.8^5)^25,
   5 in 100,000; a more similar one with less.
3. A bucket of up to ``BLOCK`` nodes (and ``ELEMENTS`` shingles in all) is one task's block: the sets of all its nodes are
   compared with each other, by 64-bit hashes of their shingles, and what leaves it is a star for each component. Buckets of the
   same nodes are taken once.
4. The nodes of larger buckets form crowds (of overlapping buckets), in which all links are found, without comparing all pairs:

   * M is the set of the shingles that more than half of the crowd have; a node is what it lacks of M (a) and has besides
     (b). With C = 5 |a| + 4 |b|, two nodes are linked if C + C' <= |M|, whatever they share, so every such link also joins
     both to the node of the smallest C. That star is all that is kept of them, and nothing is compared.
   * Any other link must share at least (C + C' - |M|) / 9 of the differences a and b. So its nodes share one among their
     rarest differences, in prefixes as long as the smallest possible partner leaves them. Nodes that the star has
     joined meet only those that it has not.
   * Nodes that share such a difference are a bucket again: one of up to ``BLOCK`` nodes is compared, a larger one is a crowd of
     at most half the size.

   Rows stay in proportion to the differences; nothing of a crowd is gathered in one task, and the hub's set is not moved.

Defined cases: rows with a NULL doc_id play no part; NULL, empty and blank texts are copies of each other; fewer words than a
shingle make one shingle; a document is a pair of doc_id and text, so rows that share a doc_id only are different ones, and rows
that share both are one; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.components import components
from pulseframe.llm.shared import release, releasing, store

SHINGLE, SEED, BANDS, ROWS = 5, 42, 25, 5
BLOCK, ELEMENTS = 256, 1 << 20
_COLUMNS = 1 << 14
_RANDOM = np.random.default_rng(SEED)
_ODD = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_HELD = 4 << 20
_BLOCK = 1 << 13


def shingles(text: str | None) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(
        starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())), np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each permutation of the hashes."""
    out = np.full(len(_ODD), ~np.uint64(0))
    for k in range(0, len(hashes), _BLOCK):
        part = hashes[k:k + _BLOCK]
        for i, (odd, add) in enumerate(zip(_ODD, _ADD)):
            mixed = part * odd + add
            out[i] = min(out[i], (mixed ^ (mixed >> np.uint64(32))).min())
    return out


def _prints(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), node (of its set), n (shingles), and keys of the bands."""
    kind = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("node", pa.binary()), ("n", pa.int32()),
                      ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for text in batch["text"]:
                hashes = shingles(text.as_py())
                least = minima(hashes)
                nodes.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                sizes.append(len(hashes))
                bands = [xxhash.xxh64_intdigest(least[i * ROWS:(i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
                keys.append(np.array(bands, np.uint64).view(np.int64))
            yield pa.record_batch([batch["doc_id"], batch["th"], pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()),
                                   pa.array(keys, pa.list_(pa.int64()))], schema=kind)

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(releasing(run), "doc_id long, th long, node binary, n int, keys array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """node and its shingles, from ``texts`` (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(nodes: list, sets: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(nodes, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

        for batch in batches:
            nodes, sets, held = [], [], 0
            for node, text in zip(batch["node"], batch["text"]):
                nodes.append(node.as_py())
                sets.append(shingles(text.as_py()).view(np.int64))
                held += len(sets[-1])
                if held * 8 > _HELD:
                    yield out(nodes, sets)
                    nodes, sets, held = [], [], 0
            if nodes:
                yield out(nodes, sets)

    return texts.mapInArrow(releasing(run), "node binary, hashes array<long>")


def _buckets(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (key, node, n, open, and others) of buckets in which a pair is left to compare, with whether they are ``large``; of
    buckets that hold the same nodes, one."""
    sizes = rows.groupBy("key").agg(
        F.count("*").alias("size"), F.max("open").alias("any"), F.sum("n").alias("elements"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("node")).alias("mix"))
    once = sizes.where("size > 1 AND any").groupBy("size", "sum", "mix", "elements").agg(F.min("key").alias("key"))
    large = (F.col("size") > 2) & ((F.col("size") > block) | (F.col("elements") > ELEMENTS))
    return rows.join(once.select("key", large.alias("large")), "key")


def linked_nodes(sets: list[np.ndarray], c: np.ndarray, m: int) -> list[tuple[int, int]]:
    """(position, smallest position of its component) of the nodes of a block that are linked: 9 * shared >= c + c' - m."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, column = owner[many[column] > 1], column[many[column] > 1]
    _, column = np.unique(column, return_inverse=True)
    shared, order = np.zeros((len(sets), len(sets)), np.float64), np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [first, first + _COLUMNS])
        has = np.zeros((len(sets), _COLUMNS), np.float32)
        has[owner[a:b], column[a:b] - first] = 1
        shared += has @ has.T
    met = 9 * shared >= c[:, None] + c[None, :] - m
    root = np.arange(len(sets))
    while True:
        least = np.where(met, root[None, :], len(sets)).min(axis=1)
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return [(i, int(r)) for i, r in enumerate(root) if r < i]
        root = new


def _compare(rows: DataFrame) -> DataFrame:
    """Links (a, b) within blocks, from ``rows`` (key, node, c, m, all)."""

    def run(table: pa.Table) -> pa.Table:
        nodes, lists = table["node"].combine_chunks(), table["all"].combine_chunks()
        sets = [np.asarray(x.values) for x in lists]
        found = linked_nodes(sets, table["c"].to_numpy().astype(np.float64), table["m"][0].as_py())
        a, b = ([f[i] for f in found] for i in (0, 1))
        if len(lists.values) > ELEMENTS // 8:
            release()
        return pa.table([nodes.take(pa.array(a, pa.int64())), nodes.take(pa.array(b, pa.int64()))], ["a", "b"])

    return rows.select("key", "node", "c", "m", "all").groupBy("key").applyInArrow(run, "a binary, b binary")


def _about_majority(crowds: DataFrame) -> DataFrame:
    """``crowds`` (crowd, node, m, a, b), restated for the set of what more than half of each crowd have: with c = 5 |a| + 4 |b|."""
    sizes = crowds.groupBy("crowd").agg(F.count("*").alias("size"))
    lacks = crowds.select("crowd", F.explode("a").alias("e"), F.lit(True).alias("inside"))
    has = crowds.select("crowd", F.explode("b").alias("e"), F.lit(False).alias("inside"))
    most = lacks.unionByName(has).groupBy("crowd", "e", "inside").agg(F.count("*").alias("many")).join(sizes, "crowd").where(
        "2 * many > size")
    turned = most.groupBy("crowd").agg(F.collect_list(F.when(~F.col("inside"), F.col("e"))).alias("comes"),
                                       F.collect_list(F.when(F.col("inside"), F.col("e"))).alias("goes"))
    none = F.array().cast("array<long>")
    both = crowds.join(turned, "crowd", "left").select(
        "crowd", "node", "m", "a", "b", F.coalesce("comes", none).alias("comes"), F.coalesce("goes", none).alias("goes"))
    now = both.select(
        "crowd", "node", (F.col("m") + F.size("comes") - F.size("goes")).alias("m"),
        F.concat(F.array_except("a", "goes"), F.array_except("comes", "b")).alias("a"),
        F.concat(F.array_except("b", "comes"), F.array_except("goes", "a")).alias("b"))
    return now.withColumn("c", (5 * F.size("a") + 4 * F.size("b")).cast("long"))


def _one_round(crowds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of crowds: the nodes restated, links that need no comparison, and rows (crowd, key, node, n, open) of the nodes that
    share one of their rarest differences, the key."""
    now = store(_about_majority(crowds))
    hubs = now.groupBy("crowd").agg(F.min(F.struct("c", "node")).alias("hub"))
    led = now.join(hubs, "crowd").withColumn("open", F.col("c") + F.col("hub.c") > F.col("m"))
    star = led.where(~F.col("open") & (F.col("node") != F.col("hub.node"))).select(
        F.col("node").alias("a"), F.col("hub.node").alias("b"))
    left = led.groupBy("crowd").agg(F.min(F.when(F.col("open"), F.col("c"))).alias("least")).where("least IS NOT NULL")
    left = led.join(left, "crowd")
    size, n = (F.size("a") + F.size("b")).alias("size"), F.col("m") - F.size("a") + F.size("b")
    # A partner has four fifths of the shingles at least, of which M gives no more than it has.
    partner = F.greatest(F.when(F.col("open"), F.col("hub.c")).otherwise(F.col("least")), F.ceil(3.2 * n) - 4 * F.col("m"))
    shared = F.greatest(F.lit(1), F.ceil((F.col("c") + partner - F.col("m")) / 9))
    nodes = left.select("crowd", "node", "open", n.alias("n"), size,
                        (F.size("a") + F.size("b") - shared + 1).cast("int").alias("prefix"), F.concat("a", "b").alias("all"))
    rows = nodes.where("prefix > 0").select("crowd", "node", F.explode("all").alias("e"))
    many = rows.groupBy("crowd", "e").agg(F.count("*").alias("many")).where("many > 1")
    common = rows.join(many, ["crowd", "e"]).groupBy("crowd", "node").agg(
        F.array_sort(F.collect_list(F.struct("many", "e"))).alias("common"))
    # Differences that no other node has come first in the order, and need no bucket.
    taken = F.col("prefix") - (F.col("size") - F.size("common"))
    chosen = nodes.drop("all").join(common, ["crowd", "node"]).withColumn("taken", taken).where("taken > 0")
    keyed = chosen.select("crowd", "node", "n", "open", F.explode(F.slice("common", F.lit(1), F.col("taken"))).alias("d"))
    return now, star, keyed.select("crowd", F.xxhash64("crowd", "d.e").alias("key"), "node", "n", "open")


def crowd_links(crowds: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all that is linked within each crowd, from ``crowds`` (crowd, node, hashes)."""
    crowds = store(crowds.select("crowd", "node", F.lit(0).cast("long").alias("m"), F.array().cast("array<long>").alias("a"),
                                 F.col("hashes").alias("b")))
    links = crowds.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    while not crowds.isEmpty():
        now, star, keyed = _one_round(crowds)
        full = store(_buckets(store(keyed), block))
        few = full.where("NOT large").select("crowd", "key", "node").join(
            now.select("crowd", "node", "c", "m", F.concat("a", "b").alias("all")), ["crowd", "node"])
        links = links.unionByName(store(star.unionByName(_compare(few))))
        larger = full.where("large").select("crowd", "key", "node")
        crowds = store(larger.join(now, ["crowd", "node"]).select(F.col("key").alias("crowd"), "node", "m", "a", "b"))
    return links


def _joined(prints: DataFrame, alike: DataFrame) -> DataFrame:
    """Links (a, b) of the nodes whose documents ``alike`` (doc_id, th, cluster) has in one cluster."""
    # Rows may repeat doc_id and text on both sides.
    held = prints.select("doc_id", "th", "node").distinct().join(alike.distinct(), ["doc_id", "th"]).select("cluster", "node").distinct()
    least = held.groupBy("cluster").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b < top")
    return held.join(least, "cluster").where("node > b").select(F.col("node").alias("a"), "b")


def near_copies(docs: DataFrame, block: int = BLOCK, alike: DataFrame | None = None) -> DataFrame:
    """doc_id, th (hash of the text), component_id (the smallest doc_id that links reach), and whether the document ``leads``: it
    has the smallest (doc_id, th) of its component.  ``alike`` (doc_id, th, cluster) has documents that are linked already: those of
    one cluster."""
    prints = store(_prints(docs))
    nodes = store(prints.groupBy("node").agg(
        F.min(F.struct("doc_id", "th")).alias("first"), F.first(F.struct("n", "keys")).alias("p"))
        .select("node", "first", "p.*"))
    keyed = nodes.where("n > 0").select("node", "n", F.explode("keys").alias("key"), F.lit(True).alias("open"))
    full = store(_buckets(keyed, block))
    wanted = nodes.join(full.select("node").distinct(), "node").select("node", "first.doc_id", "first.th")
    # Two rows may share doc_id and text.
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), "text").join(
        wanted, ["doc_id", "th"]).select("node", "text")
    sets = store(_sets(texts).dropDuplicates(["node"]))
    few = full.where("NOT large").join(sets, "node").select(
        "key", "node", (4 * F.size("hashes")).alias("c"), F.lit(0).cast("long").alias("m"), F.col("hashes").alias("all"))
    compared = store(_compare(few))
    large = full.where("large")
    least = large.groupBy("key").agg(F.min("node").alias("least"))
    crowds = components(large.join(least, "key").select(F.col("node").alias("a"), F.col("least").alias("b")))
    links = crowd_links(crowds.select("node", F.xxhash64("component").alias("crowd")).join(sets, "node"), block)
    linked = components(links.unionByName(compared) if alike is None else
                        links.unionByName(compared).unionByName(_joined(prints, alike)))
    named = nodes.select("node", "first").join(linked, "node", "left").select(
        "node", "first", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("lead"))
    ids = named.join(least, "component").select("node", "lead")
    return prints.select("doc_id", "th", "node").join(ids, "node").select(
        "doc_id", "th", F.col("lead.doc_id").alias("component_id"), (F.struct("doc_id", "th") == F.col("lead")).alias("leads"))
