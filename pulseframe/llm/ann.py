"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample (``SAMPLE`` rows, those with the smallest hash of their vec_id); every row is then
assigned to a leaf, by Spark. To make inner products comparable as distances, each row gets one more component that brings it
to the length of the longest one; a query's is zero.

A query keeps a priority queue of tree nodes by distance to their centres. It takes the nearest one; an inner node puts
its children into the queue, a leaf is visited. How many leaves to visit is calibrated: for ``CALIBRATION`` queries the
true neighbours among all rows are found by brute force (one pass, the queries broadcast), and the number of visits is
widened until at least ``TARGET`` of them lie in visited leaves. A query goes on beyond that while its leaves hold fewer
rows than it asks for.

Neighbouring leaves are searched together, in cells of up to ``CHUNK`` rows: a query comes to a cell once, with the leaves
that it visits there, and leaves with its k best of them. A leaf of more rows, such as one of many equal vectors, is dealt
over several cells by hash; so are the queries, where more than ``QUERY_BLOCK`` of them visit the same leaves. A cell thus
holds a bounded number of either, and leaves that no query visits are not moved.

Defined cases: see ``usable`` (zero vectors take no part); shorter vectors count as ending in zeros; a query with fewer
other rows than k gets all of them; equal scores are ordered by vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.shared import store
from pulseframe.llm.vectors import best_first, matrix, paired, search_cells, top, usable

K, TARGET = 20, 0.95
SAMPLE, CALIBRATION, BRANCHES = 16_384, 128, 16
PER_LEAF, MOST_LEAVES, CHUNK, QUERY_BLOCK = 400, 1024, 8192, 2048
_TOGETHER = 512
#: Rows of queries and groups that a task hands on together.
_HANDED = 8192


class Tree:
    """Centres of all nodes, the children of inner nodes, and the number of each leaf."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 11):
        self.centres, self.children, self.leaf = [], [], []
        self._grow(sample, max(1, len(sample) // leaves), np.random.default_rng(seed))
        self.centres = np.array(self.centres)
        numbers = iter(range(len(self.leaf)))
        self.leaf = [-1 if c else next(numbers) for c in self.children]
        self.leaves = sum(n >= 0 for n in self.leaf)

    def _grow(self, sample: np.ndarray, least: int, rng: np.random.Generator) -> int:
        node = len(self.centres)
        self.centres.append(sample.mean(axis=0))
        self.children.append([])
        self.leaf.append(-1)
        if len(sample) > max(least, 2):
            own = _k_means(sample, min(BRANCHES, -(-len(sample) // least)), rng)
            groups = [sample[own == g] for g in np.unique(own)]
            if len(groups) > 1:
                self.children[node] = [self._grow(g, least, rng) for g in groups]
        return node

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: from the root always on to the nearest child."""
        out = np.empty(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            if not self.children[node]:
                out[own] = self.leaf[node]
                continue
            nearest = _distances(rows[own], self.centres[self.children[node]]).argmin(axis=1)
            todo += [(c, own[nearest == i]) for i, c in enumerate(self.children[node]) if (nearest == i).any()]
        return out

    def visits(self, distances: np.ndarray) -> Iterator[int]:
        """Leaves best bin first, for a query's distances to all centres."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heappop(queue)
            if self.children[node]:
                for c in self.children[node]:
                    heappush(queue, (distances[c], c))
            else:
                yield self.leaf[node]


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows * rows).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(axis=1)[None, :]


def _k_means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from k-means++ centres; the group of each row."""
    centres = rows[rng.integers(len(rows))][None, :]
    for _ in range(k - 1):
        far = _distances(rows, centres).min(axis=1).clip(0)
        if far.sum() <= 0:
            break
        centres = np.vstack([centres, rows[rng.choice(len(rows), p=far / far.sum())]])
    for _ in range(rounds):
        own = _distances(rows, centres).argmin(axis=1)
        centres = np.array([rows[own == g].mean(axis=0) if (own == g).any() else centres[g] for g in range(len(centres))])
    return _distances(rows, centres).argmin(axis=1)


def _lengthened(rows: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack([rows, np.sqrt((longest ** 2 - (rows * rows).sum(axis=1)).clip(0))])


def _exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in the order of the components: equal vectors get equal scores."""
    total = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        total += queries[:, d] * rows[:, d]
    return total


def _best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int,
          visited: np.ndarray | None = None) -> pd.DataFrame:
    """Each query's k best of these rows, or of the ``visited`` ones, its own left out."""
    parts = []
    for a in range(0, len(q), _TOGETHER):
        own, part = query_ids[a:a + _TOGETHER], q[a:a + _TOGETHER]
        rough = part @ x.T
        rough[own[:, None] == ids[None, :]] = -np.inf
        if visited is not None:
            rough[~visited[a:a + _TOGETHER]] = -np.inf
        most = min(k, len(ids))
        least = np.partition(rough, len(ids) - most, axis=1)[:, len(ids) - most]
        slack = 1e-12 * np.sqrt((part * part).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max()) * x.shape[1]
        at, row = np.nonzero((rough >= (least - slack)[:, None]) & np.isfinite(rough))
        parts.append(best_first(own, at, ids[row], _exact(part[at], x[row]), k))
    return pd.concat(parts)


def _search(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    q, x = paired(queries, rows)
    leaf = rows["leaf"].to_numpy()
    visited = np.array([np.isin(leaf, own) for own in queries["leaves"]])
    return _best(queries["vec_id"].to_numpy(), q, rows["vec_id"].to_numpy(), x, k, visited)


def _grouped(sizes: list[int]) -> list[int]:
    """The group of each leaf: leaves in the order of the tree, as many as fit into a cell."""
    out, held = [], 0
    for size in sizes:
        new = not out or held + size > CHUNK
        out.append((out[-1] + 1 if out else 0) if new else out[-1])
        held = size if new else held + size
    return out


def fit(rows: DataFrame, total: int, width: int, longest: float) -> Tree:
    """The tree, from a sample of at most ``SAMPLE`` rows."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().to_pandas()
    leaves = min(MOST_LEAVES, max(1, total // PER_LEAF))
    return Tree(_lengthened(matrix(sample["vec"], width), longest), leaves)


def calibrate(assigned: DataFrame, queries: DataFrame, tree: Tree, k: int, target: float, width: int) -> tuple[int, float]:
    """The number of leaf visits that reaches ``target``, and the recall that it has on the calibration queries."""
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).toArrow().to_pandas()
    if sample.empty:
        return 1, 1.0
    asked = assigned.sparkSession.sparkContext.broadcast((sample["vec_id"].to_numpy(), matrix(sample["vec"], width)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                ids = rows["vec_id"].to_numpy()
                hits = _best(*asked.value, ids, matrix(rows["vec"], width), k)
                order = np.argsort(ids)
                leaf = rows["leaf"].to_numpy()[order][np.searchsorted(ids[order], hits["vec_id"].to_numpy())]
                yield hits.assign(leaf=leaf)

    hits = assigned.select("vec_id", "vec", "leaf").mapInPandas(run, "query_id long, vec_id long, score double, leaf long")
    best = top(hits, k).join(hits.select("query_id", "vec_id", "leaf"), ["query_id", "vec_id"]).toArrow().to_pandas()
    if best.empty:
        return 1, 1.0
    far = _distances(np.column_stack([matrix(sample["vec"], width), np.zeros(len(sample))]), tree.centres)
    place = [dict(zip(tree.visits(d), range(tree.leaves))) for d in far]
    row = dict(zip(sample["vec_id"], range(len(sample))))
    needed = np.sort([place[row[q]][leaf] + 1 for q, leaf in zip(best["query_id"], best["leaf"])])
    visits = int(needed[int(np.ceil(target * len(needed))) - 1])
    return visits, float((needed <= visits).mean())


def nearest(vectors: DataFrame, k: int = K, every: int = 20, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by ``every`` the k nearest that the search finds."""
    rows = store(usable(vectors, zero=False))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    total, width, longest = rows.agg(F.count("*"), F.max(F.size("vec")), F.max(length)).first()
    if not total:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = fit(rows, total, width, longest)
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def to_leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                yield part.assign(leaf=shared.value.assign(_lengthened(matrix(part["vec"], width), longest)))

    assigned = store(rows.mapInPandas(to_leaf, "vec_id long, vec array<double>, leaf long"))
    queries = rows.where(F.col("vec_id") % every == 0)
    visits, _ = calibrate(assigned, queries, tree, k, target, width)
    sizes = {r["leaf"]: r["many"] for r in assigned.groupBy("leaf").agg(F.count("*").alias("many")).collect()}
    group_of = _grouped([sizes.get(leaf, 0) for leaf in range(tree.leaves)])
    held = np.bincount(group_of, weights=[sizes.get(leaf, 0) for leaf in range(tree.leaves)])
    chunks = [max(1, -(-int(n) // CHUNK)) for n in held]

    def to_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for part in batches:
            if not len(part):
                continue
            far = _distances(np.column_stack([matrix(part["vec"], width), np.zeros(len(part))]), own.centres)
            at, groups, leaves = [], [], []
            for i, distances in enumerate(far):
                seen = rows = 0
                visited: dict[int, list[int]] = {}
                for leaf in own.visits(distances):
                    if seen >= visits and rows > k:
                        break
                    seen, rows = seen + 1, rows + sizes.get(leaf, 0)
                    visited.setdefault(group_of[leaf], []).append(leaf)
                at += [i] * len(visited)
                groups += visited
                leaves += visited.values()
                if len(at) >= _HANDED or i == len(far) - 1:
                    yield pd.DataFrame({"group": groups, "vec_id": part["vec_id"].to_numpy()[at],
                                        "vec": part["vec"].to_numpy()[at], "leaves": leaves})
                    at, groups, leaves = [], [], []

    asked = store(queries.mapInPandas(to_groups, "group int, vec_id long, vec array<double>, leaves array<int>"))
    asking = {r["group"]: r["many"] for r in asked.groupBy("group").agg(F.count("*").alias("many")).collect()}
    blocks = [-(-asking.get(group, 0) // QUERY_BLOCK) for group in range(len(chunks))]

    def of_group(numbers: list[int]) -> Column:
        return F.get(F.array(*[F.lit(n) for n in numbers]), F.col("group"))

    def share(many: Column) -> Column:
        return F.pmod(F.xxhash64("vec_id"), many).cast("int")

    def every_one(many: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), many - 1))

    cell = ((F.col("group").cast("long") * max(chunks) + F.col("chunk")) * max(blocks) + F.col("block")).alias("cell")
    cells = (assigned.withColumn("group", F.get(F.array(*[F.lit(g) for g in group_of]), F.col("leaf").cast("int")))
             .where(of_group(blocks) > 0).withColumn("chunk", share(of_group(chunks)))
             .withColumn("block", every_one(of_group(blocks))).select(cell, "vec_id", "vec", "leaf"))
    asked = (asked.withColumn("block", share(of_group(blocks))).withColumn("chunk", every_one(of_group(chunks)))
             .select(cell, "vec_id", "vec", "leaves"))
    return top(search_cells(asked, cells, lambda q, x: _search(q, x, k), "double"), k)
