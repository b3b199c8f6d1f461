"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors become integers, floor(scale * x). A block of rows is an inverted index: every non-zero component is a posting of
its row in the list of its dimension, and its quantised impact is the bit length of its absolute value. Postings of one
impact are the segments of one level, kept for the rows and dimensions that have any. Levels are processed by descending
impact for a block of queries: each adds its products to the scores of its rows. What a row may still gain or lose is at
most |q| times the length of its postings that are not processed yet. Rows whose upper bound lies below the k-th best lower
bound are proven out, and once half of the rows are out for all queries of a block, their accumulators and postings are
passed over. A query stops as soon as few possible members are left, which are then scored exactly; without such proof it
runs through the last level, where the scores are exact themselves. Ties at the last place are never cut before the exact
scores are known.

Every query block meets every row block once, and a block's results are its k best per query. That is not a cross join:
each side is dealt over the cells of a grid, and a cell holds a bounded number of rows whatever their values.

Defined cases: see ``usable`` (a zero vector takes part); shorter vectors count as ending in zeros; a query with fewer
other rows than k gets all of them; an empty table gives an empty result. Scores that could reach 2**53, from where on doubles
are not exact, are an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.shared import store
from pulseframe.llm.vectors import best_first, paired, search_cells, top, usable

K, SCALE = 20, 64
QUERY_BLOCK, ROW_BLOCK = 2048, 8192
#: Queries of a block that are processed together, and possible members at which a query is scored exactly.
_TOGETHER, _FEW = 256, 6


def impact_levels(rows: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """By descending impact: the level's rows, its dimensions, its postings (dimensions by rows), and each row's length of what
    comes after."""
    size = np.abs(rows)
    impact = np.where(size > 0, np.frexp(size)[1], 0)
    levels = []
    for level in np.unique(impact[impact > 0])[::-1]:
        own = impact == level
        has, dims = np.flatnonzero(own.any(axis=1)), np.flatnonzero(own.any(axis=0))
        postings = np.where(own, rows, 0.0)[np.ix_(has, dims)].T.copy()
        later = np.where(impact < level, rows, 0.0)
        levels.append((has, dims, postings, np.sqrt((later * later).sum(axis=1)) * (1 + 1e-12)))
    return levels


def score_at_a_time(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query position, row position, score) of every possible member of each query's k best; ``own[q]`` is left out.

    ``own`` has the position of the query's own row, or -1.
    """
    found: list[tuple[np.ndarray, ...]] = []
    levels = impact_levels(rows)
    length = np.sqrt((queries ** 2).sum(axis=1)) * (1 + 1e-12)
    if len(rows) and len(queries) and length.max() * np.sqrt((rows ** 2).sum(axis=1).max()) >= 2 ** 53:
        raise ValueError("scores of 2**53 and more are not exact: use a smaller scale")
    active, alive = np.arange(len(queries)), np.arange(len(rows))
    scores = np.zeros((len(queries), len(rows)))
    has = np.flatnonzero(own >= 0)
    scores[has, own[has]] = -np.inf
    k = min(k, len(rows))
    for step in range(max(1, len(levels))):
        if levels:
            hit, dims, postings, rest = levels[step]
            place = np.searchsorted(alive, hit)
            in_play = np.flatnonzero((place < len(alive)) & (alive[place.clip(0, len(alive) - 1)] == hit))
            scores[:, place[in_play]] += queries[np.ix_(active, dims)] @ postings[:, in_play]
            slack = length[active][:, None] * rest[alive][None, :]
        else:
            slack = np.zeros_like(scores)
        least = np.partition(scores - slack, len(alive) - k, axis=1)[:, len(alive) - k]
        possible = (scores + slack >= least[:, None]) & np.isfinite(scores)
        last = step >= len(levels) - 1
        done = np.full(len(active), last) | (possible.sum(axis=1) <= _FEW * k)
        if done.any():
            at, row = np.nonzero(possible & done[:, None])
            at, row = active[at], alive[row]
            found.append((at, row, np.einsum("ij,ij->i", queries[at], rows[row])))
        active, scores, possible = active[~done], scores[~done], possible[~done]
        if not len(active):
            break
        # A query's own row stays, so that no query has fewer than k rows in play.
        kept = possible.any(axis=0) | ~np.isfinite(scores).all(axis=0)
        if 2 * kept.sum() < len(alive):
            alive, scores = alive[kept], scores[:, kept]
    return tuple(np.concatenate(c) for c in zip(*found))


def _search(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    q, x = paired(queries, rows)
    query_ids, ids = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
    where = np.searchsorted(ids, query_ids).clip(0, len(ids) - 1)
    own = np.where(ids[where] == query_ids, where, -1)
    parts = []
    for a in range(0, len(q), _TOGETHER):
        at, row, scores = score_at_a_time(q[a:a + _TOGETHER], x, own[a:a + _TOGETHER], k)
        parts.append(best_first(query_ids[a:a + _TOGETHER], at, ids[row], scores.astype(np.int64), k))
    return pd.concat(parts)


def exact_top_k(vectors: DataFrame, k: int = K, every: int = 20, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by ``every`` its k best among all other rows."""
    whole = F.transform("vec", lambda x: F.floor(x * scale).cast("double"))
    rows = store(usable(vectors, zero=True).select("vec_id", whole.alias("vec")))
    queries = rows.where(F.col("vec_id") % every == 0)
    across = max(1, -(-queries.count() // QUERY_BLOCK))
    down = max(1, -(-rows.count() // ROW_BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(down))
    group = F.pmod(F.xxhash64("vec_id"), F.lit(across))
    cells = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).select(
        (F.col("group") * down + block).alias("cell"), "vec_id", "vec")
    asked = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).select(
        (group * down + F.col("block")).alias("cell"), "vec_id", "vec")
    return top(search_cells(asked, cells, lambda q, x: _search(q, x, k), "long"), k)
