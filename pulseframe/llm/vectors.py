"""What both searches over vectors share: which rows take part, and cells that pair blocks of queries and of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id and ``vec`` (doubles) of the rows that take part.

    Left out: NULL vec_id; vectors that are NULL or hold NULL, NaN or infinite components; without ``zero`` also those of
    length zero, empty ones included. Of rows that share a vec_id, the one with the smallest vector counts.
    """
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vec")).where(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    kept = kept.where(F.coalesce(finite, F.lit(False)))
    if not zero:
        kept = kept.where(F.exists("vec", lambda x: x != 0))
    return kept.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of equal width; a shorter vector counts as ending in zeros."""
    if all(len(v) == width for v in vectors):
        return np.stack(vectors.to_numpy()).astype(np.float64)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def paired(queries: pd.DataFrame, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    width = max(*queries["vec"].map(len), *rows["vec"].map(len))
    return matrix(queries["vec"], width), matrix(rows["vec"], width)


def best_first(query_ids: np.ndarray, at: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """The k highest scores of each query, ties to the smaller vec_id, from hits (query position, vec_id, score)."""
    order = np.lexsort((ids, -scores, at))
    at, ids, scores = at[order], ids[order], scores[order]
    start = np.searchsorted(at, at)
    keep = np.arange(len(at)) - start < k
    return pd.DataFrame({"query_id": query_ids[at[keep]], "vec_id": ids[keep], "score": scores[keep]})


def search_cells(queries: DataFrame, rows: DataFrame, search: Callable, score: str) -> DataFrame:
    """Applies ``search(queries, rows)`` to what shares a ``cell``; both sides have cell, vec_id and vec."""

    def run(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if own.empty or others.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search(own.sort_values("vec_id"), others.sort_values("vec_id"))

    return queries.groupBy("cell").cogroup(rows.groupBy("cell")).applyInPandas(
        run, f"query_id long, vec_id long, score {score}")


def top(hits: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best hits."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
