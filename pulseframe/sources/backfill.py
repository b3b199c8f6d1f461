"""History into the store, chunk by chunk, from where an earlier run stopped.

The unit is a metric's 90-day chunk.  The version that puts a chunk's samples into force also
names it as done, so a run that dies leaves each chunk either stored and done, or neither.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.time import backfill_chunk
from . import manifest, tables


def finished(spark: SparkSession, root: str, name: str = "backfill") -> set[tuple[str, int]]:
    """The (metric, chunk) pairs that have been loaded."""
    entry = manifest.current(spark, root, directories=False)
    return {(m, c) for m, c in (entry.settings.get(name) or [])} if entry else set()


def run_backfill(spark: SparkSession, root: str, history: DataFrame, at_once: int = 1, name: str = "backfill",
                 most: int | None = None) -> list[tuple[str, int]]:
    """Load the chunks of `history` that are not done yet, oldest first, `at_once` to a version; the pairs loaded.

    A key that is stored already stays as it is.  Metrics and chunks are few (some hundred pairs
    for ten years), so the driver goes through them; `most` ends a run after as many versions.
    """
    rows = history.withColumn("_chunk", backfill_chunk("started_at"))
    found = {(r["metric_type"], r["_chunk"]) for r in rows.select("metric_type", "_chunk").distinct().collect()
             if r["metric_type"] is not None and r["_chunk"] is not None}
    todo = sorted({c for _, c in found - finished(spark, root, name)})
    loaded: list[tuple[str, int]] = []
    for i in range(0, len(todo), at_once)[:most]:
        pairs = sorted(p for p in found - finished(spark, root, name) if p[1] in todo[i:i + at_once])
        wanted = F.struct("metric_type", "_chunk").isin(*[F.struct(F.lit(m), F.lit(c).cast("bigint")) for m, c in pairs])
        delivery = tables.Delivery(spark, root, rows.filter(F.col("_chunk").between(todo[i], max(todo[i:i + at_once])) & wanted),
                                   tables.FIRST)

        def build(entry: manifest.Version) -> manifest.Change:
            done = sorted({tuple(p) for p in entry.settings.get(name) or []} | set(pairs))
            change = delivery.change(entry)
            return replace(change, settings={**change.settings, name: [list(p) for p in done]})

        manifest.transact(spark, root, build)
        loaded += pairs
    return loaded
