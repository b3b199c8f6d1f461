"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other. Each has a logistic regression over text features and the probabilities of
all earlier categories. For training, those probabilities are out-of-fold predictions, so a later model learns from
what an earlier one says about texts that it has not seen; scoring uses the models fitted on the whole sample.

Features of a text are its distinct words (letters and digits, A-Z lowered) and their prefixes of 3 to 6 bytes, hashed. A
model keeps the features that speak for its category with a z-score of at least ``Z`` in its training rows, at most
``FEATURES`` of them. A text without any of them gets the model's base rate.

The fit uses at most ``SAMPLE`` labelled rows of each value of the last category, those with the smallest hash of their
doc_id; its memory does not grow with the corpus. Scoring covers every document and its whole text.

Defined cases: NULL and empty texts have no features; labels that are NULL, or of unknown documents, are not used; several
labels of a document count as their maximum; without labelled rows every probability is zero, and a category with one
value only gets that value's clipped rate; repeated rows get equal probabilities; an empty table gives an empty one; other
columns of the documents are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, FOLDS, FEATURES, Z, THRESHOLD = 6000, 4, 1024, 3.5, 0.5
BUCKETS = 1 << 20
#: Lowers A-Z and turns all other ASCII signs but digits into spaces.
_CLEAN = bytes(ord(chr(b).lower()) if chr(b).isalnum() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))
_WORDS = 200_000


class Words(dict):
    """The feature numbers of a word, remembered for up to ``_WORDS`` words at a time."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = {zlib.crc32(b"=" + word) % BUCKETS}
        found |= {zlib.crc32(word[:n]) % BUCKETS for n in range(3, 7) if len(word) >= n}
        if len(self) >= _WORDS:
            self.clear()
        self[word] = out = tuple(found)
        return out


def features(text: str | None, words: Words) -> np.ndarray:
    """The sorted distinct feature numbers of a text."""
    own = set((text or "").encode().translate(_CLEAN).split())
    return np.unique(np.fromiter((i for w in own for i in words[w]), np.int32))


class Linear:
    """Logistic regression over chosen features and dense extra columns."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float):
        self.chosen, self.weights, self.bias = chosen, weights, bias

    @classmethod
    def fit(cls, rows: Sequence[np.ndarray], extra: np.ndarray, target: np.ndarray, steps: int = 120) -> Linear:
        """Nesterov steps on the ridge-penalised log loss."""
        rate = target.mean() if len(target) else 0.0
        if not 0 < rate < 1:
            clipped = np.clip(rate, 1e-3, 1 - 1e-3)
            return cls(np.array([], np.int32), np.zeros(extra.shape[1]), float(np.log(clipped / (1 - clipped))))
        chosen = _speaking_for(rows, target)
        x = np.hstack([_dense(rows, chosen), extra.astype(np.float32)])
        step = 4.0 / max(1.0, float((x * x).sum(axis=1).mean()) + 1)
        w, b = np.zeros(x.shape[1], np.float32), float(np.log(rate / (1 - rate)))
        ahead_w, ahead_b = w, b
        for t in range(steps):
            error = _sigmoid(x @ ahead_w + ahead_b) - target
            new_w = ahead_w - step * ((x.T @ error) / len(x) + 1e-5 * ahead_w).astype(np.float32)
            new_b = ahead_b - step * float(error.mean())
            pull = t / (t + 3)
            ahead_w, ahead_b = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
            w, b = new_w, new_b
        return cls(chosen, w.astype(np.float64), b)

    def predict(self, rows: Sequence[np.ndarray], extra: np.ndarray) -> np.ndarray:
        n = len(self.chosen)
        linear = extra @ self.weights[n:] + self.bias
        if n:
            linear += np.array([self.weights[:n][_places(self.chosen, r)].sum() for r in rows])
        return _sigmoid(linear)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _places(chosen: np.ndarray, row: np.ndarray) -> np.ndarray:
    at = np.searchsorted(chosen, row).clip(0, len(chosen) - 1)
    return at[chosen[at] == row]


def _dense(rows: Sequence[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    x = np.zeros((len(rows), len(chosen)), np.float32)
    if len(chosen):
        for i, row in enumerate(rows):
            x[i, _places(chosen, row)] = 1
    return x


def _speaking_for(rows: Sequence[np.ndarray], target: np.ndarray) -> np.ndarray:
    """The features whose log odds ratio for the target is most clearly above zero."""
    count = np.zeros((2, BUCKETS))
    for row, y in zip(rows, target.astype(int)):
        count[y, row] += 1
    many = np.array([(target == 0).sum(), (target == 1).sum()])[:, None]
    have, lack = count + 0.5, many - count + 0.5
    odds = np.log(have[1] / lack[1]) - np.log(have[0] / lack[0])
    z = odds / np.sqrt((1 / have + 1 / lack).sum(axis=0))
    best = np.argsort(-z, kind="stable")[:FEATURES]
    return np.sort(best[z[best] >= Z]).astype(np.int32)


class Chain:
    """Linear models in the order of their categories."""

    def __init__(self, categories: Sequence[str], models: Sequence[Linear] | None):
        self.categories, self.models = tuple(categories), models

    @classmethod
    def fit(cls, categories: Sequence[str], rows: Sequence[np.ndarray], targets: np.ndarray) -> Chain:
        """``targets`` has a column of 0 and 1 for each category."""
        if not len(rows):
            return cls(categories, None)
        folds, models, known = np.arange(len(rows)) % FOLDS, [], np.zeros((len(rows), 0))
        for j in range(len(categories)):
            y, unseen = targets[:, j].astype(float), np.zeros(len(rows))
            if j + 1 < len(categories):  # the last category feeds no other
                for f in range(FOLDS):
                    out = np.flatnonzero(folds == f)
                    rest = np.flatnonzero(folds != f)
                    model = Linear.fit([rows[i] for i in rest], known[rest], y[rest])
                    unseen[out] = model.predict([rows[i] for i in out], known[out])
            models.append(Linear.fit(rows, known, y))
            known = np.column_stack([known, unseen])
        return cls(categories, models)

    def predict(self, rows: Sequence[np.ndarray]) -> np.ndarray:
        """A column of probabilities for each category."""
        known = np.zeros((len(rows), 0))
        if self.models is None:
            return np.zeros((len(rows), len(self.categories)))
        for model in self.models:
            known = np.column_stack([known, model.predict(rows, known)])
        return known


def fit_chain(docs: DataFrame, targets: DataFrame, categories: Sequence[str], sample: int = SAMPLE) -> Chain:
    """The chain for ``categories``, columns of 0 and 1 in ``targets`` beside doc_id, in this order."""
    last = categories[-1]
    labelled = targets.dropna(subset=["doc_id", *categories]).groupBy("doc_id").agg(
        *[F.max(F.col(c).cast("int")).alias(c) for c in categories])
    # An inner join first: labels of documents that an earlier step removed are not part of the sample.
    labelled = labelled.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = None
    for value in (0, 1):
        part = labelled.where(F.col(last) == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            rows = [features(t.as_py(), words) for t in batch["text"]]
            yield pa.record_batch([batch["doc_id"], pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "features"])

    # At most two times ``sample`` rows: broadcast, so that the documents are not moved.
    chosen = F.broadcast(docs.sparkSession.createDataFrame(chosen.toArrow()))
    picked = docs.select("doc_id", "text").join(chosen.select("doc_id"), "doc_id")
    found = picked.mapInArrow(run, "doc_id long, features array<int>").join(chosen, "doc_id").toArrow()
    order = np.argsort([zlib.crc32(str(i).encode()) for i in found["doc_id"].to_pylist()], kind="stable")
    rows = [np.asarray(found["features"][int(i)].values, np.int32) for i in order]
    table = np.column_stack([found[c].to_numpy() for c in categories])[order] if rows else np.zeros((0, len(categories)))
    return Chain.fit(categories, rows, table)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and the probability of each category, ``p_<category>``."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            table = shared.value.predict([features(t.as_py(), words) for t in batch["text"]])
            yield pa.record_batch([batch["doc_id"], *[pa.array(table[:, j]) for j in range(len(names))]],
                                  ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(["doc_id long", *[f"{n} double" for n in names]]))


def targets_of(labels: DataFrame) -> DataFrame:
    """The categories that the labels table supports: low quality, then toxic."""
    return labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"),
                         (F.col("toxic") == 1).cast("int").alias("toxic"))


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and ``toxic`` for every document."""
    chain = fit_chain(docs, targets_of(labels), ("low_quality", "toxic"))
    return score(docs, chain).withColumn("toxic", F.col("p_toxic") >= threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not toxic, all columns kept. The text is scored where it lies; nothing is joined."""
    chain = fit_chain(docs, targets_of(labels), ("low_quality", "toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            table = shared.value.predict([features(t.as_py(), words) for t in batch["text"]])
            yield batch.filter(pa.array(table[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)
