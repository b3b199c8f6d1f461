"""The whole pipeline against its stages done plainly, and the chain of classifiers against one written out."""

from __future__ import annotations

import random
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pulseframe.llm import pii, toxicity
from pulseframe.llm.queries import pii_key, with_test_key
from tests.llm import brute
from tests.llm.test_operators import DOCS, prose
from tests.llm.test_pipeline import components_by_search

BAD = "vile horrid nasty awful rotten".split()


def corpus(rng):
    """Documents with toxic ones, common lines, near copies, personal data, and NULLs; labels for some."""
    docs, labels = [], []
    for i in range(160):
        text = "\n".join(" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randrange(12, 40))) for _ in range(3))
        if i % 4 == 0:
            text += "\n" + " ".join(rng.choice(BAD) for _ in range(12))
        labels.append((i, 1, int(i % 4 == 0)))
        docs.append((i, text))
    base = docs[1][1].split()
    changed = [w if k != 7 else "other" for k, w in enumerate(base)]
    docs += [(200, " ".join(changed)), (201, "a line that many documents share with each other\n" + prose(rng, 30)),
             (202, "a line that many documents share with each other\ntail " + prose(rng, 25)),
             (203, "a line that many documents share with each othe"), (204, "call +44 20 7946 0958 or mail a@b.example.com " + prose(rng, 20)),
             (205, None), (206, ""), (207, " ".join(f"v{rng.randrange(9000)}" for _ in range(4000)))]
    return docs, labels


def test_the_pipeline_equals_its_stages_done_plainly(spark, tmp_path):
    docs, labels = corpus(random.Random(21))
    frame = spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in docs], f"{DOCS}, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    marks = toxicity.toxic_documents(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    bad = {r.doc_id for r in marks.where("toxic").collect()}
    assert {i for i in range(160) if i % 4 == 0} == bad
    one = {d: t for d, t in docs if d not in bad}
    two = {d: t for d, t in brute.without_near_lines(sorted(one.items())).items() if t == one[d] or t.strip()}
    assert 203 not in two and two[202].startswith("tail")
    groups = components_by_search([(d, t) for d, t in two.items() if t])
    three = {d: t for d, t in two.items() if groups.get(d, d) == d and (t or d == min(k for k, v in two.items() if not v))}
    assert 200 not in three and 206 not in three and 205 in three
    key = pii_key(with_test_key(spark))
    four = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(list(three.items()), DOCS), key).collect()}
    assert "7946" not in four[204] and "a@b.example" not in four[204]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, lengths = [], Counter()
    for d, t in four.items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((d, k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())))
            lengths[b - a] += 1
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    assert len({r.sequence_id for r in out}) == brute.best_fit(lengths, 2048)


def test_stages_keep_the_columns_of_documents_and_empty_tables(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "pii", "packing"]
    schema = f"{DOCS}, lang string, source string, n_chars long, leads string, n_replaced string, n_lines_removed long, toxic int"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "one two three four five six +44 20 7946 0958", "en", "w", 44, "l", "r", 5, 1), (None, None, None, None, None, None, None, None, None)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() == len(data), name
        assert corpus_pipeline.pack(spark, docs, str(tmp_path)).count() == len(data)


def test_a_line_stage_drops_documents_of_blank_lines_only_if_it_emptied_them(spark):
    docs = [(1, "a line to be repeated in the next one"), (2, "a line to be repeated in the next one\n\n\t\n"), (3, "\n\n")]
    out = corpus_pipeline.line_dedup(spark, spark.createDataFrame(docs, DOCS), "")
    assert {r.doc_id for r in out.collect()} == {1, 3}


def test_a_chain_equals_one_written_out():
    """The second model is trained on what models of other folds say, and scored with the first model of all rows."""
    rng, words = random.Random(2), toxicity.Words()
    texts = [prose(rng, 15) + (" sour" * (i % 3 == 0)) + (" vile" * (i % 5 == 0)) for i in range(240)]
    rows = [toxicity.features(t, words) for t in texts]
    target = np.array([[i % 3 == 0, i % 5 == 0] for i in range(240)], float)
    folds = np.arange(240) % toxicity.FOLDS
    unseen = np.zeros((240, 1))
    for f in range(toxicity.FOLDS):
        inside = [i for i in range(240) if folds[i] != f]
        model = toxicity.Linear.fit([rows[i] for i in inside], np.zeros((len(inside), 0)), target[inside, 0])
        for i in np.flatnonzero(folds == f):
            unseen[i, 0] = model.predict([rows[i]], np.zeros((1, 0)))[0]
    first = toxicity.Linear.fit(rows, np.zeros((240, 0)), target[:, 0])
    second = toxicity.Linear.fit(rows, unseen, target[:, 1])
    p = first.predict(rows, np.zeros((240, 0)))
    want = np.column_stack([p, second.predict(rows, p[:, None])])
    got = toxicity.Chain.fit(("a", "b"), rows, target).predict(rows)
    assert np.allclose(got, want) and ((got > 0.5) == (target > 0.5)).mean() > 0.95


def test_a_linear_model_is_where_its_loss_is_flat():
    rng, words = random.Random(5), toxicity.Words()
    rows = [toxicity.features(prose(rng, 6) + " vile" * (rng.random() < 0.4), words) for _ in range(300)]
    mark = zlib.crc32(b"=vile") % toxicity.BUCKETS
    y = np.array([(mark in r) != (rng.random() < 0.1) for r in rows], float)
    model = toxicity.Linear.fit(rows, np.zeros((300, 0)), y, steps=2000)
    x = np.array([[float(c in r) for c in model.chosen] for r in rows])
    error = 1 / (1 + np.exp(-(x @ model.weights + model.bias))) - y
    assert len(model.chosen) and abs(x.T @ error / 300 + 1e-5 * model.weights).max() < 1e-3 and abs(error.mean()) < 1e-3


def test_very_long_documents_pass_toxicity(spark):
    text = "word " * 200_000
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, text), (2, text + " vile"), (3, None)], DOCS)
    assert toxicity.drop_toxic(docs, labels).count() + toxicity.toxic_documents(docs, labels).where(F.col("toxic")).count() == 3
