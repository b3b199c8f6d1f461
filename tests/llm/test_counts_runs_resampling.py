"""Token counts, periodic runs and importance resampling against the library, plain versions, and their defined cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from pulseframe.llm import queries, resample, runs, transducer
from tests.llm.test_operators import DOCS, edge_documents, prose

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def counter():
    return transducer.Transducer(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


# token counts

def hostile_texts(rng, many):
    pieces = [*"abcdeghinorstuETAOIN    .,\n\t0123", "▁", "é", "日", "的", "😀", "\0", "<s>", "</s>", "<0x0A>", "the ", "ing",
              "    ", "aaaa", "====", " ", "́"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(many)]


def test_counts_equal_the_library(counter, library):
    rng = random.Random(1)
    texts = [*hostile_texts(rng, 4000), "", " ", "a", *("a" * n for n in (5, 300, 5000, 9001)), "ab" * 4000, " " * 6000,
             "=" * 7777, "the" * 3000, "\t" * 3000, "日" * 3000, "".join(rng.choice("abcdeACDE") for _ in range(9000)),
             prose(rng, 20_000)]
    assert counter.count(texts).tolist() == [len(t) for t in library.encode(texts, num_threads=1)]
    assert counter.count([]).tolist() == [] and counter.count(["", ""]).tolist() == [0, 0]


def test_a_small_table_is_started_anew_without_changing_counts(library):
    rng = random.Random(2)
    texts = [*hostile_texts(rng, 300), "ab" * 3000, "".join(rng.choice("abcdeACDE") for _ in range(6000))]
    small = transducer.Transducer(MODEL, most_states=200)
    assert small.count(texts).tolist() == [len(t) for t in library.encode(texts, num_threads=1)]


@pytest.mark.parametrize("text", ["ab" * 2500, "x" * 4000, "nonono" * 700 + "x", "=-" * 3000])
def test_chunk_maps_compose_to_the_whole(counter, text):
    codes = counter.of_char[[ord(c) for c in text]]
    state, total = counter.states[counter.intern(counter.start)], 0
    for code in codes.tolist():
        state, certain = counter._run_one(state, code)
        total += certain
    assert counter._long(codes, 0, len(codes), counter.start) == total + state[-1][2]


def test_token_counts_of_documents(spark, library):
    docs = [*edge_documents(), (None, "no id"), (1, "again"), (1, "again")]
    rows = [(d, t, 7) for d, t in docs]
    out = transducer.token_counts(spark.createDataFrame(rows, DOCS + ", n_tokens int"), MODEL, limit=20).collect()
    want = [(d, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 20) for d, t in docs]
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    assert transducer.token_counts(spark.createDataFrame([], DOCS), MODEL).collect() == []


# periodic runs

def plain_runs(words):
    """(start, length, period) of all runs, period by period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and not any(s <= i and j + q <= s + m for s, m, _ in out):
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng, kinds):
    words = []
    while len(words) < rng.randrange(5, 150):
        if rng.random() < 0.5:
            period = [rng.randrange(kinds) for _ in range(rng.randrange(1, 9))]
            words += (period * rng.randrange(1, 9))[:rng.randrange(1, 60)]
        else:
            words.append(rng.randrange(kinds))
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_a_plain_search(seed):
    rng = random.Random(seed)
    for _ in range(150):
        words = repetitive(rng, rng.choice([1, 2, 2, 3, 5]))
        assert runs.runs_of(np.array(words)) == plain_runs(words)


def test_stretches_hold_all_runs_and_keep_texts_apart():
    rng = random.Random(9)
    texts = [[], *(repetitive(rng, 3) for _ in range(40)), [], [1] * 4, [1] * 4]
    index, ends = np.array(sum(texts, [])), np.cumsum([len(t) for t in texts])
    found = {}
    for a, b in runs.stretches(index, ends):
        k = int(np.searchsorted(ends, a, side="right"))
        assert b <= ends[k]
        found.setdefault(k, []).extend((int(a - ends[k] + len(texts[k])) + s, m, q) for s, m, q in runs.runs_of(index[a:b]))
    assert found == {k: plain_runs(t) for k, t in enumerate(texts) if plain_runs(t)} | {k: [] for k in found if not found[k]}


def test_long_repetitions_stay_cheap():
    assert runs.runs_of(np.zeros(100_000, int)) == [(0, 100_000, 1)]
    assert runs.runs_of(np.tile(np.arange(2000), 9)) == [(0, 18_000, 2000)]
    assert runs.runs_of(np.arange(5000)) == [] and runs.runs_of(np.zeros(0, int)) == []


def test_a_grammar_derives_its_sequence():
    ids = repetitive(random.Random(4), 3)
    grammar = runs.Grammar(ids, 3)

    def derive(symbol):
        return [symbol] if symbol < 3 else [w for s in grammar.rules[symbol - 3][:2] for w in derive(s)]

    assert [w for s, _ in grammar.rest for w in derive(s)] == ids
    pairs = Counter(zip([s for s, _ in grammar.rest], [s for s, _ in grammar.rest[1:]]))
    assert all(many == 1 or a == b for (a, b), many in pairs.items())


def plain_op12(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    return (doc_id, len(found), *best, None if not found else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())


def test_op12_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(8)
    docs = edge_documents()[:-1] + [(None, "a b " * 9), (700, "x " * 50), (700, "x " * 50), (701, prose(rng, 700))]
    docs += [(i, " ".join(f"w{w}" for w in repetitive(rng, 4))) for i in range(100, 300)]
    docs += [(i, "\x0b".join(prose(rng, 90).split())) for i in range(300, 360)]
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs) > 10
    spark.createDataFrame([(d, t, 1) for d, t in docs], DOCS + ", runs int").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_periodic_runs(spark, str(tmp_path)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(plain_op12(d, t)) for d, t in docs)
    assert runs.find_runs(spark.createDataFrame([], DOCS)).collect() == []


def test_runs_and_collapsed_text(spark):
    text = "start  " + "a b c " * 5 + "a\nend"
    out = runs.find_runs(spark.createDataFrame([(1, text), (2, None)], DOCS)).orderBy("doc_id").collect()
    assert out[0].collapsed == "start a b c end" and [tuple(r) for r in out[0].runs] == [(1, 16, 3)] and out[0].n_words == 18
    assert out[1].collapsed == "" and out[1].runs == [] and out[1].n_words == 0


# importance resampling

def plain_resample(docs, target, n, buckets=10_000, percent=10, least=20, seed=2024):
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(table))

    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(f for _, x in docs for f in features(x)), Counter(f for x in target for f in features(x))
    a, b = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for doc_id, text in docs:
        f = features(text)
        weight = sum(math.floor(1000 * math.log((t[x] + 1) * a / ((s[x] + 1) * b))) for x in f)
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(words(text)), len(f), weight, score, None])
    fit = sorted((r for r in out if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(fit[:percent * len(fit) // 100], 1):
        r[5] = k
    return sorted(map(str, map(tuple, out)))


@pytest.mark.parametrize("n,head", [(1, 65536), (1, 3), (2, 5), (3, 65536)])
def test_resampling_equals_a_plain_version(spark, n, head):
    rng = random.Random(n)
    docs = [*edge_documents(), (None, prose(rng, 30)), (30, "ÀÉ a1B2 x " * 30), (31, "y" * 200 + " " + prose(rng, 25))]
    docs += [(i, prose(rng, rng.randrange(15, 60)).title()) for i in range(100, 220)]
    docs += [(7, "same words " * 20)] * 30
    target = [prose(rng, 50) + " sigma pi" * 20, None, ""]
    frame = spark.createDataFrame([(d, t, 1.0) for d, t in docs], DOCS + ", score double").repartition(5)
    out = resample.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), n, head=head)
    got = out.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(str, map(tuple, got))) == plain_resample(docs, target, n)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    one = spark.createDataFrame([(1, "a " * 30)], DOCS)
    assert resample.resample(none, one).collect() == []
    row = resample.resample(one, none, percent=100).first()
    assert (row.rank, row.n_features) == (1, 30) and row.weight == 30 * math.floor(
        1000 * math.log(10_030 / (31 * 10_000)))
    with pytest.raises(ValueError):
        resample.resample(one, none, percent=101)


def test_summaries_keep_every_frequent_key():
    summary, rng = resample.Frequent(50), random.Random(3)
    for _ in range(200):
        keys = ["hot", "warm", *(f"w{rng.randrange(5000)}" for _ in range(60))]
        summary.add(keys, [20, 5, *([1] * 60)])
    kept = dict(summary.items())
    assert len(kept) <= 50 and {"hot", "warm"} <= set(kept) and kept["hot"] <= 4000


def test_only_the_head_reaches_the_driver(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("of of the "), F.col("id")).alias("text"))
    words, pairs = resample.head_vocabulary(docs, 2, most=4)
    assert len(words) <= 4 and len(pairs) <= 4 and {"of", "the"} <= set(words) and "of the" in pairs
    assert words["the"] == zlib.crc32(b"the")
