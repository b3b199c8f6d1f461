"""Stages of the pipeline on small tables with planted cases."""

from __future__ import annotations

import random
from functools import cache

import numpy as np
import pytest

import corpus_pipeline
from pulseframe.llm import near, simhash

DOCS = "doc_id long, text string, lang string"


@cache
def shingles(text):
    return frozenset(zip(*[text.lower().split()[i:] for i in range(5)]))


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def planted(rng, groups, copies):
    """Originals and copies with a few changed words, at similarities from 0.8 to 0.95, and others below 0.8."""
    docs, ids = [], iter(range(10_000))
    for _ in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        docs.append((next(ids), " ".join(words)))
        for changes in [1, 2, 3, 4, 6, 9][:copies]:
            changed = list(words)
            for at in rng.sample(range(5, 195, 9), changes):
                changed[at] = "new"
            docs.append((next(ids), " ".join(changed)))
    return docs


def components_by_search(docs):
    root = {d: d for d, _ in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(docs):
        for b, y in docs[:i]:
            if find(a) != find(b) and similarity(x, y) >= 0.8:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d in root}


def test_near_dedup_removes_copies_of_similarity_from_080(spark):
    docs = planted(random.Random(4), 12, 6)
    alike = [similarity(docs[0][1], t) for _, t in docs[1:7]]
    assert any(0.8 <= s < 0.85 for s in alike) and any(0.9 <= s < 0.96 for s in alike) and any(s < 0.8 for s in alike)
    rows = [(d, t, "en") for d, t in docs] + [(None, docs[0][1], "en")]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert {r.doc_id for r in out} == set(components_by_search(docs).values()) | {None}


def test_a_crowd_of_near_copies_is_one_component(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(150)]
    docs = [(i, " ".join(w if k != at else f"x{i}" for k, w in enumerate(words)))
            for i in range(60) for at in [rng.randrange(150)]]
    out = near.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), block=4).collect()
    assert {r.component_id for r in out} == {0} and len(out) == 60
    assert near.near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("block", [near.BLOCK, 16])
def test_pairs_on_one_template_are_all_found(spark, block):
    """200 documents on one long template: 100 pairs of similarity 0.81, all others just below 0.8."""
    rng = random.Random(12)
    template = [f"t{i}" for i in range(1500)]
    docs = []
    for pair in range(100):
        words = list(template)
        for at in rng.sample(range(1500), 8):
            words[at] = f"p{pair}x{at}"
        for one in range(2):
            own = list(words)
            for at in rng.sample(range(1500), 14):
                own[at] = f"d{pair}y{one}x{at}"
            docs.append((len(docs), " ".join(own)))
    inner, outer = similarity(docs[0][1], docs[1][1]), similarity(docs[0][1], docs[2][1])
    assert 0.72 < outer < 0.79 and 0.8 <= inner < 0.85
    out = near.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), block=block).collect()
    want = components_by_search(docs)
    assert len(set(want.values())) > 90 and {r.doc_id: r.component_id for r in out} == want


@pytest.mark.parametrize("seed,block", [(1, 2), (2, 12)])
def test_crowds_equal_a_plain_search(spark, seed, block):
    """Several templates and templates of templates, copies at all distances, and small blocks."""
    rng, docs = random.Random(seed), []
    base = [f"t{i}" for i in range(120)]
    for branch in range(3):
        stem = list(base)
        for at in rng.sample(range(120), 3 * branch):
            stem[at] = f"b{branch}"
        for leaf in range(4):
            twig = list(stem)
            for at in rng.sample(range(120), 2 * leaf):
                twig[at] = f"b{branch}l{leaf}"
            for _ in range(9):
                own = list(twig)
                for at in rng.sample(range(120), rng.randrange(5)):
                    own[at] = f"w{rng.randrange(40)}"
                docs.append((len(docs), " ".join(own)))
    rng.shuffle(docs)
    frame = spark.createDataFrame([(d, t) for d, t in docs], "node long, text string")
    links = near.crowd_links(near._sets(frame.selectExpr("cast(cast(node as string) as binary) as node", "text")).selectExpr(
        "1L as crowd", "node", "hashes"), block=block)
    text = dict(docs)
    plain = {d: d for d in text}

    def find(d):
        while plain[d] != d:
            d = plain[d]
        return d

    for r in links.collect():
        p, q = sorted((find(int(r.a)), find(int(r.b))))
        plain[q] = p
    assert {d: find(d) for d in text} == components_by_search(sorted(docs))


def test_a_block_links_what_is_alike():
    rng = random.Random(4)
    sets = [np.unique([rng.randrange(60) for _ in range(rng.randrange(1, 60))]) for _ in range(80)]
    sets += [np.append(sets[k][1:], 1000 + k) for k in range(40)]
    found = dict(near.linked_nodes(sets, np.array([4.0 * len(x) for x in sets]), 0))
    plain = list(range(len(sets)))
    for _ in sets:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.8:
                    plain[i] = min(plain[i], plain[j])
    assert [found.get(i, i) for i in range(len(sets))] == plain


def test_documents_are_pairs_of_id_and_text(spark):
    """Repeated ids with other texts, repeated rows, clashing columns, long and empty texts, and none."""
    rng = random.Random(3)
    a, b, c = (" ".join(f"{k}{rng.randrange(999)}" for _ in range(40)) for k in "abc")
    long = " ".join(f"l{rng.randrange(10**6)}" for _ in range(60_000))
    rows = [(1, a, 0, "x"), (2, a, 0, "x"), (2, b, 0, "y"), (3, c, 0, "z"), (3, c, 0, "z"), (4, long, 0, "x"), (5, long + " end", 0, ""),
            (6, None, 0, ""), (7, "", 0, ""), (8, " \n", 0, ""), (None, a, 0, "n"), (None, None, 0, "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, component_id int, th string")
    out = corpus_pipeline.near_dedup(spark, frame, "")
    assert out.columns == frame.columns
    got = sorted((str(r.doc_id), (r.text or "")[:3]) for r in out.collect())
    assert got == sorted([("1", a[:3]), ("2", b[:3]), ("3", c[:3]), ("4", long[:3]), ("6", ""), ("None", a[:3]), ("None", "")])


def test_near_dedup_has_the_links_of_fingerprints(spark):
    """Documents within two bits of each other are near copies, also where their sets of shingles are not; groups reach across
    both kinds of links."""
    rng = random.Random(3)
    phrase, other = ([f"{p}{i}" for i in range(40)] for p in "pq")
    # Much of the same over and over, and a few words of their own: repeats count in fingerprints, not in sets.
    texts = [" ".join(phrase * 30 + [f"d{d}w{k}" for k in range(24)]) for d in range(2)]
    # A near copy by shingles of the second, but with a fingerprint of its own.
    texts.append(" ".join(phrase * 3 + [f"d1w{k}" for k in range(24)]))
    texts.append(" ".join(other))
    texts += [" ".join(f"w{rng.randrange(5000)}" for _ in range(100)) for _ in range(3)]
    apart = [[(simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() for b in texts] for a in texts]
    assert apart[0][1] <= 2 and similarity(texts[0], texts[1]) < 0.8
    assert min(apart[0][2], apart[1][2]) > 2 and similarity(texts[1], texts[2]) >= 0.8 > similarity(texts[0], texts[2])
    rows = [(d, t, "en") for d, t in enumerate(texts)] + [(None, texts[0], "en"), (7, texts[3], "en"), (7, texts[0], "en"), (3, texts[3], "en")]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((r.doc_id, r.text) for r in out if r.doc_id is not None) == [(d, texts[d]) for d in (0, 3, 4, 5, 6)]
    assert sum(r.doc_id is None for r in out) == 1
