"""Operators against plain versions, and the cases that their docstrings define."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulseframe.llm import ann, bpe, chat, components, lines, packing, pii, simhash, suffixes, topk, toxicity
from tests.llm import brute

DOCS = "doc_id long, text string"
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "alpha beta gamma delta épée tau rho sigma pi mu nu xi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edge_documents():
    """NULLs, empty and blank texts, ties, repeated rows, and one long text."""
    rng = random.Random(5)
    base = [prose(rng, 40) for _ in range(6)]
    docs = [(i, t) for i, t in enumerate(base)]
    docs += [(10, base[0]), (11, base[1] + " more"), (12, base[2].replace("alpha", "ALPHA")), (13, None), (14, ""),
             (15, "   \n\t "), (16, prose(rng, 30) + "\n" + base[3] + "\n" + prose(rng, 30)), (17, "one"), (18, "one two"),
             (19, prose(rng, 5000))]
    return docs


# line de-duplication

def line_documents(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abc é") for _ in range(rng.choice([1, 2, rng.randint(3, 18), rng.randint(18, 26)])))
            for _ in range(25)]

    def changed(line):
        at = rng.randrange(len(line))
        return rng.choice([line, line[:at] + line[at + 1:], line[:at] + "z" + line[at:], line[:at] + "y" + line[at + 1:]])

    docs = [(i, "\n".join(changed(rng.choice(pool)) for _ in range(rng.randint(0, 8)))) for i in range(40)]
    long = "".join(rng.choice("abc") for _ in range(30_000))
    return docs + [(50, None), (51, ""), (52, "\n\n"), (53, "\n".join("a" * n for n in range(24, 16, -1))), (54, " \n \n\t"),
                   (55, f"{long}\nx"), (56, f"x\n{long[:9]}{long[10:]}"), (57, long + long)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_equal_a_plain_search(spark, seed):
    docs = line_documents(seed)
    out = lines.dedup_documents(spark.createDataFrame(docs, DOCS))
    assert {r.doc_id: r.text for r in out.collect()} == brute.without_near_lines(docs)


def test_deletion_keys_are_those_of_the_shorter_line():
    for line in ("abcdé", "x", "aaaa", "日本語テキスト"):
        without, own = lines.deletion_keys(line)
        for i, key in enumerate(without.tolist()):
            rest = line[:i] + line[i + 1:]
            assert not rest or key == lines.deletion_keys(rest)[1]
        assert own == lines.deletion_keys(line)[1]


def test_lines_without_ids_repeated_rows_and_other_columns(spark):
    line = "a line that is long enough to count"
    rows = [(None, line, "x"), (1, line, "y"), (1, line, "y"), (2, "head\n" + line, "z"), (2, line + "!", "w")]
    out = lines.dedup_documents(spark.createDataFrame(rows, "doc_id long, text string, line string"))
    got = sorted((str(r.doc_id), r.text, r.line, r.n_lines_removed) for r in out.collect())
    assert got == sorted([("None", line, "x", 0), ("1", line, "y", 0), ("1", line, "y", 0), ("2", "head", "z", 1),
                          ("2", "", "w", 1)])
    assert lines.dedup_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_a_crowd_of_neighbours_is_reduced_to_the_earliest(spark):
    text = "the same line in many hands, but for one character: "
    docs = [(i, text + chr(0x4E00 + i)) for i in range(300)]
    out = {r.doc_id: r.text for r in lines.dedup_documents(spark.createDataFrame(docs, DOCS)).collect()}
    assert out[0] == docs[0][1] and all(out[i] == "" for i in range(1, 300))


def test_equal_lines_of_any_length_are_reduced_to_the_earliest(spark):
    rows = [(1, "Les.\n\nAnd ornd.\n \u3000"), (2, "Les.\n\nLes!\n \u3000\n日本\n日本"), (3, "And ornd."),
            (4, "x" * 19 + "\n" + "x" * 18), (5, "x" * 19 + "\n" + "x" * 20 + "\n" + "x" * 21)]
    out = {r.doc_id: (r.text, r.n_lines_removed) for r in lines.dedup_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {1: (rows[0][1], 0), 2: ("\nLes!\n \u3000\n日本", 2), 3: ("", 1), 4: (rows[3][1], 0), 5: ("x" * 20, 2)}


# SimHash

def test_masks_cover_all_pairs_of_positions():
    masks = [m % (1 << 64) for m in simhash.masks()]
    assert len(masks) == 7
    for i in range(64):
        for j in range(i):
            assert any(not m & (1 << i | 1 << j) for m in masks)


@pytest.mark.parametrize("small", [0, 2, 8])
def test_links_equal_a_plain_search(spark, small):
    rng = random.Random(9)
    prints = {0, -1, 1 << 62}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            x = centre
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            prints.add(x - (1 << 64) if x >> 63 else x)
    prints = sorted(prints)
    links = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp long"), small)
    found = {r.node: r.component for r in components.components(links).collect()}
    wanted = brute.components(prints, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    assert {p: found.get(p, p) for p in prints} == wanted


def test_near_duplicates_equal_a_plain_search(spark):
    docs = edge_documents()
    out = simhash.near_duplicates(spark.createDataFrame(docs + docs[:1], DOCS).withColumn("fp", F.lit("other"))).collect()
    assert len(out) == len(docs) + 1
    prints = {d: brute.fingerprint(t) for d, t in docs}
    assert {r.doc_id: r.fingerprint for r in out} == {d: f"{p:016x}" for d, p in prints.items()}
    wanted = brute.components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {r.doc_id: r.component_id for r in out} == wanted
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_fingerprints_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40).collect()
    for d in docs:
        assert simhash.fingerprint(d.text) == brute.fingerprint(d.text)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 500), (600, 601)], "a long, b long")
    found = {r.node: r.component for r in components.components(links).collect()}
    assert found == {**{i: 0 for i in range(201)}, 600: 600, 601: 600}


# toxicity

def labelled(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        junk = i % 7 == 0
        words = [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(rng.randint(5, 60))]
        if toxic:
            words[rng.randrange(len(words))] = "vile" + rng.choice("abcdefghijklm") + rng.choice("nopqrstuv")
        if junk:
            words[rng.randrange(len(words))] += "@@ click"
        docs.append((i, " ".join(words)))
        labels.append((i, 0 if junk else 1, 1 if toxic else 0))
    return docs, labels


def test_toxicity_on_documents_that_the_chain_has_not_seen(spark):
    docs, labels = labelled(900, 4)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = table.where("doc_id < 600").unionByName(spark.createDataFrame([(None, 1, 1), (3, None, 1), (9999, 0, 1)],
                                                                        "doc_id long, quality int, toxic int"))
    rows = spark.createDataFrame(docs + [(5000, None), (5001, "")], DOCS).withColumn("toxic", F.lit(0))
    out = {r.doc_id: r for r in toxicity.toxic_documents(rows, seen).collect()}
    unseen = [x for x in labels if x[0] >= 600]
    wrong = sum(out[i].toxic != bool(t) for i, _, t in unseen)
    assert wrong <= 0.02 * len(unseen)
    assert sum((out[i].p_low_quality > 0.5) != (q == 0) for i, q, _ in unseen) <= 0.05 * len(unseen)
    assert not out[5000].toxic and not out[5001].toxic
    kept = {r.doc_id for r in toxicity.drop_toxic(rows, seen).collect()}
    assert kept == {i for i, r in out.items() if not r.toxic}


def test_toxicity_without_labels_and_without_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.toxic_documents(spark.createDataFrame([(1, "a b c"), (1, "a b c")], DOCS), none).collect()
    assert [(r.p_low_quality, r.p_toxic, r.toxic) for r in out] == [(0.0, 0.0, False)] * 2
    assert toxicity.toxic_documents(spark.createDataFrame([], DOCS), none).collect() == []
    clean = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert not toxicity.toxic_documents(spark.createDataFrame([(1, "a b c")], DOCS), clean).first().toxic


def test_a_later_model_learns_from_out_of_fold_predictions():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, 8)).astype(np.int32) for _ in range(400)]
    first = np.array([7 in r for r in rows], float)
    chain = toxicity.Chain.fit(("first", "second"), rows, np.column_stack([first, first]))
    assert len(chain.models[1].weights) == len(chain.models[1].chosen) + 1
    assert ((chain.predict(rows)[:, 1] > 0.5) == (first > 0)).mean() > 0.98


# chat formatting

def test_examples_hold_every_reply_once_with_all_turns_before(spark):
    rows = [(1, 0, "system", "be <|end|> kind\\"), (1, 1, "user", "<<SYS>> [INST]"), (1, 2, "assistant", "a</s>"),
            (1, 3, "assistant", "\\<\\["), (1, 4, "user", None), (2, 0, "user", "only"), (3, 0, None, ""),
            (None, 0, "assistant", "x"), (4, 5, "assistant", "same"), (4, 5, "assistant", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("spans", F.lit(1))
    formatted = chat.format_conversations(turns)
    examples = chat.expand_examples(formatted)
    by = {}
    for r in examples.orderBy("conv_id", "example").collect():
        by.setdefault(r.conv_id, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {1: 3, 2: 1, 3: 1, None: 1, 4: 2}
    whole = {r.conv_id: r.formatted for r in formatted.collect()}
    for conv, found in by.items():
        assert all(whole[conv].startswith(r.text) for r in found) and found[-1].text == whole[conv] and found[-1].last
    for mark in ("</s>", "[INST]", "<<SYS>>"):
        assert mark not in whole[1]
    out = {r.conv_id: r for r in chat.digests(examples).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    turns = [(r or "", t or "") for c, _, r, t in rows if c == 1]
    assert out[1].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns)) and out[1].n_turns == 5
    assert out[1].loss_sha256 == sha("a</s>\\<\\[") and out[1].loss_chars == 9
    assert out[2].loss_chars == 0 and out[4].loss_sha256 == sha("samesame") and out[None].loss_chars == 1
    assert out[3].turns_sha256 == sha("\n\n")
    assert chat.digests(chat.expand_examples(chat.format_conversations(
        spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).collect() == []


# searches

def vector_rows(seed, n=150, dims=6):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=dims))]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(60)]  # a crowd of equal vectors
    return rows


BAD = [(900, None), (920, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (940, [float("nan")] * 6), (960, [float("inf")] * 6), (980, []),
       (None, [1.0] * 6), (20, [9.0] * 6)]
VECTORS = "vec_id long, embedding array<float>"


def test_exact_search_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rows = vector_rows(2)
    rows[5] = (5, [0.0] * 6)
    out = topk.exact_top_k(spark.createDataFrame(rows + BAD + rows[:3], VECTORS).withColumn("score", F.lit(1)))
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in [*rows, (980, [])]}
    wanted = brute.top_k(whole, 20, 20, lambda a, b: sum(x * y for x, y in zip(a, b)))
    assert sorted(map(tuple, out.collect())) == sorted(wanted)


def test_scores_that_doubles_cannot_hold_are_an_error():
    rows = np.array([[2.0 ** 27, 1.0], [2.0 ** 26, 3.0]])
    with pytest.raises(ValueError):
        topk.score_at_a_time(rows, rows, np.arange(2), 1)
    assert len(topk.score_at_a_time(rows[:1] / 4, rows / 4, np.array([0]), 1)[0])


def test_segments_hold_the_postings_of_their_rows_only():
    rows = np.array([[0.0, 9.0, 0.0], [1.0, 0.0, 0.0], [0.0, -8.0, 1.0]])
    levels = topk.impact_levels(rows)
    assert [(h.tolist(), d.tolist(), p.tolist()) for h, d, p, _ in levels] == [
        ([0, 2], [1], [[9.0, -8.0]]), ([1, 2], [0, 2], [[1.0, 0.0], [0.0, 1.0]])]


def test_impact_levels_stop_early_and_lose_nothing():
    rng = np.random.default_rng(3)
    rows = np.floor(64 * rng.normal(size=(3000, 16)) ** 5)
    queries = rows[:40]
    at, row, scores = topk.score_at_a_time(queries, rows, np.arange(40), 5)
    full = queries @ rows.T
    full[np.arange(40), np.arange(40)] = -np.inf
    for q in range(40):
        best = set(np.flatnonzero(full[q] >= np.sort(full[q])[-5]))
        assert best <= set(row[at == q])
        assert (scores[at == q] == full[q, row[at == q]]).all()
    assert len(at) < 40 * 3000 / 4


@pytest.mark.parametrize("query_block", [10, 2048])
def test_tree_search_scores_exactly_and_reaches_its_recall(spark, monkeypatch, query_block):
    monkeypatch.setattr(ann, "PER_LEAF", 20)
    monkeypatch.setattr(ann, "CHUNK", 32)
    monkeypatch.setattr(ann, "QUERY_BLOCK", query_block)
    monkeypatch.setattr(ann, "_HANDED", 8)
    rows = vector_rows(6, n=1500)
    bad = [*BAD, (1000000, [0.0] * 6)]
    found = ann.nearest(spark.createDataFrame(rows + bad, VECTORS).withColumn("leaf", F.lit(1))).collect()
    exact = dict(rows)
    score = lambda a, b: float(np.add.accumulate(np.array(a) * np.array(b))[-1])
    wanted = brute.top_k(exact, 20, 20, score)
    assert len(found) == len(wanted)
    assert all(r.score == score(exact[r.query_id], exact[r.vec_id]) for r in found)
    hits = {(r.query_id, r.vec_id) for r in found}
    assert np.mean([(q, v) in hits for q, _, v, _ in wanted]) >= 0.9
    assert sorted((r.query_id, r["rank"]) for r in found) == sorted((q, k) for q, k, _, _ in wanted)


def test_searches_with_few_rows_and_with_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (40, [1.0, 2.0])], VECTORS)
    for search in (topk.exact_top_k, ann.nearest):
        got = [(r.query_id, r["rank"], r.vec_id) for r in search(few).orderBy("query_id", "rank").collect()]
        assert got == [(0, 1, 40), (0, 2, 1), (40, 1, 0), (40, 2, 1)]
        assert search(spark.createDataFrame([], VECTORS)).collect() == []
        assert search(spark.createDataFrame([(1, [1.0]), (0, None)], VECTORS)).collect() == []


# repeated byte strings

def repeat_documents(seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abé ") for _ in range(rng.randint(3, 40))) for _ in range(12)]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    return docs + [(70, None), (71, ""), (72, "aaaa" * 30), (73, docs[4][1]), (74, "ab" * 90)]


@pytest.mark.parametrize("seed,length,hot", [(1, 8, ""), (2, 30, ""), (3, 30, "all"), (4, 100, ""), (5, 8, "late")])
def test_repeats_equal_a_plain_search(spark, monkeypatch, seed, length, hot):
    if hot == "late":  # anchors that the sample did not show, but their runs do
        monkeypatch.setattr(suffixes, "MOST_RUNS", 3)
    if hot == "all":
        grams = lambda d, n: suffixes.runs(d, n).select("gram").distinct().toPandas()["gram"].to_numpy()
        monkeypatch.setattr(suffixes, "hot_anchors", grams)
    docs = repeat_documents(seed)
    out = suffixes.remove_repeats(spark.createDataFrame(docs, DOCS).withColumn("start", F.lit(1)), length)
    out = out.select("doc_id", "n_bytes", suffixes.span_bytes(F.col("spans")), F.size("spans"), F.sha2("kept", 256))
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == brute.removed_bytes(docs, length)


def test_repeats_across_buffers_and_of_tied_rows(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_BUFFER", 150)
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh") for _ in range(2000))
    docs = [(1, text), (2, "xyz" + text[500:1500]), (3, text[700:])]
    out = suffixes.remove_repeats(spark.createDataFrame(docs, DOCS), 100)
    got = {r.doc_id: hashlib.sha256(r.kept).hexdigest() for r in out.collect()}
    assert got == {d: x[3] for d, x in brute.removed_bytes(docs, 100).items()}
    tied = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], DOCS)
    got = sorted((str(r.doc_id), len(r.kept)) for r in suffixes.remove_repeats(tied, 100).collect())
    assert got == [("1", 2000), ("1", 2000), ("2", 0), ("None", 2000)]
    assert suffixes.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


# personal data

KEY = "k"


def masked(spark, *texts):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, _pieces int")
    return [(r.text, r.n_replaced) for r in pii.pseudonymise(docs, KEY).orderBy("doc_id").collect()]


def test_numbers_keep_their_format_and_can_be_undone(spark):
    card, spaced = "4111111111111111", "4111 1111 1111 1111"
    out = masked(spark, f"a {card} b", f"{spaced}, {card}", "+1 (974) 555-3436", "10.0.0.255 and 1.2.3", "078-05-1120")
    new = out[0][0][2:-2]
    assert new != card and len(new) == 16 and brute.luhn(new)
    assert out[1][0].replace(" ", "") == f"{new},{new}" and out[1][0][4] == " " and out[1][1] == 2
    x, y = brute.undo_feistel(KEY, "card15", int(new[:7]), int(new[7:15]), 10 ** 7, 10 ** 8)
    assert f"{x:07d}{y:08d}" == card[:15]
    assert out[2][0].startswith("+1 (") and out[2][0][7:9] == ") " and out[2][0] != "+1 (974) 555-3436"
    octets, rest = out[3][0].split(" ", 1)
    assert rest == "and 1.2.3" and all(0 <= int(o) <= 255 for o in octets.split("."))
    x, y = brute.feistel(KEY, "address", 10 * 256, 255, 65536, 65536)
    assert octets == f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    area, group, serial = map(int, out[4][0].split("-"))
    assert area not in (0, 666) and area < 900 and group and serial


def test_dates_become_dates_and_what_is_not_valid_stays(spark):
    import datetime as dt

    left = ["4111111111111112", "2024-02-30", "300.1.1.1", "nothing here", "", "31.13.2001", "12345678901234567890123"]
    out = masked(spark, "2024-02-29", "29/02/2024", "29.02.2024", *left)
    iso, slash, dots = (o[0] for o in out[:3])
    assert iso != "2024-02-29" and 1800 <= dt.date.fromisoformat(iso).year < 2200
    assert slash == "/".join(reversed(iso.split("-"))) and dots == slash.replace("/", ".")
    day = (dt.date(2024, 2, 29) - dt.date(1800, 1, 1)).days
    x, y = brute.feistel(KEY, "date", day // 5411, day % 5411, 27, 5411)
    assert dt.date.fromisoformat(iso) == dt.date(1800, 1, 1) + dt.timedelta(x * 5411 + y)
    assert [o for o in out[3:]] == [(t, 0) for t in left]


def test_addresses_secrets_and_null_text(spark):
    mail, secret = "die.55@mail4.example.com", "cf1d64a9a4cd9723e1f4eafc27395915e6868ffa"
    out = masked(spark, f"x {mail}, {mail.upper()}.", f'token = "{secret}" der', None, f"no name: {secret}")
    assert mail not in out[0][0] and out[0][1] == 2
    one, two = out[0][0][2:-1].split(", ")
    assert one == two and one.endswith(".invalid")
    assert secret not in out[1][0] and len(out[1][0]) == len(f'token = "{secret}" der') and out[1][1] == 1
    assert out[2] == (None, 0) and out[3] == (f"no name: {secret}", 0)
    with pytest.raises(ValueError):
        pii.pseudonymise(spark.createDataFrame([], DOCS), "")
    assert pii.pseudonymise(spark.createDataFrame([], DOCS), KEY).collect() == []


def test_a_feistel_network_is_a_permutation(spark):
    grid = spark.range(7 * 12).select(F.floor(F.col("id") / 12).alias("l"), (F.col("id") % 12).alias("r"))
    out = grid.select(pii.feistel(F.lit(KEY), F.lit("x"), F.col("l"), F.col("r"), F.lit(7).cast("long"),
                                  F.lit(12).cast("long")).alias("p")).select("p.*").collect()
    assert {tuple(r) for r in out} == {(a, b) for a in range(7) for b in range(12)}


def test_no_python_in_the_plan(spark):
    plan = pii.pseudonymise(spark.createDataFrame([(1, "a")], DOCS), KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# tokenizers and packing

def tricky_texts(n=400):
    rng = random.Random(3)
    signs = "abé ß\n\t  '.!1²ñthe  \x1c日本  "
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)] + [
        "ab" * 3000, " ", "", "I'll don't 'S <|endoftext|>", "x" * 500 + " " * 300]


def test_encoding_equals_the_library(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = tricky_texts()
    rows = [*enumerate(texts), (9000, None), (9000, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit(0))
    ids = {r.doc_id: r.ids for r in bpe.encode_documents(docs, MULTI, public_tokenizers.PATTERN).collect()}
    out = {r.doc_id: r for r in bpe.encoding_digests(docs, MULTI, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        wanted = library.encode_ordinary(t or "")
        assert ids[i] == wanted and out[i].n_tokens == len(wanted)
        assert out[i].ids_sha256 == hashlib.sha256(",".join(map(str, wanted)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encoding_digests(spark.createDataFrame([], DOCS), MULTI, public_tokenizers.PATTERN).collect() == []


def test_pretokens_that_share_a_queue_are_merged_each_in_its_own_order(monkeypatch):
    """Ranks in no order: what a merge makes may have a lower rank than the merge itself."""
    monkeypatch.setattr(bpe, "_TOGETHER", 300)
    for seed in range(40):
        rng = random.Random(seed)
        tokens = [bytes([b]) for b in b"abcd"] + sorted({bytes(rng.choices(b"abcd", k=rng.randint(2, 5))) for _ in range(60)})
        rng.shuffle(tokens)
        ranks = {t: 7 * i for i, t in enumerate(tokens)}
        codec = bpe.Codec(ranks, ".")

        def plain(data):
            parts = [data[i:i + 1] for i in range(len(data))]
            while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
                i = min(pairs)[1]
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            return [ranks[data]] if data in ranks else [ranks[p] for p in parts]

        words = [bytes(rng.choices(b"abcd", k=rng.randint(0, 60))) for _ in range(80)] + [b"abcd" * 100]
        assert list(codec.encode_pretokens(words)) == [plain(w) for w in words]
        assert codec.encode_pretoken(words[-1]) == plain(words[-1])
    with pytest.raises(KeyError):
        list(codec.encode_pretokens([b"ab", b"axb"]))


def test_pieces_have_the_ids_of_the_library(spark):
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    rows = [*enumerate(tricky_texts()), (9000, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("length", F.lit(0))
    pieces = packing.tokenise(docs, JSON, size=64).orderBy("doc_id", "piece").collect()
    found = {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert p.start == len(found.setdefault(p.doc_id, [])) and p.length == len(ids) <= 64
        assert p.piece == 0 or p.length == 64
        assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        found[p.doc_id] += ids
    assert found == {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}


def test_added_tokens_have_the_ids_of_the_library_as_it_is(spark):
    library, end = Tokenizer.from_file(JSON), "<|endoftext|>"
    rng = random.Random(8)
    texts = [f"hi {end} there", end, end * 3, f"a  {end}  b", f"a\n{end}\n b", f"x{end}y {end}. {end[:-1]} {end[1:]}"] + [
        "".join(rng.choice([end, *"ab é\n.'1 "]) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    docs = spark.createDataFrame([*enumerate(texts)], DOCS)
    wanted = {i: library.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert 50256 in wanted[0]
    out = packing.pack_documents(docs, JSON).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in out} == {
        i: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in wanted.items()}


@pytest.mark.parametrize("size", [10, 64, 2048])
def test_runs_fill_sequences_without_gaps(size):
    rng = random.Random(size)
    for _ in range(40):
        counts = {rng.randint(1, size): rng.randint(1, 60) for _ in range(rng.randint(0, 50))}
        ranks, filled = {}, {}
        for length, first, many, sequence, offset in packing.plan_runs(counts, size).tolist():
            for k in range(many):
                ranks.setdefault(length, []).append(first + k)
                filled.setdefault(sequence + k, []).append((offset, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
        for held in filled.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= size
        assert len(filled) <= 1.02 * brute.best_fit(counts, size) + 1


def test_packing_places_every_piece_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "_PER_SALT", 10)
    rng = random.Random(1)
    docs = [(i, prose(rng, rng.choice([1, 1, 1, 30, 400, 3000]))) for i in range(120)] + [(7, "twin"), (7, "twin"), (None, "")]
    out = packing.pack_documents(spark.createDataFrame(docs, DOCS), JSON).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
    ends = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    assert len(ends) <= 1.1 * sum(r.length for r in out) / 2048 + 1
    assert packing.pack_documents(spark.createDataFrame([], DOCS), JSON).collect() == []


def test_a_vocabulary_out_of_order_is_refused(tmp_path):
    vocabulary = json.load(open(JSON, encoding="utf-8"))
    merges = vocabulary["model"]["merges"]
    merges[0], merges[1] = merges[1], merges[0]
    path = tmp_path / "v.json"
    path.write_text(json.dumps(vocabulary))
    with pytest.raises(ValueError):
        packing.load_encoding(str(path))
