"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash


def within_one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def without_near_lines(docs: list[tuple], from_chars: int = 20) -> dict[int, str | None]:
    """doc_id -> text, for documents with distinct ids: of equal lines that are not blank the earliest stays, and of lines of
    ``from_chars`` characters and more within one edit too."""
    lines = [(d, k, line) for d, t in docs if d is not None and t is not None for k, line in enumerate(t.split("\n"))]
    lines.sort(key=lambda x: x[:2])
    gone = set()
    for i, (d, k, line) in enumerate(lines):
        if line.strip() and any(line == other or (min(len(line), len(other)) >= from_chars and within_one_edit(line, other))
                                for _, _, other in lines[:i]):
            gone.add((d, k))
    return {d: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in docs}


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes: list, linked) -> dict:
    """node -> smallest node it reaches; ``linked(a, b)`` tells whether two are joined."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def removed_bytes(docs: list[tuple[int, str | None]], length: int) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> (bytes, removed, spans, hash of the rest)."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        mark = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            window = data[i:i + length]
            if window in seen:
                mark[i:i + length] = True
            seen.add(window)
        kept = bytes(b for b, m in zip(data, mark) if not m)
        spans = int((mark[1:] & ~mark[:-1]).sum() + (mark[0] if len(data) else 0))
        out[doc_id] = (len(data), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def top_k(vectors: dict[int, list], k: int, every: int, score) -> list[tuple]:
    out = []
    for q in sorted(v for v in vectors if v % every == 0):
        hits = sorted(((-score(vectors[q], x), v) for v, x in vectors.items() if v != q))[:k]
        out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(hits)]
    return out


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def feistel(key: str, kind: str, left: int, right: int, a: int, b: int, rounds: int = 8) -> tuple[int, int]:
    x, y = left, right
    for i in range(1, rounds + 1):
        m = a if i % 2 else b
        digest = hashlib.sha256(f"{key}|{kind}|{i}|{y}".encode()).hexdigest()
        x, y = y, (x + int(digest[:15], 16) % m) % m
    return x, y


def undo_feistel(key: str, kind: str, x: int, y: int, a: int, b: int, rounds: int = 8) -> tuple[int, int]:
    for i in range(rounds, 0, -1):
        m = a if i % 2 else b
        digest = hashlib.sha256(f"{key}|{kind}|{i}|{x}".encode()).hexdigest()
        x, y = (y - int(digest[:15], 16) % m) % m, x
    return x, y


def best_fit(counts: dict[int, int], size: int) -> int:
    """Sequences that best fit, longest first, needs."""
    gaps: list[int] = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            at = min((i for i, g in enumerate(gaps) if g >= length), key=gaps.__getitem__, default=None)
            if at is None:
                gaps.append(size - length)
            else:
                gaps[at] -= length
    return len(gaps)
