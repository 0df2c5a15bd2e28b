"""What the operators should give, the plain way."""

import hashlib
from collections import Counter

import numpy as np
import xxhash


class Groups:
    """Union-find whose names are the smallest members."""

    def __init__(self, members):
        self.parent = {m: m for m in members}

    def top(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.parent[max(a, b)] = min(a, b)


def cut_repeats(texts: list[bytes], length: int) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, kept))
    return out


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def simhash(text: str, words: int = 3) -> int:
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_copies(docs: list[tuple[int, str]], bits: int = 3) -> dict[int, tuple[int, int]]:
    """doc_id -> (fingerprint, smallest doc_id reachable)."""
    prints = {d: simhash(t or "") for d, t in docs}
    groups, ids = Groups(prints), list(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= bits):
            groups.join(i, ids[j])
    return {i: (prints[i], groups.top(i)) for i in ids}


def targets(sizes: list[tuple], weights=(3, 1, 2), share=1.5, most=2.0) -> dict:
    """source -> target, by sharing again and again; ``sizes`` in the order of sources."""
    left, closed = share * sum(n for _, n in sizes), {}
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(sizes)}
    open_ = dict(sizes)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        above = [s for s, n in open_.items() if weight[s] * rate > most * n]
        if not above:
            return closed | {s: weight[s] * rate for s in open_}
        for s in above:
            closed[s] = most * open_.pop(s)
            left -= closed[s]
    return closed


def vector_links(rows: list[tuple], threshold: float) -> dict:
    """id -> (n_links, component); rows (id, vector or None, label or None)."""
    good = [(i, np.array(v, float), l) for i, v, l in rows if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    groups, count = Groups([i for i, _, _ in rows]), Counter()
    for i, v, l in good:
        for j, w, m in good:
            if i != j and l == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                count[i] += 1
                groups.join(i, j)
    return {i: (count[i], groups.top(i)) for i, _, _ in rows}
