"""Plain versions of the operators, one document or pair at a time, that the tests hold results against."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = words(lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def jaccard_components(docs, k, num, den):
    """[(doc_id, n, component)] of (doc_id, text) rows."""
    sets = [shingles(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None and (r not in least or d < least[r]):
            least[r] = d
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)]


def substring_dedup(docs, k):
    count = Counter()
    split = [words(t) for _, t in docs]
    for w in split:
        count.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(docs, split, strict=True):
        gone = set()
        for i in range(len(w) - k + 1):
            if count[tuple(w[i : i + k])] > 1:
                gone |= set(range(i, i + k))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept)))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def secrets(text):
    """Base spans by the contract's patterns, as they stand."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def nearest(vectors, query, k):
    """[(vec_id, score)] of (id, vector) rows, largest inner product first, ties to the smaller id, not the query's own."""
    import numpy as np

    q = np.asarray(query[1], dtype=np.float64)
    rows = [(i, float(np.asarray(v, dtype=np.float64) @ q)) for i, v in vectors if i != query[0]]
    return sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
