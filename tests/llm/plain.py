"""Brute-force versions that the operators are held against."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import xxhash


def words(text):
    return (text or "").encode().split()


def fold(i, m):
    return -1 if i is None else zlib.crc32(str(i).encode()) % m


def substring(rows, window=13):
    """{index: (n_words, n_removed, kept text)} of (doc_id, text) rows; null ids come last."""
    order = [math.inf if i is None else i for i, _ in rows]
    first = {}
    for (_, t), o in zip(rows, order, strict=True):
        w = words(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, math.inf), o)
    out = {}
    for n, ((_, t), o) in enumerate(zip(rows, order, strict=True)):
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < o:
                gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        out[n] = (len(w), len(gone), kept)
    return out


def fingerprint(text, size=4, seed=42):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def groups(ids, fps, radius=4, sets=None, similarity=None):
    """{id: smallest id reachable} by comparing all pairs of fingerprints, and of shingle sets if given."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            alike = similarity and sets[a] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])
            if alike or (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(ids[a]), find(ids[b])
                if x != y:
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def alignment(item, doc):
    """Smith-Waterman over the whole document, cell by cell."""
    best, row = 0, [0] * (len(doc) + 1)
    for w in item:
        new = [0] * (len(doc) + 1)
        for j, x in enumerate(doc, 1):
            new[j] = max(0, row[j - 1] + (2 if w == x else -1), row[j] - 1, new[j - 1] - 1)
        best, row = max(best, max(new)), new
    return best / (2 * len(item))


def topk(rows, k=20):
    """(query, rank, id, score) of (id, integer vector) rows."""
    out = []
    for i, v in rows:
        if i % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i and len(w) == len(v))[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(found, 1)]
    return sorted(out)


def lm(rows, trained, mu):
    """{index: (n_tokens, n_known, N, base, score)} with exact counts, quantised as levels, and no false positives."""
    tokens = [[*(w.lower() for w in words(t)), None] for _, t in rows]
    one, two = Counter(), Counter()
    for t, use in zip(tokens, trained, strict=True):
        if use:
            one.update(t)
            two.update(zip([0, *t[:-1]], t, strict=True))
    n, v = sum(one.values()), len(one)
    one[0] = one[None]
    middle = lambda c: 0 if not c else (2 ** (c.bit_length() - 1) + 2 ** c.bit_length() - 1) / 2
    out = {}
    for i, t in enumerate(tokens):
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        total = 0.0
        for h, w in zip([0, *t[:-1]], t, strict=True):
            e, eh = middle(one[w]), middle(one[h])
            both = min(middle(two[h, w]), e, eh)
            total += math.log10((both + mu * (e + 0.1) / (n + 0.1 * (v + 1))) / (eh + mu))
        out[i] = (len(t), sum(one[w] > 0 for w in t), n, base, total)
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def language(network, text, chunk, context):
    """Probabilities of a text's languages, byte by byte without arrays over time, chunk by chunk of whole characters."""
    w = {k: v.astype(float) for k, v in network.weights.items()}
    words = "".join(c.lower() if c.isascii() and c.isalpha() else c if not c.isascii() else " " for c in text).split(" ")
    flat = " ".join(x for x in words if x).encode()

    def whole(at):
        while 0 < at < len(flat) and flat[at] & 0xC0 == 0x80:
            at -= 1
        return min(at, len(flat))

    def read(part, d):
        h, out = np.zeros(w[f"U{d}"].shape[0]), []
        k = len(h)
        for b in part:
            a = w["E"][b] @ w[f"W{d}"] + w[f"b{d}"]
            r, z = (1 / (1 + np.exp(-(a[i * k : i * k + k] + h @ w[f"U{d}"][:, i * k : i * k + k]))) for i in (0, 1))
            n = np.tanh(a[2 * k :] + (r * h) @ w[f"U{d}"][:, 2 * k :])
            h = z * h + (1 - z) * n
            out.append(h)
        return out

    total, count = np.zeros(len(network.langs)), 0
    for first in range(0, len(flat), chunk):
        a, b = whole(first), whole(first + chunk)
        low, high = whole(max(0, a - context)), whole(b + context)
        part = flat[low:high]
        for i, (f, g) in enumerate(zip(read(part, "f"), read(part[::-1], "b")[::-1], strict=True)):
            if a <= low + i < b and part[i] != 32:
                o = np.concatenate((f, g)) @ w["V"] + w["c"]
                total += o - np.log(np.exp(o).sum())
                count += 1
    p = np.exp(total / count)
    return p / p.sum()


def quality_features(raw, size, pair):
    """Names of the indicators that a text sets, counted one at a time."""
    marks = ".,!?%&$#*|<>()[{\"'-_/:;=@+"
    kind = {**{ord(m): 5 + i for i, m in enumerate(marks)}, ord("]"): 5 + marks.index("["), ord("}"): 5 + marks.index("{")}

    def of(b):
        if 97 <= b <= 122 or b >= 128:
            return 0
        return 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in (32, 9, 11, 12) else 4 if b in (10, 13) else kind.get(b, 31)

    grams = Counter((of(raw[i]) * 32 + of(raw[i + 1])) * 32 + of(raw[i + 2]) for i in range(len(raw) - 2))
    words = [xxhash.xxh3_64_intdigest(x) for x in raw.lower().split()]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    form = set(grams) | {g + 32**3 for g, c in grams.items() if c * 64 >= len(raw)} | {2 * 32**3 + again.bit_length(), 2 * 32**3 + 32 + (32 * again // len(words) if words else 31)}
    low = raw.lower()
    start = 2 * 32**3 + 64
    one = {start + mixed(x) % size for x in words} | {start + mixed((a * pair + b) % 2**64) % size for a, b in zip(words, words[1:], strict=False)}
    two = {start + size + mixed(int.from_bytes(low[i : i + 4], "big")) % size for i in range(len(low) - 3)}
    return form | one | two


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor % 2**64
    return x ^ x >> 31


def hinge(rows, y, cost, size, epochs, seed):
    """Dual coordinate descent, one number at a time; rows: {feature: value}."""
    w, b, alpha, rng = [0.0] * size, 0.0, [0.0] * len(rows), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            gradient = y[i] * (sum(w[k] * v for k, v in rows[i].items()) + b) - 1
            new = min(max(alpha[i] - gradient / (sum(v * v for v in rows[i].values()) + 1), 0.0), cost[i])
            for k, v in rows[i].items():
                w[k] += (new - alpha[i]) * y[i] * v
            b += (new - alpha[i]) * y[i]
            alpha[i] = new
    return w, b
