"""What the queries should give, worked out plainly in Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def substring(rows, k=13):
    """doc_id -> (n_words, n_removed, kept_sha256); ids are distinct."""
    words, first = {d: WORD.findall(t or "") for d, t in rows}, {}
    for d in sorted(words):
        for i in range(len(words[d]) - k + 1):
            first.setdefault(tuple(words[d][i : i + k]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        out[d] = len(w), sum(gone), sha(" ".join(x for x, y in zip(w, gone, strict=True) if not y))
    return out


def near(rows, percent=75):
    """doc_id -> (n_shingles, component_id)"""
    sets, held, root = {}, defaultdict(list), {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
        root[d] = d

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d in sorted(sets):
        both = Counter(e for g in sets[d] for e in held[g])
        for g in sets[d]:
            held[g].append(d)
        for e, n in both.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def pieces(rows, encode, capacity):
    out = {}
    for d, t in rows:
        ids, at, p = np.array([*encode(t or ""), 0], "<u4"), 0, 0
        while at < len(ids):
            to = at + ((len(ids) - at) % capacity or capacity)
            out[d, p] = at, to - at, zlib.crc32(ids[at:to].tobytes())
            at, p = to, p + 1
    return out


def quality_counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    """Base spans of a text: (start, rank, kind, end)."""
    t = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(found)
