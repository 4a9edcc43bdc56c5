"""Plain versions of the numbered operators, for small fixtures."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeats(texts, length):
    """For each text: (bytes, removed, spans, digest of the rest)."""
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    count = collections.Counter(windows)
    covered = {j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 8)}
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, n < 20 or 100 * rep > 30 * n


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_components(rows, t=80):
    """{id: smallest id reachable} for (id, text) rows."""
    sets = [(i, shingles(x)) for i, x in rows]
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= t * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        r = find(a)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(i, len(s), least.get(find(a)) if s else i) for a, (i, s) in enumerate(sets)]


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """sizes: {source: words}. Shares the excess again until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        wsum = sum(w[s] for s in names if s not in full)
        t = {s: most * sizes[s] if s in full else rest * w[s] / wsum for s in names}
        over = {s for s in names if s not in full and t[s] > most * sizes[s] + 1e-9}
        if not over:
            return t
        full |= over
