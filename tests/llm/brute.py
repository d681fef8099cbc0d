"""Plain single-process versions of the operators, written from their contracts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LAST = 1 << 62


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def contaminated(docs, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add(str(item))
    sizes = {len(g) for g in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (g := tuple(w[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[g]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def repeats(docs, width=50):
    first, out = {}, []
    rows = [(doc, LAST if doc is None else doc, (text or "").encode()) for doc, text in docs]
    for _, d, b in rows:
        for p in range(len(b) - width + 1):
            g = b[p : p + width]
            first[g] = min(first.get(g, 2 * LAST), d)
    for doc, d, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < d:
                gone[p : p + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    marked = {i for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for i in range(k, k + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), n < 10 or 100 * len(marked) > 20 * n


def linked(docs, k=4, percent=85):
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(p for g in s for p in holders[g])
        for p, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[p]) - n):
                parent[find(i)] = find(p)
        for g in s:
            holders[g].append(i)
    low = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), low.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(docs)), key=str)
