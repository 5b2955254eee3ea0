"""Plain-Python answers to compare with."""

import hashlib
import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORDLIKE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def licenses(text):
    words = WORDLIKE.findall(lower(text))
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def quality(text):
    text = text or ""
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(tri)
    hit = {j for i, t in enumerate(tri) if seen[t] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    found.sort()
    count = Counter(x[3] for x in found)
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
    return count["assign"], count["access"], count["hex"], hashlib.sha256(joined.encode()).hexdigest()


def shingles(text):
    words = SPACED.findall(lower(text))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def jaccard_components(docs):
    """docs: list of (id, text). Returns id -> (set size, smallest linked id), by an inverted index over all tokens."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        overlap = Counter(j for x in s for j in index.get(x, ()))
        for j, n in overlap.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for x in s:
            index.setdefault(x, []).append(i)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[root(i)] = min(low.get(root(i), d), d)
    return {d: (len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(docs)}


def repeats(docs, length=200):
    """docs: list of (id, text). Returns [(id, n_bytes, n_removed, n_spans, sha256 of the rest)]."""
    raws = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(raw[i : i + length] for _, raw in raws for i in range(len(raw) - length + 1))
    out = []
    for d, raw in raws:
        covered, kept, spans, until = 0, bytearray(), 0, 0
        inside = False
        for i in range(len(raw)):
            if i + length <= len(raw) and seen[raw[i : i + length]] > 1:
                until = i + length
            if i < until:
                covered += 1
                spans += not inside
                inside = True
            else:
                kept.append(raw[i])
                inside = False
        out.append((d, len(raw), covered, spans, hashlib.sha256(bytes(kept)).hexdigest()))
    return out
