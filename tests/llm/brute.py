"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

SPACE = " \t\n\x0b\x0c\r"
sha = lambda b: hashlib.sha256(b).hexdigest()


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def substrings(docs, length=100):
    docs = sorted((d, (t or "").encode()) for d, t in docs)
    seen, out = set(), {}
    for d, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[d] = (len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(kept))
    return out


def base_secrets(text):
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def quality(text):
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    places = defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i : i + 5])].append(i)
    cover = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), failed)


def shingles(text, n):
    w = [x for x in words(lower(text))]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def classes(docs, n, num, den):
    sets = {d: shingles(t or "", n) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            by[x].add(d)
    for a, s in sets.items():
        for b in set().union(*[by[x] for x in s]) if s else ():
            if a < b and len(s & sets[b]) * den >= len(s | sets[b]) * num:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places, labels = [], set()
    for phrase, label in {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """sizes: source -> words; by reshare until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, rest, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: rest * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            open_.discard(s)
            rest -= out[s]
    return out
