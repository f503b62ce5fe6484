"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def rows_of(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=str)


def components(docs):
    sets = {}
    for d, t in docs:
        w = spaced(t, lower=True)
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def without_repeats(docs, length):
    counts, words = Counter(), [spaced(t) for _, t in docs]
    for w in words:
        counts.update(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
    out = []
    for (d, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - length + 1):
            if counts[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def contamination(docs, items, window):
    windows, sizes = defaultdict(set), set()
    for i, t in items:
        w = alnum(t)
        if w:
            k = min(window, len(w))
            sizes.add(k)
            for s in range(len(w) - k + 1):
                windows[tuple(w[s : s + k])].add(i)
    out = []
    for d, t in docs:
        w, hit, ids = alnum(t), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if own := windows.get(tuple(w[s : s + k])):
                    hit.update(range(s, s + k))
                    ids |= own
        listed = ",".join(sorted(str(i) for i in ids if i is not None))
        out.append((d, len(w), len(hit), len(ids - {None}), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out
