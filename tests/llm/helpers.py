"""Plain Python versions that the operators are compared with."""

import collections
import re

UPPER = {i: i + 32 for i in range(65, 91)}


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def gram_set(text, n):
    words = spaced_words(text)
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def near_components(docs, n, part, whole):
    """{id: smallest id reachable}, for (id, text) pairs with distinct ids."""
    sets = {d: gram_set(t, n) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and whole * both >= part * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}


def bag_likeness(a, b):
    a, b = collections.Counter(spaced_words(a)), collections.Counter(spaced_words(b))
    every = set(a) | set(b)
    return sum(min(a[x], b[x]) for x in every) / max(1, sum(max(a[x], b[x]) for x in every))
