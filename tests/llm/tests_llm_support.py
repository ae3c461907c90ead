"""Brute-force forms shared by tests."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def exact_keepers(texts):
    """Smallest id of each normalised text."""
    first = {}
    for i, t in sorted(texts.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    return set(first.values())


def plain_sets(text, k):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute_components(rows, k, num, den):
    """doc_id -> (n_shingles, component_id) by comparing all pairs."""
    sets = [(i, plain_sets(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, (a, x) in enumerate(sets):
        for b, y in sets[p + 1 :]:
            if x and y and min(len(x), len(y)) * den >= num * max(len(x), len(y)) and den * len(x & y) >= num * len(x | y):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {i: (len(s), root(i)) for i, s in sets}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def plain_secrets(text):
    """Spans of the base kinds, by start and kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
