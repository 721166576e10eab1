"""Plain Python counterparts and fixtures for the operators' tests."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def word_list(text):
    raw = (text or "").encode()
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    return re.findall(rb"[^\x20\x09-\x0D]+", lower)


def shingle_set(text, n=5):
    w = word_list(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def jaccard_components(rows):
    """(n_shingles, smallest linked id) by row number, over all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = find(i), find(j)
                top[max(p, q)] = min(p, q)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None)))
    return out


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}x{rnd.randrange(3)}" for _ in range(n))


def edited(rnd, text, changes):
    w = text.split(" ")
    for _ in range(changes):
        w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
    return " ".join(w)


def documents(spark, rows):
    """Rows of (id, text) as the documents table, with a column whose name an operator might use inside."""
    full = [(d, t, "en", "s", len(t) if t is not None else None) for d, t in rows]
    return spark.createDataFrame(full, DOCS)


def rnd(seed=7):
    return random.Random(seed)
