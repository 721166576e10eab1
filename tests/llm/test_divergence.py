import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from boxwise.llm import catalog, divergence
from tests.llm.helpers import prose, rnd

SCHEMA = "text string, lang string, source string, term string, n long, value string"


def brute(rows):
    docs = [tuple(v or "" for v in r[:3]) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for t, _, _ in docs]
    out = []
    for lang in {d[1] for d in docs}:
        held = Counter(w for (_, g, _), ws in zip(docs, terms) if g == lang for w in set(ws))
        kept = sorted(w for w, n in held.items() if n >= 3)
        counts = defaultdict(Counter)
        for (_, g, s), ws in zip(docs, terms):
            if g == lang:
                counts[s].update(w for w in ws if held[w] >= 3)
        whole = sum(counts.values(), Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(o, sum(f(p(counts[s], w), p(counts[o], w)) for w in kept)) for o in counts if o != s]
            found = [(w, f(p(counts[s], w), p(whole, w))) for w in kept if counts[s][w] and p(counts[s], w) > p(whole, w)]
            for part, items in (("pair", pairs), ("term", found)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, w, v, k) for k, (w, v) in enumerate(ranked, 1) if part == "pair" or k <= 200]
    return sorted(out)


def result(spark, rows):
    return sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA)).select("lang", "source", "part", "item", "value", "rank").collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD", 60)
    r = rnd(3)
    rows = []
    for i in range(240):
        lang, source = r.choice(["en", "de", None, "x1"]), r.choice(["a", "b", "ä", None, "c"])
        text = prose(r, r.choice([0, 1, 5, 40]), 60) + r.choice(["", " Éa éA ABC abc", "_[`{\x00\x7f", " \U0001f600\U0001f600 z"])
        rows.append((text, lang, source, "clash", i, "extra"))
    rows += [(None, "en", "only null", "", 0, ""), ("", "fr", "a", "", 0, ""), ("word", "fr", "b", "", 0, ""), ("word word word", "es", "solo", "", 0, "")] + [rows[0]] * 3
    got = result(spark, rows)
    assert got == brute(rows)
    assert any(g[0] == "fr" and g[4] == 0 for g in got) and any(g[1] == "" for g in got)


def test_more_than_the_top(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = [(" ".join(words), "en", "a", "", 0, "")] * 3 + [("other", "en", "b", "", 0, "")] * 3
    got = result(spark, rows)
    assert got == brute(rows) and sum(g[2] == "term" and g[1] == "a" for g in got) == 200


def test_empty_and_long(spark, monkeypatch):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    monkeypatch.setattr(divergence, "SLICE", 64)
    assert sorted(map(tuple, (Counter(sum(divergence.text_terms(b"ab cd " * 500), [])).items()))) == [(b"ab", 500), (b"cd", 500)]
    rows = [("ab cd " * 40_000 + "e", "en", "a", "", 0, "")] * 3 + [("ab", "en", "b", "", 0, "")]
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("n,m", [(0, 5), (3, 4000), (700, 900), (1, 1)])
def test_gallop(n, m):
    g = np.random.default_rng(n + m)
    a, b = (np.unique(g.integers(0, 5000, k)) for k in (n, m))
    i, j = divergence.gallop(a, b)
    assert np.array_equal(a[i], np.intersect1d(a, b)) and np.array_equal(b[j], a[i])


def test_shares_are_exact():
    n = np.array([0, 1, 10**6, 10**13], np.int64)
    assert divergence.shares(n, 10**14 + 7).tolist() == [1 + 10**9 * (int(c) + 1) // (10**14 + 7) for c in n]


def test_query_equals_brute_force(spark, small):
    rows = [tuple(r) for r in catalog.table(spark, small, "documents").select("text", "lang", "source").collect()]
    got = sorted(tuple(r) for r in catalog.QUERIES["op12_source_divergence"](spark, small).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute(rows)
