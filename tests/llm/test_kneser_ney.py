import math
from collections import Counter, defaultdict

import pytest

from boxwise.llm import catalog
from boxwise.llm import kneser_ney as K

from .helpers import documents, rnd

LABELS = "doc_id long, quality int, toxic int"


def plain_model(texts):
    """Interpolated modified Kneser-Ney of bytes, from its definition."""
    n = K.ORDER
    high = Counter()
    for t in texts:
        b = b"\0" * (n - 1) + t.lower().encode()
        high.update(b[i : i + n] for i in range(len(b) - n + 1))
    tables = {n: high}
    for k in range(n - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    cuts = {}
    for k, t in tables.items():
        c = Counter(min(v, 5) for v in t.values())
        n1, n2, n3, n4 = (c[i] for i in range(1, 5))
        if n1 and n2 and n3 and n4:
            y = n1 / (n1 + 2 * n2)
            d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
            cuts[k] = [min(max(x, 0.01), i - 0.01) for i, x in enumerate(d, 1)]
        else:
            cuts[k] = [0.5, 0.75, 0.9]
    totals = {k: Counter() for k in tables}
    taken = {k: defaultdict(float) for k in tables}
    for k, t in tables.items():
        for g, v in t.items():
            totals[k][g[:-1]] += v
            taken[k][g[:-1]] += cuts[k][min(v, 3) - 1]

    def p(ctx, w):
        k = len(ctx) + 1
        low = p(ctx[1:], w) if ctx else 1 / 256
        if not totals[k][ctx]:
            return low
        v = tables[k][ctx + w]
        own = (v - cuts[k][min(v, 3) - 1]) / totals[k][ctx] if v else 0
        return own + taken[k][ctx] / totals[k][ctx] * low

    def perplexity(text):
        b = b"\0" * (n - 1) + text.lower().encode()
        logs = [math.log(p(b[i - n + 1 : i], b[i : i + 1])) for i in range(n - 1, len(b))]
        return math.exp(-sum(logs) / len(logs))

    return perplexity


def corpus(spark):
    r = rnd(1)
    vocabulary = ["alpha", "beta", "gamma", "delta", "über", "el niño", "the", "of"]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(3, 30)))) for i in range(120)]
    rows += [(200, "zxq9 %%% $$$ qqq"), (201, None), (202, ""), (None, "alpha beta"), (203, "alpha " * 20000), (1, rows[1][1])]
    labels = [(i, 1, 0) for i in range(100)] + [(200, 0, 0), (100, 1, 1), (None, 1, 0), (5, 1, 0), (6, 0, 0)]
    return rows, documents(spark, rows), spark.createDataFrame(labels, LABELS)


def test_perplexity_equals_the_definition(spark):
    rows, docs, labels = corpus(spark)
    got = K.classify(docs, labels).collect()
    assert len(got) == len(rows)
    from pyspark.sql import functions as F

    held = {r.doc_id for r in docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(K.HELD)) == 0).select("doc_id").collect()}
    trusted = {i for i in range(100)} - {6}
    model = plain_model([t for d, t in rows if d in trusted and d not in held])
    texts = dict(rows)
    for g in got:
        t = texts[g.doc_id]
        if not t:
            assert g.perplexity is None and not g.keep and g.n_bytes == 0
        elif len(t) < 1000:
            assert g.perplexity == pytest.approx(model(t), rel=1e-4), t
        assert g.trusted == (g.doc_id in trusted)
    keep = {g.doc_id: g.keep for g in got}
    assert keep[203] and not keep[200]


def test_shards_add_up(spark):
    _, docs, labels = corpus(spark)
    key = lambda r: (str(r.doc_id), r.n_bytes)
    one = sorted(K.classify(docs, labels).collect(), key=key)
    many = sorted(K.classify(docs, labels, shard_rows=100).collect(), key=key)
    assert len(one) == len(many)
    for a, b in zip(one, many):
        assert (a.perplexity is None) == (b.perplexity is None) and a.keep == b.keep
        assert a.perplexity is None or a.perplexity == pytest.approx(b.perplexity, rel=1e-4)


def test_without_trusted_text_and_empty_tables(spark):
    _, docs, labels = corpus(spark)
    got = K.classify(docs, labels.limit(0)).collect()
    assert all(g.perplexity is None and g.threshold is None for g in got)
    assert all(g.keep == (g.n_bytes > 0) for g in got)
    assert K.classify(docs.limit(0), labels).count() == 0


def test_query_keeps_good_text(spark, small):
    got = {r.doc_id: r.keep for r in catalog.QUERIES["op9_quality"](spark, small).collect()}
    labels = spark.read.parquet(f"{small}/labels.parquet").collect()
    good = [got[r.doc_id] for r in labels if r.quality == 1]
    assert sum(good) >= 0.95 * len(good)
