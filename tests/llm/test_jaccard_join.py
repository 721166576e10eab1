import numpy as np
import pytest

from boxwise.llm import catalog
from boxwise.llm import jaccard_join as J
from boxwise.llm.graph import components

from .helpers import edited, jaccard_components, prose, rnd, shingle_set


def agree(rows, got):
    key = lambda r: tuple(map(str, r))
    assert sorted(((g.doc_id, g.n_shingles, g.component_id) for g in got), key=key) == sorted(jaccard_components(rows), key=key)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS k", "1 AS n", "2 AS a", "3 AS id")
    return J.join(df).collect()


def families(r, sizes, changes):
    rows = []
    for size in sizes:
        base = prose(r, size)
        rows += [edited(r, base, c) for c in changes]
    return rows


def test_pairs_around_the_threshold(spark):
    r = rnd()
    texts = families(r, (5, 6, 8, 9, 12, 20, 33, 60, 130, 400), (0, 0, 1, 1, 2, 3, 5))
    rows = list(enumerate(texts + [prose(r, r.randrange(1, 80), 12) for _ in range(120)]))
    agree(rows, run(spark, rows))


def test_nulls_ties_short_and_long_texts(spark):
    r = rnd(2)
    long = prose(r, 30000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, "one  two"), (7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (None, "alone here"), (None, None)]
    rows += [(8, long), (9, edited(r, long, 300)), (10, long + " tail")]
    agree(rows, run(spark, rows))
    assert J.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    agree([(1, None), (2, "")], run(spark, [(1, None), (2, "")]))


def test_hot_groups_stay_exact(spark):
    """More near copies than HOT, some of them too far from most others, and texts that share one long passage."""
    r = rnd(4)
    base = prose(r, 60)
    texts = [edited(r, base, r.randrange(0, 4)) for _ in range(60)]
    passage = prose(r, 40)
    texts += [prose(r, 4) + " " + passage + " " + prose(r, n) for n in range(1, 50)]
    common = prose(r, 30)
    texts += [common + " " + prose(r, r.randrange(1, 9)) for _ in range(60)]
    rows = list(enumerate(texts))
    agree(rows, run(spark, rows))


def test_blocks_of_a_family(spark, monkeypatch):
    r = rnd(6)
    base = prose(r, 50)
    texts = [edited(r, base, r.randrange(0, 3)) for _ in range(20)] + [prose(r, 50) for _ in range(5)]
    rows = [(i, t) for i, t in enumerate(texts)]
    links = J.block_links([(i, np.array(sorted(hash(g) & (2**63 - 1) for g in shingle_set(t)), np.uint64).tobytes()) for i, t in rows[:12]], [(i, np.array(sorted(hash(g) & (2**63 - 1) for g in shingle_set(t)), np.uint64).tobytes()) for i, t in rows[12:]])
    top = {i: i for i, _ in rows}

    def find(x):
        return x if top[x] == x else find(top[x])

    for a, b in links:
        top[max(find(a), find(b))] = min(find(a), find(b))
    want = jaccard_components(rows)
    assert [find(i) for i, _ in rows] == [c for _, _, c in want]


@pytest.mark.parametrize("seed", range(3))
def test_every_linked_pair_shares_a_signature_it_can_afford(seed):
    """Pigeonhole: a linked pair shares a signature, even without those of as many segments as a set may spare."""
    r = rnd(seed)
    texts = families(r, (6, 9, 10, 14, 25, 70, 200), (0, 1, 1, 2, 4, 8))
    import pyarrow as pa

    ((_, _, g, bounds),) = list(J.sets(pa.array(texts)))
    edges = J.bands(int(np.diff(bounds).max()))
    sig, owner, spare = J.signatures(g, bounds, edges)
    have = [set(sig[owner == i].tolist()) for i in range(len(texts))]
    full = [set(g[bounds[i] : bounds[i + 1]].tolist()) for i in range(len(texts))]
    sk = J.sketches(g, bounds)
    assert (spare >= 0).all()
    for i in range(len(texts)):
        for j in range(i):
            if full[i] != full[j] and 100 * len(full[i] & full[j]) >= 80 * len(full[i] | full[j]):
                assert have[i] & have[j]
                assert J.may_link(len(full[i]), sk[i], len(full[j]), sk[j])


def test_pairs_that_share_hot_signatures_only_are_poor_on_both_sides():
    """Also where one set ended at a level that the other left: a signature of such a level can't be spared."""
    import pyarrow as pa

    r = rnd(12)
    crossed = 0
    texts = []
    for _ in range(1500):
        base = prose(r, r.randrange(12, 40), 5000)
        texts += [base, edited(r, base, r.randrange(1, 3)), " ".join(base.split(" ")[r.randrange(1, 3) :])]
    ((_, _, g, bounds),) = list(J.sets(pa.array(texts)))
    sig, owner, spare, early = J.level_signatures(g, bounds, J.bands(int(np.diff(bounds).max())))
    have = [{} for _ in texts]
    for s, o, e in zip(sig.tolist(), owner.tolist(), early.tolist()):
        have[o][s] = e
    for i in range(0, len(texts), 3):
        for x, y in ((i, i + 1), (i, i + 2), (i + 1, i + 2)):
            a, b = (set(g[bounds[j] : bounds[j + 1]].tolist()) for j in (x, y))
            if a == b or 100 * len(a & b) < 80 * len(a | b):
                continue
            for one, other in ((x, y), (y, x)):
                hot = [[s for s in have[one] if s in have[other] and s & 1 == odd] for odd in (0, 1)]
                old = any(len(hot[odd]) > spare[one, odd] for odd in (0, 1))
                new = old or any(have[one][s] for h in hot for s in h)
                assert new
                crossed += not old
    assert crossed


def test_hot_members_can_not_spare_signatures_of_levels_they_left(spark):
    import pyarrow as pa

    r = rnd(15)
    bases = [prose(r, n, 5000) for n in range(10, 40, 2)]
    texts = [edited(r, b, 1) for b in bases for _ in range(60)]
    ((_, _, g, bounds),) = list(J.sets(pa.array(texts)))
    edges = J.bands(int(np.diff(bounds).max()))
    sig, owner, spare, early = J.level_signatures(g, bounds, edges)
    keys, groups = J.set_keys(g, bounds).astype(np.int64).tolist(), {}
    for s, o, e in zip(sig.tolist(), owner.tolist(), early.tolist()):
        groups.setdefault(s, {})[keys[o]] = -1 if e else int(spare[o, s & 1])
    want = sorted((k, v) for m in groups.values() if len(m) > J.HOT for k, v in m.items())
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    found = J.shared_signatures(J.packed_signatures(docs, edges, 4), 2).filter("kind = 2")
    assert sorted((m.a, m.b) for m in found.collect()) == want
    assert any(v < 0 for _, v in want)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    agree(rows, catalog.QUERIES["op5_jaccard_join"](spark, small).collect())
