import hashlib

import numpy as np

from boxwise.llm import catalog
from boxwise.llm import edit_embedding as E

from .helpers import prose, rnd


def plain_walk(text):
    """The walk of one text, step by step, from the same drawn bits."""
    code, _ = E.classes([text])
    i, j, seen = 0, 0, []
    while code[i]:
        seen.append(int(E._NIBBLE[code[i]]))
        i += int(E.drawn(j // E.BLOCK)[j % E.BLOCK][code[i]])
        j += 1
    return seen


def test_lockstep_walk_equals_plain_walk():
    r = rnd()
    texts = [prose(r, n) for n in (1, 3, 40, 200, 700)] + ["", "é漢😀 x"]
    steps, seen = E.walk(texts)
    due = E.all_steps(20)
    for t, s, row in zip(texts, steps, seen):
        want = plain_walk(t)
        assert len(want) <= s < len(want) + 64
        for at, v in zip(due, row):
            assert v == (want[at] if at < len(want) else 0)


def test_likeness_follows_edits():
    r = rnd(3)
    base = prose(r, 400)
    some = base[:900] + "X" + base[901:1500] + base[1510:]
    other = prose(rnd(99), 400)
    steps, seen = E.walk([base, base, some, other, ""])
    like = lambda i, j: float(E.likeness(steps[[i]], seen[[i]], steps[[j]], seen[[j]])[0])
    assert like(0, 1) == 1.0 and like(4, 4) == 1.0 and like(0, 4) == 0.0
    assert like(0, 2) > 0.6 > 0.45 > like(0, 3) >= 0
    prints = [E.packed(s, x) for s, x in zip(steps, seen)]
    back_steps, back = E.unpacked(prints)
    assert list(back_steps) == list(steps)
    assert np.allclose(E.likeness(back_steps[[0]], back[[0]], back_steps[[2]], back[[2]]), like(0, 2))


def check(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    texts = [t or "" for _, t in order]
    want = sorted(
        (str(d), len(t), hashlib.sha256(E.edited(t, texts[(i + 1) % len(texts)]).encode()).hexdigest()) for i, ((d, _), t) in enumerate(zip(order, texts))
    )
    assert sorted((str(g.doc_id), g.n_chars, g.edited_sha256) for g in got) == want


def test_next_text_with_nulls_ties_and_long_texts(spark):
    r = rnd(5)
    rows = [(i, prose(r, r.randrange(30))) for i in range(200)]
    rows += [(7, "again"), (7, "again"), (9, None), (11, ""), (None, "no id"), (None, None), (500, "é" * 70000), (-(2**62), "low")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS b", "3 AS r")
    got = E.fingerprint_with_next(df).collect()
    check(rows, got)
    by = {}
    for d, t in rows:
        by.setdefault(t or "", set())
    for g in got:
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
    assert len({g.fingerprint for g in got if g.n_chars == 0}) == 1


def test_single_row_and_empty_table(spark):
    df = spark.createDataFrame([(1, "only one")], "doc_id long, text string")
    (g,) = E.fingerprint_with_next(df).collect()
    assert g.near_next == 1.0 and g.edited_sha256 == hashlib.sha256(b"onlyonly").hexdigest()
    assert E.fingerprint_with_next(df.limit(0)).count() == 0


def test_near_pairs_find_edited_copies(spark):
    r = rnd(8)
    base = [prose(r, 150) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t[:300] + "#" + t[305:]) for i, t in enumerate(base)] + [(200, base[0]), (300, None), (None, base[1])]
    pairs = {(p.a, p.b) for p in E.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum((i, 100 + i) in pairs for i in range(12))
    assert found >= 11
    assert all(b - a == 100 for a, b in pairs)
    assert E.distance_within("kitten", "sitting", 3) == 3 and E.distance_within("kitten", "sitting", 2) is None
    assert E.distance_within("", "abc", 3) == 3 and E.distance_within("abc", "abc", 0) == 0


def test_near_pairs_behind_a_first_text_that_is_too_far(spark):
    r = rnd(12)
    rows = []
    for i in range(30):
        text = prose(r, 150)
        cut = int(0.8 * len(text))
        rows += [(i, text[:cut] + prose(r, 40)), (100 + i, text), (200 + i, text[:-4] + "#" + text[-3:])]
    pairs = {(p.a, p.b) for p in E.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum((100 + i, 200 + i) in pairs for i in range(30)) >= 27
    assert all((b - a) % 100 == 0 for a, b in pairs)


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check(rows, catalog.QUERIES["op1_edit_fingerprint"](spark, small).collect())
