import numpy as np

from boxwise.llm import catalog
from boxwise.llm import decontaminate as D

from .helpers import edited, prose, rnd


def smith_waterman(a, b):
    best, rows = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = D.MATCH if a[i - 1] == b[j - 1] else D.MISMATCH
            rows[i][j] = max(0, rows[i - 1][j - 1] + s, rows[i - 1][j] + D.GAP, rows[i][j - 1] + D.GAP)
            best = max(best, rows[i][j])
    return best


def plain(text):
    return ["".join(c) for c in "".join(ch if ch.isalnum() or ord(ch) > 127 else " " for ch in (text or "").lower()).split()]


def brute(docs, items):
    out = set()
    for d, t in docs:
        for i, x in items:
            a, b = plain(x), plain(t)
            if a and b and smith_waterman(a, b) >= D.SHARE * D.MATCH * len(a):
                out.add((d, i))
    return out


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS item", "3 AS n"),
        spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS h"),
    )


def test_alignment_equals_the_plain_recurrence():
    r = rnd()
    for _ in range(60):
        a = np.array([r.randrange(6) for _ in range(r.randrange(1, 25))])
        b = np.array([r.randrange(6) for _ in range(r.randrange(1, 40))])
        assert D.aligned(a, b)[0] == smith_waterman(a, b)


def test_copies_edited_copies_and_clean_texts(spark):
    r = rnd(1)
    items = [(i, prose(r, r.randrange(16, 60), 3000)) for i in range(12)] + [(50, prose(r, 20, 3000)), (51, "")]
    docs = [(i, prose(r, 120, 3000)) for i in range(30)]
    for i, t in items[:12]:
        docs.append((100 + i, prose(r, 50, 3000) + " " + t + " " + prose(r, 50, 3000)))
        docs.append((200 + i, prose(r, 20, 3000) + " " + edited(r, t, max(1, len(t.split()) // 8)) + "!!! " + prose(r, 9, 3000)))
        docs.append((300 + i, t.upper().replace(" ", "!! ")))
    docs += [(400, None), (401, ""), (None, items[0][1]), (402, items[1][1]), (402, items[1][1]), (403, (prose(r, 20000, 3000) + " " + items[2][1]))]
    got = D.leaks(*frames(spark, docs, items)).collect()
    found = {(g.doc_id, g.item_id) for g in got}
    want = brute([d for d in docs if d[0] != 403], items) | {(403, 2)}
    assert found == want
    assert all(0.6 <= g.score <= 1 for g in got)
    assert len(got) == len(found)


def test_heavily_edited_copies_equal_brute_force(spark):
    """Copies with 10 to 25% of the words replaced, also without any whole run of 4 words, and with words put in between."""
    r = rnd(5)
    items, docs = [], []
    for i in range(24):
        size = (4, 5, 6, 8, 12, 16, 25, 40)[i % 8]
        w = prose(r, size, 3000).split(" ")
        items.append((i, " ".join(w)))
        copies = [[f"new{r.randrange(10**6)}" if k % 4 == 3 else x for k, x in enumerate(w)], " and ".join(w[:1] + [f"{a} {b}" for a, b in zip(w[1::2], w[2::2])]).split(" ")]
        for share in (0.1, 0.15, 0.2, 0.25):
            gone = set(r.sample(range(size), round(share * size)))
            copies.append([f"new{r.randrange(10**6)}" if k in gone else x for k, x in enumerate(w)])
        if i % 3 == 0:
            copies.append(w)
        docs += [(1000 * i + k, f"{prose(r, 30, 3000)} {' '.join(c)} {prose(r, 30, 3000)}") for k, c in enumerate(copies)]
    want = brute(docs, items)
    assert len(want) > 100
    assert {(g.doc_id, g.item_id) for g in D.leaks(*frames(spark, docs, items)).collect()} == want


def test_short_long_and_repeated_items(spark):
    r = rnd(2)
    long = prose(r, 1500, 5000)
    items = [(1, "two words"), (2, long), (3, "alpha beta gamma delta epsilon"), (4, "alpha beta gamma delta epsilon"), (5, None)]
    docs = [(1, "here are two words indeed"), (2, "two other words"), (3, prose(r, 10) + " " + long), (4, "x alpha beta gamma delta epsilon y")]
    found = {(g.doc_id, g.item_id) for g in D.leaks(*frames(spark, docs, items)).collect()}
    assert found == {(1, 1), (3, 2), (4, 3), (4, 4)}


def test_the_last_part_of_a_long_item_is_a_full_one(spark):
    r = rnd(8)
    long = prose(r, D.PART + 2, 5000)
    end = " ".join(long.split(" ")[-4:])
    docs = [(1, f"{prose(r, 40, 5000)} {end} {prose(r, 40, 5000)}"), (2, " ".join(long.split(" ")[-400:]))]
    items = [(1, long)]
    parts = [(p.part, len(p.words)) for p in D.pieces(frames(spark, docs, items)[1], "item_id", "text").collect()]
    assert sorted(parts) == [(0, D.PART), (1, D.PART)]
    assert {g.doc_id for g in D.leaks(*frames(spark, docs, items)).collect()} == {2}


def test_clean_and_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b c d e f g h"), (2, "q r s t u v w"), (None, "z")], [(1, "a b c d e f g h")])
    assert {r.doc_id for r in D.clean(docs, items).collect()} == {2, None}
    assert D.leaks(docs.limit(0), items).count() == 0 and D.leaks(docs, items.limit(0)).count() == 0
    assert D.clean(docs, items.limit(0)).count() == 3


def test_clean_decides_by_id_and_text(spark):
    copy = "one two three four five six seven eight"
    rows = [(7, copy), (7, "a clean text of the same id"), (None, copy), (None, "another clean text"), (8, "x " + copy), (9, None), (9, copy)]
    docs, items = frames(spark, rows, [(1, copy)])
    assert sorted((str(r.doc_id), str(r.text)) for r in D.clean(docs, items).collect()) == sorted([("7", rows[1][1]), ("None", rows[3][1]), ("9", "None")])


def test_seeds_in_rounds_and_slices(spark, monkeypatch):
    r = rnd(9)
    items = [(i, prose(r, 20, 300)) for i in range(30)]
    docs = [(i, f"{prose(r, 60, 300)} {edited(r, items[i % 30][1], 2)} {prose(r, 60, 300)}") for i in range(60)]
    want = brute(docs, items)
    monkeypatch.setattr(D, "SEEDS", 100)
    assert {(g.doc_id, g.item_id) for g in D.leaks(*frames(spark, docs, items)).collect()} == want and len(want) >= 60


def test_query_against_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect() if len(r.text or "") < 2500]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    grams = {i: {tuple(w[k : k + 2]) for w in [plain(x)] for k in range(len(w) - 1)} for i, x in items}
    close = set()
    for d, t in docs:  # pairs that share few word pairs can't reach the score
        w = plain(t)
        own = {tuple(w[k : k + 2]) for k in range(len(w) - 1)}
        for i, x in items:
            if len(own & grams[i]) >= 0.2 * len(grams[i]) and smith_waterman(plain(x), w) >= D.SHARE * D.MATCH * len(plain(x)):
                close.add((d, i))
    kept = {d for d, _ in docs}
    got = {(g.doc_id, g.item_id) for g in catalog.QUERIES["op3_decontaminate"](spark, small).collect() if g.doc_id in kept}
    assert got == close
