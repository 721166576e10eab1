import numpy as np
import pytest

from boxwise.llm import catalog, forest

SCHEMA = "vec_id long, embedding array<double>, label int, node long, w long, h1 string"


def brute(rows):
    """(id, links, component, kept) over all pairs; rows are (id, vector, label)."""
    ok = [v is not None and len(v) > 0 and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    links = [set() for _ in rows]
    groups = {}
    for i, (_, v, lab) in enumerate(rows):
        if ok[i]:
            groups.setdefault((lab, len(v)), []).append(i)
    for at in groups.values():
        x = np.array([rows[i][1] for i in at], np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(x @ x.T >= 0.93)):
            if i != j:
                links[at[i]].add(at[j])
    component = [None] * len(rows)
    for i in range(len(rows)):
        if component[i] is None:
            seen, todo = {i}, [i]
            while todo:
                for k in links[todo.pop()] - seen:
                    seen.add(k)
                    todo.append(k)
            for k in seen:
                component[k] = (min((rows[s][0] for s in seen if rows[s][0] is not None), default=None),)
    return [(r[0], len(links[i]), component[i][0], r[0] == component[i][0]) for i, r in enumerate(rows)]


def result(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2, "clash") for r in rows], SCHEMA)
    return [tuple(r) for r in forest.near_duplicates(df, **options).select("vec_id", "n_links", "component_id", "kept").collect()]


def near(g, v, cosine):
    """A vector with this cosine to v."""
    r = g.standard_normal(len(v))
    r -= v * (r @ v) / (v @ v)
    r *= np.linalg.norm(v) / np.linalg.norm(r)
    return cosine * v + np.sqrt(1 - cosine**2) * r


def test_edge_cases(spark):
    a = [1.0, 2.0, 0.5]
    rows = [(1, a, 1), (2, a, 1), (2, a, 1), (3, [2.0, 4.0, 1.0], 1), (4, a, 2), (5, a, None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0, 0.0], 1), (9, [1.0, None, 0.5], 1)]
    rows += [(10, [1.0, float("nan"), 1.0], 1), (11, [float("inf"), 1.0, 1.0], 1), (None, a, 2), (None, [5.0, -1.0, 0.0], 3), (12, a + [0.0], 1), (13, [1e308, 2e308 / 1.2, 0.5e308], 1), (14, [-0.0, 3.0, 0.0], 3), (15, [0.0, 3.0, 0.0], 3)]
    assert sorted(result(spark, rows), key=str) == sorted(brute(rows), key=str)
    assert forest.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("model_bytes", [forest.MODEL_BYTES, 0])
def test_deep_trees_find_pairs_at_the_threshold(spark, monkeypatch, model_bytes):
    monkeypatch.setattr(forest, "MODEL_BYTES", model_bytes)
    g = np.random.default_rng(4)
    rows = []
    for i in range(400):
        v = g.standard_normal(64)
        rows += [(10 * i + k, (near(g, v, c) * g.uniform(0.5, 2)).tolist(), 1) for k, c in enumerate([1.0, 0.935, 0.96])]
    rows += [(10**6 + i, g.standard_normal(64).tolist(), 1) for i in range(600)]
    want, got = {r[0]: r for r in brute(rows)}, {r[0]: r for r in result(spark, rows, most=64)}
    assert set(want) == set(got) and all(got[k][1] <= want[k][1] for k in want)
    assert sum(r[1] for r in got.values()) >= 0.95 * sum(r[1] for r in want.values())


def test_a_tight_group_is_compared_by_blocks_and_counts_once(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 70)
    monkeypatch.setattr(forest, "COPIES", 20)
    g = np.random.default_rng(5)
    v = g.standard_normal(32)
    rows = [(i, near(g, v, 0.99).tolist(), 1) for i in range(300)] + [(1000 + i, v.tolist(), 1) for i in range(50)]
    rows += [(2000 + i, g.standard_normal(32).tolist(), 1) for i in range(300)] + [(3000 + i, near(g, v, 0.99).tolist(), 2) for i in range(5)]
    assert sorted(result(spark, rows, most=64)) == sorted(brute(rows))


def test_task_links_count_weights_once():
    import pandas as pd

    x = np.eye(3)
    rows = pd.DataFrame({"node": [1, 2, 3], "w": [5, 1, 1], "vec": [np.array([1.0, 0.01 * i, 0]).tobytes() for i in range(3)], "before": [[4], [4], []]})
    counted, links = forest.task_links(rows, rows, len(x), True)
    assert dict(counted) == {1: 1, 2: 1, 3: 6} and len(links) == 2


def test_query_equals_brute_force(spark, small):
    rows = [tuple(r) for r in catalog.table(spark, small, "embeddings").select("vec_id", "embedding", "label").collect()]
    got = catalog.QUERIES["op13_embedding_forest"](spark, small).select("vec_id", "n_links", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))
