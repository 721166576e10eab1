"""Overlaps by levels, connected parts, and the match of dense images against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from boxwise.operators import crops as CR
from boxwise.operators import grid as G
from boxwise.operators import matching as M
from boxwise.operators.parts import connected
from tests.test_matching import frames, greedy, pairs


def boxes(seed, n):
    r = random.Random(seed)
    side = lambda: r.choice([0.5, 8.0, 9.0, 40.0, 300.0, 5000.0]) * r.uniform(0.5, 1.5)
    return [(r.randrange(3), i, r.uniform(-2000, 2000), r.uniform(-900, 900), side(), side()) for i in range(n)] + [(1, n + k, 8.0, 16.0, 8.0, 8.0) for k in range(4)]


def test_every_overlap_once(spark):
    a, b = boxes(1, 120), boxes(2, 120)
    left = spark.createDataFrame(a, "image_id long, i long, gx double, gy double, gw double, gh double")
    right = spark.createDataFrame(b, "_image long, j long, dx double, dy double, dw double, dh double")
    got = sorted((x.i, x.j) for x in G.overlap_join(left, right, "g", "d").collect())
    meet = lambda p, q: p[0] == q[0] and p[2] < q[2] + q[4] and q[2] < p[2] + p[4] and p[3] < q[3] + q[5] and q[3] < p[3] + p[5]
    assert got == sorted((p[1], q[1]) for p in a for q in b if meet(p, q))
    assert G.overlap_join(left.limit(0), right, "g", "d").count() == 0


def test_connected_parts_of_a_long_chain(spark):
    r = random.Random(3)
    names = list(range(60))
    r.shuffle(names)
    edges = [(1, a, b) for a, b in zip(names, names[1:])] + [(2, 5, 9), (2, 9, 70), (1, 100, 101)]
    got = {(x.k, x.node): x.part for x in connected(spark.createDataFrame(edges, "k int, a long, b long"), ["k"]).collect()}
    assert {v for (k, n), v in got.items() if k == 1 and n < 60} == {0}
    assert got[2, 70] == got[2, 9] == 5 and got[1, 101] == 100 and len(got) == 65


@pytest.mark.parametrize("most", [10**6, 3])
def test_dense_match_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(M, "FOLD_PAIRS", most)
    r = random.Random(4)
    gt = [(0, k, r.choice([1, 2]), r.uniform(-200, 200), r.uniform(0, 200), r.choice([10.0, 60.0]), r.choice([10.0, 60.0])) for k in range(90)]
    gt += [(0, 90 + k, 1, 500.0, 0.0, 20.0, 20.0) for k in range(5)]
    ds = [(0, k, g[2], g[3] + r.uniform(-4, 4), g[4] + r.uniform(-4, 4), g[5], g[6], r.choice([0.3, 0.5, 0.9])) for k, g in enumerate(gt + gt[:40])]
    o, d = frames(spark, gt, ds)
    hot = spark.createDataFrame([(0,)], "image_id long")
    assert pairs(M.greedy_match(o, d, 0.3, hot=hot)) == greedy(gt, ds, 0.3)


def test_context_counts_objects_off_the_crop(spark):
    r = random.Random(5)
    rows = [(i % 2, i, 1, r.uniform(0, 900), r.uniform(0, 500), r.choice([6.0, 80.0]), r.choice([6.0, 80.0])) for i in range(60)]
    objects = spark.createDataFrame(rows, "image_id long, annotation_id long, category_id int, x double, y double, w double, h double")
    targets = objects.where("annotation_id % 3 = 0").withColumns({"failure_group": F.lit("x"), "width": F.lit(1280), "height": F.lit(720)})
    crops = CR.plan_crops(targets)
    got = {c.annotation_id: c for c in CR.crop_context(crops, objects).collect()}
    every = CR.crop_neighbours(crops, objects).collect()
    for a, c in got.items():
        own = [n for n in every if n.annotation_id == a and not n.is_target]
        assert c.source_neighbor_count == len(own) and c.fully_removed_objects == sum(n.removed for n in own)
        assert c.retained_neighbor_count == sum(n.retained for n in own) and c.boundary_clipped_objects == sum(n.clipped for n in own)
        assert c.crop_object_count == sum(n.supervised for n in every if n.annotation_id == a)
    assert len(got) == 20


def test_classes_of_a_dense_image_need_no_parts(spark, monkeypatch):
    """Groups of a size that one task may go through aren't cut into connected parts first."""
    monkeypatch.setattr(M, "connected", None)
    r = random.Random(6)
    gt = [(i, 100 * i + k, r.choice([1, 2]), r.uniform(0, 90), r.uniform(0, 90), r.choice([10.0, 30.0]), 20.0) for i in range(3) for k in range(60)]
    ds = [(g[0], k, g[2], g[3] + r.uniform(-4, 4), g[4] + r.uniform(-4, 4), g[5], g[6], r.choice([0.3, 0.5, 0.9])) for k, g in enumerate(gt + gt)]
    o, d = frames(spark, gt, ds)
    assert pairs(M.greedy_match(o, d, 0.3, hot=o.select("image_id").distinct())) == greedy(gt, ds, 0.3)


@pytest.mark.parametrize("least", [0.3, 0.5, 0.999])
def test_least_overlap_loses_no_pair(spark, least):
    """With a least IoU boxes of too unlike sizes don't meet; all that reach it do."""
    r = random.Random(7)
    a = [(0, i, r.uniform(0, 60), r.uniform(0, 60), r.choice([8.0, 16.0, 17.0, 64.0]), r.choice([8.0, 16.0, 33.0])) for i in range(150)]
    b = [(0, i, x + r.choice([0.0, 1.0, 3.0]), y, w * r.choice([1.0, 0.5, 2.0, 0.3]), h) for _, i, x, y, w, h in a]

    def like(p, q):
        w = min(p[2] + p[4], q[2] + q[4]) - max(p[2], q[2])
        h = min(p[3] + p[5], q[3] + q[5]) - max(p[3], q[3])
        return w * h / (p[4] * p[5] + q[4] * q[5] - w * h) if w > 0 and h > 0 else 0.0

    left = spark.createDataFrame(a, "image_id long, i long, gx double, gy double, gw double, gh double")
    right = spark.createDataFrame(b, "_image long, j long, dx double, dy double, dw double, dh double")
    got = [(x.i, x.j) for x in G.overlap_join(left, right, "g", "d", min_iou=least).collect()]
    want = {(p[1], q[1]) for p in a for q in b if like(p, q) >= least}
    assert len(got) == len(set(got)) and want and want <= set(got)
    assert len(got) < G.overlap_join(left, right, "g", "d").count() / 2
