"""Masks of the match cache against the protocol in plain Python, crowds and hot images included."""

import random

import pytest
from pyspark.sql import functions as F

from boxwise import constants as K
from boxwise.operators import matching as M
from boxwise.operators import precision as P

OBJECT = "image_id long, annotation_id long, category_id int, x double, y double, w double, h double, area double, iscrowd int"
DETECTION = "image_id long, prediction_index long, category_id int, x double, y double, w double, h double, score double"
RANGES = ((0.0, 1e10), (0.0, 1024.0), (1024.0, 9216.0), (9216.0, 1e10))


def overlap(g, d):
    """IoU, or for a crowd the covered part of the detection."""
    iw = min(g[3] + g[5], d[3] + d[5]) - max(g[3], d[3])
    ih = min(g[4] + g[6], d[4] + d[6]) - max(g[4], d[4])
    inter = max(iw, 0.0) * max(ih, 0.0)
    base = d[5] * d[6] if g[8] else g[5] * g[6] + d[5] * d[6] - inter
    return inter / base if base > 0 else 0.0


def protocol(objects, dets, most):
    """{prediction_index: (tp, ignored)} by walking each detection over the objects, counted ones first."""
    out = {}
    for key in {(d[0], d[2]) for d in dets}:
        own = sorted((d for d in dets if (d[0], d[2]) == key), key=lambda d: (-d[7], d[1]))[:most]
        masks = {d[1]: [0, 0] for d in own}
        for a, (low, high) in enumerate(RANGES):
            out_of = lambda area: area < low or area > high
            gts = sorted((g for g in objects if (g[0], g[2]) == key), key=lambda g: g[1])
            gts.sort(key=lambda g: bool(g[8]) or out_of(g[7]))
            skip = [bool(g[8]) or out_of(g[7]) for g in gts]
            for t, level in enumerate(K.IOU_THRESHOLDS):
                taken = set()
                for d in own:
                    best, found = level, -1
                    for j, g in enumerate(gts):
                        if j in taken and not g[8]:
                            continue
                        if found > -1 and not skip[found] and skip[j]:
                            break
                        if overlap(g, d) >= best:
                            best, found = overlap(g, d), j
                    bit = 1 << (a * len(K.IOU_THRESHOLDS) + t)
                    if found > -1:
                        taken.add(found)
                        masks[d[1]][1 if skip[found] else 0] |= bit
                    elif out_of(d[5] * d[6]):
                        masks[d[1]][1] |= bit
        out |= {p: tuple(m) for p, m in masks.items()}
    return out


def scene(seed, images, objects, dets, crowds):
    r = random.Random(seed)
    gt, ds = [], []
    for i in range(images):
        for _ in range(objects):
            w, h = (float(r.choice([12, 30, 34, 90, 110])) for _ in range(2))
            gt.append((i, len(gt) + 1, r.randint(1, 2), float(r.randint(0, 60)), float(r.randint(0, 60)), w, h, w * h, int(r.random() < crowds)))
        own = [g for g in gt if g[0] == i]
        for _ in range(dets):
            g = r.choice(own)
            shrink = r.choice([1.0, 1.0, 0.5]) if g[8] else 1.0
            ds.append((i, len(ds) + 1, g[2], g[3] + r.randint(-3, 3), g[4] + r.randint(-3, 3), g[5] * shrink, g[6] * shrink, r.randint(1, 9) / 10))
    return gt, ds


@pytest.mark.parametrize("crowds", [0.0, 0.3, 1.0], ids=["none", "some", "all"])
@pytest.mark.parametrize("hot", [False, True], ids=["cold", "hot"])
def test_masks_follow_the_protocol(spark, crowds, hot):
    gt, ds = scene(11, 5, 9, 24, crowds)
    o, d = spark.createDataFrame(gt, OBJECT), spark.createDataFrame(ds, DETECTION)
    for most in (100, 6):
        images = spark.createDataFrame([(0,), (3,)], "image_id long") if hot else None
        got = P.match_cache(o, d, most, images).collect()
        want = protocol(gt, ds, most)
        assert {r.prediction_index: (r.tp, r.ignored) for r in got} == want
    if crowds:
        assert any(bin(m[1]).count("1") for m in want.values())


def test_one_crowd_takes_many(spark):
    """Three detections inside a crowd are ignored, not false; the one on a counted object is a hit; null marks say no."""
    gt = [(1, 1, 1, 0.0, 0.0, 100.0, 100.0, 10000.0, 1), (1, 2, 1, 200.0, 0.0, 40.0, 40.0, 1600.0, None)]
    ds = [(1, k, 1, 10.0 * k, 5.0, 40.0, 40.0, 0.5) for k in range(3)] + [(1, 9, 1, 200.0, 0.0, 40.0, 40.0, 0.4)]
    o, d = spark.createDataFrame(gt, OBJECT), spark.createDataFrame(ds, DETECTION)
    got = {r.prediction_index: (r.tp & 1, r.ignored & 1) for r in P.match_cache(o, d).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (0, 1), 9: (1, 0)}
    row = P.coco_eval(o, d).first()
    assert round(row.AP, 6) == 1.0 and row.AR100 == 1.0
    assert P.coco_eval(o.where(F.col("iscrowd") == 1), d).first().AP is None
    assert M.hot_images(o, d) is None
