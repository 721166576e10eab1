"""Array sums against window sums, and the bootstrap's evidence against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwise.operators import precision as P
from boxwise.operators import stats as ST
from boxwise.operators import weighted as Wt
from boxwise.session import materialize

CACHE = "model string, image_id long, category_id int, prediction_index long, score double, rank int, tp long, ignored long"
COUNTS = "image_id long, category_id int, g0 long, g1 long, g2 long, g3 long"


def made(spark, seed, rows, scores):
    r = random.Random(seed)
    bits = lambda p: sum(1 << k for k in range(40) if r.random() < p)
    cache = []
    for i in range(rows):
        tp = bits(0.4)
        cache.append((r.choice("ab"), r.randrange(30), r.choice([1, 2, 5]), i, r.choice(scores), r.randrange(1, 15), tp, bits(0.2) & ~tp))
    # classes 7 (no detections) and 5 (no objects in one area)
    counts = [(i, c, r.randrange(1, 90), r.randrange(30), 0 if c == 5 else r.randrange(30), r.randrange(30)) for i in range(30) for c in (1, 2, 5, 7)]
    weights = [(i, k, r.choice([0, 1, 1, 2, 5])) for i in range(30) for k in range(4)]
    weights = [w for w in weights if w[2] and w[0] != 11]
    return spark.createDataFrame(cache, CACHE), spark.createDataFrame(counts, COUNTS), spark.createDataFrame(weights, "image_id long, replicate int, weight long")


def rounded(df, columns):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("scores", [[0.5], [0.1, 0.2, 0.9], [k / 997 for k in range(997)]], ids=["one score", "few", "many"])
def test_array_sums_equal_window_sums(spark, monkeypatch, scores):
    monkeypatch.setattr(Wt, "FAN", 3)
    cache, counts, weights = (materialize(x) for x in made(spark, 3, 900, scores))
    rows = materialize(Wt.placed(cache, ["model"], 70))
    assert rows.select("block").distinct().count() > 9
    got = Wt.evaluate_columns(rows, counts, ["model"], Wt.weight_table(weights, "replicate", 4), 4)
    want = P.evaluate_cells(cache.join(weights, "image_id"), counts.join(weights, "image_id").withColumn("model", F.explode(F.array(F.lit("a"), F.lit("b")))), ["model", "replicate"], "weight")
    columns = ["model", "replicate", "category_id", "area", "threshold", "gt", "ap", "recall100", "recall10", "recall1"]
    assert rounded(got.withColumnRenamed("column", "replicate"), columns) == rounded(want, columns)


def test_plain_weights_and_nothing(spark):
    cache, counts, _ = made(spark, 4, 300, [0.1, 0.5])
    columns = ["category_id", "area", "threshold", "gt", "ap", "recall100", "recall10", "recall1"]
    got = Wt.evaluate_columns(materialize(Wt.placed(cache, [])), counts, [])
    assert rounded(got, columns) == rounded(P.evaluate_cells(cache, counts, []), columns)
    empty = Wt.evaluate_columns(materialize(Wt.placed(cache.limit(0), [])), counts, [])
    assert {r.ap for r in empty.collect()} == {0.0} and Wt.evaluate_columns(materialize(Wt.placed(cache, [])), counts.limit(0), []).count() == 0


def test_bootstrap_evidence_equals_plain_sums(spark):
    r = random.Random(6)
    images = spark.range(40).selectExpr("id AS image_id")
    objects = [(i, i * 10 + k, r.choice([1, 2]), 0.0 + 100 * k, 0.0, 40.0, 40.0, 1600.0) for i in range(40) for k in range(3)]
    objects = spark.createDataFrame(objects, "image_id long, annotation_id long, category_id int, x double, y double, w double, h double, area double")
    cache, _, _ = made(spark, 8, 500, [k / 97 for k in range(97)])
    caches = {m: materialize(cache.where(F.col("model") == m).drop("model")) for m in "ab"}
    deltas = ST.paired_bootstrap(objects, images, caches, "a", 6, batch=4).collect()
    weights = {(w.replicate, w.image_id): w.weight for w in ST.bootstrap_weights(images, 6).collect()}
    rows = {m: [x.asDict() for x in caches[m].collect()] for m in "ab"}
    gt = [x.asDict() for x in objects.collect()]

    def ap(m, rep, cell):
        values = []
        for c in (1, 2):
            total = sum(weights.get((rep, o["image_id"]), 0) for o in gt if o["category_id"] == c)
            t = n = 0
            best = [0.0] * 101
            for x in sorted((x for x in rows[m] if x["category_id"] == c), key=lambda x: (-x["score"], x["image_id"], x["rank"])):
                w = weights.get((rep, x["image_id"]), 0)
                n += w * (1 - (x["ignored"] >> cell & 1))
                if w and x["tp"] >> cell & 1:
                    t += w
                    for k in range(101):
                        if k * 0.01 <= t / total:
                            best[k] = max(best[k], t / (n + 2.220446049250313e-16))
            values.append(sum(best) / 101)
        return sum(values) / 2

    assert len(deltas) == 6 * len(ST.METRICS)
    for d in deltas:
        if d.metric in ("AP50", "AP75"):
            cell = 0 if d.metric == "AP50" else 5
            assert abs(d.delta - (ap("b", d.replicate, cell) - ap("a", d.replicate, cell))) < 1e-9


def test_weight_table_by_array(spark):
    """An image's weights are laid into its array in one pass, without a lookup per column; columns of other batches are left out."""
    rows = [(7, 10, 3), (7, 12, 1), (8, 11, 2), (8, 9, 5), (9, 13, 4)]
    df = spark.createDataFrame(rows, "image_id long, replicate int, weight long")
    table = Wt.weight_table(df, "replicate", 3, 10)
    assert {r.image_id: list(r.weights) for r in table.collect()} == {7: [3, 0, 1], 8: [0, 2, 0], 9: [0, 0, 0]}
    assert "map_from_entries" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert table.schema["weights"].dataType.simpleString() == "array<smallint>" and Wt.weight_table(df.limit(0), "replicate", 3).count() == 0


def test_curve_points_count_only_what_is_not_ignored():
    rng = np.random.default_rng(3)
    n, width = 400, 5
    w = rng.integers(0, 3, (width, n)).astype(np.int32)
    tp = rng.integers(0, 1 << Wt.CELLS, n) & rng.integers(0, 1 << Wt.CELLS, n)
    ignored = rng.integers(0, 1 << Wt.CELLS, n) & ~tp & ~((1 << Wt.THRESHOLDS) - 1)
    before = rng.integers(0, 50, (2, Wt.CELLS, width)).astype(float)
    gt = rng.integers(0, 2, (Wt.AREAS, width)) * 900.0
    place, best = Wt.curve_points(w, tp, ignored, before, gt)
    want = {}
    for c in range(Wt.CELLS):
        for k in range(width):
            if gt[c // Wt.THRESHOLDS, k] > 0:
                t = np.cumsum(w[k] * ((tp >> c) & 1)) + before[0, c, k]
                m = np.cumsum(w[k] * (1 - ((ignored >> c) & 1))) + before[1, c, k]
                for i in np.flatnonzero((tp >> c) & 1):
                    recall = t[i] / gt[c // Wt.THRESHOLDS, k]
                    level = max(j for j in range(-1, 101) if j * 0.01 <= recall)
                    at = (c * width + k) * Wt.LEVELS + level
                    want[at] = max(want.get(at, 0), t[i] / (m[i] + Wt.EPS))
    assert dict(zip(place.tolist(), best.tolist())) == want
