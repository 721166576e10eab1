"""Failure subsets at several operating points, against the risk table of every combination, row by row."""

import random

from pyspark.sql import functions as F

from boxwise.operators import matching as M
from boxwise.operators import ranking as RK
from boxwise.operators import risk as RI
from boxwise.operators import sensitivity as SE
from tests.test_matching import frames, scene

POINTS = {"a": {"low": (0.1, 0.6), "central": (0.4, 0.62), "high": (0.7, 0.61)}, "b": {"low": (0.2, 0.58), "central": (0.5, 0.6)}}


def by_rows(objects, pairs, central):
    """The long way: a row per object and combination through ranks and joins."""
    status = {m: SE.status_at_points(objects, pairs[m], POINTS[m], None, ["scale"]) for m in "ab"}
    risk = SE.combination_risk(status["a"], status["b"], ["image_id", "category_id", "scale"])
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in RI.subset_flags().items()]))
    return RI.subset_drift(risk.select("combination", "annotation_id", "image_id", F.explode(names).alias("subset")), central)


def inputs(spark):
    o, d = frames(spark, *scene(21))
    r = random.Random(4)
    ids = [row.annotation_id for row in o.select("annotation_id").collect()]
    more = spark.createDataFrame([(i, r.choice(["small", "small", "large", None])) for i in ids], "annotation_id long, scale string")
    o = o.join(more, "annotation_id")
    # numbers that come twice, a class and an image that are missing
    o = o.unionByName(o.where("annotation_id % 9 = 0").withColumn("scale", F.lit("small")))
    o = o.withColumn("category_id", F.when(F.col("annotation_id") % 13 > 0, F.col("category_id")))
    o = o.withColumn("annotation_id", F.when(F.col("annotation_id") % 17 > 0, F.col("annotation_id"))).cache()
    pairs = {m: M.iou_pairs(o, d.where(F.col("prediction_index") % k > 0), 0.0, False, None).cache() for m, k in (("a", 4), ("b", 3))}
    return o, pairs


def test_subsets_are_those_of_the_risk_tables(spark):
    o, pairs = inputs(spark)
    rows = lambda df: sorted(map(str, (r.asDict() for r in df.select(sorted(df.columns)).collect())))
    for central in ("a_central__b_central", "a_low__b_central"):
        want = rows(by_rows(o, pairs, central))
        assert len({w.split("'combination': '")[1].split("'")[0] for w in want}) == 6
        assert rows(SE.sensitivity(o, pairs, POINTS, central)) == want


def test_no_table_has_a_row_per_combination(spark, monkeypatch):
    o, pairs = inputs(spark)
    o = o.where("annotation_id IS NOT NULL").dropDuplicates(["annotation_id"])
    sizes = []
    keep = SE.materialize

    def counted(df):
        table = keep(df)
        if "annotation_id" in table.columns:
            sizes.append(table.count())
        return table

    for module in (SE, RI, RK, M):
        monkeypatch.setattr(module, "materialize", counted, raising=False)
    SE.sensitivity(o, pairs, POINTS, "a_central__b_central").collect()
    assert sizes and max(sizes) <= o.count()
