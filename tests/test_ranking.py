"""Bucketed running sums, ranks and quantiles against plain ways."""

import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxwise.operators import ranking as R


def values(spark, n=500, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice("ab"), rng.choice([-2.5, 0.0, rng.random(), rng.random() * 1e5])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, k string, v double")


def test_running_sums_equal_a_plain_window(spark):
    _, df = values(spark)
    got = R.running_sums(df, ["k"], ["v", "id"], [R.order_bucket("v")], {"s": "id"})
    w = W.partitionBy("k").orderBy("v", "id").rowsBetween(W.unboundedPreceding, 0)
    want = df.withColumn("s", F.sum("id").over(w))
    assert sorted(got.collect()) == sorted(want.collect())


def test_quantiles_equal_numpy(spark):
    rows, df = values(spark)
    got = R.quantiles(df, "v", ["k"], {"q1": 0.1, "q5": 0.5, "q9": 0.99}).collect()
    for r in got:
        own = np.array([v for _, k, v in rows if k == r.k])
        assert np.allclose([r.q1, r.q5, r.q9], np.quantile(own, [0.1, 0.5, 0.99]))


def test_mid_percentile_shares_ties_and_handles_one_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("b", 5.0)], "k string, v double")
    got = sorted((r.k, r.v, r.percentile) for r in R.mid_percentile(df, "v", ["k"]).collect())
    assert got == [("a", 1.0, 0.25), ("a", 1.0, 0.25), ("a", 2.0, 1.0), ("b", 5.0, 0.5)]


def test_buckets_never_decrease(spark):
    rng = random.Random(5)
    vs = sorted([rng.uniform(-10, 10) for _ in range(200)] + [0.0, 1e-9, -1e-9, 1e12, -1e12])
    b = [r.b for r in spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "i int, v double").selectExpr("i", f"{R.order_bucket('v')} AS b").orderBy("i").collect()]
    assert b == sorted(b)
