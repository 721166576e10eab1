"""Tables on the way to another one, and the shuffle files of a write, go as soon as that one stands."""

import os
import re

from pyspark.sql import functions as F

from boxwise import session
from boxwise.catalog import views as V
from boxwise.operators import matching as M
from boxwise.operators import precision as P
from boxwise.operators import risk as RI
from tests.test_matching import frames, scene


def paths(df) -> list[str]:
    return [f.removeprefix("file:").replace("//", "/") for f in df.inputFiles()]


def shuffle_files(spark) -> int:
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(name.startswith("shuffle_") and name.endswith(".data") for d in top for _, _, names in os.walk(d) for name in names)


def test_steps_go_when_the_table_stands(spark):
    steps = []

    def make():
        steps.append(session.materialize(spark.range(5)))
        steps.append(session.written(lambda: session.materialize(spark.range(7)), keep=False))
        steps.append(session.written(lambda: spark.range(9)))
        return steps[0].union(steps[1])

    table = session.written(make)
    assert sorted(r.id for r in table.collect()) == sorted([*range(5), *range(7)])
    assert steps[2].count() == 9
    there = [all(map(os.path.exists, paths(s))) for s in (*steps, table)]
    assert there == [False, False, True, True]


def test_steps_of_a_failure_go(spark):
    steps = []

    def make():
        steps.append(paths(session.materialize(spark.range(5))))
        raise ValueError

    try:
        session.written(make)
    except ValueError:
        pass
    assert steps[0] and not any(map(os.path.exists, steps[0]))


def test_a_write_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    dealt = spark.range(2000).groupBy((F.col("id") % 97).alias("k")).agg(F.sum("id").alias("s"))
    assert len(session.materialize(dealt).collect()) == 97
    session.materialize(dealt.join(dealt.withColumnRenamed("s", "t"), "k"))
    assert shuffle_files(spark) <= before


def test_risk_of_written_outcomes_is_that_of_all_columns(spark):
    """Qualities found per detector before the join, and consensus and disagreement after the ranks, change no value."""
    o, d = frames(spark, *scene(11))
    o = o.withColumn("scale", F.lit("small"))
    status = {m: M.object_status(o, d.where(F.col("prediction_index") % k > 0), 0.3, keep=["scale"]) for m, k in (("a", 3), ("b", 2))}
    shared, own = ["image_id", "category_id", "scale"], ["annotation_id", "image_id", "category_id", "scale", "a_status"]
    wide = M.join_models(status["a"], status["b"].where(F.col("annotation_id") % 5 > 0), shared)
    want = RI.risk_table(wide, {"a": 0.3, "b": 0.3}, keep=own)
    stored = RI.detector_qualities(wide, {"a": 0.3, "b": 0.3}).select(*own, "a_quality", F.coalesce("b_quality", F.lit(0.0)).alias("b_quality"))
    got = RI.risk_table(session.materialize(stored), keep=own, stored=True)
    assert got.columns == want.columns and "disagreement" in got.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_views_keep_no_pairs_that_nobody_asked_for(spark, folder):
    v = V.Views(spark, folder)
    known = session._WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    before = list(known)
    assert v.risk.count() > 0
    kept = {re.search(r"boxwise-\w+", p)[0] for p in known if p not in before}
    read = {re.search(r"boxwise-\w+", p)[0] for df in (v.risk, v.outcomes, v.objects) for p in paths(df)}
    assert kept == read and not v.pairs and not v.status


def test_match_cache_is_made_in_steps(spark):
    """Ranks, pairs and masks are written, so the last step is one join of what stands."""
    o, d = frames(spark, *scene(12))
    o = o.withColumn("area", F.col("w") * F.col("h"))
    plan = P.match_cache(o, d, hot=None)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and plan.count("Join ") == 1
