"""Time the headline jobs and print one JSON line.

Jobs run in pipeline order, each reading the stored result of the one before it, as
a production run would; ``inputs`` is the projection of the star-schema tables into
objects and detections.
"""

import json
import os
import sys
import time

from boxwise.session import local_session


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    import boxwise.catalog.more  # noqa: F401
    from boxwise.catalog.queries import QUERIES
    from boxwise.catalog.views import views

    v = views(spark, folder)
    done: dict[str, float] = {}

    def timed(name, job):
        start = time.time()
        df = job()
        if df is not None:
            df.write.format("noop").mode("overwrite").save()
        done[name] = round(time.time() - start, 3)
        print(name, done[name], file=sys.stderr, flush=True)

    timed("inputs", lambda: (v.objects, v.dets, v.hot) and None)
    timed("match_status_both", lambda: v.status and None)
    jobs = [
        "jn2_greedy_match",
        "jn6_false_positives",
        "jn8_image_summary",
        "sc4_risk_score",
        "agg13_subset_summary",
        "agg14_subset_overlap",
        "agg11_image_risk",
        "win4_threshold_sweep",
        "win5_threshold_grid",
        "agg16_coco_eval",
        "agg17_coco_eval_per_class",
        "agg18_coco_eval_by_condition",
        "agg19_subset_recovery",
        "st1_paired_bootstrap",
        "st1_bootstrap_evidence",
        "st8_sensitivity",
        "agg20_exposure_summary",
        "agg22_crop_context",
        "smp5_typed_quota_sample",
        "smp6_matched_sample",
    ]
    for name in jobs:
        timed(name, lambda: QUERIES[name](spark, folder))
    print(
        json.dumps(
            {
                "metric": "detection evaluation jobs, total wall time",
                "value": round(sum(done.values()), 3),
                "unit": "sec",
                "queries": done,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
