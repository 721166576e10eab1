"""Registered queries against their SQL on the smallest tables.

A spread of queries runs by default; BOXWISE_ALL=1 runs every one (tools/check.py does so too).
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of, same

SPREAD = [
    "flt1_detection_errors", "flt3_duplicate_objects", "jn4_object_status", "jn6_false_positives", "jn10_segment_evidence", "jn12_multi_threshold_match",
    "agg6_failure_rates", "agg13_subset_summary", "agg17_coco_eval_per_class", "win5_threshold_grid", "sc4_risk_score", "sc10_crop_labels",
    "smp6_matched_sample", "smp11_diverse_pick", "st1_bootstrap_weights", "st3_bh_adjust", "src4_read_detections", "snk2_norm_label_lines",
]
NAMES = list(entry.oracle_sql()) if os.environ.get("BOXWISE_ALL") else SPREAD


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, folder, duck, name):
    df = entry.queries()[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert all(all(map(same, a, b)) for a, b in zip(got[1], want[1]))


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
