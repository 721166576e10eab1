"""Running sums, ranks and exact quantiles over a global order without a one-task sort.

``Window.orderBy`` with few partition keys puts each key's rows in one task. The
helpers here cut every key's order into value buckets by a monotone, deterministic
expression, so a hot key is spread over thousands of groups: local windows run
inside (key, bucket), bucket totals are summed first and carried over as offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise.session import materialize


def order_bucket(value: str, resolution: int = 1024) -> str:
    """SQL text of a bucket number that never decreases with the value.

    Logarithmic in magnitude: scores in [0, 1] spread over ``resolution`` buckets,
    large values over ``resolution`` per doubling.
    """
    v = f"CAST({value} AS DOUBLE)"
    size = f"CAST(floor(log2(abs({v}) + 1.0D) * {resolution}) AS INT)"
    return f"CASE WHEN {v} < 0 THEN -{size} - 1 ELSE {size} END"


def attach(df: DataFrame, per_group: DataFrame, by: list[str]) -> DataFrame:
    """Join a per-group table; without keys it is the one row of a global aggregate."""
    if by:
        return df.join(per_group, by)
    one = F.lit(0).alias("_one")
    return df.select("*", one).join(F.broadcast(per_group.select("*", one)), "_one").drop("_one")


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: list[str],
    sums: dict[str, str],
) -> DataFrame:
    """Add inclusive running sums of ``sums`` along ``order`` inside each key.

    Orders, buckets and summed values are SQL texts over the columns of ``df``;
    ``bucket`` holds expressions that never decrease along ``order``. Texts keep the
    plan cheap to build when there are dozens of sums.
    """
    marks = [f"_b{i}" for i in range(len(bucket))]
    by = keys or ["_all"]
    columns = df.columns
    deltas = {name: f"_d_{name}" for name in sums}
    tagged = df.selectExpr(
        *columns,
        *([] if keys else ["0 AS _all"]),
        *[f"{b} AS {m}" for b, m in zip(bucket, marks)],
        *[f"{e} AS {deltas[n]}" for n, e in sums.items()],
    )
    group = ", ".join(by)
    place = ", ".join(by + marks)
    earlier = f"OVER (PARTITION BY {group} ORDER BY {', '.join(marks)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    offsets = (
        tagged.groupBy(*by, *marks)
        .agg(*[F.expr(f"sum({d}) AS {d}") for d in deltas.values()])
        .selectExpr(*by, *marks, *[f"coalesce(sum({d}) {earlier}, 0) AS _o_{n}" for n, d in deltas.items()])
    )
    local = f"OVER (PARTITION BY {place} ORDER BY {', '.join(order)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    summed = tagged.selectExpr(*columns, *([] if keys else ["_all"]), *marks, *[f"sum({d}) {local} AS {n}" for n, d in deltas.items()])
    right = offsets.withColumnsRenamed({c: f"_r{c}" for c in by + marks})
    on = None
    for c in by + marks:
        same = summed[c].eqNullSafe(right[f"_r{c}"])
        on = same if on is None else on & same
    return summed.join(right, on, "left").selectExpr(*columns, *[f"{n} + _o_{n} AS {n}" for n in sums])


def value_counts_before(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Distinct (by, value) with ``cnt`` copies and ``upto`` rows at or below the value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("cnt"))
    return running_sums(
        counts, by, [value], [order_bucket(value)], {"upto": "cnt"}
    )


def mid_percentile(
    df: DataFrame, value: str, by: list[str] | None = None, name: str = "percentile"
) -> DataFrame:
    """Mid-rank percentile in [0, 1]: ties share the mean position over n-1; n=1 gives 0.5."""
    by = by or []
    ranked = value_counts_before(df, value, by)
    size = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"))
    ranked = attach(ranked, size, by)
    position = (F.col("upto") - F.col("cnt")) + (F.col("cnt") - 1) / 2.0
    ranked = ranked.select(
        *by,
        value,
        F.when(F.col("_n") == 1, F.lit(0.5)).otherwise(position / (F.col("_n") - 1)).alias(name),
    )
    return df.join(ranked, [*by, value], "left")


def mid_percentiles(df: DataFrame, value: str, names: dict[str, list[str]]) -> DataFrame:
    """Several ``mid_percentile`` columns of one value, a list of keys for each name.

    The percentiles are found for distinct values and meet there, so the rows of ``df`` are dealt once for all of them.
    """
    finest = list(dict.fromkeys(k for by in names.values() for k in by))
    counts = materialize(df.where(F.col(value).isNotNull()).groupBy(*finest, value).agg(F.count("*").alias("cnt")))
    return df.join(percentiles_of(counts, value, names), [*finest, value], "left")


def percentiles_of(counts: DataFrame, value: str, names: dict[str, list[str]]) -> DataFrame:
    """The ``mid_percentiles`` of distinct values, from written rows (keys, value, cnt)."""
    finest = list(dict.fromkeys(k for by in names.values() for k in by))
    table = counts.select(*finest, value)
    for name, by in names.items():
        own = counts if set(by) == set(finest) else counts.groupBy(*by, value).agg(F.sum("cnt").alias("cnt"))
        ranked = running_sums(own, by, [value], [order_bucket(value)], {"upto": "cnt"})
        ranked = attach(ranked, counts.groupBy(*by).agg(F.sum("cnt").alias("_n")), by)
        position = (F.col("upto") - F.col("cnt")) + (F.col("cnt") - 1) / 2.0
        place = F.when(F.col("_n") == 1, F.lit(0.5)).otherwise(position / (F.col("_n") - 1))
        table = table.join(ranked.select(*by, value, place.alias(name)), [*by, value])
    return table


def quantiles(
    df: DataFrame, value: str, by: list[str], probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles with linear interpolation; no group is gathered in one task.

    One row per group with the columns named in ``probs``.
    """
    ranked = value_counts_before(df, value, by)
    size = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"))
    ranked = attach(ranked, size, by)
    before = F.col("upto") - F.col("cnt")

    def at(position: Column) -> Column:
        return F.max(F.when((before <= position) & (position < F.col("upto")), F.col(value)))

    picks, lines = [], []
    for name, q in probs.items():
        place = F.lit(float(q)) * (F.col("_n") - 1)
        picks += [
            at(F.floor(place)).alias(f"_lo_{name}"),
            at(F.ceil(place)).alias(f"_hi_{name}"),
            F.max(place - F.floor(place)).alias(f"_fr_{name}"),
        ]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        lines.append((lo + (hi - lo) * F.col(f"_fr_{name}")).alias(name))
    return ranked.groupBy(*by).agg(*picks).select(*by, *lines)


def distribution(
    df: DataFrame,
    value: str,
    by: list[str] | None = None,
    probs: dict[str, float] | None = None,
) -> DataFrame:
    """Count, mean, population deviation, extremes and exact quantiles per group."""
    by = by or []
    probs = probs or {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    basic = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by)
        .agg(
            F.count("*").alias("count"),
            F.avg(value).alias("mean"),
            F.stddev_pop(value).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
        )
    )
    exact = quantiles(df, value, by, probs)
    return attach(basic, exact, by)


def global_position(df: DataFrame, value: str, tie: str, name: str = "position") -> DataFrame:
    """1-based position of every row in the order (value, tie) over the whole table."""
    return running_sums(df, [], [value, tie], [order_bucket(value)], {name: "1"})
