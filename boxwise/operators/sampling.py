"""Hash-ranked splits and samples, quota and matched selection, case picking, audits.

Greedy selections that walk a sorted list with a "used images" set are one-to-one
choices with a common order, so they run as a few rounds of joins and top-n windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxwise import constants as K
from boxwise.functions.hashing import hash_rank, hash_uniform
from boxwise.functions.labels import failure_group
from boxwise.functions.risk import risk_bin, risk_weight
from boxwise.operators.ranking import attach, global_position, order_bucket, running_sums
from boxwise.session import checkpoint


def with_hash_rank(df: DataFrame, namespace: str, key: str, seed=K.SAMPLING_SEED) -> DataFrame:
    return df.withColumn("hash_rank", hash_rank(seed, namespace, F.col(key)))


def _hash_value(rank: str) -> str:
    """Monotone number of a hex hash rank, for bucketing."""
    return f"CAST(conv(substring({rank}, 1, 12), 16, 10) AS DOUBLE) / 281474976710656D"


def stratified_split(images: DataFrame, n: int, strata=("timeofday", "scene"), seed=K.SAMPLING_SEED) -> DataFrame:
    """Mark ``n`` images as dev, proportionally to the strata, by hash rank.

    Quotas are largest remainders: floors first, then one more for the largest fractions.
    """
    keys = list(strata)
    sizes = images.groupBy(*keys).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    share = F.col("size") * F.lit(n) / F.col("total")
    v = attach(sizes, total, []).select(
        *keys, F.floor(share).cast("long").alias("base"), (share - F.floor(share)).alias("rest")
    )
    # One row per stratum: attribute values only.
    everything = W.partitionBy(F.lit(0))
    left = F.lit(n) - F.sum("base").over(everything)
    place = F.row_number().over(everything.orderBy(F.desc("rest"), *keys))
    quota = v.select(*keys, (F.col("base") + F.when(place <= left, 1).otherwise(0)).alias("quota"))
    ranked = with_hash_rank(images, "dev_split", "image_id", seed).join(quota, keys).withColumn("_h", F.expr(_hash_value("hash_rank")))
    placed = running_sums(ranked, keys, ["hash_rank", "image_id"], [order_bucket("_h")], {"_r": "1L"})
    return placed.select(
        *images.columns, F.when(F.col("_r") <= F.col("quota"), "dev").otherwise("core").alias("assigned")
    )


def weighted_priority(risk: DataFrame, namespace: Column | str, seed=K.SAMPLING_SEED) -> DataFrame:
    """Exponential-race priority -ln(u)/w: taking the smallest is sampling by weight."""
    u = hash_uniform(seed, namespace, F.col("annotation_id"))
    return risk.withColumn("priority", -F.log(u) / risk_weight(F.col("risk_score")))


def with_failure_group(risk: DataFrame) -> DataFrame:
    return risk.withColumn(
        "failure_group", failure_group(F.col("scale"), F.col("risk_tier"), F.col("a_status"), F.col("a_detected"), F.col("b_detected"))
    )


def typed_quota_sample(
    risk: DataFrame,
    quotas: dict[str, int] | None = None,
    max_class_fraction: float = K.MAX_CLASS_FRACTION,
    min_support: int = K.MIN_CLASS_SUPPORT,
    seed=K.SAMPLING_SEED,
    strict: bool = True,
) -> DataFrame:
    """Fill group quotas in order by weighted priority; an image serves once, classes are capped.

    A quota that can't be filled is an error that names group, selected and required rows; with
    ``strict=False`` the shorter sample is returned, and ``shortfall`` tells what it lacks.

    Inside a group the best row per free image is taken in priority order. Rows before
    the first one that breaks a class cap are final; that class then closes and the rest
    of the group is chosen again. A cap fraction f lets at most 1/f classes close.
    """
    quotas = quotas or K.GROUP_QUOTAS
    slots = sum(quotas.values())
    cap = int(slots * max_class_fraction)
    support = risk.groupBy("category_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_support)
    pool = with_failure_group(risk).join(F.broadcast(support.select("category_id")), "category_id", "left_semi")
    namespace = F.concat(F.lit("typed:"), F.col("failure_group"))
    pool = weighted_priority(pool.where(F.col("failure_group").isin(*quotas)), namespace, seed)
    columns = ["annotation_id", "image_id", "category_id", "scale", "risk_score", "failure_group", "priority"]
    pool = checkpoint(pool.select(*columns))
    chosen: DataFrame | None = None
    used: dict[int, int] = {}
    for group, quota in quotas.items():
        need, closed = quota, [c for c, n in used.items() if n >= cap]
        while need > 0:
            free = pool.where((F.col("failure_group") == group) & ~F.col("category_id").isin(closed or [-1]))
            if chosen is not None:
                free = free.join(chosen.select("image_id"), "image_id", "left_anti")
            best = free.groupBy("image_id").agg(F.min(F.struct("priority", *[c for c in columns if c not in ("priority", "image_id")])).alias("b"))
            best = best.select("image_id", "b.*").select(*columns)
            ranked = global_position(best, "priority", "annotation_id").where(F.col("position") <= need)
            ranked = checkpoint(_class_position(ranked))
            room = [F.when(F.col("category_id") == c, F.lit(cap - n)) for c, n in used.items()]
            over = ranked.where(F.col("class_position") > F.coalesce(*room, F.lit(cap)))
            stop = over.agg(F.min(F.struct("position", "category_id")).alias("m")).first()["m"]
            taken = ranked if stop is None else ranked.where(F.col("position") < stop["position"])
            taken = taken.select(*columns)
            counts = {r["category_id"]: r["count"] for r in taken.groupBy("category_id").count().collect()}
            for c, n in counts.items():
                used[c] = used.get(c, 0) + n
            need -= sum(counts.values())
            chosen = checkpoint(taken if chosen is None else chosen.unionByName(taken))
            if stop is None:
                break
            closed = closed + [stop["category_id"]]
        if need > 0 and strict:
            raise ValueError(f"group {group}: {quota - need} rows of {quota} can be selected")
    return chosen if chosen is not None else pool.limit(0)


def shortfall(selection: DataFrame, required: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, required, selected) of groups or strata of which a selection has fewer rows than required."""
    have = selection.groupBy(*keys).agg(F.count("*").alias("selected"))
    out = required.select(*keys, "required").join(have, keys, "left").withColumn("selected", F.coalesce("selected", F.lit(0)))
    return out.where(F.col("selected") < F.col("required"))


def _class_position(ranked: DataFrame) -> DataFrame:
    return running_sums(ranked, ["category_id"], ["position"], [order_bucket("position")], {"class_position": "1"})


STRATA = {
    "joint": ["category_id", "scale", "risk_bin"],
    "class": ["category_id"],
}


def matched_sample(
    risk: DataFrame,
    target: DataFrame,
    strata: str = "joint",
    mode: str = "uniform",
    seed=K.SAMPLING_SEED,
    strict: bool = True,
) -> DataFrame:
    """A control selection with the target's counts per stratum; an image serves once.

    A stratum that can't be filled is an error unless ``strict=False``; ``shortfall`` lists such strata.

    Strata are filled scarcest first. ``mode``: ``weighted`` by risk-weighted priority,
    ``top_risk`` by highest risk with a hash jitter, ``uniform`` by hash alone. All images
    prefer the scarcer stratum, so the walk is a stable matching: each round every stratum
    claims its best rows, an image stays with its scarcest claimant, losers claim again.
    """
    keys = STRATA[strata]
    with_bin = lambda df: df.withColumn("risk_bin", risk_bin(F.col("risk_score")))
    required = with_bin(target).groupBy(*keys).agg(F.count("*").alias("required"))
    pool = with_bin(risk).join(required, keys)
    label = F.concat_ws(":", F.lit("matched"), *[F.col(k).cast("string") for k in keys])
    if mode == "top_risk":
        priority = -F.col("risk_score") + hash_uniform(seed, label, F.col("annotation_id")) * 1e-12
    elif mode == "weighted":
        priority = -F.log(hash_uniform(seed, label, F.col("annotation_id"))) / risk_weight(F.col("risk_score"))
    elif mode == "uniform":
        priority = hash_uniform(seed, label, F.col("annotation_id"))
    else:
        raise ValueError(mode)
    sizes = pool.groupBy(*keys).agg((F.count("*") / F.first("required")).alias("scarcity"))
    # One row per stratum: classes x scales x bins.
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("scarcity", *keys))
    strata_order = sizes.select(*keys, place.alias("stratum"))
    alive = checkpoint(
        pool.join(strata_order, keys).select(
            "annotation_id", "image_id", "category_id", "scale", "risk_score", "risk_bin", "stratum", "required", priority.alias("priority")
        )
    )
    while True:
        # The best row of an image in a stratum is the only one that can be used there.
        best = alive.groupBy("stratum", "image_id").agg(
            F.min(F.struct("priority", "annotation_id")).alias("b"), F.first("required").alias("required")
        )
        flat = best.select("stratum", "image_id", "required", "b", F.col("b.priority").alias("_p"), F.col("b.annotation_id").alias("_a"))
        claims = running_sums(flat, ["stratum"], ["_p", "_a"], [order_bucket("_p", 4096)], {"_r": "1L"}).where(F.col("_r") <= F.col("required"))
        held = checkpoint(
            claims.groupBy("image_id").agg(F.min("stratum").alias("holder"), F.count("*").alias("claims"), F.min(F.struct("stratum", "b")).alias("first"))
        )
        if held.where(F.col("claims") > 1).isEmpty():
            winners = held.select(F.col("first.b.annotation_id").alias("annotation_id"), "holder")
            chosen = alive.join(winners, (alive.annotation_id == winners.annotation_id) & (alive.stratum == winners.holder), "left_semi").drop("required")
            if strict:
                chosen = checkpoint(chosen)
                short = shortfall(chosen, required, keys).limit(20).collect()
                if short:
                    raise ValueError("strata that can't be filled: " + "; ".join(str(r.asDict()) for r in short))
            return chosen
        alive = checkpoint(
            alive.join(held.select("image_id", "holder"), "image_id", "left")
            .where(F.col("holder").isNull() | (F.col("stratum") <= F.col("holder")))
            .drop("holder")
        )


def base_split(images: DataFrame, n: int, seed=K.SAMPLING_SEED) -> DataFrame:
    """Common base of the ``n`` lowest hash ranks, the rest is the supplement."""
    ranked = with_hash_rank(images, "common_original_base", "image_id", seed).withColumn("_h", F.expr(_hash_value("hash_rank")))
    placed = global_position(ranked, "_h", "image_id")
    return placed.select("image_id", F.when(F.col("position") <= n, "base").otherwise("supplement").alias("part"))


def bottom_k(df: DataFrame, group: list[str], k: int, key: str, namespace: str = "bottom", seed=K.SAMPLING_SEED) -> DataFrame:
    """The k lowest hash ranks of each group; partial top-k runs before the shuffle."""
    order = W.partitionBy(*group).orderBy("hash_rank", key)
    return with_hash_rank(df, namespace, key, seed).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def diverse_pick(cands: DataFrame, k: int) -> DataFrame:
    """Up to k rows per family: first new images of new classes by rank, then new images.

    ``cands`` has family, annotation_id, image_id, category_id, selection_rank. Both
    passes need only a bounded cut: the best row per (family, class, image) among each
    class's k best images, and the 2k best images of the family.
    """
    row = F.struct("selection_rank", "annotation_id", "image_id", "category_id")
    per_image = cands.groupBy("family", "category_id", "image_id").agg(F.min(row).alias("r"))
    by_class = W.partitionBy("family", "category_id").orderBy("r")
    first = per_image.withColumn("_k", F.row_number().over(by_class)).where(F.col("_k") <= k).select("family", "r")
    by_image = cands.groupBy("family", "image_id").agg(F.min(row).alias("r"))
    overall = W.partitionBy("family").orderBy("r")
    second = by_image.withColumn("_k", F.row_number().over(overall)).where(F.col("_k") <= 2 * k).select("family", "r")
    lists = (
        first.withColumn("pass", F.lit(1)).unionByName(second.withColumn("pass", F.lit(2)))
        .groupBy("family")
        .agg(F.sort_array(F.collect_list(F.struct("pass", "r"))).alias("rows"))
    )
    fold = f"""aggregate(rows, slice(rows, 1, 0), (acc, q) -> IF(
        size(acc) >= {k} OR exists(acc, m -> m.r.image_id = q.r.image_id
            OR (q.pass = 1 AND m.r.category_id = q.r.category_id)), acc, array_append(acc, q)))"""
    return lists.selectExpr("family", f"posexplode({fold}) AS (i, m)").selectExpr(
        "family", "i + 1 AS case_index", "m.r.annotation_id", "m.r.image_id", "m.r.category_id", "m.r.selection_rank"
    )


def probe_sample(df: DataFrame, n: int, namespace: str = "probe", seed=K.BOOTSTRAP_SEED) -> DataFrame:
    """The first n distinct images by their best hash rank."""
    ranked = with_hash_rank(df, namespace, "annotation_id", seed)
    best = ranked.groupBy("image_id").agg(F.min(F.struct("hash_rank", "annotation_id")).alias("b"))
    rows = best.select("image_id", "b.annotation_id", "b.hash_rank").withColumn("_h", F.expr(_hash_value("hash_rank")))
    return global_position(rows, "_h", "annotation_id").where(F.col("position") <= n).drop("_h")


# Families of cases by their rule.
FLAG_FAMILIES = {
    "repairs_small_failure": "NOT a_detected AND b_detected",
    "remaining_failure": "NOT a_detected AND NOT b_detected",
    "short_term_recovery": "b_detected AND NOT u_detected",
    "non_transfer": "u_detected AND NOT b_detected",
}
SHIFT_FAMILIES = {
    "crop_scale_condition_shift": "full_scene_network_scale = 'small' AND crop_network_scale IN ('medium', 'large')",
    "crop_context_condition_shift": "coalesce(neighbor_retention_fraction, 1D) <= 0.5D OR fully_removed_objects >= 1",
}
CORRUPTED_FAMILIES = {
    "corrupted_success": "b_detected AND NOT a_detected",
    "corrupted_failure": "NOT b_detected AND NOT a_detected",
}


def case_families(rows: DataFrame, families: dict[str, str], seed=K.BOOTSTRAP_SEED) -> DataFrame:
    """One row per object and family whose rule it meets, with a hash rank per family."""
    names = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(n)) for n, rule in families.items()]))
    v = rows.select("annotation_id", "image_id", "category_id", F.explode(names).alias("family"))
    return v.withColumn("selection_rank", hash_rank(seed, F.col("family"), F.col("annotation_id")))


def audit_selection(sel_a: DataFrame, sel_b: DataFrame, max_gap: float = K.MEAN_RISK_GAP) -> DataFrame:
    """Checks of two selections as (check, value, passed) rows."""
    tag = lambda df, name: df.select(F.lit(name).alias("arm"), "annotation_id", "image_id", "category_id", "scale", "risk_score")
    both = tag(sel_a, "a").unionByName(tag(sel_b, "b")).withColumn("risk_bin", risk_bin(F.col("risk_score")))

    def repeats(key: str) -> DataFrame:
        n = both.groupBy("arm", key).agg(F.count("*").alias("n"))
        return n.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("double").alias("value")).select(F.lit(f"repeated_{key}").alias("check"), "value")

    def gap(key: str) -> DataFrame:
        n = both.groupBy(key).agg(F.abs(F.sum(F.when(F.col("arm") == "a", 1).otherwise(-1))).alias("d"))
        return n.agg(F.coalesce(F.sum("d"), F.lit(0)).cast("double").alias("value")).select(F.lit(f"unequal_{key}").alias("check"), "value")

    mean = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("risk_score")))
    risk = both.agg(F.abs(mean("a") - mean("b")).alias("value")).select(F.lit("mean_risk_gap").alias("check"), "value")
    checks = repeats("annotation_id").unionByName(repeats("image_id"))
    for key in ("category_id", "scale", "risk_bin"):
        checks = checks.unionByName(gap(key))
    checks = checks.unionByName(risk)
    limit = F.when(F.col("check") == "mean_risk_gap", F.lit(max_gap)).otherwise(F.lit(0.0))
    return checks.withColumn("passed", F.col("value") <= limit)


def build_views(base: DataFrame, crops: DataFrame, dev: DataFrame) -> DataFrame:
    """Training-view list: originals, crops and dev images with a path and its repeats."""
    original = lambda df, role: df.select(
        F.concat(F.lit("images/"), F.col("image_id"), F.lit(".jpg")).alias("path"), "image_id", F.lit(role).alias("role")
    )
    crop = crops.select(
        F.concat(F.lit("crops/"), F.col("annotation_id"), F.lit(".jpg")).alias("path"), "image_id", F.lit("crop").alias("role")
    )
    return original(base, "original").unionByName(crop).unionByName(original(dev, "dev"))


def repeated_paths(views: DataFrame) -> DataFrame:
    return views.groupBy("path").agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def check_partition(parts: list[DataFrame], whole: DataFrame, key: str = "image_id") -> DataFrame:
    """One row: ids in several parts, missing from the parts, and foreign to the whole."""
    tagged = whole.select(key, F.lit(-1).alias("part"))
    for i, part in enumerate(parts):
        tagged = tagged.unionByName(part.select(key, F.lit(i).alias("part")))
    n = tagged.groupBy(key).agg(
        F.count_if(F.col("part") >= 0).alias("in_parts"), F.count_if(F.col("part") < 0).alias("in_whole")
    )
    return n.agg(
        F.count_if(F.col("in_parts") > 1).alias("overlapping"),
        F.count_if((F.col("in_parts") == 0) & (F.col("in_whole") > 0)).alias("missing"),
        F.count_if((F.col("in_parts") > 0) & (F.col("in_whole") == 0)).alias("foreign"),
    )
