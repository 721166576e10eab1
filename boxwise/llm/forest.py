"""Embedding near-dedup by a random-projection tree forest (operator 13).

Equal vectors of a label are one node with a weight. In each of ``TREES`` trees a group of more than ``LEAF`` nodes is
split by the best of ``CANDIDATES`` random directions, where a bounded sample of the group (``SAMPLE`` nodes) lies
thinnest; nodes near the cut go to both sides (at most a share of ``SPILL``). Groups are split recursively, ``LEVELS`` levels a round;
all nodes are routed. A group without a thin cut, such as thousands of near copies, stays whole. In the leaves all
vectors are compared in double precision, large leaves block against block, each task with two blocks. A pair counts in the
smallest leaf that its two nodes share, so no pair is counted twice and none is ever written: tasks hand on counts
per node and a spanning forest of the links that they saw, and components are the union of these.

Every link reported is exact; links can be missed only where a pair is parted in all trees. Groups of at most ``LEAF``
nodes are not split at all, so they lose nothing. The model of a round is sent to all tasks up to ``MODEL_BYTES`` and joined beyond.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link
with nothing (component: own id); vectors of unlike lengths don't link; rows with a null id link like any other, but
are never a component's id (null if there is no other) and kept only in such a component; repeated rows are linked with each other; an empty
table gives an empty result; other columns aren't read. A vector's components are scaled by the largest one, so that no
norm overflows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import batch, map_arrow, ship
from boxwise.llm.graph import components
from boxwise.session import materialize

COSINE = 0.93
TREES = 8
LEAF = 512
SPILL = 0.1
#: Nodes of a group by which it is split, about.
SAMPLE = 4096
CANDIDATES = 6
LEVELS = 6
#: Largest share of a group that may lie within the reach of a threshold pair on either side of a cut.
THICK = 0.5
#: Nodes of one side of a comparison.
BLOCK = 2048
MODEL_BYTES = 32 << 20
#: Copies from which a vector is joined by broadcast, and vectors that are sent so at most.
COPIES = 1000
BROADCAST_ROWS = 100_000
TREE_SHIFT = 56
KEYS = ["label", "dim", "leaf"]


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def direction(leaf: int, candidate: int, dim: int) -> np.ndarray:
    """The random direction of a candidate; anyone can draw it again."""
    r = np.random.default_rng([leaf & 0xFFFFFFFF, leaf >> 32, candidate]).standard_normal(dim)
    return r / np.linalg.norm(r)


def best_cut(x: np.ndarray, leaf: int) -> tuple[int, float, float] | None:
    """(candidate, low, high): a direction and cut where few of the vectors lie, with the margin that goes to both sides."""
    reach = np.sqrt(2 - 2 * COSINE) / np.sqrt(x.shape[1])
    best = None
    for c in range(CANDIDATES):
        p = np.sort(x @ direction(leaf, c, x.shape[1]))
        for cut in p[(len(p) * np.linspace(0.3, 0.7, 9)).astype(np.int64)]:
            near = (np.searchsorted(p, cut + reach) - np.searchsorted(p, cut - reach)) / len(p)
            if best is None or near < best[0]:
                away = np.sort(np.abs(p - cut))
                margin = min(2 * reach, away[min(int(SPILL * len(p)), len(p) - 1)])
                best = (near, c, float(cut - margin), float(cut + margin))
    return None if best[0] > THICK else best[1:]


def grown(x: np.ndarray, leaf: int, size: float, most: int = LEAF) -> list[tuple[int, int, float, float]]:
    """(group, candidate, low, high) of the splits below a group of ``size`` nodes, grown on a sample of it."""
    out, todo = [], [(leaf, x, size, 0)]
    while todo:
        at, own, n, level = todo.pop()
        if n <= most or level == LEVELS or len(own) < 32:
            continue
        cut = best_cut(own, at)
        if cut is None:
            continue
        out.append((at, *cut))
        p = own @ direction(at, cut[0], own.shape[1])
        for side, part in ((0, own[p < cut[2]]), (1, own[p >= cut[1]])):
            if len(part) < len(own):
                todo.append((child(at, side), part, n * len(part) / len(own), level + 1))
    return out


def child(leaf: int, side: int) -> int:
    """The group of one side: a tree's number, then its path from a leading 1."""
    tree, path = leaf >> TREE_SHIFT, leaf & (1 << TREE_SHIFT) - 1
    return tree << TREE_SHIFT | path << 1 | side


def routed(x: np.ndarray, leaf: int, splits: dict[int, tuple[int, float, float]]) -> list[tuple[int, np.ndarray]]:
    """(group, rows) where the given vectors of a group end."""
    out, todo = [], [(leaf, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if at not in splits or not len(rows):
            out.append((at, rows))
            continue
        c, low, high = splits[at]
        p = x[rows] @ direction(at, c, x.shape[1])
        todo += [(child(at, 0), rows[p < high]), (child(at, 1), rows[p >= low])]
    return out


def vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a binary column of doubles or floats."""
    flat = b"".join(x.as_buffer() for x in column)
    kind = np.float32 if len(flat) == 4 * dim * len(column) else np.float64
    return unit(np.frombuffer(flat, kind).reshape(-1, dim).astype(np.float64))


def valid(vector: str, label: str):
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(label).isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nodes_of(rows: DataFrame) -> DataFrame:
    """(label, dim, h1, h2, node, w, least, vec): each vector once; vec is packed, in the precision of the table."""
    kind = rows.schema["vector"].dataType.elementType.typeName()
    number = np.float32 if kind == "float" else np.float64
    once = rows.filter("ok").groupBy("label", "h1", "h2").agg(F.first("vector").alias("vector"), F.count("*").alias("w"), F.min("id").alias("least"))
    once = once.withColumn("dim", F.size("vector")).withColumn("node", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = pa.array([x.values.to_numpy(zero_copy_only=False).astype(number).tobytes() for x in b.column(7)], pa.binary())
            yield batch(["label", "dim", "h1", "h2", "node", "w", "least", "vec"], [*b.columns[:7], packed])

    label = rows.schema["label"].dataType.simpleString()
    return map_arrow(once.select("label", "dim", "h1", "h2", "node", "w", "least", "vector"), run, f"label {label}, dim int, h1 bigint, h2 bigint, node bigint, w bigint, least bigint, vec binary")


def fitted(state: DataFrame, big: DataFrame, most: int = LEAF) -> DataFrame:
    """(label, dim, leaf, splits) of the groups (label, dim, leaf, size) that can be split, on a sample of each."""
    import pandas as pd

    part = F.xxhash64("node", "leaf").cast("double") / F.lit(2.0**64) + F.lit(0.5) < F.lit(float(SAMPLE)) / F.col("size")
    sample = state.select("label", "dim", "node", "vec", F.explode("leaves").alias("leaf")).join(big, KEYS).filter(part)
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    schema = f"label {kinds['label']}, dim int, leaf bigint, splits array<struct<at: bigint, c: int, low: double, high: double>>"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        pdf = pdf.sort_values("node")
        found = grown(vectors(pa.array(pdf.vec), int(first.dim)), int(first.leaf), float(first["size"]), most)
        rows = [[first.label, first.dim, first.leaf, [dict(zip(("at", "c", "low", "high"), s)) for s in found]]] if found else []
        return pd.DataFrame(rows, columns=["label", "dim", "leaf", "splits"])

    ship(state.sparkSession)
    return sample.groupBy(*KEYS).applyInPandas(fit, schema)


def descend(state: DataFrame, model: DataFrame) -> DataFrame:
    """``state`` with the leaves below the groups that the model splits."""
    spark, names = state.sparkSession, state.columns
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    size = model.agg(F.sum(F.size("splits")).alias("n")).first().n or 0

    def rows_below(x: np.ndarray, groups: list[list[int]], splits: dict) -> list[list[int]]:
        held: dict[int, list[int]] = {}
        for i, own in enumerate(groups):
            for g in own:
                held.setdefault(g, []).append(i)
        out: list[list[int]] = [[] for _ in groups]
        for g, members in held.items():
            members = np.array(members)
            for leaf, at in routed(x[members], g, splits):
                for i in members[at]:
                    out[i].append(leaf)
        return [sorted(o) for o in out]

    if 64 * size <= MODEL_BYTES:
        found: dict[tuple, dict[int, tuple]] = {}
        for r in model.toLocalIterator():
            found.setdefault((r.label, r.dim), {}).update({s.at: (s.c, s.low, s.high) for s in r.splits})
        shared = spark.sparkContext.broadcast(found)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
                leaves = b.column(5).to_pylist()
                for key in set(keys):
                    at = [i for i, k in enumerate(keys) if k == key]
                    below = rows_below(vectors(b.column(4).take(pa.array(at)), key[1]), [leaves[i] for i in at], shared.value.get(key, {}))
                    for i, own in zip(at, below):
                        leaves[i] = own
                yield batch(names, [*b.columns[:5], pa.array(leaves, pa.list_(pa.int64()))])

        return map_arrow(state, run, ", ".join(f"{c} {kinds[c]}" for c in names))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, (node, leaf, dim, splits) in enumerate(zip(*(b.column(k).to_pylist() for k in range(4)))):
                own = {s["at"]: (s["c"], s["low"], s["high"]) for s in splits or []}
                out += [(node, g) for g in rows_below(vectors(b.column(4).slice(i, 1), dim), [[leaf]], own)[0]]
            yield batch(["node", "leaf"], [pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)])

    each = state.withColumn("leaf", F.explode("leaves")).join(model, KEYS, "left").select("node", "leaf", "dim", "splits", "vec")
    below = map_arrow(each, one, "node bigint, leaf bigint").groupBy("node").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    return state.drop("leaves").join(below, "node").select(*state.columns)


def leaves(nodes: DataFrame, most: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """(label, dim, node, w, vec, leaves) of every node, and (label, dim, leaf, size) of every leaf."""
    roots = F.array(*(F.lit((t << TREE_SHIFT) | 1).cast("long") for t in range(TREES)))
    # a label that fits into one leaf needs one tree
    sizes = materialize(nodes.groupBy("label", "dim").agg(F.count("*").alias("size")))
    large = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    state = nodes.join(large, ["label", "dim"]).select("label", "dim", "node", "w", "vec", F.when(F.col("size") <= most, F.slice(roots, 1, 1)).otherwise(roots).alias("leaves"))
    whole: DataFrame | None = None
    while True:
        counts = materialize(state.select("label", "dim", F.explode("leaves").alias("leaf")).groupBy(*KEYS).agg(F.count("*").alias("size")))
        big = counts.filter(F.col("size") > most)
        if whole is not None:
            big = big.join(whole, KEYS, "left_anti")
        big = materialize(big)
        if big.isEmpty():
            return state, counts
        model = materialize(fitted(state, big, most))
        stuck = big.join(model, KEYS, "left_anti").select(*KEYS)
        whole = materialize(stuck if whole is None else whole.unionByName(stuck))
        state = materialize(descend(state, model))


def compared(state: DataFrame, counts: DataFrame) -> DataFrame:
    """(a, b, n): b null: a has n more links by weight; else a and b are linked (a spanning forest of each task's links)."""
    import pandas as pd

    parts = counts.filter("size > 1").select(*KEYS, F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    each = state.withColumn("leaf", F.explode("leaves")).join(parts, KEYS)
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    each = each.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    each = each.select(*KEYS, "node", "w", "vec", F.filter("leaves", lambda x: x < F.col("leaf")).alias("before"), "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        pdf = pdf.sort_values("node")
        left, right = pdf[pdf.own == first.i], pdf[pdf.own == first.j]
        counted, forest = task_links(left, right, int(first.dim), bool(first.i == first.j))
        none = pd.Series([None] * len(counted), dtype="Int64")
        out = pd.DataFrame({"a": [c[0] for c in counted] + [f[0] for f in forest], "n": [c[1] for c in counted] + [0] * len(forest)}, dtype="int64")
        out["b"] = pd.concat([none, pd.Series([f[1] for f in forest], dtype="Int64")], ignore_index=True)
        return out[["a", "b", "n"]]

    ship(state.sparkSession)
    return each.groupBy(*KEYS, "i", "j").applyInPandas(compare, "a bigint, b bigint, n bigint")


def task_links(left, right, dim: int, same: bool) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """((node, links by weight) of pairs whose smallest shared leaf this is, spanning forest of all links) of two blocks of a leaf."""
    x, y = (vectors(pa.array(s.vec), dim) if len(s) else np.zeros((0, dim)) for s in (left, right))
    ids = np.concatenate([left.node.to_numpy(np.int64), right.node.to_numpy(np.int64)])
    weight = np.concatenate([left.w.to_numpy(np.int64), right.w.to_numpy(np.int64)])
    before = [*left.before, *right.before]
    names, place = np.unique(np.concatenate([np.asarray(b, np.int64) for b in before]) if before else np.zeros(0, np.int64), return_inverse=True)
    shared = np.zeros((len(ids), len(names)), np.uint8)
    shared[np.repeat(np.arange(len(ids)), [len(b) for b in before]), place] = 1
    shared = np.packbits(shared, axis=1)
    total = np.zeros(len(ids), np.int64)
    top = np.arange(len(ids))
    forest = []

    def find(v: int) -> int:
        while top[v] != v:
            top[v] = top[top[v]]
            v = top[v]
        return v

    for a in range(0, len(x), 256):
        i, j = np.nonzero(x[a : a + 256] @ y.T >= COSINE)
        i += a
        if same:
            i, j = i[i < j], j[i < j]
        j = j + (0 if same else len(x))
        for s in range(0, len(i), 1 << 16):
            p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            new = ~(shared[p] & shared[q]).any(axis=1)
            total += np.bincount(p[new], weight[q[new]], len(ids)).astype(np.int64) + np.bincount(q[new], weight[p[new]], len(ids)).astype(np.int64)
            # links inside one component of this task add nothing; most of them are seen at once
            for _ in range(2):
                apart = top[p] != top[q]
                p, q = p[apart], q[apart]
                if len(p):
                    _, once = np.unique(q, return_index=True)
                    for u, v in zip(p[once].tolist(), q[once].tolist()):
                        if (f := find(u)) != (g := find(v)):
                            top[max(f, g)] = min(f, g)
                            forest.append((u, v))
                    while (top != top[top]).any():
                        top[:] = top[top]
            for u, v in zip(p.tolist(), q.tolist()):
                if (f := find(u)) != (g := find(v)):
                    top[max(f, g)] = min(f, g)
                    forest.append((u, v))
    some = np.flatnonzero(total)
    return list(zip(ids[some].tolist(), total[some].tolist())), [(int(ids[u]), int(ids[v])) for u, v in forest]


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", most: int = LEAF) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    rows = rows.select("*", valid("vector", "label").alias("ok"), F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(7), F.col("vector"), F.lit(13)).alias("h2"))
    nodes = materialize(nodes_of(rows))
    state, counts = leaves(nodes, most)
    found = materialize(compared(state, counts))
    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    group = components(found.filter("b is not null").select("a", "b"))
    named = nodes.select("label", "h1", "h2", "node", "w", "least").join(links, "node", "left").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named.select("label", "h1", "h2", "w", "least", "component", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    best = named.groupBy("component").agg(F.min("least").alias("component_id"))
    result = materialize(named.join(best, "component").select("label", "h1", "h2", "w", "n_links", "component_id"))

    fit, keys = rows.filter("ok").select("id", "label", "h1", "h2"), ["label", "h1", "h2"]
    hot = result.filter(F.col("w") >= COPIES)
    if 0 < hot.count() <= BROADCAST_ROWS:
        few = F.broadcast(hot)
        out = fit.join(few, keys).unionByName(fit.join(few.select(*keys), keys, "left_anti").join(result.filter(F.col("w") < COPIES), keys))
    else:
        out = fit.join(result, keys)
    out = out.select("id", "n_links", "component_id")
    alone = rows.filter("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
