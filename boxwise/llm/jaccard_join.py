"""n-gram Jaccard join by universe partition and pigeonhole (operator 5).

A text's set is its distinct shingles of ``N`` words (fewer words: their whole sequence). Sets
link when 100 x intersection >= ``PERCENT`` x union. Equal sets are one node.

Sets are banded by size so that partners lie in one band or neighbouring ones. A scheme serves
the sets of a band and the next: it hashes the universe of shingles into m segments. Partners differ in
at most H shingles, so of any H + 1 segments one is equal, and of any (H + 1) / 2 one differs by one
shingle at most. Allocation by cost: schemes with a small H index their few long segments
with all one-deletion neighbours, others index ``ROOM`` x (H + 1) segments as they are. Empty
segments are skipped; a set that keeps too few others enters a next level with twice the segments, too.

Signatures are dealt to buckets in packed rows. Sets that share a signature are candidates:
each with the smallest of its group first; groups of at most ``HOT`` sets give their other pairs, which are verified
only where they would join components. A larger group's signature is skipped, which a set can afford
as long as H + 1 of its segments remain at each level that it enters; sets that can't are compared exactly, block by block,
within families of such groups, unless they are in one component by then. Parity sketches turn down candidates that differ
in too many shingles for certain, and all links are verified on the sets.

Edge cases: null text, empty text and text without words have an empty set and link with
nothing (component: own id); null ids link as any row but are never a component's id (null if
there is no other); repeated rows are one node and each get a row; an empty table gives an empty
result; other columns aren't read. Hashes have 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import batch, grams, map_arrow, mix, slices, text_bytes, words
from boxwise.llm.graph import components
from boxwise.session import materialize

N = 5
PERCENT = 80
ROOM = 1.25
#: Largest H for which segments are indexed with their one-deletion neighbours.
DELETE = 3
#: Largest group whose pairs are all listed.
HOT = 16
#: Sets of one side of an exact comparison.
BLOCK = 300
#: Signatures that a task packs at a time.
FLUSH = 400_000
#: Signatures that one task compares.
BUCKET = 1_500_000
#: Bytes of text that a task looks at together.
SLICE = 1 << 20
KEY_BITS = 24
U = np.uint64


def bands(largest: int, percent: int = PERCENT) -> np.ndarray:
    """Lower ends of the size bands: a set's partners lie in its own band or the next or the one before."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, 100 * (out[-1] - 1) // percent + 1))
    return np.array(out, np.int64)


def differences(top: int, percent: int = PERCENT) -> int:
    """Most shingles in which a set of at most ``top`` and a partner not smaller than it differ."""
    return int((100 - percent) * (top + 100 * top // percent) // (100 + percent))


def sets(column: pa.Array, n: int = N) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, sorted distinct shingles, set ranges) of row ranges."""
    buf, offs = text_bytes(column)
    for a, b in slices(offs, SLICE):
        w, _, _, bounds = words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        g, _, own = grams(w, bounds, n, whole=True)
        row = np.repeat(np.arange(b - a), np.diff(own))
        order = np.argsort(g, kind="stable")
        order = order[np.argsort(row[order], kind="stable")]
        g, row = g[order], row[order]
        keep = np.ones(len(g), bool)
        keep[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        yield a, b, g[keep], np.searchsorted(row[keep], np.arange(b - a + 1)).astype(np.int64)


def set_keys(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every set."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(g + U(0x51ED270B)), dtype=U)])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(U) * U(0x9E3779B97F4A7C15))


def _summed(at: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Sums of 64-bit values by place, modulo 2^64; halves are summed exactly as doubles."""
    low = np.bincount(at, (value & U(0xFFFFFFFF)).astype(np.float64), size).astype(U)
    high = np.bincount(at, (value >> U(32)).astype(np.float64), size).astype(U)
    return low + (high << U(32))


def level_signatures(g: np.ndarray, bounds: np.ndarray, edges: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set) of all sets, for each set how many segments it can spare in even and odd schemes, and which signatures are early.

    The lowest bit of a signature tells the parity of its scheme. Early ones are of a level that their set left with too
    few segments: it can spare none of them, as a partner may have ended there.
    """
    sizes = np.diff(bounds)
    band = np.searchsorted(edges, sizes, side="right") - 1
    tops = np.append(edges[1:] - 1, edges[-1] * 100 // percent)
    limit = np.array([differences(int(t), percent) for t in tops], np.int64)
    sigs, owners, early = [], [], []
    spare = np.full((len(sizes), 2), 1 << 14, np.int64)
    for lower in (0, 1):
        scheme = band - lower
        todo = np.flatnonzero((sizes > 0) & (scheme >= 0))
        todo = todo[limit[scheme[todo]] > 0]  # without differences partners are equal sets
        if lower:  # larger than any partner in the lower band
            todo = todo[100 * tops[scheme[todo]] >= percent * sizes[todo]]
        level = 0
        while len(todo):
            h = limit[scheme[todo]]
            drop = (h <= DELETE) & (level == 0)
            many = np.ceil(ROOM * (h + 1)).astype(np.int64) << (level - (h <= DELETE) if level else np.zeros_like(h))
            m = np.where(drop, (h + 2) // 2, many)
            start = np.concatenate([[0], np.cumsum(m)])
            count = sizes[todo]
            place = np.arange(count.sum()) + np.repeat(bounds[todo] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
            who = np.repeat(np.arange(len(todo)), count)
            salt = mix((scheme[todo] * 64 + level + 1).astype(U))
            v = mix(g[place] ^ salt[who])
            at = start[who] + ((v >> U(20)) % m[who].astype(U)).astype(np.int64)
            total = int(start[-1])
            sums, filled = _summed(at, v, total), np.bincount(at, minlength=total)
            own = np.repeat(np.arange(len(todo)), m)
            base = salt[own] + (np.arange(total) - start[own]).astype(U) * U(0xD6E8FEB86659FD93)
            parity = (scheme[todo] & 1).astype(U)
            used = np.flatnonzero(filled > 0)
            sigs.append(mix(sums[used] + base[used]) & ~U(1) | parity[own[used]])
            owners.append(todo[own[used]])
            less = drop[who] & (filled[at] >= 2)
            if less.any():
                sigs.append(mix(sums[at[less]] - v[less] + base[at[less]]) & ~U(1) | parity[who[less]])
                owners.append(todo[who[less]])
            good = np.bincount(own, np.where(drop[own], filled >= 2, filled >= 1), len(todo)).astype(np.int64)
            left = good - np.where(drop, (h + 2) // 2, h + 1)
            done = left >= 0
            early.append(~done[own[used]])
            if less.any():
                early.append(~done[who[less]])
            spare[todo[done], scheme[todo[done]] & 1] = np.minimum(left[done], 1 << 14)
            todo = todo[~done]
            level += 1
    if not sigs:
        return np.zeros(0, U), np.zeros(0, np.int64), spare, np.zeros(0, bool)
    return np.concatenate(sigs), np.concatenate(owners), spare, np.concatenate(early)


def signatures(g: np.ndarray, bounds: np.ndarray, edges: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``level_signatures`` without the early ones' mark."""
    return level_signatures(g, bounds, edges, percent)[:3]


def sketches(g: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Parity sketch of every set: a bit per cell tells whether an odd number of shingles falls on it.

    There are at least as many cells as shingles, and a power of two. Two sketches differ in no more bits
    than the sets differ in shingles.
    """
    n = np.diff(bounds)
    cells = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(cells)])
    place = (mix(g ^ U(0x2545F4914F6CDD1D)) & (np.repeat(cells, n) - 1).astype(U)).astype(np.int64)
    odd = np.bincount(np.repeat(start[:-1], n) + place, minlength=int(start[-1])).astype(np.uint8) & 1
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[a >> 3 : b >> 3] for a, b in zip(start[:-1].tolist(), start[1:].tolist())]


def may_link(n: int, x: bytes, m: int, y: bytes) -> bool:
    """Whether sets with these sizes and sketches can link; no linked pair is turned down."""
    if 100 * min(n, m) < PERCENT * max(n, m):
        return False
    a, b = (int.from_bytes(v, "little") for v in (x, y))
    while len(x) != len(y):  # the longer sketch is folded: its halves are added, cell by cell
        if len(x) < len(y):
            x, y, a, b = y, x, b, a
        half = len(x) // 2
        a, x = (a & ((1 << 8 * half) - 1)) ^ (a >> 8 * half), x[:half]
    return (a ^ b).bit_count() <= (100 - PERCENT) * (n + m) // (100 + PERCENT)


def possible(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose sketches do not rule a link out; ``facts`` has (k, n, sketch) of every set."""
    side = lambda c: facts.select(F.col("k").alias(c), F.struct("n", "sketch").alias(f"_{c}"))
    names = pairs.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [may_link(x["n"], x["sketch"], y["n"], y["sketch"]) for x, y in zip(b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist())]
            keep = pa.array(ok, pa.bool_())
            yield batch(names, [c.filter(keep) for c in b.columns[: len(names)]])

    return map_arrow(pairs.join(side("a"), "a").join(side("b"), "b").select(*names, "_a", "_b"), run, kinds)


def set_table(docs: DataFrame) -> DataFrame:
    """(id, h, n, k, sketch): hash of every text, size, key and parity sketch of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, g, bounds in sets(b.column(2)):
                own = b.slice(low, high - low)
                yield batch(["id", "h", "n", "k", "sketch"], [own.column(0), own.column(1), np.diff(bounds), set_keys(g, bounds).astype(np.int64), pa.array(sketches(g, bounds), pa.binary())])

    return map_arrow(docs.select("id", F.xxhash64("text").alias("h"), "text"), run, "id bigint, h bigint, n bigint, k bigint, sketch binary")


_MEMBER = np.dtype([("k", "<i8"), ("even", "<i2"), ("odd", "<i2")])
_ENTRY = np.dtype([("high", "<u4"), ("low", "<u2"), ("owner", "<u2")])


def packed_signatures(docs: DataFrame, edges: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, members, entries): the signatures of a batch of texts, packed by bucket.

    48 bits of a signature are kept; sets that meet in a bucket by chance are told apart when verified.
    """

    def pack(parts: list, members: list) -> pa.RecordBatch:
        member = np.concatenate(members)
        sig, owner, early = (np.concatenate([p[i] for p in parts]) for i in range(3))
        _, first, same = np.unique(member["k"], return_index=True, return_inverse=True)
        once = first[same[owner]] == owner  # copies of a set among these texts count once
        sig, owner, early = sig[once], owner[once], early[once]
        bucket = ((sig >> U(1)) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sig, owner, early, bucket = sig[order], owner[order], early[order], bucket[order]
        entry = np.zeros(len(sig), _ENTRY)
        entry["high"], entry["low"] = sig >> U(32), (sig >> U(16)) & U(0xFFFE) | (sig & U(1))
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows = []
        for s, e in zip(cut, [*cut[1:], len(sig)]):
            who, new = np.unique(owner[s:e], return_inverse=True)
            own = entry[s:e].copy()
            own["owner"] = new | early[s:e].astype(np.int64) << 15
            rows.append((int(bucket[s]), member[who].tobytes(), own.tobytes()))
        return batch(["bucket", "members", "entries"], [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, members, at, held = [], [], 0, 0
            for first in range(0, b.num_rows, 30_000):  # members are numbered in 15 bits
                for _, _, g, bounds in sets(b.column(0).slice(first, 30_000)):
                    sig, owner, spare, early = level_signatures(g, bounds, edges)
                    member = np.zeros(len(bounds) - 1, _MEMBER)
                    member["k"], member["even"], member["odd"] = set_keys(g, bounds).astype(np.int64), spare[:, 0], spare[:, 1]
                    members.append(member)
                    parts.append((sig, owner + at, early))
                    at += len(bounds) - 1
                    held += len(sig)
                    if held > FLUSH:
                        yield pack(parts, members)
                        parts, members, at, held = [], [], 0, 0
                if at:
                    yield pack(parts, members)
                parts, members, at, held = [], [], 0, 0

    return map_arrow(docs.select("text"), run, "bucket int, members binary, entries binary")


def shared_signatures(packed: DataFrame, parts: int) -> DataFrame:
    """(kind, a, b, sig): kind 0, a set and the smallest of its group; 1, another pair; 2, a member (a; b: what it can spare) of a hot group."""

    def found(rows: list[tuple]) -> pa.RecordBatch:
        members = [np.frombuffer(m, _MEMBER) for _, m, _ in rows]
        start = np.concatenate([[0], np.cumsum([len(m) for m in members])])
        member = np.concatenate(members)
        entries = [np.frombuffer(e, _ENTRY) for _, _, e in rows]
        sig = np.concatenate([e["high"].astype(U) << U(16) | e["low"].astype(U) for e in entries])
        owner = np.concatenate([(e["owner"] & 0x7FFF).astype(np.int64) + at for e, at in zip(entries, start)])
        early = np.concatenate([e["owner"] >> 15 > 0 for e in entries])
        order = np.argsort(sig, kind="stable")
        sig, owner, early = sig[order], owner[order], early[order]
        same = sig[1:] == sig[:-1]
        shared = np.zeros(len(sig), bool)
        shared[1:] |= same
        shared[:-1] |= same
        sig, owner, early = sig[shared], owner[shared], early[shared]
        key = member["k"][owner]
        order = np.lexsort((key, sig))
        sig, owner, early, key = sig[order], owner[order], early[order], key[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        sig, owner, early, key = sig[fresh], owner[fresh], early[fresh], key[fresh]
        cut = np.flatnonzero(np.diff(sig, prepend=~sig[:1]))
        size = np.diff(np.append(cut, len(sig)))
        pivot = np.repeat(cut, size)
        star = np.flatnonzero(np.arange(len(sig)) != pivot)
        pairs = [np.column_stack([np.zeros(len(star), np.int64), key[pivot[star]], key[star]])]
        small = (size > 2) & (size <= HOT)
        for k in np.unique(size[small]):
            first = cut[small & (size == k)]
            i, j = np.triu_indices(k, 1)
            i, j = i[k - 1 :], j[k - 1 :]  # pairs without the smallest
            a, c = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
            pairs.append(np.column_stack([np.ones(len(a), np.int64), key[a], key[c]]))
        pair = np.unique(np.concatenate(pairs), axis=0)
        hot = np.flatnonzero(np.repeat(size > HOT, size))
        spare = np.where(sig[hot] & U(1) > 0, member["odd"][owner[hot]], member["even"][owner[hot]]).astype(np.int64)
        spare[early[hot]] = -1
        kind = np.concatenate([pair[:, 0], np.full(len(hot), 2)])
        sig = sig | U(rows[0][0]) << U(48)  # a hot signature is known by its bucket too
        a, c = np.concatenate([pair[:, 1], key[hot]]), np.concatenate([pair[:, 2], spare])
        return batch(["kind", "a", "b", "sig"], [pa.array(kind, pa.int32()), a, c, np.concatenate([np.zeros(len(pair), np.int64), sig[hot].astype(np.int64)])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and row[0] != held[0][0]:
                    yield found(held)
                    held = []
                held.append(row)
        if held:
            yield found(held)

    dealt = packed.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return map_arrow(dealt, run, "kind int, a bigint, b bigint, sig bigint")


def fetched(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, shingles binary): the sets of the given keys, found again in the texts.

    A bit table of fixed size lets few others through; those are harmless.
    """
    slot = F.col("k").bitwiseAND(F.lit((1 << KEY_BITS) - 1))
    packed = keys.select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit")).distinct()
    table = np.zeros(1 << (KEY_BITS - 6), np.int64)
    for r in packed.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toLocalIterator():
        table[r.word] = r.bits
    shared = docs.sparkSession.sparkContext.broadcast(table.view(U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[int] = set()
            for _, _, g, bounds in sets(b.column(0)):
                k = set_keys(g, bounds)
                s = k & U((1 << KEY_BITS) - 1)
                hit = (shared.value[(s >> U(6)).astype(np.int64)] >> (s & U(63))) & U(1) > 0
                at = [i for i in np.flatnonzero(hit & (np.diff(bounds) > 0)) if not (int(k[i]) in seen or seen.add(int(k[i])))]
                yield batch(["k", "shingles"], [k[at].astype(np.int64), pa.array([g[bounds[i] : bounds[i + 1]].tobytes() for i in at], pa.binary())])

    found = map_arrow(docs.select("text"), run, "k bigint, shingles binary")
    # the sets of a key are equal, so any one of them will do
    return found.dropDuplicates(["k"])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def verified(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    full = pairs.select("a", "b").join(table.select(F.col("k").alias("a"), F.col("shingles").alias("x")), "a").join(table.select(F.col("k").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [linked(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)) for x, y in zip(b.column(2), b.column(3))]
            keep = pa.array(ok, pa.bool_())
            yield batch(["a", "b"], [b.column(0).filter(keep), b.column(1).filter(keep)])

    return map_arrow(full.select("a", "b", "x", "y"), run, "a bigint, b bigint")


def block_links(held: list[tuple[int, bytes]], other: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
    """Links between two lists of sets that join components of them: products of incidence columns."""
    rows = held + other
    flat = np.concatenate([np.frombuffer(s, U) for _, s in rows])
    size = np.array([len(s) // 8 for _, s in rows])
    who = np.repeat(np.arange(len(rows)), size)
    _, dim, many = np.unique(flat, return_inverse=True, return_counts=True)
    keep = many[dim] > 1
    kept, dim = who[keep], np.unique(dim[keep], return_inverse=True)[1]
    both = np.zeros((len(rows), len(rows)), np.float32)
    for low in range(0, int(dim.max(initial=-1)) + 1, 4096):
        part = (dim >= low) & (dim < low + 4096)
        x = np.zeros((len(rows), 4096), np.float32)
        x[kept[part], dim[part] - low] = 1
        both += x @ x.T
    i, j = np.nonzero(np.triu(100 * both >= PERCENT * (size[:, None] + size[None, :] - both), 1))
    top = list(range(len(rows)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        if (p := find(a)) != (q := find(b)):
            top[max(p, q)] = min(p, q)
            out.append((rows[a][0], rows[b][0]))
    return out


def family_links(members: DataFrame, table: DataFrame) -> DataFrame:
    """Exact links within families (family, k), block against block; each task holds two blocks of sets."""
    import pandas as pd

    sized = members.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sized, "family").withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    copies = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("family", "k", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    full = copies.join(table, "k")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a = [(int(k), s) for k, s, o in zip(pdf.k, pdf.shingles, pdf.own) if o == pdf.i.iloc[0]]
        b = [(int(k), s) for k, s, o in zip(pdf.k, pdf.shingles, pdf.own) if o != pdf.i.iloc[0]]
        return pd.DataFrame(block_links(a, b), columns=["a", "b"], dtype="int64")

    return full.groupBy("family", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def labelled(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, h, n, component, component_id) of every row; h is the hash of its text, component (null without words) tells components apart whatever their ids."""
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = materialize(set_table(docs))
    facts = rows.agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    nodes = rows.filter("n > 0").groupBy("k").agg(F.min("id").alias("least"))
    if facts.largest:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(facts.total * 0.65 / BUCKET))
        packed = packed_signatures(docs, bands(facts.largest), 2 * parts)
        shared = materialize(shared_signatures(packed, parts))
        facts_of = materialize(rows.filter("n > 0").select("k", "n", "sketch").dropDuplicates(["k"]))
        pairs = possible(shared.filter("kind < 2").groupBy("a", "b").agg(F.min("kind").alias("kind")), facts_of)
        hot = shared.filter("kind = 2").select(F.col("a").alias("k"), F.col("b").alias("spare"), "sig")
        poor = hot.groupBy("k", (F.col("sig") % 2 != 0).alias("odd")).agg(F.count("*").alias("n"), F.min("spare").alias("spare")).filter("n > spare").select("k").distinct()
        pairs, poor = materialize(pairs), materialize(poor)
        wanted = pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).unionByName(poor).distinct()
        table = materialize(fetched(docs, wanted))
        links = materialize(verified(pairs.filter("kind = 0"), table))
        found = materialize(components(links))
        label = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        apart = F.coalesce("of_a", "a") != F.coalesce("of_b", "b")
        more = verified(materialize(pairs.filter("kind = 1").join(label("a"), "a", "left").join(label("b"), "b", "left").filter(apart).select("a", "b")), table)
        if not poor.isEmpty():
            groups = hot.join(poor, "k", "left_semi")
            firsts = groups.groupBy("sig").agg(F.min("k").alias("a"))
            families = materialize(components(groups.join(firsts, "sig").filter("a < k").select("a", F.col("k").alias("b")).distinct()))
            whose = families.join(found.withColumnRenamed("component", "of"), "node", "left").select(F.col("component").alias("family"), F.col("node").alias("k"), F.coalesce("of", "node").alias("of"))
            open_ = whose.groupBy("family").agg(F.min("of").alias("low"), F.max("of").alias("high")).filter("low <> high").select("family")
            more = more.unionByName(family_links(whose.join(open_, "family", "left_semi").select("family", "k"), table))
        more = materialize(more)
        if not more.isEmpty():
            found = materialize(components(links.unionByName(more)))
        named = nodes.join(found.withColumnRenamed("node", "k"), "k", "left").withColumn("component", F.coalesce("component", "k"))
    else:
        named = nodes.withColumn("component", F.col("k"))
    named = materialize(named)
    best = named.groupBy("component").agg(F.min("least").alias("component_id"))
    label = named.join(best, "component").select("k", "component", "component_id")
    out = rows.filter("n > 0").join(label, "k").select("id", "h", "n", "component", "component_id")
    return out.unionByName(rows.filter("n = 0").select("id", "h", "n", F.lit(None).cast("long").alias("component"), F.col("id").alias("component_id")))


def join(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row."""
    return labelled(df, key, text).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def first_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = 2_000_000) -> DataFrame:
    """One row of every component, that with the smallest id (a null one is the largest), then hash of the text; rows without words stay.

    Ids and hashes of the rows that go are sent to all tasks up to ``most`` of them, which spares the texts a shuffle; more are joined.
    """
    rows = materialize(labelled(df, key, text))
    least = rows.filter("component is not null").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("x"))
    other = ~(F.col("id").eqNullSafe(F.col("x.id")) & (F.col("h") == F.col("x.h")))
    gone = materialize(rows.join(least, "component").filter(other).select(F.col("id").alias("_id"), F.col("h").alias("_h")).distinct())
    mine = lambda: F.col(key).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("_h"))
    kept = df.join(F.broadcast(gone) if gone.count() <= most else gone, mine(), "left_anti")
    again = rows.filter("component is not null").groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).count().filter("count > 1").drop("count")
    again = materialize(again.join(gone.withColumnsRenamed({"_id": "_id2", "_h": "_h2"}), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2")), "left_anti"))
    if again.isEmpty():
        return kept
    side = lambda: F.broadcast(again) if again.count() <= most else again
    once = kept.join(side(), mine(), "left_semi").withColumn("_h", F.xxhash64(F.col(text).cast("string"))).dropDuplicates([key, "_h"]).drop("_h")
    return kept.join(side(), mine(), "left_anti").unionByName(once)
