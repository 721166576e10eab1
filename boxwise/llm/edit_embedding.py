"""Document fingerprints by randomised edit embedding (operator 1).

A text is walked over with shared random bits: at step j the walk writes down the character it
stands on and moves on if the bit drawn for (j, character) is one, until the text ends. Texts
a few edits apart fall back into step soon after each edit, so edit distance turns into
Hamming distance. The fingerprint samples the written characters at steps that are the same
for all texts, ``SAMPLES`` in every octave of steps, so texts of any length compare; four
hashed bits are kept of each (zero: behind the end). Likeness is the share of steps that agree,
estimated octave by octave. ``near_pairs`` bands sampled characters, and verifies the edit
distance of pairs that share a band.

Edge cases: null text is empty; two empty texts have likeness 1, an empty and another one 0;
equal texts have equal fingerprints; the order is descending key, a null key last, equal keys
by SHA-256 of the text; a single row is its own next; an empty table gives an empty result;
other columns are not read. Very long texts are walked to their end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxwise.llm.common import batch, map_arrow, mix, ship
from boxwise.session import materialize

SEED = 20240229
SAMPLES = 32
#: Steps drawn at a time.
BLOCK = 2048
#: Characters that a task walks over at a time.
CHARS = 4 << 20
BANDS, ROWS = 24, 6
LOWEST = -(1 << 63)


def sample_steps(octave: int) -> np.ndarray:
    """The sampled steps of [2^octave, 2^(octave + 1)), in order; octave 0 has step 0 too."""
    low, high = (0, 2) if octave == 0 else (1 << octave, 2 << octave)
    if high - low <= SAMPLES:
        return np.arange(low, high)
    pick = np.random.Generator(np.random.Philox(key=[SEED, octave]))
    width = (high - low) // SAMPLES
    return low + np.arange(SAMPLES) * width + pick.integers(0, width, SAMPLES)


_STEPS: list[np.ndarray] = []


def all_steps(octaves: int) -> np.ndarray:
    while len(_STEPS) < octaves:
        _STEPS.append(sample_steps(len(_STEPS)))
    return np.concatenate(_STEPS[:octaves]) if octaves else np.zeros(0, np.int64)


def drawn(block: int) -> np.ndarray:
    """A bit for each step of a block and each character class; class 0, the end, never moves."""
    raw = np.random.Generator(np.random.Philox(key=[SEED + 1, block])).bytes(BLOCK * 32)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(BLOCK, 256)
    bits[:, 0] = 0
    return bits.astype(np.int64)


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes 1-255 of all texts, a 0 after each, and where each begins."""
    cp = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    code = ((cp * np.uint32(2654435761)) >> np.uint32(7)) % np.uint32(255)
    out = code.astype(np.uint8) + np.uint8(1)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    out[ends - 1] = 0
    return out, np.concatenate([[0], ends[:-1]]) if len(texts) else np.zeros(0, np.int64)


_NIBBLE = np.concatenate([[0], 1 + mix(np.arange(255, dtype=np.uint64)) % np.uint64(15)]).astype(np.uint8)


def walk(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Steps of every walk, and the sampled characters (four bits each) in step order."""
    n = len(texts)
    code, pos = classes(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    order = np.argsort(-sizes, kind="stable")
    steps = np.zeros(n, np.int64)
    active, at = order[sizes[order] > 0], pos[order][sizes[order] > 0]
    taken: list[np.ndarray] = []
    j, octaves, due, filled = 0, 0, np.zeros(0, np.int64), 0
    while len(active):
        bits = drawn(j // BLOCK)
        for k in range(BLOCK):
            if filled == len(due):
                octaves += 1
                due, filled = all_steps(octaves), len(all_steps(octaves - 1))
            c = code[at]
            if due[filled] == j:
                row = np.zeros(n, np.uint8)
                row[active] = _NIBBLE[c]
                taken.append(row)
                filled += 1
            at += bits[k][c]
            j += 1
            if j % 64 == 0 or j < 64:  # from 64 steps on, lengths are multiples of 64
                going = code[at] > 0
                if not going.all():
                    steps[active[~going]] = j
                    active, at = active[going], at[going]
                    if not len(active):
                        break
    return steps, np.stack(taken, axis=1) if taken else np.zeros((n, 0), np.uint8)


def packed(steps: int, row: np.ndarray) -> str:
    """The fingerprint: steps of the walk, then a hex digit per sampled step."""
    size = np.searchsorted(all_steps(max(1, int(steps).bit_length())), steps)
    return f"{steps:x}." + "".join("0123456789abcdef"[v] for v in row[:size].tolist())


def unpacked(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [p.split(".") for p in prints]
    out = np.zeros((len(parts), max([0, *(len(x) for _, x in parts)])), np.uint8)
    for i, (_, x) in enumerate(parts):
        out[i, : len(x)] = [int(v, 16) for v in x]
    return np.array([int(s, 16) for s, _ in parts], np.int64), out


def likeness(steps_a: np.ndarray, a: np.ndarray, steps_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of steps at which two walks wrote the same, row by row; 0 to 1."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    total = np.maximum(steps_a, steps_b)
    same, octave, col = np.zeros(len(a)), 0, 0
    most = int(total.max(initial=0))
    hit = (a == b) & (a > 0)
    while most > (0 if octave == 0 else 1 << octave):
        low, high = (0, 2) if octave == 0 else (1 << octave, 2 << octave)
        due = sample_steps(octave)
        n = np.searchsorted(due, total)
        part = hit[:, col : col + len(due)] & (np.arange(len(due))[: max(0, width - col)] < n[:, None])
        same += np.where(n > 0, part.sum(axis=1) / np.maximum(n, 1) * (np.minimum(total, high) - low), 0)
        octave, col = octave + 1, col + len(due)
    return np.where(total > 0, np.minimum(same / np.maximum(total, 1), 1.0), 1.0)


def edited(text: str, after: str) -> str:
    """The last half of a text (rounded down) replaced by as much of the beginning of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprint_with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness to each other and to the next.

    Rows are dealt into ranges of the key between quantiles of it; the first row of a range
    is copied into the range before, so every row meets its next one without a global sort.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rank = F.coalesce("k", F.lit(LOWEST))
    cuts = sorted(set(rows.approxQuantile("k", [i / (2 * parts) for i in range(1, 2 * parts)], 0.1 / parts) or []))
    ship(spark)

    @F.pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(), side="right").astype(np.int32))

    dealt = rows.withColumn("b", bucket(rank))
    # one row per range: the number of ranges is fixed by the number of partitions
    tops = sorted(((r.b, r.top) for r in dealt.select("b", rank.alias("r")).groupBy("b").agg(F.max("r").alias("top")).collect()), reverse=True)
    copies = spark.createDataFrame([(top, tops[i - 1][0]) for i, (_, top) in enumerate(tops)], "r long, before int")
    both = dealt.withColumn("r", rank).join(F.broadcast(copies), "r", "left")
    both = both.select("k", "t", "r", F.explode(F.array(F.struct("b", F.lit(0).alias("copied")), F.struct(F.col("before").alias("b"), F.lit(1).alias("copied")))).alias("x")).filter("x.b is not null").select("k", "t", "r", "x.b", "x.copied")
    placed = both.repartition(parts, "b").withColumn("h", F.sha2(F.col("t").cast("binary"), 256)).sortWithinPartitions("b", "copied", F.desc("r"), "h").select("k", "t", "b", "copied")

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        """All rows but the last; each but the copied ones gets a result from the row after it."""
        texts = [r[1] for r in rows]
        own = [i for i in range(len(rows) - 1) if not rows[i][3]]
        changed = [edited(texts[i], texts[i + 1]) for i in own]
        steps, seen = walk(texts + changed)
        at, ed = np.array(own, np.int64), len(texts) + np.arange(len(own))
        return batch(
            [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            [
                pa.array([rows[i][0] for i in own], pa.int64()),
                pa.array([len(texts[i]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
                pa.array([packed(steps[i], seen[i]) for i in own], pa.string()),
                pa.array([packed(steps[i], seen[i]) for i in ed], pa.string()),
                pa.array(likeness(steps[at], seen[at], steps[ed], seen[ed])),
                pa.array(likeness(steps[at], seen[at], steps[at + 1], seen[at + 1])),
            ],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held.append(row)
                chars += len(row[1])
                if chars > CHARS and len(held) > 1:
                    yield flush(held)
                    held, chars = held[-1:], len(row[1])
        if len(held) > 1:
            yield flush(held)

    schema = f"{key} bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(placed, run, schema)


def distance_within(a: str, b: str, most: int) -> int | None:
    """Edit distance of two texts if it is at most ``most``: furthest-reaching points by diagonal."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    x = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), "<u4")
    y = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), "<u4")

    def slide(i: int, j: int) -> int:
        while i < n and j < m:
            k = min(n - i, m - j, 256)
            differ = np.flatnonzero(x[i : i + k] != y[j : j + k])
            if len(differ):
                return i + int(differ[0])
            i, j = i + k, j + k
        return i

    reach = {0: slide(0, 0)}
    for d in range(most + 1):
        if reach.get(m - n, -1) >= 0 and n - reach[m - n] == 0 and m - (reach[m - n] + (m - n)) == 0:
            return d
        new = {}
        for g in range(-d - 1, d + 2):
            best = max(reach.get(g, -2) + 1, reach.get(g - 1, -2), reach.get(g + 1, -2) + 1)
            if best < 0 or best < -g:
                continue
            best = min(best, n, m - g)
            if best >= max(0, -g):
                new[g] = slide(best, best + g)
        reach = new
    return None


#: Texts of a band below which each meets ``BEFORE`` others besides the first.
MODERATE = 1000
BEFORE = 7


def near_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.1) -> DataFrame:
    """(a, b, distance): texts whose edit distance is at most ``share`` of the longer one.

    A band hashes ``ROWS`` sampled characters of the octaves of a length class, and each text
    is banded in its own class and the one below. Equal texts stand for each other: pairs are between
    the smallest keys of different texts. In a band each text meets the first one, and in bands of at most ``MODERATE`` texts
    the ``BEFORE`` ones before it too; other pairs of larger bands are found if they share a smaller band.
    """
    rows = df.filter(F.col(key).isNotNull()).groupBy(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).agg(F.min(key).alias("k")).select(F.col("k").cast("long"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            steps, seen = walk(texts)
            ids, bands = [], []
            for i, k in enumerate(b.column(0).to_pylist()):
                top = int(steps[i]).bit_length() - 1
                for octave in {max(top, 0), max(top - 1, 0)}:
                    size = len(all_steps(max(octave, 1)))
                    have = np.zeros(size, np.uint8)
                    have[: min(size, seen.shape[1])] = seen[i, :size]
                    pick = np.random.Generator(np.random.Philox(key=[SEED + 2, octave])).integers(0, size, (BANDS, ROWS))
                    for n, own in enumerate(have[pick]):
                        ids.append(k)
                        bands.append(f"{octave}.{n}." + own.tobytes().hex())
            yield batch(["k", "band"], [pa.array(ids, pa.int64()), pa.array(bands, pa.string())])

    banded = map_arrow(rows, run, "k bigint, band string")
    banded = materialize(banded)
    firsts = banded.groupBy("band").agg(F.min("k").alias("a"), F.count("*").alias("n")).filter("n > 1")
    met = banded.join(firsts, "band")
    # the first one may be too far: in bands of moderate size each meets the ones before it too, in small ones all of them
    order = W.partitionBy("band").orderBy("k")
    before = F.array(*[F.lag("k", i).over(order) for i in range(1, BEFORE + 1)])
    near = met.filter(F.col("n") <= MODERATE).select("k", before.alias("before")).select(F.explode("before").alias("a"), F.col("k").alias("b")).filter("a is not null")
    pairs = met.select("a", F.col("k").alias("b")).unionByName(near).filter("a < b").distinct()
    full = pairs.join(rows.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(rows.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")

    @F.pandas_udf("long")
    def distance(ta: pd.Series, tb: pd.Series) -> pd.Series:
        return pd.Series([distance_within(x, y, int(share * max(len(x), len(y)))) for x, y in zip(ta, tb)], dtype="Int64")

    return full.select("a", "b", distance("ta", "tb").alias("distance")).filter("distance is not null")
