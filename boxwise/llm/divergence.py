"""Source divergence audit by pair-task sparse merges (operator 12).

Terms are runs of letters A-Z (lower-cased) and characters outside ASCII. A language keeps the terms that
``DOCUMENTS`` of its texts hold; of these every source of it, and the language, has a smoothed share in parts
per billion, p = 1 + floor(10^9 (count + 1) / (N + V)). How far p is from q is floor((p - q)^2 / q).

Kept terms get ids inside shards of about ``SHARD`` terms. A source's shard is one array of sorted ids with one of
counts. Every unordered pair of sources is a task per shard: its two arrays are co-grouped, a galloping intersection
finds the terms of both, and one merge prices these, the one-sided ones and, by number, the absent ones, both ways.
The shards' sums are added in Spark. A task so holds two arrays of bounded size, whatever the source. Shares are
computed with integers or decimals, never in floating point.

Edge cases: null text, language and source are empty strings; texts without terms leave their (language, source)
in the result with counts of 0; a language without kept terms has pairs of value 0 and no terms; a language of one
source has no pairs; repeated rows count as often as they occur; ties in value rank by item, byte by byte; an empty
table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxwise.llm.common import batch, map_arrow, slices, text_bytes
from boxwise.session import materialize

#: Documents of a language that must hold a term.
DOCUMENTS = 3
BILLION = 1_000_000_000
#: Ranks of terms that are returned.
TOP = 200
#: Terms of one shard of a language, about.
SHARD = 50_000
#: Distinct terms that a task holds before it hands its counts on.
HELD = 300_000
#: Bytes of a text that are cut into terms at a time.
SLICE = 1 << 20
#: Languages that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Ids by which a gallop begins.
STRIDE = 64

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[128:] = np.arange(128, 256)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)


def text_terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of one text, which has other bytes as spaces, some at a time."""
    low = 0
    while low < len(data):
        high = len(data) if len(data) - low <= SLICE else data.find(b" ", low + SLICE)
        high = len(data) if high < 0 else high
        yield data[low:high].split()
        low = high


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and texts, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occur: dict[tuple[str, str], Counter] = {}
        texts: dict[tuple[str, str], Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), c in occur.items():
                d, names = texts[lang, source], list(c)
                for a in range(0, len(names), 20_000):
                    part = names[a : a + 20_000]
                    yield batch(
                        ["lang", "source", "term", "n", "docs"],
                        [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array([w.decode() for w in part]), pa.array([c[w] for w in part], pa.int64()), pa.array([d[w] for w in part], pa.int64())],
                    )

        for b in batches:
            langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
            buf, offs = text_bytes(b.column(2))
            for a, z in slices(offs, 4 << 20):
                data = _LETTER[buf[offs[a] : offs[z]]].tobytes()
                for i in range(a, z):
                    key = (langs[i], sources[i])
                    c, d = occur.setdefault(key, Counter()), texts.setdefault(key, Counter())
                    own: set[bytes] = set()
                    for part in text_terms(data[offs[i] - offs[a] : offs[i + 1] - offs[a]]):
                        c.update(part)
                        own.update(part)
                    d.update(own)
                if sum(map(len, occur.values())) > HELD:
                    yield from rows()
                    occur, texts = {}, {}
        yield from rows()

    found = map_arrow(docs.select("lang", "source", "text"), run, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, whole: Column) -> Column:
    """1 + floor(10^9 (n + 1) / whole), exactly."""
    wide = (n + F.lit(1)).cast("decimal(20,0)") * F.lit(BILLION).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", wide, whole.cast("decimal(20,0)"))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def shares(n: np.ndarray, whole: int) -> np.ndarray:
    """``share`` of an array; three digits at a time keep the products within 64 bits."""
    out, rest = (n + 1) // whole, (n + 1) % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal ids in two sorted arrays of distinct ids.

    The longer one is passed in doubling steps until it is beyond the next ids of the shorter one, which are then
    sought between the last two steps only.
    """
    left, right, low = [], [], 0
    for a in range(0, len(short), STRIDE):
        part = short[a : a + STRIDE]
        step = STRIDE
        while low + step < len(long) and long[low + step] < part[-1]:
            step *= 2
        window = long[low : low + step + 1]
        at = np.searchsorted(window, part)
        hit = np.flatnonzero(at < len(window))
        hit = hit[window[at[hit]] == part[hit]]
        left.append(hit + a)
        right.append(at[hit] + low)
        low += int(at[-1])
        if low >= len(long):
            break
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], whole_a: int, whole_b: int) -> tuple[int, int, int]:
    """(a from b, b from a, distinct terms) over the terms that at least one of two (ids, counts) has."""
    swap = len(a[0]) > len(b[0])
    i, j = gallop(b[0], a[0])[::-1] if swap else gallop(a[0], b[0])
    only_a, only_b = np.ones(len(a[0]), bool), np.ones(len(b[0]), bool)
    only_a[i], only_b[j] = False, False
    nothing = np.zeros(1, np.int64)
    p = shares(np.concatenate([a[1][i], a[1][only_a], np.repeat(nothing, only_b.sum())]), whole_a)
    q = shares(np.concatenate([b[1][j], np.repeat(nothing, only_a.sum()), b[1][only_b]]), whole_b)
    return int(distances(p, q).sum()), int(distances(q, p).sum()), len(p)


def pair_sums(arrays: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, ab, ba, seen): for each pair of sources a < b the sums over terms that one of them has.

    ``arrays`` has (lang, source, shard, ids, counts, whole), ``groups`` the sources of every language.
    """
    other = groups.select("lang", F.col("source").alias("other"), F.col("whole").alias("other_whole"))
    side = arrays.join(other, "lang").filter("source <> other")
    first = F.col("source") < F.col("other")
    side = side.select(
        "lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), "shard", first.alias("first"), "ids", "counts",
        F.when(first, F.col("whole")).otherwise(F.col("other_whole")).alias("whole_a"),
        F.when(first, F.col("other_whole")).otherwise(F.col("whole")).alias("whole_b"),
    )
    names = ["lang", "a", "b", "ab", "ba", "seen"]
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, tuple[np.ndarray, np.ndarray]] = {}
        now, wholes = None, (1, 1)
        for x in batches:
            out = []
            keys = list(zip(*(x.column(k).to_pylist() for k in range(4))))
            firsts, wa, wb = (x.column(k).to_pylist() for k in (4, 7, 8))
            for r, key in enumerate(keys):
                if key != now:
                    if now is not None:
                        out.append((*now[:3], *merged(held.get(True, none), held.get(False, none), *wholes)))
                    now, wholes, held = key, (wa[r], wb[r]), {}
                held[firsts[r]] = tuple(x.column(k)[r].values.to_numpy() for k in (5, 6))
            yield batch(names, [pa.array([o[k] for o in out], pa.string() if k < 3 else pa.int64()) for k in range(6)])
        if now is not None:
            yield batch(names, [pa.array([v], pa.string() if k < 3 else pa.int64()) for k, v in enumerate((*now[:3], *merged(held.get(True, none), held.get(False, none), *wholes)))])

    dealt = side.repartition("lang", "a", "b", "shard").sortWithinPartitions("lang", "a", "b", "shard")
    dealt = dealt.select("lang", "a", "b", "shard", "first", "ids", "counts", "whole_a", "whole_b")
    found = map_arrow(dealt, run, "lang string, a string, b string, ab bigint, ba bigint, seen bigint")
    return found.groupBy("lang", "a", "b").agg(*(F.sum(c).alias(c) for c in ("ab", "ba", "seen")))


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how far every source is from the others (part ``pair``) and from its language by term (``term``)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = df.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))
    counted = materialize(term_counts(docs))
    kept = materialize(counted.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("all_docs")).filter(F.col("all_docs") >= DOCUMENTS).select("lang", "term", "all_n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))
    langs = materialize(langs)
    # by broadcast, as one language may hold most terms
    of_lang = F.broadcast(langs) if langs.count() <= BROADCAST_ROWS else langs
    own = materialize(counted.drop("docs").join(kept, ["lang", "term"]))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "all_total")))
    groups = materialize(groups.withColumn("whole", F.col("total") + F.col("v")))

    # ids by term inside hash shards, so that no array and no window grows with the vocabulary
    sharded = kept.join(of_lang.select("lang", "v"), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / SHARD)))
    numbered = sharded.select("lang", "term", "shard", F.row_number().over(W.partitionBy("lang", "shard").orderBy("term")).cast("long").alias("id"))
    placed = own.join(numbered, ["lang", "term"]).groupBy("lang", "source", "shard").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("x"))
    arrays = placed.select("lang", "source", "shard", F.col("x.id").alias("ids"), F.col("x.n").alias("counts")).join(groups.select("lang", "source", "whole"), ["lang", "source"])
    sums = pair_sums(arrays, groups)
    way = lambda x, y, found: F.struct(F.col(x).alias("source"), F.col(y).alias("item"), F.col(found).alias("found"))
    sums = sums.select("lang", "seen", F.explode(F.array(way("a", "b", "ab"), way("b", "a", "ba"))).alias("x")).select("lang", "seen", "x.*")
    pairs = groups.select("lang", "source", "v", "whole").join(groups.select("lang", F.col("source").alias("item"), F.col("whole").alias("item_whole")), "lang").filter("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left")
    absent = (F.col("v") - F.coalesce("seen", F.lit(0))) * distance(share(F.lit(0), F.col("whole")), share(F.lit(0), F.col("item_whole")))
    value = F.when(F.col("v") == 0, F.lit(0)).otherwise(F.coalesce("found", F.lit(0)) + absent)
    pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.withColumn("rank", F.row_number().over(order))
    terms = own.join(groups.select("lang", "source", "whole", "v", "all_total"), ["lang", "source"])
    terms = terms.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("whole")).alias("p"), share(F.col("all_n"), F.col("all_total") + F.col("v")).alias("q")).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", distance(F.col("p"), F.col("q")).alias("value"))
    # only the best of each task are shuffled, as the limit stands on the rank
    term = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    return pair.unionByName(term)
