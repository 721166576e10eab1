"""Benchmark decontamination (operator 3).

Words are lower-cased, without punctuation. An item and a passage are aligned by Smith-Waterman over words (match 2,
mismatch -1, gap -1); a score of at least ``SHARE`` of a full match of the item is a leak. Such an alignment has few
errors, so at least ``(2 SHARE - 1) x words - 1`` of the item's word pairs are whole in the passage (for 4 or 5 words, where
this is below one: ``SHARE x words`` single words). Call this number t. An item's seeds are its n-grams but the t // 2
most frequent ones, so a leak holds ``t - t // 2`` of them within twice the item's words. That many seeds of one item, this
close, are looked for inside the task that reads the text; nothing else leaves it. Such a passage, cut out with
a margin of twice the item's words, is joined with its item and aligned. No step loses a leak. Seeds are sent to all tasks,
``SEEDS`` of them at most; with more, the items are dealt to several rounds over the texts.

Items of fewer than ``N`` words have one seed, their whole sequence, and need an exact copy of a text of the same words
or a passage that holds it; it is sought as an n-gram of that length.

Edge cases: null or empty texts and items have no seeds and no leaks; repeated items and items with
equal text each get their rows; rows with a null doc_id are searched and reported with a null id;
repeated rows are reported once per id and item; ``clean`` decides by id and text, so of rows that share an id (or have
none) only those whose own text leaks go; empty tables give an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import batch, grams, map_arrow, slices, text_bytes, words
from boxwise.session import materialize

#: Words from which an item may be found by a part of it.
N = 4
SHARE = 0.6
BITS = 24
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of an item from which it is aligned in parts of this length.
PART = 512
#: Bytes of text that a task looks at together.
SLICE = 1 << 20
#: Seeds that are sent to the tasks at once.
SEEDS = 1_000_000


def plain_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of lower-cased texts without punctuation, and the word range of every text."""
    buf, offs = text_bytes(pc.utf8_lower(column))
    w, _, _, bounds = words(buf, offs, plain=True)
    return w, bounds


def word_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``plain_words`` of a column in slices of about ``SLICE`` bytes, each with its first row."""
    _, offs = text_bytes(column)
    for a, b in slices(offs, SLICE):
        yield a, *plain_words(column.slice(a, b - a))


def needed(size: int, share: float) -> tuple[int, int]:
    """(n, t): every alignment of ``share`` holds at least t of the n-grams of an item of this many words.

    With m matches and e errors, 2m - e >= 2 share x size and m <= size; the errors part the matches into e + 1 runs at
    most, which hold m - (e + 1) pairs or more.
    """
    if size < N:
        return size, 1
    pairs = math.ceil((2 * share - 1) * size - 1 - 1e-9)
    return (2, pairs) if pairs > 0 else (1, max(1, math.ceil(share * size - 1e-9)))


def pieces(items: DataFrame, key: str, text: str, share: float = SHARE) -> DataFrame:
    """(item, part, n, t, words, grams): word and n-gram hashes of every item, long ones in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, bounds = plain_words(b.column(1))
            rows = []
            for i, item in enumerate(b.column(0).to_pylist()):
                own = w[bounds[i] : bounds[i + 1]]
                last = max(0, len(own) - PART)  # the last part is as long as the others and overlaps the one before
                for k, at in enumerate([*range(0, last, PART), last]):
                    part = own[at : at + PART]
                    if len(part):
                        n, t = needed(len(part), share)
                        g, _, _ = grams(part, np.array([0, len(part)]), n)
                        rows.append((item, k, n, t, part.astype(np.int64), g.astype(np.int64)))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield batch(["item", "part", "n", "t", "words", "grams"], [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)])

    source = items.select(F.col(key).cast("long").alias("item"), F.col(text).cast("string").alias("text"))
    return map_arrow(source, run, "item bigint, part int, n int, t int, words array<bigint>, grams array<bigint>")


def bit_table(hashes: DataFrame) -> np.ndarray:
    """A table of 2^BITS bits with the bit of every hash set: 2 MB at most, whatever the number of hashes."""
    slot = F.col("h").bitwiseAND(F.lit((1 << BITS) - 1))
    packed = hashes.select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit")).distinct()
    words64 = packed.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    out = np.zeros(1 << (BITS - 6), np.int64)
    for r in words64.toLocalIterator():
        out[r.word] = r.bits
    return out.view(np.uint64)


def is_set(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.uint64((1 << BITS) - 1)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def frequencies(docs: DataFrame, table, sizes: list[int]) -> DataFrame:
    """(h, n): occurrences in all texts of the n-grams whose bit is set, added up per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.zeros(0, np.uint64)]
            for _, w, bounds in word_slices(b.column(0)):
                for n in sizes:
                    g, _, _ = grams(w, bounds, n)
                    found.append(g[is_set(table.value, g)])
            k, c = np.unique(np.concatenate(found), return_counts=True)
            yield batch(["h", "n"], [k.astype(np.int64), c])

    return map_arrow(docs.select("text"), run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def seeds(parts: DataFrame, counted: DataFrame) -> DataFrame:
    """(h, item, part, n, need, span): the n-grams of a part but its t // 2 most frequent ones, how many a leak has and within how many words.

    Those that no text has are left out; they are the rarest and so never take the place of another.
    """
    each = parts.select("item", "part", "n", "t", F.size("words").alias("size"), F.posexplode("grams").alias("at", "h")).join(counted.withColumnRenamed("n", "seen"), "h", "left")
    row = each.groupBy("item", "part", "n", "t", "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "at", "h"))).alias("g"))
    chosen = row.select("item", "part", "n", F.expr("t - t div 2").cast("int").alias("need"), (2 * F.col("size")).alias("span"), F.explode(F.expr("slice(g, 1, size(g) - cast(t div 2 as int))")).alias("x"))
    return chosen.filter("x.seen > 0").select("x.h", "item", "part", "n", "need", "span").distinct()


class SeedTable:
    """Seeds by hash with the parts that they belong to, as flat arrays; parts know how many seeds they need, and how close."""

    def __init__(self, rows: pa.Table):
        h, item, part, n, need, span = (rows.column(c).to_numpy() for c in ("h", "item", "part", "n", "need", "span"))
        keys, first, self.of = np.unique(np.rec.fromarrays([item, part], names="item,part"), return_index=True, return_inverse=True)
        self.item, self.part = keys["item"].astype(np.int64), keys["part"].astype(np.int32)
        self.size, self.need, self.span = n[first].astype(np.int64), need[first].astype(np.int64), span[first].astype(np.int64)
        order = np.argsort(h.view(np.uint64), kind="stable")
        self.of = self.of[order].astype(np.int32)
        self.h, self.start = np.unique(h.view(np.uint64)[order], return_index=True)
        self.start = np.append(self.start, len(order))
        self.sizes = sorted(set(self.size.tolist()))
        self.bits = np.zeros(1 << (BITS - 6), np.uint64)
        slot = self.h & np.uint64((1 << BITS) - 1)
        np.bitwise_or.at(self.bits, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))

    def passages(self, w: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, part number, first word, last word + 1) where enough seeds of a part lie close together."""
        ats, ofs = [], []
        for n in self.sizes:
            g, first, _ = grams(w, bounds, n)
            hit = np.flatnonzero(is_set(self.bits, g))
            near = np.minimum(np.searchsorted(self.h, g[hit]), len(self.h) - 1)
            same = self.h[near] == g[hit]
            hit, near = hit[same], near[same]
            many = self.start[near + 1] - self.start[near]
            of = self.of[np.repeat(self.start[near], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            ok = self.size[of] == n
            ats.append(np.repeat(first[hit], many)[ok])
            ofs.append(of[ok])
        at, of = np.concatenate(ats), np.concatenate(ofs)
        order = np.lexsort((at, of))
        at, of = at[order], of[order].astype(np.int64)
        text = np.searchsorted(bounds, at, side="right") - 1
        need, span = self.need[of], self.span[of]
        last = np.arange(len(at)) + need - 1
        inside = last < len(at)
        last = np.minimum(last, max(len(at) - 1, 0))
        full = np.flatnonzero(inside & (of[last] == of) & (text[last] == text) & (at[last] - at < span))
        mark = np.zeros(len(at) + 1, np.int64)
        np.add.at(mark, full, 1)
        np.add.at(mark, last[full] + 1, -1)
        kept = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        at, of, text, span = at[kept], of[kept], text[kept], span[kept]
        new = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0) | (np.diff(at, prepend=0) >= span)) if len(at) else []
        for s, e in zip(new, [*new[1:], len(at)]):
            d = int(text[s])
            yield d, int(of[s]), max(int(bounds[d]), int(at[s] - span[s])), min(int(bounds[d + 1]), int(at[e - 1] + span[s] + N))


def passages(docs: DataFrame, table) -> DataFrame:
    """(doc_id, k, item, part, start, passage): parts of texts with enough seeds of an item; passages are packed word hashes."""
    names = ["doc_id", "k", "item", "part", "start", "passage"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table.value
        for b in batches:
            for a, w, bounds in word_slices(b.column(2)):
                rows = []
                for d, of, low, high in own.passages(w, bounds):
                    rows.append((b.column(0)[a + d].as_py(), b.column(1)[a + d].as_py(), own.item[of], own.part[of], low - bounds[d], w[low:high].tobytes()))
                if rows:
                    yield batch(names, [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)])

    return map_arrow(docs.select("doc_id", "k", "text"), run, "doc_id bigint, k bigint, item bigint, part int, start bigint, passage binary")


def aligned(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two word sequences, and where in the passage it ends.

    A row at a time: gaps along the row are a running maximum of the scores without them.
    """
    step = np.arange(len(passage) + 1) * -GAP
    row, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + step) - step
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


_FOUND = "doc_id bigint, k bigint, item_id bigint, score double, n_words bigint, word_end bigint"


def found(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, k, item_id, score, n_words, word_end) of every alignment above the threshold; k is the hash of the text."""
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("k", F.xxhash64("text"))
    parts = materialize(pieces(items, item, item_text, share))
    sizes = parts.agg(F.collect_set("n").alias("sizes")).first().sizes
    every = spark.sparkContext.broadcast(bit_table(parts.select(F.explode("grams").alias("h"))))
    chosen = materialize(seeds(parts, materialize(frequencies(source, every, sorted(sizes)))))
    rounds = -(-chosen.count() // SEEDS)
    met = None
    for r in range(rounds):
        own = chosen if rounds == 1 else chosen.filter(F.pmod(F.xxhash64("item"), F.lit(rounds)) == r)
        rows = own.toArrow()
        if rows.num_rows:
            some = passages(source, spark.sparkContext.broadcast(SeedTable(rows)))
            met = some if met is None else met.unionByName(some)
    if met is None:
        return spark.createDataFrame([], _FOUND)
    both = met.join(parts.select("item", "part", "words"), ["item", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, seen = [], {}
            ids, keys, numbers, numbered, starts = (b.column(i).to_pylist() for i in range(5))
            for r, (d, k, i, part, start) in enumerate(zip(ids, keys, numbers, numbered, starts)):
                own, passage = b.column(6)[r].values.to_numpy(), b.column(5)[r].as_py()
                same = (i, part, passage)  # copies are aligned once per batch
                if same not in seen:
                    seen[same] = aligned(own, np.frombuffer(passage, np.int64))
                score, end = seen[same]
                if score >= share * MATCH * len(own):
                    out.append((d, k, i, score / (MATCH * len(own)), len(own), start + end))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield batch(["doc_id", "k", "item_id", "score", "n_words", "word_end"], [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)])

    return map_arrow(both.select("doc_id", "k", "item", "part", "start", "passage", "words"), run, _FOUND)


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, score, n_words, word_end): the best alignment of every document and item above the threshold."""
    best = F.max(F.struct("score", "n_words", (-F.col("word_end")).alias("before"))).alias("x")
    some = found(docs, items, key, text, item, item_text, share).groupBy("doc_id", "item_id").agg(best)
    return some.select("doc_id", "item_id", "x.score", "x.n_words", (-F.col("x.before")).alias("word_end"))


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has no leak."""
    bad = materialize(found(docs, items, key, text).select(F.col("doc_id").alias("_bad"), F.col("k").alias("_k")).distinct())
    mine = F.col(key).cast("long").eqNullSafe(F.col("_bad")) & (F.xxhash64(F.col(text).cast("string")) == F.col("_k"))
    return docs.join(bad, mine, "left_anti")
