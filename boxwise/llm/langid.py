"""Language ID by nearest centroid (operator 10).

A text is a TF-IDF vector of hashed byte trigrams of its lower-cased letters, scaled to length
one. Every language has several centroids, found by spherical k-means; the best cosine decides.
A text whose best cosine lies below a floor for its length is rejected: ``REJECT_SHARE`` of the
``REJECT_QUANTILE`` of that cosine over all training rows of like length (``NEAR`` half octaves
up and down), and never above the floor of a longer text.

Document frequencies, label counts and floors come from all training rows. Only k-means works
on a bounded sample: about ``SAMPLE`` rows per language, picked by a hash of the id, and fewer of each, ``FEWEST``
at least, where languages are so many that this would exceed ``SAMPLE_ROWS``. The model is of fixed size (``DIMS`` x centroids), so it goes to every task.

Edge cases: null text or one without a letter is ``und`` with score 0 and is rejected; rows with
a null label or null id teach nothing, and a null id counts as held out; without training rows
every text is ``und``; ties go to the first label in byte order; repeated rows are scored
alike; an empty table gives an empty result; other columns are carried or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import batch, map_arrow, slices, text_bytes

DIMS = 4096
SAMPLE = 500
SAMPLE_ROWS = 20_000
FEWEST = 20
#: Most languages; more are an error.
LABELS = 1000
CENTROIDS = 5
ROUNDS = 12
REJECT_QUANTILE = 0.001
REJECT_SHARE = 0.33
NEAR = 3
UNKNOWN = "und"
BINS = 40
STEPS = 200

_CLASS = np.arange(256, dtype=np.uint32)
for _b in range(128):
    if not chr(_b).isalpha():
        _CLASS[_b] = 32
_LETTER = regex.compile(r"\p{L}")


def vectors(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row, counts) of row ranges; counts has a row per text and DIMS columns."""
    for at in range(0, len(column), 256):  # few texts at a time, so that a task's memory stays small
        buf, offs = text_bytes(pc.utf8_lower(column.slice(at, 256)))
        for c, d in slices(offs, 4 << 20):
            part, o = _CLASS[buf[offs[c] : offs[d]]], offs[c : d + 1] - offs[c]
            out = np.zeros((d - c, DIMS), np.float32)
            if len(part) > 2:
                g = part[:-2] * np.uint32(0x01000193) + part[1:-1] * np.uint32(0x9E3779B1) + part[2:] * np.uint32(0x85EBCA6B)
                g ^= g >> np.uint32(15)
                g *= np.uint32(0x2C1B3C6D)
                g >>= np.uint32(20)
                row = np.repeat(np.arange(d - c), np.diff(o))
                ok = (row[:-2] == row[2:]) & ~((part[:-2] == 32) & (part[1:-1] == 32))
                key = row[:-2][ok] * DIMS + g[ok]
                out = np.bincount(key, minlength=(d - c) * DIMS).astype(np.float32).reshape(d - c, DIMS)
            yield at + c, at + d, out


def scaled(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def length_bin(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(counts.sum(axis=1) + 1) * 2, BINS - 1).astype(np.int64)


@dataclass
class Model:
    labels: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray

    def best(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label number and cosine of the nearest centroid of every row."""
        cos = scaled(counts, self.idf) @ self.centroids.T
        at = cos.argmax(axis=1)
        return self.owner[at], np.clip(cos[np.arange(len(at)), at], 0, 1)


def kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; the rows come in a fixed order."""
    k = min(k, len(x))
    picks = [0]
    near = x @ x[0]
    for _ in range(k - 1):
        picks.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picks[-1]])
    c = x[picks].copy()
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        for j in range(k):
            if (own == j).any():
                m = x[own == j].sum(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def held_out(key: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def rows_each(languages: int, sample: int = SAMPLE) -> int:
    """Rows of the sample per language."""
    return min(sample, max(FEWEST, SAMPLE_ROWS // max(1, languages)))


def fit(df: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """Learn from rows with a label; the caller leaves out what must not be learned from."""
    rows = df.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(label).alias("label"), F.col(key).alias("key"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for c, d, x in vectors(b.column(0)):
                total += (x > 0).sum(axis=0)
                seen += d - c
        dims = np.flatnonzero(total)
        yield batch(["dim", "n"], [np.append(dims, -1), np.append(total[dims], seen)])

    counted = {r.dim: r.n for r in map_arrow(rows.select("text"), frequencies, "dim bigint, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    n = counted.pop(-1, 0)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + np.array([counted.get(i, 0) for i in range(DIMS)], np.float32))).astype(np.float32) + 1

    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().limit(LABELS + 1).collect()}
    if len(sizes) > LABELS:
        raise ValueError(f"more than {LABELS} languages")
    each = rows_each(len(sizes), sample)
    share = F.create_map(*[F.lit(x) for label, count in sizes.items() for x in (label, each / count)])
    mark = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.withColumn("mark", mark).filter(F.col("mark") < share[F.col("label")]).select("text", "label", "mark", "key")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, _, x in vectors(b.column(0)):
                for row in x:
                    i = np.flatnonzero(row)
                    out.append(np.stack([i, row[i]]).astype("<u4").tobytes())
            yield batch(["label", "mark", "key", "data"], [b.column(1), b.column(2), b.column(3), pa.array(out, pa.binary())])

    kind = df.schema[key].dataType.simpleString()
    found = sorted(map_arrow(picked, sparse, f"label string, mark double, key {kind}, data binary").collect(), key=lambda r: (r.label, r.mark, str(r.key), bytes(r.data)))
    labels, owner, centroids = sorted({r.label for r in found}), [], []
    for k, name in enumerate(labels):
        own = [np.frombuffer(r.data, "<u4").reshape(2, -1) for r in found if r.label == name]
        x = np.zeros((len(own), DIMS), np.float32)
        for i, (dims, values) in enumerate(own):
            x[i, dims] = values
        c = kmeans(scaled(x, idf), CENTROIDS)
        centroids.append(c)
        owner += [k] * len(c)
    model = Model(labels, np.array(owner), np.concatenate(centroids).astype(np.float32), idf, np.zeros(BINS, np.float32))

    shared = df.sparkSession.sparkContext.broadcast(model)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS * STEPS, np.int64)
        for b in batches:
            for _, _, x in vectors(b.column(0)):
                cell = length_bin(x) * STEPS + np.minimum(shared.value.best(x)[1] * STEPS, STEPS - 1).astype(np.int64)
                total += np.bincount(cell, minlength=BINS * STEPS)
        cells = np.flatnonzero(total)
        yield batch(["cell", "n"], [cells, total[cells]])

    table = np.zeros(BINS * STEPS, np.int64)
    for r in map_arrow(rows.select("text"), histogram, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[r.cell] = r.n
    table = table.reshape(BINS, STEPS)
    floors = np.full(BINS, np.inf)
    for i in range(BINS):
        counts = table[max(0, i - NEAR) : i + NEAR + 1].sum(axis=0)
        if (size := counts.sum()) > 0:
            floors[i] = REJECT_SHARE * np.searchsorted(np.cumsum(counts), REJECT_QUANTILE * size, side="right") / STEPS
    # lengths that no training row has take the floor of the next longer one that some have, else of the longest
    last = floors[np.isfinite(floors)][-1]
    floors[np.flatnonzero(np.isfinite(floors))[-1] :] = last
    model.floors[:] = np.minimum.accumulate(floors[::-1])[::-1]
    return model


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of ``df`` with lang_pred, score and rejected."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            column = b.column(at)
            n = len(column)
            label, score, bad = np.zeros(n, np.int64), np.zeros(n), np.ones(n, bool)
            letters = np.array([x is not None and _LETTER.search(x) is not None for x in column.to_pylist()], bool)
            if m is not None:
                for c, d, x in vectors(column):
                    label[c:d], score[c:d] = m.best(x)
                    bad[c:d] = score[c:d] < m.floors[length_bin(x)]
            else:
                letters[:] = False
            pred = [m.labels[k] if ok else UNKNOWN for k, ok in zip(label.tolist(), letters.tolist())]
            yield batch([*names, "lang_pred", "score", "rejected"], [*b.columns, pa.array(pred, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(bad | ~letters)])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_arrow(df, run, f"{kinds}, lang_pred string, score double, rejected boolean")
