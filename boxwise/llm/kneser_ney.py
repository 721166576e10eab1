"""Quality classifier: interpolated modified Kneser-Ney model (operator 9).

n-grams are runs of ``ORDER`` bytes of the lower-cased text, packed into integers, so counts are
exact. Raw counts of the highest order come from trusted text; lower orders count distinct left
neighbours. Counts, discounts, probabilities and back-off weights are grouped and joined as
tables. For scoring the tables are split by the byte before the predicted one into shards of at most
``SHARD`` rows (one byte's rows at least); a text meets one shard after the other and its log-probabilities add
up, so no task holds more than one shard. A language's threshold is the ``QUANTILE`` of the perplexity of its
trusted texts that were held out of the counts (a fifth, by hash of the id), times ``SLACK``; a language with
fewer than ``FEW`` of them takes that of all languages.

Edge cases: null or empty text has no perplexity and isn't kept; without trusted text all
perplexities and thresholds are null and every text with content is kept; a null language is
a language of its own; rows with a null id are scored, never trusted; repeated rows are
scored alike; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import batch, map_arrow, slices, text_bytes
from boxwise.session import materialize

ORDER = 5
SHARD = 4_000_000
QUANTILE = 0.99
SLACK = 1.5
FEW = 50
HELD = 5
#: Ids of trusted rows up to which they are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Distinct n-grams that a task gathers before it hands them on.
FLUSH = 500_000


def keys(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, key of the n-gram that ends at each byte, text ranges) of row ranges.

    The byte that ends the n-gram is the lowest one of the key; before a text stand zeros.
    """
    for at in range(0, len(column), 256):  # few texts at a time, so that a task's memory stays small
        buf, offs = text_bytes(pc.utf8_lower(column.slice(at, 256)))
        for a, b in slices(offs, 1 << 20):
            part, o = buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            out = part.astype(np.uint64)
            for k in range(1, ORDER):
                before = np.zeros(len(part), np.uint8)
                before[k:] = part[:-k]
                for i in range(k):  # the first k bytes of a text have nothing so far before them
                    first = o[:-1] + i
                    before[first[first < o[1:]]] = 0
                out |= before.astype(np.uint64) << np.uint64(8 * k)
            yield at + a, at + b, out, o


def counts(trusted: DataFrame) -> DataFrame:
    """(key, c) of the highest order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(parts):
            k, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            return k, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        parts, size = [], 0
        for b in batches:
            for _, _, key, _ in keys(b.column(0)):
                parts.append(np.unique(key, return_counts=True))
                size += len(parts[-1][0])
                if size > FLUSH:
                    parts = [merged(parts)]
                    size = len(parts[0][0])
                    if size > FLUSH // 2:
                        yield batch(["key", "c"], [parts[0][0].astype(np.int64), parts[0][1]])
                        parts, size = [], 0
        if parts:
            k, n = merged(parts)
            yield batch(["key", "c"], [k.astype(np.int64), n])

    return map_arrow(trusted.select("text"), run, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c"))


def discounts(table: DataFrame) -> tuple[float, float, float]:
    """Discounts for counts of one, two, and three or more, from counts of counts."""
    n = {r.c: r.n for r in table.filter("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in range(1, 5))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.01), k - 0.01) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def model(trusted: DataFrame) -> DataFrame:
    """(order, kind, key, value): kind p, the probability of a seen n-gram; kind w, the back-off weight of a context."""
    tables = {ORDER: materialize(counts(trusted))}
    for k in range(ORDER - 1, 0, -1):
        longer = tables[k + 1]
        tables[k] = materialize(longer.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("key")).agg(F.count("*").alias("c")))
    below, rows = None, None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(tables[k])
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        t = tables[k].withColumn("ctx", F.shiftright("key", 8)).withColumn("cut", cut)
        ctx = t.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("cut").alias("cuts")).withColumn("w", F.col("cuts") / F.col("total"))
        t = t.join(ctx, "ctx").withColumn("a", (F.col("c") - F.col("cut")) / F.col("total"))
        if below is None:
            p = t.select("key", (F.col("a") + F.col("w") / 256).alias("value"))
        else:
            lower = below.select(F.col("key").alias("suffix"), F.col("value").alias("low"))
            t = t.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
            p = t.join(lower, "suffix").select("key", (F.col("a") + F.col("w") * F.col("low")).alias("value"))
        below = materialize(p)
        both = below.select(F.lit(k).alias("order"), F.lit("p").alias("kind"), "key", "value").unionByName(ctx.select(F.lit(k).alias("order"), F.lit("w").alias("kind"), F.col("ctx").alias("key"), F.col("w").alias("value")))
        rows = both if rows is None else rows.unionByName(both)
    return materialize(rows)


def shards(rows: DataFrame, most: int) -> list[list[int]]:
    """Bytes before the predicted one, put together while their rows stay below ``most``."""
    before = F.when(F.col("kind") == "p", F.shiftright("key", 8)).otherwise(F.col("key")).bitwiseAND(F.lit(255))
    sizes = sorted((r.b, r.n) for r in rows.filter("order > 1").groupBy(before.alias("b")).agg(F.count("*").alias("n")).collect())
    have = dict(sizes)
    out, now, size = [], [], 0
    for b in range(256):
        if now and size + have.get(b, 0) > most:
            out, now, size = [*out, now], [], 0
        now.append(b)
        size += have.get(b, 0)
    return [*out, now]


class Shard:
    """Sorted keys and logarithms of one shard, by order and kind."""

    def __init__(self, rows: pa.Table, own: list[int]):
        """``rows``: tag (2 x order, plus 1 for weights), key, log."""
        self.own = np.zeros(256, bool)
        self.own[own] = True
        self.tables = {}
        tag, key, log = (rows.column(i).to_numpy() for i in range(3))
        for t in np.unique(tag):
            k = key[tag == t].astype(np.uint64)
            at = np.argsort(k)
            self.tables[int(t) // 2, "pw"[t % 2]] = (k[at], log[tag == t][at])

    def find(self, order: int, kind: str, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have, value = self.tables.get((order, kind), (np.zeros(0, np.uint64), np.zeros(0, np.float32)))
        if not len(have):
            return np.zeros(len(key), bool), np.zeros(len(key), np.float32)
        at = np.minimum(np.searchsorted(have, key), len(have) - 1)
        return have[at] == key, value[at]

    def score(self, key: np.ndarray) -> np.ndarray:
        """Log-probability of the byte that ends each n-gram: the longest seen n-gram, with the weights of longer contexts."""
        out = np.zeros(len(key))
        todo = np.arange(len(key))
        for k in range(ORDER, 0, -1):
            part = key[todo] & np.uint64((1 << 8 * k) - 1)
            seen, p = self.find(k, "p", part)
            out[todo[seen]] += p[seen]
            todo, part = todo[~seen], part[~seen]
            known, w = self.find(k, "w", part >> np.uint64(8))
            out[todo[known]] += w[known]
        out[todo] += -np.log(256.0)
        return out


def scores(docs: DataFrame, rows: DataFrame, shard_rows: int = SHARD) -> tuple[DataFrame, list]:
    """(row columns of ``docs`` without text, n_bytes, log_p): a pass over the texts per shard, summed by row.

    The shards sent to the executors come second; the caller drops them when the result is stored.
    """
    spark, carried = docs.sparkSession, [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    plan = shards(rows, shard_rows)
    before = F.when(F.col("kind") == "p", F.shiftright("key", 8)).otherwise(F.col("key")).bitwiseAND(F.lit(255))
    parts, sent = None, []
    tag = (F.col("order") * 2 + (F.col("kind") == "w").cast("int")).cast("tinyint")
    for own in plan:
        local = rows.filter((F.col("order") == 1) | before.between(own[0], own[-1])).select(tag.alias("tag"), "key", F.log("value").cast("float").alias("log"))
        shared = spark.sparkContext.broadcast(Shard(local.toArrow(), own))
        sent.append(shared)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            s = shared.value
            for b in batches:
                n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
                for first, last, key, o in keys(b.column(b.num_columns - 1)):
                    n[first:last] = np.diff(o)
                    if not len(key):
                        continue
                    each, at = np.unique(key, return_inverse=True)
                    mine = s.own[((each >> np.uint64(8)) & np.uint64(255)).astype(np.int64)]
                    value = np.zeros(len(each))
                    value[mine] = s.score(each[mine])
                    sums = np.concatenate([[0.0], np.cumsum(value[at])])
                    total[first:last] = sums[o[1:]] - sums[o[:-1]]
                yield batch([*carried, "n_bytes", "log_p"], [*b.columns[:-1], n, total])

        part = map_arrow(docs.select(*carried, "text"), run, f"{kinds}, n_bytes bigint, log_p double")
        parts = part if parts is None else parts.unionByName(part)
    return (parts if len(plan) == 1 else parts.groupBy(*carried).agg(F.max("n_bytes").alias("n_bytes"), F.sum("log_p").alias("log_p"))), sent


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", shard_rows: int = SHARD) -> DataFrame:
    """(key, lang, n_bytes, perplexity, threshold, keep, trusted) of every row of ``docs``.

    ``labels`` (key, quality, toxic) says which rows are trusted: quality 1 and not toxic, by every label of the key.
    """
    good = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("good")).agg(F.min((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("ok")).filter("ok").select("good", F.lit(True).alias("trusted"))
    good = materialize(good)
    side = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    rows = docs.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).join(side, F.col("key") == F.col("good"), "left")
    # equal rows are told apart by a number, so that sums over shards are sums of one row
    rows = rows.select("key", "lang", F.coalesce("trusted", F.lit(False)).alias("trusted"), (F.pmod(F.xxhash64("key"), F.lit(HELD)) == 0).alias("held"), "text")
    trusted, sent = rows.filter("trusted and not held"), []
    if trusted.isEmpty():
        scored = rows.select("key", "lang", "trusted", "held", F.coalesce(F.octet_length(F.lower("text")), F.lit(0)).cast("long").alias("n_bytes"), F.lit(None).cast("double").alias("log_p"))
    else:
        table = model(trusted)
        if len(shards(table, shard_rows)) > 1:
            rows = rows.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
            unique = rows.dropDuplicates(["key", "lang", "digest"])
            scored, sent = scores(unique, table, shard_rows)
            times = rows.groupBy("key", "lang", "digest").agg(F.count("*").alias("times"))
            same = F.col("a.key").eqNullSafe(F.col("b.key")) & F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.digest") == F.col("b.digest"))
            scored = scored.alias("a").join(times.alias("b"), same).select("a.key", "a.lang", "trusted", "held", "n_bytes", "log_p", F.explode(F.expr("array_repeat(1, cast(times as int))")).alias("one")).drop("one")
        else:
            scored, sent = scores(rows, table, shard_rows)
    scored = materialize(scored.select("key", "lang", "trusted", "held", "n_bytes", F.when(F.col("n_bytes") > 0, F.exp(-F.col("log_p") / F.col("n_bytes"))).alias("perplexity")))
    for shared in sent:
        shared.destroy()
    sample = scored.filter("trusted and held and perplexity is not null")
    cut = (F.percentile_approx("perplexity", QUANTILE, 10000) * SLACK).alias("threshold")
    general = sample.agg(cut).first()[0]
    own_cut = sample.groupBy("lang").agg(cut, F.count("*").alias("n")).filter(F.col("n") >= FEW).select(F.col("lang").alias("of"), "threshold")
    out = scored.join(own_cut, F.col("lang").eqNullSafe(F.col("of")), "left")
    limit = F.coalesce("threshold", F.lit(general).cast("double"))
    return out.select(F.col("key").alias(key), "lang", "n_bytes", "perplexity", limit.alias("threshold"), ((F.col("n_bytes") > 0) & F.coalesce(F.col("perplexity") <= limit, F.lit(True))).alias("keep"), "trusted")
