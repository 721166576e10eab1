"""Conversation structure repair by bidirectional Dijkstra over the edit lattice (operator 11).

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Its rows, in order, are columns of a
lattice, the states of this grammar its rows: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an
assistant row. Edits are edges: Keep (K, 0), Rerole to what the state asks for (R, 2), Delete (D, 3, required for blank
rows and duplicates), Insert an empty row (I, 2); a truncated row that stays adds 1. A forward heap from the start and
a reverse one from the end settle nodes, each with the ASCII-least audit of its least cost, until no two open
nodes can still make a path of the least cost found; all crossings of that cost are then finished, and the least
concatenated audit wins. An audit of one node and cost is never the beginning of another, so parts can be compared alone.

A conversation of any length: rows are sorted by range over conversation and turn, so a long one lies on several
partitions, and cut in blocks of at most ``BLOCK`` rows. Searches run per block, for a cut conversation between all
states at both ends; tables of (cost, audit) by states are then merged, ``FAN`` at a time. The digest of the repaired
text is taken while the sorted rows stream by, one at a time, as SHA-256 can't be split.

Order: by turn (nulls first); rows of one turn by role, the first 64 characters of the text, then its SHA-256.

Edge cases: null roles and texts are one space, as null ids and turns are where the damage is drawn; all rows with a
null conv_id are one conversation; an empty role has no initial, so its row can't be kept; a conversation that lost all
rows has zeros, an empty audit and the digest of nothing; repeated rows are duplicates of the first; an empty table
gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import batch, map_arrow
from boxwise.session import materialize

#: Rows of a conversation that are searched at once.
BLOCK = 512
#: Partitions whose blocks are merged at once.
FAN = 16
RANGE = 33
SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
STATES = range(4)
#: The next state by initial, and the role that a state asks for with the state after it.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ASKED = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
ENDS = (0, 3)

Table = dict[tuple[int, int], tuple[int, str]]


def _moves(code: str) -> list[tuple[int, int, str, int]]:
    """(state, cost, letter, state after) of the edits that take a row of this code: its role's initial, in capitals if truncated, d if it must go."""
    out = [(s, DELETE, "D", s) for s in STATES]
    if code != "d":
        more = TRUNCATED if code.isupper() else 0
        out += [(s, REROLE + more, "R", ASKED[s][1]) for s in STATES]
        out += [(s, KEEP + more, "K", t) for (s, initial), t in NEXT.items() if initial == code.lower()]
    return out


MOVES = {c: _moves(c) for c in "dsuaxSUAX"}
FORWARD = {c: {s: [m[1:] for m in MOVES[c] if m[0] == s] for s in STATES} for c in MOVES}
BACKWARD = {c: {t: [(m[1], m[2], m[0]) for m in MOVES[c] if m[3] == t] for t in STATES} for c in MOVES}
INSERTED = {s: [(INSERT, "I", ASKED[s][1])] for s in STATES}
UNINSERTED = {t: [(INSERT, "I", s) for s in STATES if ASKED[s][1] == t] for t in STATES}


def edges(codes: str, i: int, s: int) -> list[tuple[int, str, int, int]]:
    """(cost, letter, row, state) of the nodes after a node."""
    out = [(c, e, i, t) for c, e, t in INSERTED[s]]
    return out + [(c, e, i + 1, t) for c, e, t in FORWARD[codes[i]][s]] if i < len(codes) else out


def back_edges(codes: str, i: int, s: int) -> list[tuple[int, str, int, int]]:
    """(cost, letter, row, state) of the nodes before a node."""
    out = [(c, e, i, t) for c, e, t in UNINSERTED[s]]
    return out + [(c, e, i - 1, t) for c, e, t in BACKWARD[codes[i - 1]][s]] if i else out


def search(codes: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from a state before all rows to one of ``ends`` after them, the ASCII-least of them."""
    n = len(codes)
    # the best (cost, audit) known of every node: from the start, and to the end
    best: list[dict[tuple[int, int], tuple[int, str]]] = [{(0, start): (0, "")}, {(n, e): (0, "") for e in ends}]
    # equal costs are settled in the order of the rows, as edges without cost lead to the next row
    heaps = [[(0, 0, start)], [(0, 0, e) for e in ends]]
    done: list[set[tuple[int, int]]] = [set(), set()]
    least = None
    while heaps[0] and heaps[1]:
        if least is not None and heaps[0][0][0] + heaps[1][0][0] > least:
            break
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, at, s = heapq.heappop(heaps[side])
        node = (at if side == 0 else n - at, s)
        if node in done[side]:
            continue
        done[side].add(node)
        audit = best[side][node][1]
        for more, letter, i, t in (edges, back_edges)[side](codes, *node):
            new = (cost + more, audit + letter if side == 0 else letter + audit)
            old = best[side].get((i, t))
            if old is None or new < old:
                best[side][i, t] = new
                heapq.heappush(heaps[side], (new[0], i if side == 0 else n - i, t))
            met = best[1 - side].get((i, t))
            if met is not None and (least is None or new[0] + met[0] < least):
                least = new[0] + met[0]
        met = best[1 - side].get(node)
        if met is not None and (least is None or cost + met[0] < least):
            least = cost + met[0]
    if least is None:
        return None
    # the empty audits at both ends are final, settled or not
    fore, back = done[0] | {(0, start)}, done[1] | {(n, e) for e in ends}
    audits = [best[0][v][1] + best[1][v][1] for v in fore & back if best[0][v][0] + best[1][v][0] == least]
    for v in fore:
        cost, audit = best[0][v]
        for more, letter, i, t in edges(codes, *v):
            if (i, t) in back and cost + more + best[1][i, t][0] == least:
                audits.append(audit + letter + best[1][i, t][1])
    return least, min(audits)


@lru_cache(100_000)
def whole(codes: str) -> tuple[int, str]:
    """``search`` over a whole conversation."""
    return search(codes, 0, ENDS)


def block_table(codes: str) -> Table:
    """(cost, audit) by the states before and after a block."""
    found = {(s, t): search(codes, s, (t,)) for s in STATES for t in STATES}
    return {k: v for k, v in found.items() if v is not None}


def joined(left: Table, right: Table) -> Table:
    """The table of two neighbouring parts."""
    out: Table = {}
    for (s, m), (c, a) in left.items():
        for (m2, t), (d, b) in right.items():
            if m == m2 and ((s, t) not in out or c + d <= out[s, t][0]):
                new = (c + d, a + b)
                out[s, t] = min(new, out.get((s, t), new))
    return out


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, conv_id, turn, role, text): the rows with the faults that their conversation and turn draw; c is never null."""
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = F.crc32(F.encode(F.concat(shown(conv), F.lit(":"), shown(turn)), "UTF-8")) % 20
    rows = df.select(conversation(F.col(conv)), F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), shown(role).alias("role"), shown(text).alias("text"), fate.alias("fate")).filter("fate <> 0")
    changed = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy")
    return rows.select("c", "conv_id", "turn", F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), changed.alias("text"), copies).drop("copy")


def conversation(c: Column) -> Column:
    """A key of a conversation that is never null."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string"))).alias("c")


def in_order(rows: DataFrame) -> DataFrame:
    """The rows with their fault and a place ``pos`` that grows along every conversation.

    The order is one over the whole table, cut by range, so neither a long conversation nor a turn with very many rows has to lie in one task.
    """
    keys = ["c", "turn", "role", "head", "digest", "copy"]
    marked = rows.withColumn("head", F.substring("text", 1, 64)).withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("copy", F.monotonically_increasing_id())
    ranged = marked.repartitionByRange(*keys).sortWithinPartitions(*keys)
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated")
    return ranged.select("c", "conv_id", "turn", "role", "text", "digest", fault.alias("fault"), F.monotonically_increasing_id().alias("pos"))


def coded(rows: DataFrame) -> DataFrame:
    """(c, turn, pos, initial, fault): faults with duplicates, which are all but the first of equal rows.

    First ones are found by aggregation and marked by place, so equal rows never gather in a task.
    """
    firsts = rows.groupBy("c", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    slim = rows.select("c", "turn", "pos", F.left("role", F.lit(1)).alias("initial"), "fault").join(firsts, "pos", "left")
    return slim.withColumn("fault", F.when(F.col("fault") == "blank", F.col("fault")).when(F.col("first").isNull(), "duplicate").otherwise(F.col("fault"))).drop("first")


def blocks(rows: DataFrame) -> DataFrame:
    """(c, part, block, codes, initials): rows of a conversation in strings of at most ``BLOCK``, in the order of (part, block)."""
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit("x"))
    code = F.when(F.col("fault").isin("blank", "duplicate"), F.lit("d")).when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    here = F.col("pos").bitwiseAND(F.lit((1 << RANGE) - 1))
    keyed = rows.select("c", "pos", F.shiftright("pos", RANGE).alias("part"), F.floor(here / BLOCK).alias("block"), code.alias("code"), known.alias("initial"))
    packed = keyed.groupBy("c", "part", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "code", "initial"))).alias("x"))
    texts = packed.select("c", "part", "block", F.array_join("x.code", "").alias("codes"), F.array_join("x.initial", "").alias("initials"))
    return materialize(texts)


def illegal(initials: str) -> int:
    """Neighbours other than su, ua and au."""
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


_SOLVED = "c string, cost bigint, audit string, illegal bigint"


def _solved(rows: list[tuple]) -> pa.RecordBatch:
    return batch(["c", "cost", "audit", "illegal"], [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))])


def solved_whole(packed: DataFrame) -> DataFrame:
    """(c, cost, audit, illegal) of conversations of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _solved([(c, *whole(codes), illegal(initials)) for c, codes, initials in zip(*(x.to_pylist() for x in b.columns))])

    return map_arrow(packed.select("c", "codes", "initials"), run, _SOLVED)


_TABLE = "c string, at bigint, first string, last string, illegal bigint, entries array<struct<s: int, t: int, cost: bigint, audit: string>>"
_ENTRIES = pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _table_row(c: str, at: int, first: str, last: str, breaks: int, table: Table) -> pa.RecordBatch:
    entries = [{"s": s, "t": e, "cost": cost, "audit": a} for (s, e), (cost, a) in table.items()]
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), _ENTRIES)
    return batch(["c", "at", "first", "last", "illegal", "entries"], [pa.array([v], k) for v, k in zip((c, at, first, last, breaks, entries), kinds)])


def solved_in_parts(packed: DataFrame) -> DataFrame:
    """(c, cost, audit, illegal) of conversations of several blocks: tables of the blocks, ``FAN`` neighbours merged at a time until one is left."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, at, codes, initials in zip(*(x.to_pylist() for x in b.columns)):
                yield _table_row(c, at, initials[:1], initials[-1:], illegal(initials), block_table(codes))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, at, parts in zip(*(x.to_pylist() for x in b.columns)):
                todo = [(p["first"], p["last"], p["illegal"], {(e["s"], e["t"]): (e["cost"], e["audit"]) for e in p["entries"]}) for p in parts]
                while len(todo) > 1:  # neighbours pairwise, so that audits are copied a logarithmic number of times
                    pairs = [todo[i : i + 2] for i in range(0, len(todo), 2)]
                    todo = [p[0] if len(p) == 1 else (p[0][0], p[1][1], p[0][2] + p[1][2] + illegal(p[0][1] + p[1][0]), joined(p[0][3], p[1][3])) for p in pairs]
                yield _table_row(c, at, *todo[0])

    width = packed.agg(F.max("block").alias("top")).first().top + 1
    tables = materialize(map_arrow(packed.select("c", (F.col("part") * width + F.col("block")).alias("at"), "codes", "initials"), searched, _TABLE))
    while tables.agg(F.max("at").alias("top")).first().top > 0:
        group = tables.groupBy("c", F.floor(F.col("at") / FAN).alias("up")).agg(F.sort_array(F.collect_list(F.struct("at", "first", "last", "illegal", "entries"))).alias("parts"))
        tables = materialize(map_arrow(group.select("c", F.col("up").alias("at"), "parts"), merged, _TABLE))
    ends = F.filter("entries", lambda e: (e["s"] == 0) & e["t"].isin(*ENDS))
    best = F.array_min(F.transform(ends, lambda e: F.struct(e["cost"].alias("cost"), e["audit"].alias("audit"))))
    return tables.select("c", best.alias("x"), "illegal").select("c", "x.cost", "x.audit", "illegal")


def solved(packed: DataFrame) -> DataFrame:
    """(c, cost, audit, illegal) of every conversation that has rows."""
    several = materialize(packed.groupBy("c").count().filter("count > 1").select("c"))
    if several.isEmpty():
        return solved_whole(packed)
    return solved_whole(packed.join(several, "c", "left_anti")).unionByName(solved_in_parts(packed.join(several, "c", "left_semi")))


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(c, repaired_sha256): the edits of every audit done to its rows, line by line, while these stream by in order."""
    head = audits.select("c", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    stream = rows.select("c", "pos", "role", "text").unionByName(head).repartition("c").sortWithinPartitions("c", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, at, state, digest, lines = None, "", 0, 0, hashlib.sha256(), 0

        def say(role: str, text: str) -> None:
            nonlocal lines
            digest.update(f"{chr(10) if lines else ''}{role}:".encode())
            digest.update(text.encode())
            lines += 1

        def inserted() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                say(ASKED[state][0], "")
                state, at = ASKED[state][1], at + 1

        for b in batches:
            out = []
            for c, pos, role, text in zip(*(x.to_pylist() for x in b.columns)):
                if pos < 0:
                    if now is not None:
                        inserted()
                        out.append((now, digest.hexdigest()))
                    now, audit, at, state, digest, lines = c, text, 0, 0, hashlib.sha256(), 0
                    continue
                inserted()
                letter = audit[at]
                at += 1
                if letter == "K":
                    say(role, text)
                    state = NEXT[state, role[:1]]
                elif letter == "R":
                    say(ASKED[state][0], text)
                    state = ASKED[state][1]
            yield batch(["c", "repaired_sha256"], [pa.array([r[k] for r in out], pa.string()) for k in (0, 1)])
        if now is not None:
            inserted()
            yield batch(["c", "repaired_sha256"], [pa.array([v], pa.string()) for v in (now, digest.hexdigest())])

    return map_arrow(stream, run, "c string, repaired_sha256 string")


def repairs(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation, after the damage."""
    rows = materialize(in_order(damaged(df, conv, turn, role, text)))
    marked = materialize(coded(rows))
    audits = materialize(solved(blocks(marked)))
    count = lambda name: F.sum((F.col("fault") == name).cast("long")).alias(name)
    turns = marked.groupBy("c", "turn").agg(*(F.coalesce(count(n), F.lit(0)).alias(n) for n in ("blank", "duplicate", "truncated")))
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    facts = turns.groupBy("c").agg(F.coalesce(span, F.lit(0)).alias("gaps"), *(F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")))
    known = df.select(conversation(F.col(conv)), F.col(conv).alias("conv_id")).distinct()
    out = known.join(facts, "c", "left").join(audits, "c", "left").join(digests(rows, audits), "c", "left")
    longs = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
