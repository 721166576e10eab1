import hashlib
import itertools
import re
import zlib

import pytest

from boxwise.llm import catalog, repair
from tests.llm.helpers import rnd

SCHEMA = "conv_id long, turn long, role string, text string, pos long, c string"
SPACE = "\t\n\x0b\x0c\r "


def cheapest(rows):
    """(cost, audit, lines) by dynamic programming over the rows; rows are (role, text, fault)."""
    ask = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}

    def put(d, s, v):
        d[s] = min(d.get(s, v), v)

    def insertions(d):
        out = dict(d)
        for s in (0, 1, 3, 2):
            at, (c, a, t) = s, d.get(s, (None, None, None))
            for _ in range(2):
                if c is None:
                    break
                c, a, t, at = c + 2, a + "I", t + (ask[at][0] + ":",), ask[at][1]
                put(out, at, (c, a, t))
        return out

    now = insertions({0: (0, "", ())})
    for role, text, fault in rows:
        new = {}
        for s, (c, a, t) in now.items():
            put(new, s, (c + 3, a + "D", t))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                put(new, ask[s][1], (c + 2 + more, a + "R", t + (f"{ask[s][0]}:{text}",)))
                i = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, role[:1]))
                if i is not None:
                    put(new, i, (c + more, a + "K", t + (f"{role}:{text}",)))
        now = insertions(new)
    return min(now[s] for s in (0, 3) if s in now)


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            kept += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, marked = set(), []
        for _, role, text in kept:
            last = text.rstrip(SPACE)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = [sum(f == n for _, _, f in marked) for n in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = cheapest(marked)
        out.append((conv, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n):
    r = rnd(seed)
    rows = []
    for c in range(n):
        conv = None if c == 0 else c
        for k in range(r.choice([1, 2, 4, 7, 30 if c < 2 else 3])):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "User"])
            text = r.choice(["Yes.", "No!", "Well?", "open end", "", " \n", None, "é. \x0b", " ", f"text {r.randrange(3)}.", "x" * 100 + str(r.randrange(3))])
            rows.append((conv, r.choice([k, k, k, k + 2, None]), role, text))
    return rows


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def result(spark, rows):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in repair.repairs(df).select(*COLUMNS).collect()), key=str)


def test_search_equals_dynamic_programming():
    role = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}

    def rows(codes):
        return [("user", "", "blank") if c == "d" else (role[c.lower()], "t", "truncated" if c.isupper() else None) for c in codes]

    short = ("".join(c) for n in range(4) for c in itertools.product("dsuaxSUAX", repeat=n))
    r = rnd(5)
    long = ("".join(r.choice("ddsuauauauaxUAX") for _ in range(r.randrange(4, 40))) for _ in range(400))
    for codes in itertools.chain(short, long):
        assert repair.whole(codes) == cheapest(rows(codes))[:2], codes


def test_blocks_join_to_the_whole():
    r = rnd(6)
    for _ in range(60):
        codes = "".join(r.choice("dsuauauaxUAX") for _ in range(30))
        cuts = sorted(r.sample(range(1, 30), 3))
        parts = [repair.block_table(codes[a:b]) for a, b in zip([0, *cuts], [*cuts, 30])]
        whole = repair.joined(repair.joined(parts[0], parts[1]), repair.joined(parts[2], parts[3]))
        assert min(v for (s, t), v in whole.items() if s == 0 and t in (0, 3)) == repair.whole(codes)


def test_against_brute_force(spark):
    rows = made(1, 60) + [(99, 1, "user", "Twice."), (99, 1, "user", "Twice.")]
    assert result(spark, rows) == brute(rows)


def test_long_conversations_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 4)
    monkeypatch.setattr(repair, "FAN", 3)
    r = rnd(2)
    rows = [(7, k, r.choice(["user", "assistant"]), r.choice(["Yes.", "a", f"{k}.", ""])) for k in range(300)] + made(3, 8) + [(None, None, None, None)] * 40
    assert result(spark, rows) == brute(rows)


def test_lost_and_empty(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert result(spark, [(gone, 0, "user", "Hello.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repairs(spark.createDataFrame([], SCHEMA)).collect() == []
    long = [(3, 1, "user", "a word. " * 200_000), (3, 2, "assistant", "b" * 1_000_000)]
    assert result(spark, long) == brute(long)


@pytest.mark.parametrize("name", ["op11_conversation_repair"])
def test_query_equals_brute_force(spark, small, name):
    rows = [tuple(r) for r in catalog.table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in catalog.QUERIES[name](spark, small).select(*COLUMNS).collect()), key=str) == brute(rows)
