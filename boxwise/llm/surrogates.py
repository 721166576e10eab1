"""Surrogates for personal data (operator 7).

Emails, phone numbers, IPv4 addresses, card numbers, account numbers, social security
numbers, secrets and names after a form of address are found by patterns. Each entity, in
normal form, gets a replacement made from a keyed hash: digits by a keyed Feistel permutation
that keeps length, punctuation and a card's check digit (numbers without a right one are no cards); names of the same gender, script and
case pattern; mail names of word shape under a reserved domain. One entity has one surrogate in the whole
table. All distinct entities are checked: a surrogate that is a real entity, or that a smaller
entity has taken, is made anew with the next attempt number, until none is left.

Edge cases: null text stays null with 0 entities; empty text stays empty; overlapping matches
go to the earlier pattern of ``KINDS``; repeated rows are replaced alike; an empty table gives an
empty result; all other columns are carried, and names with a clash (``n_entities``) are refused.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import batch, map_arrow, slices, text_bytes
from boxwise.session import materialize

#: Forms of address and the gender they tell.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f",
    "Mademoiselle": "f", "Señor": "m", "Señora": "f", "Señorita": "f", "Sra": "f", "господин": "m", "госпожа": "f",
}
NAME = r"\p{Lu}[\p{L}'’-]+(?:[ ]\p{Lu}[\p{L}'’-]+)?"
_D = r"(?<![\w.])"
KINDS = {
    "email": r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}",
    "secret": r"(?<![0-9A-Za-z])[0-9a-f]{32,}(?![0-9A-Za-z])|(?<=(?:token|secret|password|passwd|api_key|apikey|api-key) ?[:=] ?[\"'])[^\"'\s]{6,}(?=[\"'])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip": _D + r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)(?!\w)",
    "card": r"(?<![\w+.-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?!\w)(?![.-]\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "person": r"(?<=(?<!\w)(?:" + "|".join(TITLES) + r")\.?[ ])" + NAME,
}
_FIND = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()))
_QUICK = re.compile("[@0-9]|" + "|".join(TITLES))
_GENDER = regex.compile(r"(?:" + "|".join(TITLES) + r")(?=\.?[ ]$)")
#: Syllables that names are made of, by script.
SYLLABLES = {
    "latin": [a + b for a in "b d f g k l m n p r s t v".split() for b in "a e i o u".split()],
    "cyrillic": [a + b for a in "б в г д к л м н п р с т".split() for b in "а е и о у".split()],
    "greek": [a + b for a in "β γ δ κ λ μ ν π ρ σ τ".split() for b in "α ε ι ο".split()],
}
ENDINGS = {
    "latin": {"m": "n r s k t".split(), "f": ["a", "ia", "ina", "ela", "ora"]},
    "cyrillic": {"m": "н р с к т".split(), "f": ["а", "ия", "ина", "ела", "ора"]},
    "greek": {"m": ["ος", "ης", "ας"], "f": ["α", "η", "ια"]},
}
ROUNDS = 8
#: Attempts after which the job gives up instead of keeping a clash.
#: Bytes of text that a task looks at together.
SLICE = 1 << 20
ATTEMPTS = 50


def script(text: str) -> str:
    for c in text:
        if "Ѐ" <= c <= "ԯ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
        if c.isalpha():
            return "latin"
    return "latin"


def _number(key: bytes, *parts) -> int:
    return int.from_bytes(hmac.digest(key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), "sha256")[:16], "big")


def permuted(key: bytes, digits: list[int], radix: int, tweak: str) -> list[int]:
    """A keyed permutation of all digit strings of this length, by alternating Feistel rounds."""
    half = len(digits) // 2
    sizes = (half, len(digits) - half)
    value = lambda d: sum(x * radix**i for i, x in enumerate(reversed(d)))
    a, b = value(digits[:half]), value(digits[half:])
    for i in range(ROUNDS):
        if i % 2 == 0:
            a = (a + _number(key, tweak, i, len(digits), b)) % radix ** sizes[0]
        else:
            b = (b + _number(key, tweak, i, len(digits), a)) % radix ** sizes[1]
    out = []
    for v, n in ((a, sizes[0]), (b, sizes[1])):
        out += [v // radix**i % radix for i in reversed(range(n))]
    return out


def luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def normal(kind: str, found: str, gender: str = "") -> str:
    """The form in which two mentions are the same entity."""
    if kind in ("phone", "card", "ssn"):
        return ("+" if found.startswith("+") else "") + re.sub(r"\D", "", found)
    if kind == "iban":
        return found.replace(" ", "")
    if kind == "email":
        return found.lower()
    if kind == "person":
        return f"{gender}:{found.casefold()}"
    return found


def replacement(key: bytes, kind: str, norm: str, attempt: int) -> str:
    """The surrogate of an entity, in normal form."""
    tweak = f"{kind}#{attempt}"
    if kind in ("phone", "card", "ssn"):
        plus, d = norm.startswith("+"), [int(c) for c in norm if c.isdigit()]
        keep = min(3, max(1, len(d) - 10)) if plus else 0
        if kind == "card":
            body = permuted(key, d[:-1], 10, tweak)
            d = next(body + [c] for c in range(10) if luhn(body + [c]))
        else:
            d = d[:keep] + permuted(key, d[keep:], 10, tweak)
        return "+" * plus + "".join(map(str, d))
    if kind == "ip":
        bits = permuted(key, [int(b) for o in norm.split(".") for b in f"{int(o):08b}"], 2, tweak)
        return ".".join(str(int("".join(map(str, bits[i : i + 8])), 2)) for i in range(0, 32, 8))
    if kind == "secret":
        if re.fullmatch("[0-9a-f]+", norm):
            return "".join("0123456789abcdef"[v] for v in permuted(key, [int(c, 16) for c in norm], 16, tweak))
        n, out = _number(key, tweak, norm), []
        for i, c in enumerate(norm):
            v = _number(key, n, i)
            out.append(str(v % 10) if c.isdigit() else chr((65 if c.isupper() else 97) + v % 26) if c.isalpha() else c)
        return "".join(out)
    if kind == "iban":
        n = _number(key, tweak, norm)
        return norm[:2] + "".join(str(_number(key, n, i) % 10) if c.isdigit() else chr(65 + _number(key, n, i) % 26) for i, c in enumerate(norm[2:]))
    if kind == "email":
        n, s = _number(key, tweak, norm), SYLLABLES["latin"]
        word = "".join(s[_number(key, n, i) % len(s)] for i in range(3))
        return f"{word}.{n % 10**6:06d}@mail{n % 9 + 1}.example.org"
    gender, name = norm.split(":", 1)
    kind_of, made = script(name), []
    for i, part in enumerate(name.split(" ")):
        n, s = _number(key, tweak, gender, i, name), SYLLABLES[kind_of]
        stem = "".join(s[_number(key, n, k) % len(s)] for k in range(3))
        made.append(stem + ENDINGS[kind_of][gender or "m"][n % len(ENDINGS[kind_of][gender or "m"])])
    return f"{gender}:{' '.join(made)}"


def shaped(kind: str, found: str, made: str) -> str:
    """A surrogate in the format of one mention."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(c for c in made if c.isdigit())
        return "".join(next(digits) if c.isdigit() else c for c in found)
    if kind == "iban":
        chars = iter(made)
        return "".join(c if c == " " else next(chars) for c in found)
    if kind == "person":
        made = made.split(":", 1)[1]
        return made.upper() if found.isupper() and len(found) > 2 else made.title()
    return made


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the entities of a text, in order."""
    if not _QUICK.search(text):
        return []
    out = []
    for m in _FIND.finditer(text):
        kind, gender = m.lastgroup, ""
        if kind == "person" and (t := _GENDER.search(text[max(0, m.start() - 16) : m.start()])):
            gender = TITLES[t.group()]
        norm = normal(kind, m.group(), gender)
        if kind != "card" or luhn([int(c) for c in norm]):
            out.append((m.start(), m.end(), kind, norm))
    return out


def pieces(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``SLICE`` bytes of column ``at``."""
    for b in batches:
        for low, high in slices(text_bytes(b.column(at))[1], SLICE):
            yield b.slice(low, high - low)


def entities(df: DataFrame, text: str = "text") -> DataFrame:
    """(kind, norm): the distinct entities of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 0):
            seen = sorted({(k, n) for x in b.column(0).to_pylist() if x for _, _, k, n in mentions(x)})
            yield batch(["kind", "norm"], [pa.array([k for k, _ in seen], pa.string()), pa.array([n for _, n in seen], pa.string())])

    return map_arrow(df.select(F.col(text).cast("string").alias("text")), run, "kind string, norm string").distinct()


def _surrogates(found: DataFrame, key: bytes, attempt: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [replacement(key, k, n, attempt) for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield batch(["kind", "norm", "made", "attempt"], [b.column(0), b.column(1), pa.array(made, pa.string()), pa.array([attempt] * len(made), pa.int32())])

    return map_arrow(found.select("kind", "norm"), run, "kind string, norm string, made string, attempt int")


def assigned(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, made, attempt): a surrogate of its own for every entity."""
    found = materialize(found)
    real = found.select("kind", F.col("norm").alias("made"))
    done, todo = None, found
    for attempt in range(ATTEMPTS):
        made = _surrogates(todo, key, attempt)
        first = made.groupBy("kind", "made").agg(F.min("norm").alias("norm"))
        free = first.join(real, ["kind", "made"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "made"), ["kind", "made"], "left_anti")
        won = materialize(free.select("kind", "norm", "made", F.lit(attempt).alias("attempt")))
        done = won if done is None else done.unionByName(won)
        todo = materialize(todo.join(won.select("kind", "norm"), ["kind", "norm"], "left_anti"))
        if todo.isEmpty():
            return done
    raise RuntimeError(f"{todo.count()} entities still clash after {ATTEMPTS} attempts")


def replace(df: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """All columns of ``df`` with entities replaced in ``text``, and n_entities."""
    if "n_entities" in df.columns:
        raise ValueError("a column is named n_entities already")
    again = materialize(assigned(entities(df, text), key).filter("attempt > 0").select("kind", "norm", "attempt"))
    names, at = df.columns, df.columns.index(text)
    source = df
    clashes = not again.isEmpty()
    if clashes:
        # a few texts name an entity that needed a further attempt: they get those numbers by a join on the text's digest
        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, 1):
                rows = sorted({(h, k, n) for h, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if x for _, _, k, n in mentions(x)})
                yield batch(["h", "kind", "norm"], [pa.array([r[i] for r in rows], pa.string()) for i in range(3)])

        digest = F.sha2(F.col(text).cast("binary"), 256)
        hits = map_arrow(df.select(digest.alias("h"), F.col(text).alias("text")), named, "h string, kind string, norm string").join(again, ["kind", "norm"])
        later = hits.groupBy("h").agg(F.to_json(F.collect_set(F.array("kind", "norm", F.col("attempt").cast("string")))).alias("_later"))
        source = df.withColumn("_h", digest).join(later, F.col("_h") == F.col("h"), "left").drop("_h", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        made: dict[tuple, str] = {}
        for b in pieces(batches, at):
            texts, counts = [], []
            later = b.column(len(names)).to_pylist() if clashes else None
            for i, x in enumerate(b.column(at).to_pylist()):
                tries = {(k, n): int(a) for k, n, a in json.loads(later[i])} if clashes and later[i] else {}
                spans = mentions(x) if x else []
                parts, end = [], 0
                for s, e, kind, norm in spans:
                    who = (kind, norm, tries.get((kind, norm), 0))
                    if who not in made:
                        if len(made) > 20_000:
                            made.clear()
                        made[who] = replacement(key, *who)
                    parts += [x[end:s], shaped(kind, x[s:e], made[who])]
                    end = e
                texts.append("".join(parts) + x[end:] if spans else x)
                counts.append(len(spans))
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[: len(names)])]
            yield batch([*names, "n_entities"], [*columns, pa.array(counts, pa.int64())])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_arrow(source, run, f"{kinds}, n_entities bigint")
