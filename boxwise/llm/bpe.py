"""BPE encoding and decoding (operator 4).

A piece of text is a doubly linked list of symbols. A priority queue holds (rank, left
position) of every adjacent pair that has a merge; the lowest rank is merged first, entries
whose pair has changed since are skipped, and the two new neighbour pairs are pushed.
Pieces come from the byte-level pattern, repeated pieces from a bounded cache of each worker.
Decoding concatenates the byte strings of the ids.

Edge cases: null text is empty (0 ids); special tokens in a text become their ids, longest
first at the same place; ids outside the vocabulary decode to nothing; broken UTF-8 decodes
with U+FFFD; repeated rows and repeated or null ids are kept row by row; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.llm.common import batch, map_arrow

#: Fixed value: the pattern of byte-level pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most pieces that a worker keeps.
CACHE = 300_000
#: Characters of a piece from which it isn't kept.
LONG = 64


def byte_characters() -> dict[str, int]:
    """The printable character of each byte, as byte-level vocabularies write it."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces(dict):
    """Ids of pieces, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        return self.make(piece)


class Tokenizer:
    """Merges and vocabulary of one tokenizer file, given as its JSON text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, chars = spec["model"], byte_characters()
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE file is needed")
        raw = lambda s: bytes(chars[c] for c in s)
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.piece = {i: raw(s) for s, i in vocab.items() if s not in self.special} | {i: s.encode() for s, i in self.special.items()}
        self.first = [vocab[c] for c, b in sorted(chars.items(), key=lambda x: x[1])]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.split = regex.compile(PATTERN)
        self.prefix = bool(spec["pre_tokenizer"].get("add_prefix_space"))
        self.cuts = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache: dict[str, bytes] = Pieces(self._packed)

    def merged(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        ids = [self.first[b] for b in data]
        n = len(ids)
        merge = self.merge
        queue: list[tuple[int, int, int, int, int]] = []
        for i in range(n - 1):
            if m := merge.get((ids[i], ids[i + 1])):
                heappush(queue, (m[0], i, ids[i], ids[i + 1], m[1]))
        if not queue:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            _, i, a, b, new = heappop(queue)
            if ids[i] != a:
                continue
            j = after[i]
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merge.get((new, ids[k])):
                    heappush(queue, (m[0], i, new, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merge.get((ids[h], new))):
                heappush(queue, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]

    def _packed(self, piece: str) -> bytes:
        out = b"".join([x.to_bytes(4, "little") for x in self.merged(piece.encode())])
        if len(piece) < LONG:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[piece] = out
        return out

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        out, get = [], self.cache.__getitem__
        for k, part in enumerate(self.cuts.split(text)) if self.cuts else ((0, text),):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                part = " " + part if self.prefix and not part[0].isspace() else part
                out += map(get, self.split.findall(part))
        return b"".join(out)

    def decoded(self, packed: bytes) -> bytes:
        """The text of packed ids, in UTF-8."""
        get, ids = self.piece.get, memoryview(packed).cast("I")
        raw = b"".join([get(i, b"") for i in ids])
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


_LOADED: dict[str, Tokenizer] = {}


def loaded(text: str) -> Tokenizer:
    """One tokenizer for each file and worker, so that its cache serves every task."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Tokenizer(text)
    return _LOADED[key]


def tokenizer_text(spark: SparkSession, path: str) -> str:
    """The vocabulary file, read on the driver: its size is fixed by the tokenizer, not by the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(shared.value)
        for b in batches:
            packed = [memoryview(t.packed(x or "")).cast("i").tolist() for x in b.column(1).to_pylist()]
            yield batch([key, "ids"], [b.column(0), pa.array(packed, pa.list_(pa.int32()))])

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(key, F.col(text).cast("string")), run, f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every row of ids; null ids give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(shared.value)
        for b in batches:
            out = [t.decoded(b"".join(i.to_bytes(4, "little") for i in x or () if i is not None and i >= 0)).decode() for x in b.column(1).to_pylist()]
            yield batch([key, "text"], [b.column(0), pa.array(out, pa.string())])

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(key, F.col(ids).cast("array<bigint>")), run, f"`{key}` {kind}, text string")


def digests(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: number of ids, SHA-256 of the ids and of the text decoded from them.

    Ids of a row live only inside its task, so nothing but digests leaves it. ``keep`` names
    columns to carry along.
    """
    keep = [key] if keep is None else keep
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(shared.value)
        for b in batches:
            n, a, d = [], [], []
            for x in b.column(b.num_columns - 1):
                packed = t.packed(x.as_py() or "")
                n.append(len(packed) // 4)
                a.append(hashlib.sha256(packed).hexdigest())
                d.append(hashlib.sha256(t.decoded(packed)).hexdigest())
            yield batch([*keep, "n_tokens", "ids_sha256", "decoded_sha256"], [*b.columns[:-1], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(df.select(*keep, F.col(text).cast("string").alias("_text")), run, f"{kinds}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
