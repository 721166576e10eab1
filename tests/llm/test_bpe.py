import hashlib
import random

import tokenizers

from boxwise.llm import bpe, catalog


def reference(vocabulary):
    return tokenizers.Tokenizer.from_str(vocabulary)


def test_pieces_agree_with_the_library(vocabulary):
    mine, ref = bpe.Tokenizer(vocabulary), reference(vocabulary)
    rnd = random.Random(3)
    alphabet = "ab c\n\t'sé漢😀<|endoftext|>1 2\r　\x00\xa0İß\x1c\x85"
    texts = ["", " ", "'s", "<|endoftext|>", "<|endoftext", "a" * 5000] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(800)]
    for t in texts:
        want = ref.encode(t, add_special_tokens=False).ids
        packed = mine.packed(t)
        assert list(memoryview(packed).cast("I")) == want, t
        assert mine.decoded(packed).decode() == ref.decode(want, skip_special_tokens=False)


def test_stale_entries_are_skipped(vocabulary):
    t = bpe.Tokenizer(vocabulary)
    for s in ("aaaaaaaaaaa", "abababababab", "mississippi", "xxxyyyxxxyyy"):
        assert t.merged(s.encode()) == reference(vocabulary).encode(s, add_special_tokens=False).ids


def test_cache_stays_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 10)
    t = bpe.Tokenizer(vocabulary)
    t.packed(" ".join(f"word{i}" for i in range(100)))
    assert len(t.cache) <= 10


def test_round_trip_and_edge_rows(spark, vocabulary):
    rows = [(1, "Hello <|endoftext|> wörld"), (1, "Hello <|endoftext|> wörld"), (2, None), (3, ""), (None, "x"), (4, "long " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS ids", "1 AS n_tokens")
    ids = bpe.encode(df, vocabulary)
    back = {(r.doc_id, r.text) for r in bpe.decode(ids, vocabulary).collect()}
    assert back == {(d, t or "") for d, t in rows}
    assert ids.count() == len(rows)
    assert bpe.encode(df.limit(0), vocabulary).count() == 0 and bpe.digests(df.limit(0), vocabulary).count() == 0


def test_decode_of_odd_ids(spark, vocabulary):
    df = spark.createDataFrame([(1, [999999, 64]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(df, vocabulary).collect()} == {1: "a", 2: "", 3: ""}


def test_query_against_the_library(spark, small, vocabulary):
    ref = reference(vocabulary)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = catalog.QUERIES["op4_bpe"](spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = ref.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()
