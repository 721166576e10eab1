import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from boxwise.llm import catalog, warc

from .helpers import rnd


def expected(rows):
    first = {}
    data = [(i, (h or "").encode()) for i, h in rows]
    for i, b in data:
        d = hashlib.sha256(b).hexdigest()
        if i is not None:
            first[d] = min(first.get(d, i), i)
    out = []
    for i, b in data:
        d = hashlib.sha256(b).hexdigest()
        again = len(b) >= 100 and d in first and (i is None or i > first[d])
        out.append((i, len(b), d, "revisit" if again else "response", first[d] if again else None))
    return out


def agree(rows, got):
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(g)[:5] for g in got), key=key) == sorted(expected(rows), key=key)


def test_payloads_of_all_kinds(spark):
    r = rnd()
    big = "é\r\n\r\nWARC/1.1\r\n" * 20000
    rows = [(i, None if i % 11 == 0 else ("x\r\n\r\ny" * r.randrange(60) if i % 3 else "same text " * 15)) for i in range(150)]
    rows += [(300, big), (301, big), (7, "same text " * 15), (None, big), (3, "same text " * 15), (400, "\r\n\r\n" * 40), (401, "\r\n" * 3)]
    rows += [(402, "a" * warc.CHUNK), (403, "ab" * warc.CHUNK + "\r\n\r\n"), (5, "\r\n\r\nWARC"), (404, "z" * 99), (405, "z" * 99), (406, "z" * 100), (407, "z" * 100)]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "1 AS id", "2 AS digest", "3 AS first")
    path = warc.archive(df)
    got = warc.read(spark, path).collect()
    agree(rows, got)
    assert max(g.n_chunks for g in got) > 1
    local = path.removeprefix("file://").removeprefix("file:")
    import glob

    for f in glob.glob(f"{local}/*.gz"):
        data = gzip.open(f).read()
        assert not data or data.startswith(b"WARC/1.1\r\n")


def test_chunks_are_bounded(spark):
    df = spark.createDataFrame([(1, "x" * (3 * warc.CHUNK + 5)), (2, "")], "page_id long, html string")
    rows = warc.chunks(warc.with_references(df, "page_id", "html")).collect()
    assert [len(r.data) for r in sorted(rows, key=lambda r: (r.id, r.chunk_no))] == [warc.CHUNK] * 3 + [5, 0]


def test_empty_table_and_broken_archives(spark, tmp_path):
    df = spark.createDataFrame([(1, "some text")], "page_id long, html string")
    assert warc.read(spark, warc.archive(df.limit(0))).count() == 0
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:boxwise:page:1>\r\nWARC-Payload-Digest: sha256:{}\r\nWARC-Payload-Length: 3\r\nContent-Length: {}\r\n\r\n"
    good = hashlib.sha256(b"abc").hexdigest()
    for name, text in (("short", head.format(good, 3) + "ab"), ("digest", head.format("0" * 64, 3) + "abc\r\n\r\n"), ("junk", "no record at all\r\n\r\nhere"), ("long", head.format(good, 2) + "abc\r\n\r\n")):
        p = tmp_path / f"{name}.gz"
        p.write_bytes(gzip.compress(text.encode()))
        with pytest.raises(Exception, match="page:1|ends inside|begin with|longer"):
            warc.read(spark, str(p)).collect()


def test_query(spark, small):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", F.col("html")).collect()]
    agree(rows, catalog.QUERIES["op2_warc"](spark, small).collect())
