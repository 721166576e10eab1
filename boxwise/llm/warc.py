"""WARC archives through a chunked record table (operator 2).

A record becomes rows of (record id, chunk number, at most ``CHUNK`` bytes). Written out, every
row is a WARC/1.1 record of its own: the first one response or revisit, the others
``continuation`` records with ``WARC-Segment-Number`` and, on the last, the total length, as the
standard splits large records. So writer and reader hold one chunk at a time. Chunks of a record
follow each other in a file; files are gzip streams that one task reads in order, and the reader
carries a running SHA-256 from chunk to chunk, which it compares with the digest written.

Payloads of at least ``LEAST`` bytes that occur before (by smallest id) become revisit records
without a block; they keep digest and length of their payload and name the record they refer to.

Edge cases: a null payload is empty; ids that are repeated with one payload are all responses
if that id is the smallest; a null id is written as such, is never referred to while another id exists, and
reads back as null; an empty table gives no records; other columns aren't read; a broken or
cut-off record, and a digest that differs, is an error that names the file.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.llm.common import batch, map_arrow
from boxwise.session import shared_folder

CHUNK = 64 << 10
LEAST = 100
SALTS = 32
#: Stands between records; each task reads up to it, and lengths tell where records really end.
BETWEEN = "\r\n\r\n"
HEAD = b"WARC/1.1\r\n"


def with_references(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(id, payload, digest, length, record_type, refers_to) of every row.

    Only groups of at least two rows go to the join; they are copied to ``SALTS`` places and
    rows are dealt over them, so that one payload shared by many rows fills no single task.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("length", F.octet_length("payload").cast("long"))
    groups = rows.filter(F.col("length") >= LEAST).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    marked = rows.select("id", "digest", "length").filter(F.col("length") >= LEAST).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    again = marked.join(salted, ["digest", "salt"]).filter("first is not null and (id is null or id > first)").select("id", "digest", "first").distinct()
    again = again.select(F.col("id").alias("same_id"), F.col("digest").alias("same"), "first")
    out = rows.join(again, F.col("id").eqNullSafe(F.col("same_id")) & (F.col("digest") == F.col("same")), "left")
    return out.select("id", "payload", "digest", "length", F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("first").alias("refers_to"))


def chunks(records: DataFrame) -> DataFrame:
    """The chunk table: (id, record_type, refers_to, digest, length, chunk_no, n_chunks, data)."""
    stored = F.when(F.col("record_type") == "response", F.col("length")).otherwise(F.lit(0))
    n = F.greatest(F.lit(1), F.ceil(stored / CHUNK)).cast("int")
    rows = records.withColumn("stored", stored).withColumn("n_chunks", n)
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(1), F.col("n_chunks"))))
    data = F.when(F.col("record_type") == "response", F.substring("payload", (F.col("chunk_no") - 1) * CHUNK + 1, F.lit(CHUNK))).otherwise(F.lit(b""))
    return rows.select("id", "record_type", "refers_to", "digest", "length", "chunk_no", "n_chunks", data.alias("data"))


def write(table: DataFrame, path: str) -> None:
    """Write a chunk table as WARC files. Every row is one record; a task writes one file."""
    urn = lambda c: F.concat(F.lit("<urn:boxwise:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    only = lambda cond, text: F.when(cond, text).otherwise(F.lit(""))
    first, last = F.col("chunk_no") == 1, F.col("chunk_no") == F.col("n_chunks")
    segment = F.concat(F.lit("<urn:boxwise:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit("#"), F.col("chunk_no").cast("string"), F.lit(">"))
    head = F.concat(
        F.lit(HEAD.decode()),
        line("WARC-Type", F.when(first, F.col("record_type")).otherwise(F.lit("continuation"))),
        line("WARC-Record-ID", F.when(first, urn(F.col("id"))).otherwise(segment)),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("length").cast("string")),
        only(F.col("refers_to").isNotNull() & first, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))),
        only(F.col("n_chunks") > 1, line("WARC-Segment-Number", F.col("chunk_no").cast("string"))),
        only(~first, line("WARC-Segment-Origin-ID", urn(F.col("id")))),
        only(last & (F.col("n_chunks") > 1), line("WARC-Segment-Total-Length", F.col("length").cast("string"))),
        line("Content-Length", F.octet_length("data").cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(head.cast("binary"), F.col("data")).cast("string")
    table.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", BETWEEN).text(path)


class Reader:
    """Records of one task's pieces of text, in order; a record's payload is digested chunk by chunk."""

    def __init__(self) -> None:
        self.file = None
        self.held = bytearray()
        self.fields: dict | None = None
        self.open: dict | None = None

    def fail(self, why: str) -> None:
        raise ValueError(f"{self.file}: {why}")

    def end_of_file(self) -> None:
        # a block that ends in a line break leaves one behind, as the text reader adds the last separator
        if self.held.strip(b"\r\n") or self.fields:
            self.fail("it ends inside a record")
        if self.open:
            self.fail(f"record {self.open['id']} lacks its last segment")
        self.held.clear()

    def piece(self, file: str, data: bytes) -> Iterator[dict]:
        """Take one piece and the separator behind it; yields the records that end in it."""
        if file != self.file:
            self.end_of_file()
            self.file = file
        held, between = self.held, BETWEEN.encode()
        held += data
        held += between
        while True:
            if self.fields is None:
                if (at := held.find(between)) < 0 or not held.strip(b"\r\n"):
                    return
                if not held.startswith(HEAD):
                    self.fail("a record doesn't begin with its version")
                self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in held[len(HEAD) : at].decode("utf-8", "replace").split("\r\n"))}
                del held[: at + len(between)]
                if not self.fields.get("content-length", "").isdigit():
                    self.fail("a record says no length")
            size = int(self.fields["content-length"])
            if len(held) < size + len(between):
                return
            if held[size : size + len(between)] != between:
                self.fail("a record is longer than it says")
            fields, block = self.fields, bytes(held[:size])
            self.fields = None
            del held[: size + len(between)]
            yield from self.record(fields, block)

    def record(self, fields: dict, block: bytes) -> Iterator[dict]:
        kind = fields["warc-type"]
        if kind == "continuation":
            if not self.open or fields.get("warc-segment-origin-id") != self.open["id"] or int(fields["warc-segment-number"]) != self.open["next"]:
                self.fail("a continuation doesn't follow its record")
        else:
            if self.open:
                self.fail(f"record {self.open['id']} lacks its last segment")
            self.open = {"id": fields["warc-record-id"], "kind": kind, "refers": fields.get("warc-refers-to"), "sum": hashlib.sha256(), "size": 0, "next": 1, "digest": fields.get("warc-payload-digest", "").removeprefix("sha256:"), "length": int(fields.get("warc-payload-length", 0))}
        now = self.open
        now["sum"].update(block)
        now["size"] += len(block)
        now["next"] += 1
        if "warc-segment-number" not in fields or "warc-segment-total-length" in fields:
            self.open = None
            if kind != "revisit" and now["kind"] != "revisit" and (now["sum"].hexdigest() != now["digest"] or now["size"] != now["length"]):
                self.fail(f"record {now['id']} has another digest or length than written")
            yield now


def _id(urn: str | None) -> int | None:
    text = urn.strip("<>").rpartition(":")[2] if urn else "null"
    return None if text == "null" else int(text)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, n_chunks) of every record."""
    pieces = spark.read.option("lineSep", BETWEEN).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in batches:
            done = [r for f, v in zip(b.column(0), b.column(1)) for r in reader.piece(f.as_py(), v.as_py())]
            yield batch(
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_chunks"],
                [
                    pa.array([_id(r["id"]) for r in done], pa.int64()),
                    pa.array([r["length"] if r["kind"] == "revisit" else r["size"] for r in done], pa.int64()),
                    pa.array([r["digest"] if r["kind"] == "revisit" else r["sum"].hexdigest() for r in done], pa.string()),
                    pa.array([r["kind"] for r in done], pa.string()),
                    pa.array([_id(r["refers"]) for r in done], pa.int64()),
                    pa.array([r["next"] - 1 for r in done], pa.int64()),
                ],
            )
        reader.end_of_file()

    return map_arrow(pieces, run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, n_chunks bigint")


def archive(df: DataFrame, key: str = "page_id", payload: str = "html") -> str:
    """Write a table of payloads as WARC files into the shared folder; their path."""
    path = f"{shared_folder(df.sparkSession)}/boxwise-warc-{uuid.uuid4().hex}"
    write(chunks(with_references(df, key, payload)), path)
    return path
