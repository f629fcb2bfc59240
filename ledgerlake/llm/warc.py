"""WARC archives compressed with a Zstandard dictionary.

An archive is one skippable frame (magic 0x184D2A5D) that holds the dictionary, then one Zstandard frame for
each record. The dictionary is built from records of the archive itself. Of pages with equal payloads the one
with the largest id is written as a response; the others are revisits that name it and have no payload.

Archives are rows (name, content) of a table written by Spark to a folder that all executors share, so a
retried task leaves no half archive; each has at most ARCHIVE_BYTES of records, or one record. `export`
writes them as files.

A null html is an empty payload; empty payloads are equal to each other like any others. Rows that repeat id
and payload are all responses or all revisits, as their id is or isn't the largest. A null id is a response
only if its payload has no other id. A null url is written as about:blank. An empty table makes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, salted_join, scratch_path, text_of

DICTIONARY_FRAME = 0x184D2A5D
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL = 16_000_000, 64_000, 1_500_000, 6
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
PAGE = "urn:ledgerlake:page:"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as in WARC-Payload-Digest."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP header of the page, without its payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    uri = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{PAGE}{'' if page_id is None else page_id}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        *([("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{PAGE}{refers_to}>")] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The dictionary's frame, then a frame for each record. With too few records to build one there is no dictionary."""
    step, samples, size = max(1, sum(map(len, records)) // SAMPLE_BYTES), [], 0
    for r in records[::step]:
        if size < SAMPLE_BYTES:
            samples.append(r[:SAMPLE_BYTES])
            size += len(samples[-1])
    try:
        shared = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except (zstandard.ZstdError, ValueError):
        shared = None
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)
    out = [] if shared is None else [struct.pack("<II", DICTIONARY_FRAME, len(shared.as_bytes())), shared.as_bytes()]
    return b"".join([*out, *map(packer.compress, records)])


def records_of(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    shared, at = None, 0
    if content[:4] == struct.pack("<I", DICTIONARY_FRAME):
        (size,) = struct.unpack_from("<I", content, 4)
        shared, at = zstandard.ZstdCompressionDict(content[8 : 8 + size]), 8 + size
    opener = zstandard.ZstdDecompressor(dict_data=shared)
    view = memoryview(content)
    while at < len(content):
        frame = opener.decompressobj()
        parts, fed = [], at
        while not frame.eof:
            if fed >= len(content):
                raise ValueError("an archive ends within a frame")
            parts.append(frame.decompress(view[fed : fed + 65536]))
            fed += 65536
        at = min(fed, len(content)) - len(frame.unused_data)
        yield b"".join(parts)


def parsed(raw: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload of a record; its digest is verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    number = lambda uri: int(uri[len(PAGE) + 1 : -1]) if len(uri) > len(PAGE) + 2 else None
    found = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or response and (len(payload) != length or digest(payload) != found):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": found, "record_type": fields["WARC-Type"],
        "refers_to": None if response else number(fields["WARC-Refers-To"]), "payload": payload if response else None,
    }


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes the archives of pages to the table at `path`."""
    held = pages.select(F.col(key).cast("bigint").alias("id"), F.col(url).alias("url"), text_of(html).alias("html"))
    ids = cut(held.select("id", F.unhex(F.sha2(F.col("html").cast("binary"), 256)).alias("sha")))
    heads = ids.groupBy("sha").agg(F.max("id").alias("head"))
    roles = salted_join(ids, heads, "sha").select("id", "sha", "head").distinct()
    placed = held.alias("p").join(roles.alias("r"), F.expr("p.id <=> r.id and unhex(sha2(cast(p.html as binary), 256)) = r.sha")).select("p.id", "p.url", "p.html", "r.head")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, records, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal made, size
            out = pa.RecordBatch.from_pydict({"name": [f"pages-{task:06d}-{made:05d}.warc.zst"], "content": pa.array([archive(records)], pa.binary())})
            made, size = made + 1, 0
            records.clear()
            return out

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                id_, url_, text, head = row
                records.append(record(id_, url_, text.encode("utf-8", "replace"), head, id_ != head))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
        if records:
            yield close()

    placed.mapInArrow(packed, "name string, content binary").write.parquet(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to; with payloads, payload (null in revisits)."""
    kinds = {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"} | ({"payload": "binary"} if payloads else {})
    arrow = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for raw in records_of(content.as_py()):
                    rows.append(parsed(raw))
                    size += len(raw)
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], arrow[t]) for k, t in kinds.items()})
                        rows, size = [], 0
                yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], arrow[t]) for k, t in kinds.items()})

    return spark.read.parquet(path).select("content").mapInArrow(opened, ", ".join(f"{k} {t}" for k, t in kinds.items()))


def export(spark: SparkSession, path: str, folder: str) -> list[str]:
    """Writes the archives as files of a local folder, one at a time."""
    names = []
    for row in spark.read.parquet(path).toLocalIterator():
        with open(f"{folder}/{row['name']}", "wb") as f:
            f.write(row["content"])
        names.append(row["name"])
    return sorted(names)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(read(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS html FROM pages),
s AS (SELECT page_id, ENCODE(html) AS b, MAX(page_id) OVER (PARTITION BY html) AS head FROM p),
d AS (SELECT page_id, head, OCTET_LENGTH(b)::BIGINT AS payload_bytes, SHA1(b) AS h FROM s),
bits AS (
  SELECT page_id, head, payload_bytes,
         LIST_REDUCE(LIST_TRANSFORM(RANGE(0, 4), lambda g: LIST_REDUCE(LIST_TRANSFORM(RANGE(0, 8), lambda i:
           SUBSTR('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || SUBSTR(h, 1 + 10 * g, 10) AS BIGINT) >> (35 - 5 * i)) & 31)::INT, 1)), lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest
  FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM bits
"""
