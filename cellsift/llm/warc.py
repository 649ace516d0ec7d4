"""Dictionary-compressed WARC archives, written by tasks and read by Spark.

An archive begins with a skippable frame that holds a Zstandard dictionary built
from the archive's own records; every record follows as a frame of its own, so
one record can be read with the dictionary and its place. Pages whose payload
another record already holds become revisit records without a payload.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsift.session import small_side, written

# Fixed values of the formats: the skippable frame that holds a dictionary, and
# the profile of a revisit record.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
RECORD_ID = "urn:page:"


def dictionary(records: list[bytes], size: int) -> bytes:
    """A dictionary of up to ``size`` bytes from records spread evenly over the
    archive. Where they are too few to train one, their own first bytes serve."""
    every = max(1, sum(map(len, records)) // (60 * size))
    sample = records[::every]
    try:
        return zstandard.train_dictionary(size, sample, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(r[: max(64, size // len(sample))] for r in sample)[:size]


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, digest: bytes, date: str = DATE) -> bytes:
    """One WARC record with its HTTP header; a revisit has no payload after it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    name = lambda i: f"<{RECORD_ID}{'' if i is None else i}>"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += ["Content-Type: application/http;msgtype=response", "WARC-Payload-Digest: sha1:" + base64.b32encode(digest).decode()]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def archive(records: list[bytes], size: int, level: int = 3) -> tuple[bytes, list[int]]:
    """The archive of some records, and where each record's frame ends."""
    held = dictionary(records, size)
    coder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(held))
    out = io.BytesIO()
    out.write(struct.pack("<II", DICTIONARY_FRAME, len(held)) + held)
    ends = []
    for r in records:
        out.write(coder.compress(r))
        ends.append(out.tell())
    return out.getvalue(), ends


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record of an archive."""
    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive doesn't begin with a dictionary")
    held = zstandard.ZstdCompressionDict(content[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=held).stream_reader(memoryview(content)[8 + size :], read_across_frames=True)
    stream = io.BufferedReader(reader, 1 << 20)
    while (line := stream.readline()) != b"":
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record begins with {line[:40]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[key.lower()] = value
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record's end is missing")
        yield head, block


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``page_id, url, payload, digest, kind, refers_to``.

    Of pages with equal payloads of at least ``least`` bytes, those with the
    largest page_id are responses and all others revisit it; a null page_id is
    the smallest. Null html is an empty payload.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    long = rows.filter(F.octet_length("payload") >= least)
    again = long.groupBy("digest").agg(F.max("page_id").alias("held"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND held IS NOT NULL").select("digest", "held")
    joined = rows.join(small_side(again), "digest", "left")
    revisit = F.col("held").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("held"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("held")).cast("long").alias("refers_to"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = 16 << 20, dictionary_bytes: int = 32 << 10) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) below ``path``; returns the index of
    what was written: file, page_id, start and end of each record's frame.

    ``path`` is one that all executors share: a local one or a URI of a store
    that pyarrow knows. An attempt's files have names of their own and count
    only if the index names them, so lost or repeated attempts do no harm.
    """
    pyarrow.fs.FileSystem.from_uri(path)[0].create_dir(pyarrow.fs.FileSystem.from_uri(path)[1])
    rows = with_revisits(pages)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pyarrow.fs.FileSystem.from_uri(path)
        part, held, ids, size = TaskContext.get().partitionId(), [], [], 0

        def close() -> pa.RecordBatch:
            file = f"part-{part:05d}-{uuid.uuid4().hex}.warc.zst"
            content, ends = archive(held, dictionary_bytes)
            first = 8 + struct.unpack_from("<II", content)[1]
            with store.open_output_stream(f"{folder}/{file}", compression=None) as out:
                out.write(content)
            return pa.RecordBatch.from_arrays([pa.array([file] * len(ids)), pa.array(ids, pa.int64()), pa.array([first, *ends[:-1]], pa.int64()), pa.array(ends, pa.int64())], ["file", "page_id", "start", "end"])

        for batch in batches:
            for page_id, url, payload, digest, kind, refers_to in zip(*(batch.column(i).to_pylist() for i in range(6))):
                held.append(record(page_id, url, payload, kind, refers_to, bytes.fromhex(digest)))
                ids.append(page_id)
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, ids, size = [], [], 0
        if held:
            yield close()

    return written(rows.withColumn("page_id", F.col("page_id").cast("long")).mapInArrow(write, "file string, page_id long, start long, end long"), "warc-index")


def read_archives(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    payload`` of every record of the archives that ``index`` names.

    Payloads of responses are checked against their digests; a revisit's
    payload is null.
    """
    files = small_side(index.select("file").distinct())
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    content = content.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(files, "file", "left_semi").select("content")

    def number(name: str) -> int | None:
        return int(value) if (value := name.removeprefix(f"<{RECORD_ID}").rstrip(">")) else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for head, block in records_of(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    n = int(http.rpartition(b"Content-Length: ")[2])
                    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    revisit = head["warc-type"] == "revisit"
                    if not revisit and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"record {head['warc-record-id']} is damaged")
                    rows.append((number(head["warc-record-id"]), head.get("warc-target-uri"), n, digest, head["warc-type"], number(head["warc-refers-to"]) if revisit else None, None if revisit else payload))
                    size += len(payload)
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    return content.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
