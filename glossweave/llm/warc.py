"""WARC archives with a Zstandard dictionary.

Each archive file begins with a skippable frame that holds a dictionary built
from records of that file; every record is a frame of its own, compressed with
it. A record can so be read alone, given the first frame.

Files are written by the tasks, to a folder all executors share; a task that is
run again writes a file of another name, and only files named in the manifest,
which Spark commits, belong to the archive.

Defined results: a null payload is empty; a null page id gives a record with a
random name and is read back as null; a null url is written as the record's name.
Of equal payloads of at least ``min_revisit_bytes`` bytes, the row with the
largest page id is the response and the others revisit it; rows that share this
largest id (repeated rows) are all responses, as are all rows of a group without
any id. An empty table gives an archive without files. Only the named columns are
read, so extra columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
ID_PREFIX = "urn:page:"
#: First bytes of a file's records that its dictionary is built from.
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3

MANIFEST = "file string, records long, bytes long, dictionary_bytes long"
RECORDS = (
    "page_id long, target_uri string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, payload binary"
)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- one record -------------------------------------------------------------

def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """Response record of a page, or a revisit record if it refers to another page."""
    name = f"{ID_PREFIX}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else name),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    head = HTTP_HEAD.format(len(payload)).encode()
    if refers_to is None:
        return _record(headers, head + payload)
    headers += [("WARC-Refers-To", f"<{ID_PREFIX}{refers_to}>"), ("WARC-Profile", PROFILE)]
    return _record(headers, head)


def _page_number(name: str | None) -> int | None:
    name = (name or "").strip("<>")
    return int(name[len(ID_PREFIX):]) if name.startswith(ID_PREFIX) else None


def parse_records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode().partition(":")
            headers[key.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record ends early")
        yield headers, block


# --- one file ---------------------------------------------------------------

def build_dictionary(samples: list[bytes]) -> bytes:
    """Dictionary of the records; empty if they are too few or too small for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_file(sink, records: Iterator[bytes], info: bytes) -> tuple[int, int, int]:
    """Write a file; number of page records, bytes, and bytes of the dictionary."""
    held, size = [], 0
    for record in records:
        held.append(record)
        size += len(record)
        if size >= SAMPLE_BYTES:
            break
    trained = build_dictionary(held)
    options = {}
    written = 0
    if trained:
        frame = struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained
        sink.write(frame)
        written += len(frame)
        options["dict_data"] = zstandard.ZstdCompressionDict(trained)
        options["dict_data"].precompute_compress(level=LEVEL)
    packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **options)
    written += sink.write(packer.compress(info))
    count = 0
    for source in (held, records):
        for record in source:
            written += sink.write(packer.compress(record))
            count += 1
        held = []
    return count, written, len(trained)


def read_file(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a file, one after the other; the file is never held as a whole."""
    head = source.read(8)
    options = {}
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_MAGIC:
        trained = source.read(struct.unpack("<II", head)[1])
        if len(trained) >= 4 and struct.unpack("<I", trained[:4])[0] == FRAME_MAGIC:
            trained = zstandard.ZstdDecompressor().decompress(trained)
        options["dict_data"] = zstandard.ZstdCompressionDict(trained)
    else:
        source.seek(0)
    unpacker = zstandard.ZstdDecompressor(**options)
    yield from parse_records(io.BufferedReader(unpacker.stream_reader(source, read_across_frames=True), 1 << 20))


# --- tables -----------------------------------------------------------------

def with_roles(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Page rows with ``refers_to``: the page whose payload is the same, or null.

    Only groups of two or more meet the rows again; a payload that a third of all
    pages share is one row on that side, so the join can split its pages.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"),
        F.when(F.octet_length(payload) >= min_revisit_bytes, F.sha2(payload.cast("binary"), 256)).alias("same"),
    )
    groups = rows.where(F.col("same").isNotNull()).groupBy("same").agg(
        F.max("page_id").alias("response_id"), F.count("*").alias("n")
    )
    shared = groups.where("n > 1").select("same", "response_id")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id"))
    return rows.join(shared, "same", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str, min_revisit_bytes: int = 0, date: str | None = None
) -> DataFrame:
    """Write the pages (page_id, url, html) below ``folder``, a file per task; gives the manifest."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches):
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return

        def records():
            batch = first
            while batch is not None:
                for page_id, url, payload, refers_to in zip(*(batch.column(c) for c in range(4))):
                    yield page_record(
                        page_id.as_py(), url.as_py(), payload.as_py().encode(), refers_to.as_py(), date
                    )
                batch = next(batches, None)

        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.zst"
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        info = _record(
            [
                ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                ("WARC-Date", date), ("Content-Type", "application/warc-fields"),
            ],
            b"format: WARC File Format 1.1\r\n",
        )
        with store.open_output_stream(f"{root}/{name}", compression=None) as sink:
            count, size, trained = write_file(sink, records(), info)
        yield pa.RecordBatch.from_pydict(
            {"file": [name], "records": [count], "bytes": [size], "dictionary_bytes": [trained]}
        )

    manifest = f"{folder}/manifest"
    with_roles(pages, min_revisit_bytes).mapInArrow(write, MANIFEST).write.parquet(manifest)
    return pages.sparkSession.read.schema(MANIFEST).parquet(manifest)


def _values(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    length = int(headers["warc-payload-length"])
    payload = None
    if headers["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != length or sha1_base32(payload) != digest:
            raise ValueError(f"payload of {headers['warc-record-id']} is not as written")
    return (
        _page_number(headers["warc-record-id"]), headers["warc-target-uri"], headers["warc-type"],
        length, digest, _page_number(headers.get("warc-refers-to")), payload if with_payload else None,
    )


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of an archive. Payloads are checked against length and digest.

    A revisit has no payload of its own; :func:`with_payloads` fetches it.
    """
    names = [part.split()[0] for part in RECORDS.split(",")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, types)))

    def batch(rows):
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema=schema)

    def read(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for part in batches:
            for name in part.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_file(os.path.join(root, name)) as source:
                    for headers, block in read_file(source):
                        if headers["warc-type"] not in ("response", "revisit"):
                            continue
                        rows.append(_values(headers, block, with_payload))
                        size += len(block) if with_payload else 0
                        if len(rows) >= 4096 or size >= 16 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file")
    # A file for each task; such a count is left alone when partitions are merged.
    files = manifest.count()
    return manifest.repartition(max(files, 1)).mapInArrow(read, RECORDS)


def with_payloads(records: DataFrame) -> DataFrame:
    """Records with the payload of revisits taken from the responses they refer to."""
    responses = records.where(
        (F.col("record_type") == "response") & F.col("page_id").isNotNull()
    ).groupBy(F.col("page_id").alias("refers_to")).agg(F.first("payload").alias("_found"))
    return records.join(responses, "refers_to", "left").withColumn(
        "payload", F.coalesce("payload", "_found")
    ).drop("_found")
