"""Removal of repeated byte strings by blockwise suffix comparison with a difference cover.

A string of ``LENGTH`` bytes is removed wherever it also starts earlier. To know
which suffixes agree on that many bytes, suffixes are put into buckets by their
rank key, and one bucket at a time is ordered in memory.

* The cover. Positions p with p mod ``PERIOD`` in a difference cover are the
  sample. Any two positions i, j have a shift d < PERIOD that puts both i + d and
  j + d into the sample. So if two suffixes agree on LENGTH bytes, two sample
  suffixes inside them agree on LENGTH - PERIOD + 1 bytes. The sample, an eighth of
  all positions, is ranked first: a sample suffix whose rank is its own alone
  settles every suffix that leads to it.
* The ties. Only suffixes before a shared sample rank can tie for long. These are
  put into buckets, each bucket is ordered by key and by place, and all but the
  first of a key are marked.

Ranks are 64-bit fingerprints of the strings, of which 56 bits and the bucket's
are compared (32 and the bucket's for the sample, where a false tie costs only work).
Texts are stored once as chunks of documents in the shared folder and read from
there by every pass. Chunks and buckets exchange packed arrays: a chunk sends each
of its keys once, however often it has it, so a string that a third of all texts
share is one key per chunk; a bucket answers with a bit per key. Documents that
equal an earlier one as a whole take no part: all of their strings start earlier.

The number of buckets follows the bytes, ``BUCKET_BYTES`` of text for each, so a
bucket's memory does not grow with the table; a chunk is ``CHUNK_BYTES``, or one
longer document.

Defined results: a null text is empty; texts under LENGTH bytes lose nothing;
documents count as earlier by smaller id, a null id before all others, and rows
with equal ids by their place in the input; an empty table gives no rows. Only
the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, new_scratch_path

LENGTH = 100
PERIOD = 73
# Every difference modulo 73 is one of these less another.
COVER = (0, 1, 3, 7, 15, 31, 36, 54, 63)
SAMPLE_LENGTH = LENGTH - PERIOD + 1
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20
KEY_BYTES = 7
#: Chunks whose answers share a file.
SLOT_CHUNKS = 8
NO_ID = -(1 << 63)

_BASE = 0x9E3779B97F4A7C15
_CHUNKS = "chunk long, ids binary, lengths binary, digests binary, data binary"
_SENT = "bucket int, chunk long, keys binary, ids binary, runs binary"
_ANSWER = "chunk long, bucket int, bits binary"


# --- chunks -----------------------------------------------------------------

class Chunk(NamedTuple):
    number: int
    ids: np.ndarray
    lengths: np.ndarray
    data: np.ndarray


def _documents(batches) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            yield NO_ID if key is None else key, text.encode() if text else b""


def _pack(number: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
    held.sort(key=lambda d: d[0])
    digests = b"".join(hashlib.sha256(raw).digest() for _, raw in held)
    return pa.RecordBatch.from_pydict({
        "chunk": [number],
        "ids": [np.array([i for i, _ in held], np.int64).tobytes()],
        "lengths": [np.array([len(raw) for _, raw in held], np.int64).tobytes()],
        "digests": [digests],
        "data": [b"".join(raw for _, raw in held)],
    })


def write_chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Documents as packed rows, ordered by id inside a chunk, written once."""

    def build(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for document in _documents(batches):
            if held and size + len(document[1]) > CHUNK_BYTES:
                yield _pack(number, held)
                number, held, size = number + 1, [], 0
            held.append(document)
            size += len(document[1])
        if held:
            yield _pack(number, held)

    spark = docs.sparkSession
    path = new_scratch_path(spark, "chunks")
    rows = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(build, _CHUNKS)
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(_CHUNKS).parquet(path)


def whole_copies(chunks: DataFrame) -> DataFrame:
    """Places (chunk, at) of documents that equal an earlier one as a whole."""

    def places(batches):
        for batch in batches:
            for number, ids, digests in zip(*(batch.column(c).to_pylist() for c in range(3))):
                ids = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_pydict({
                    "digest": [digests[i * 32:i * 32 + 32] for i in range(len(ids))],
                    "id": ids, "chunk": np.full(len(ids), number), "at": pa.array(range(len(ids)), pa.int32()),
                })

    rows = cut(
        chunks.select("chunk", "ids", "digests").mapInArrow(places, "digest binary, id long, chunk long, at int"),
        "digests",
    )
    place = F.struct("id", "chunk", "at")
    first = rows.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    # Written first, so that the join may split a digest that very many documents share.
    first = cut(first.select("digest", "first"), "copied-digests")
    return rows.join(first, "digest").where(place != F.col("first")).select("chunk", "at")


# --- looking up answers -----------------------------------------------------

class Answers(NamedTuple):
    """A table whose rows a task can look up by chunk: a folder, and one file in it for each slot of chunks."""
    path: str
    slots: int

    def of(self, chunk: int) -> list[dict]:
        """Rows of a chunk: one file is opened, and read as far as its statistics say."""
        store, root = fs.FileSystem.from_uri(self.path)
        folder = f"{root}/slot={slot_of(chunk, self.slots)}"
        if store.get_file_info(folder).type == fs.FileType.NotFound:
            return []
        found = pads.dataset(folder, filesystem=store, format="parquet")
        return found.to_table(filter=pads.field("chunk") == chunk).to_pylist()


def slot_of(chunk, slots: int):
    """Slot of a chunk, of a number or a column: partition and running number mixed."""
    if isinstance(chunk, int):
        return ((chunk >> 32) * 31 + (chunk & 0xFFFFFFFF)) % slots
    return F.pmod(F.shiftright(chunk, 32) * 31 + chunk.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(slots))


def store_by_chunk(df: DataFrame, label: str, slots: int) -> Answers:
    path = new_scratch_path(df.sparkSession, label)
    rows = df.withColumn("slot", slot_of(F.col("chunk"), slots)).repartition("slot")
    rows.sortWithinPartitions("slot", "chunk").write.partitionBy("slot").parquet(path)
    return Answers(path, slots)


# --- fingerprints of strings ------------------------------------------------

_powers: dict[str, np.ndarray] = {}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if "up" not in _powers or len(_powers["up"]) < size:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:size], _powers["down"][:size]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    _, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:-1], out=sums[1:])
    return sums


def fingerprints_at(sums: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of the strings of a length that start at given places."""
    up, _ = _power_tables(len(sums))
    h = (sums[at + length] - sums[at]) * up[at]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


# --- one chunk --------------------------------------------------------------

class Samples(NamedTuple):
    sums: np.ndarray
    ends: np.ndarray  # end of the document of every byte
    at: np.ndarray  # sample places
    keys: np.ndarray  # distinct fingerprints in order
    inverse: np.ndarray
    repeated: np.ndarray  # per key, twice or more in the chunk


def sample_chunk(chunk: Chunk, copies: set[int]) -> Samples:
    stops = np.cumsum(chunk.lengths)
    ends = np.repeat(stops, chunk.lengths)
    takes_part = np.ones(len(chunk.lengths), bool)
    takes_part[list(copies)] = False
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    size = len(chunk.data)
    at = np.flatnonzero(np.resize(cover, size)) if size else np.zeros(0, np.int64)
    at = at[(at + SAMPLE_LENGTH <= ends[at]) & np.repeat(takes_part, chunk.lengths)[at]]
    sums = prefix_sums(chunk.data)
    keys, inverse, counts = np.unique(
        fingerprints_at(sums, at, SAMPLE_LENGTH), return_inverse=True, return_counts=True
    )
    return Samples(sums, ends, at, keys, inverse, counts > 1)


class Suffixes(NamedTuple):
    at: np.ndarray  # places of suffixes that may tie
    keys: np.ndarray  # distinct fingerprints in the order they are sent
    first: np.ndarray  # first place of each
    number: np.ndarray  # key of each place
    document: np.ndarray  # document of each key's first place


def tied_suffixes(chunk: Chunk, samples: Samples, shared: np.ndarray, bits: int) -> Suffixes:
    """Suffixes of LENGTH bytes before a shared sample rank, by bucket and document."""
    marks = samples.at[(samples.repeated | shared)[samples.inverse]]
    size = len(chunk.data)
    steps = np.bincount(np.maximum(marks - (PERIOD - 1), 0), minlength=size + 2)[: size + 1].astype(np.int64)
    steps -= np.bincount(marks + 1, minlength=size + 2)[: size + 1]
    at = np.flatnonzero(np.cumsum(steps)[:size] > 0)
    at = at[at + LENGTH <= samples.ends[at]]
    keys, first, number = np.unique(
        fingerprints_at(samples.sums, at, LENGTH), return_index=True, return_inverse=True
    )
    document = np.searchsorted(np.cumsum(chunk.lengths), at[first], side="right")
    # Keys in the order of buckets, and of documents inside a bucket.
    order = np.argsort(bucket_of(keys, bits) * len(chunk.lengths) + document, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Suffixes(at, keys[order], first[order], place[number], document[order])


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _by_bucket(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    buckets = bucket_of(keys, bits)
    edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]])) if len(keys) else [0]
    for start, stop in zip(edges[:-1], edges[1:]):
        yield int(buckets[start]), slice(start, stop)


def _chunks(batches) -> Iterator[Chunk]:
    for batch in batches:
        for row in range(batch.num_rows):
            number, ids, lengths, data = (batch.column(c)[row] for c in range(4))
            yield Chunk(
                number.as_py(), np.frombuffer(ids.as_buffer(), np.int64),
                np.frombuffer(lengths.as_buffer(), np.int64), np.frombuffer(data.as_buffer(), np.uint8),
            )


def _copies(places: Answers, chunk: int) -> set[int]:
    return {row["at"] for row in places.of(chunk)}


def _bits(stored: Answers, chunk: int, keys: np.ndarray, bits: int) -> np.ndarray:
    """A chunk's answers, in the order of its keys."""
    answers = {row["bucket"]: row["bits"] for row in stored.of(chunk)}
    out = np.zeros(len(keys), bool)
    for bucket, part in _by_bucket(keys, bits):
        raw = np.frombuffer(answers[bucket], np.uint8)
        out[part] = np.unpackbits(raw, count=part.stop - part.start).astype(bool)
    return out


def _reply(chunks: list[int], bucket: int, flags: list[np.ndarray]) -> pa.Table:
    return pa.table({
        "chunk": pa.array(chunks, pa.int64()), "bucket": pa.array([bucket] * len(chunks), pa.int32()),
        "bits": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary()),
    })


# --- buckets ----------------------------------------------------------------

def shared_samples(group: pa.Table) -> pa.Table:
    """Which sample keys of a bucket come from two chunks or more."""
    parts = [np.frombuffer(k, np.uint32) for k in group["keys"].to_pylist()]
    every = pd.Series(np.concatenate(parts)).duplicated(keep=False).to_numpy()
    edges = np.cumsum([0, *map(len, parts)])
    flags = [every[s:e] for s, e in zip(edges, edges[1:])]
    return _reply(group["chunk"].to_pylist(), group["bucket"][0].as_py(), flags)


def later_suffixes(group: pa.Table) -> pa.Table:
    """Which suffixes of a bucket are not the first of their key, by document and place."""
    numbers = group["chunk"].to_pylist()
    keys, runs, ids, chunks = [], [], [], []
    for number, k, i, r in zip(numbers, *(group[c].to_pylist() for c in ("keys", "ids", "runs"))):
        raw = np.frombuffer(k, np.uint8).reshape(-1, KEY_BYTES)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :KEY_BYTES] = raw
        keys.append(wide.view("<u8").ravel())
        runs.append(np.frombuffer(r, np.uint32).astype(np.int64))
        ids.append(np.frombuffer(i, np.int64))
        chunks.append(np.full(len(ids[-1]), number))
    lengths, key = np.concatenate(runs), np.concatenate(keys)
    order = np.lexsort((np.concatenate(chunks), np.concatenate(ids)))
    starts = np.cumsum(lengths) - lengths
    taken = lengths[order]
    place = np.repeat(starts[order], taken) + np.arange(len(key)) - np.repeat(np.cumsum(taken) - taken, taken)
    # Stable, so that equal keys stay in the order of documents.
    ranked = place[np.argsort(key[place], kind="stable")]
    later = np.zeros(len(key), bool)
    later[ranked[1:]] = key[ranked[1:]] == key[ranked[:-1]]
    edges = np.cumsum([0, *map(len, keys)])
    return _reply(numbers, group["bucket"][0].as_py(), [later[s:e] for s, e in zip(edges, edges[1:])])


# --- the operator -----------------------------------------------------------

def bucket_bits(total: int) -> int:
    return max(0, int(np.ceil(np.log2(max(total, 1) / BUCKET_BYTES))))


def removed_bytes(chunk: Chunk, copies: set[int], suffixes: Suffixes, later: np.ndarray) -> np.ndarray:
    """Bytes of a chunk that a later start covers."""
    again = np.ones(len(suffixes.at), bool)
    again[suffixes.first] = later
    starts = suffixes.at[again]
    steps = np.zeros(len(chunk.data) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + LENGTH, -1)
    mask = np.cumsum(steps[:-1]) > 0
    stops = np.cumsum(chunk.lengths)
    for i in copies:
        if chunk.lengths[i] >= LENGTH:
            mask[stops[i] - chunk.lengths[i]:stops[i]] = True
    return mask


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Rows (key, n_bytes, n_removed, n_spans, kept_sha256[, kept]).

    ``kept`` are the bytes that are left; a removal may cut a sign of several bytes.
    """
    chunks = write_chunks(docs, key, text)
    sizes = chunks.agg(F.sum(F.octet_length("data")).alias("n"), F.count("*").alias("chunks")).first()
    slots = max(1, sizes["chunks"] // SLOT_CHUNKS)
    bits = bucket_bits(sizes["n"] or 0)
    copies = store_by_chunk(whole_copies(chunks), "copies", slots)
    rows = chunks.select("chunk", "ids", "lengths", "data")

    def send_samples(batches):
        for chunk in _chunks(batches):
            samples = sample_chunk(chunk, _copies(copies, chunk.number))
            short = (samples.keys >> np.uint64(32 - bits)).astype(np.uint32)
            for bucket, part in _by_bucket(samples.keys, bits):
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([bucket], pa.int32()), "chunk": [chunk.number],
                    "keys": [short[part].tobytes()], "ids": [b""], "runs": [b""],
                })

    answered = rows.mapInArrow(send_samples, _SENT).groupBy("bucket").applyInArrow(shared_samples, _ANSWER)
    shared = store_by_chunk(answered, "shared-samples", slots)

    def suffixes_of(chunk: Chunk, gone: set[int]) -> Suffixes:
        samples = sample_chunk(chunk, gone)
        return tied_suffixes(chunk, samples, _bits(shared, chunk.number, samples.keys, bits), bits)

    def send_suffixes(batches):
        for chunk in _chunks(batches):
            found = suffixes_of(chunk, _copies(copies, chunk.number))
            rest = (found.keys << np.uint64(bits)) >> np.uint64(8)
            short = rest.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
            for bucket, part in _by_bucket(found.keys, bits):
                document = found.document[part]
                edges = np.flatnonzero(np.concatenate([[True], document[1:] != document[:-1], [True]]))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([bucket], pa.int32()), "chunk": [chunk.number],
                    "keys": [np.ascontiguousarray(short[part]).tobytes()],
                    "ids": [chunk.ids[document[edges[:-1]]].tobytes()],
                    "runs": [np.diff(edges).astype(np.uint32).tobytes()],
                })

    ordered = rows.mapInArrow(send_suffixes, _SENT).groupBy("bucket").applyInArrow(later_suffixes, _ANSWER)
    later = store_by_chunk(ordered, "later-suffixes", slots)

    def finish(batches):
        for chunk in _chunks(batches):
            gone = _copies(copies, chunk.number)
            found = suffixes_of(chunk, gone)
            mask = removed_bytes(chunk, gone, found, _bits(later, chunk.number, found.keys, bits))
            stops = np.cumsum(chunk.lengths)
            out = []
            for i, (number, stop, length) in enumerate(zip(chunk.ids.tolist(), stops.tolist(), chunk.lengths.tolist())):
                cut_out = mask[stop - length:stop]
                kept = chunk.data[stop - length:stop][~cut_out].tobytes()
                spans = int((cut_out[1:] & ~cut_out[:-1]).sum() + cut_out[:1].sum())
                out.append((
                    None if number == NO_ID else number, length, length - len(kept), spans,
                    hashlib.sha256(kept).hexdigest(), kept if with_text else None,
                ))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_pydict({
                key: pa.array(columns[0], pa.int64()), "n_bytes": columns[1], "n_removed": columns[2],
                "n_spans": columns[3], "kept_sha256": columns[4], "kept": pa.array(columns[5], pa.binary()),
            })

    schema = f"{key} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    result = rows.mapInArrow(finish, schema)
    return result if with_text else result.drop("kept")
