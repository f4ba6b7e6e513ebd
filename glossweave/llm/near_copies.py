"""Near copies of whole texts: documents that share most of their five-word shingles.

Two texts are near copies if the Jaccard similarity of their shingle sets is
``SIMILARITY`` or more, or if their fingerprints are within op5's threshold. At a
similarity of 0.8 fingerprints differ in about ten bits, farther than anchors of a
64-bit code reach, so candidates come from ``BANDS`` bands of ``BAND_ROWS`` minimum
hashes each and are confirmed on the whole sets: texts at 0.8 share a band with a
chance of 0.9998, nearer ones with more.

A bucket of over ``MAX_BUCKET`` sets is not compared pair by pair. Its members are
compared with its least, and within the buckets of two bands; those that are crowded
too are compared with their least.

Defined results: null, empty and blank texts are copies of each other; fewer than
five words are one shingle; rows are told apart by a number of their own, so rows
with equal keys, or without one, count as rows. Of a component the row with the least
key stays, without keys the first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import simhash
from .common import in_pieces
from .components import connected_components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 16, 4
MAX_BUCKET = 32
#: Shingles of a text whose minima are taken at a time.
BLOCK = 1 << 11

_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def shingles(words: list[bytes], size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of lower-cased words."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    count = len(words) - size + 1
    out = np.zeros(count, np.uint64)
    for i in range(size):
        out = out * _STEP + hashes[i:i + count]
    return np.unique(_mixed(out))


def band_hashes(found: np.ndarray) -> np.ndarray:
    """Hashes of the bands of minimum hashes, the number of the band among them."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), BLOCK):
        least = np.minimum(least, (_FACTORS[:, None] * found[at:at + BLOCK]).min(axis=1))
    rows = _mixed(least).reshape(BANDS, BAND_ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND_ROWS):
        out = _mixed(out * _STEP + rows[:, i])
    return out.view(np.int64)


def _words(body: str | None) -> list[bytes]:
    return body.encode().lower().split() if body else []


def sketches(rows: DataFrame) -> DataFrame:
    """Rows (row, fp, same, size, bands) of (row, text); ``same`` stands for the whole set."""

    def run(batches):
        for batch in in_pieces(batches, 500):
            columns = [[], [], [], []]
            for body in batch.column(1).to_pylist():
                words = _words(body)
                found = shingles(words)
                columns[0].append(simhash.fingerprint(words))
                columns[1].append(xxhash.xxh64_intdigest(found.tobytes()))
                columns[2].append(len(found))
                columns[3].append(band_hashes(found))
            longs = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns[:2]]
            flat = np.concatenate(columns[3]) if columns[3] else np.zeros(0, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, BANDS), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *longs, pa.array(columns[2], pa.int32()), bands],
                names=["row", "fp", "same", "size", "bands"],
            )

    return rows.select("row", "text").mapInArrow(run, "row long, fp long, same long, size int, bands array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """Rows (row, set) of (row, text), the set packed as halves of the hashes."""

    def run(batches):
        for batch in in_pieces(batches, 200):
            packed = [
                np.unique(shingles(_words(b)).astype(np.uint32)).tobytes() for b in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["row", "set"])

    return rows.select("row", "text").mapInArrow(run, "row long, set binary")


# --- candidates -------------------------------------------------------------

def _in_buckets(members: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) of (bucket, row, size), and members of crowded buckets."""
    counted = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("row", "size")).alias("least"))
    met = cut(members.join(counted.where("n > 1"), "bucket"), label)
    few = met.where(F.col("n") <= MAX_BUCKET)
    other = few.select("bucket", F.col("row").alias("b"), F.col("size").alias("size_b"))
    pairs = few.select("bucket", F.col("row").alias("a"), F.col("size").alias("size_a")).join(other, "bucket")
    crowded = met.where(F.col("n") > MAX_BUCKET)
    least = crowded.select(
        F.col("least.row").alias("a"), F.col("least.size").alias("size_a"), F.col("row").alias("b"), F.col("size").alias("size_b")
    )
    every = pairs.drop("bucket").unionByName(least).where("a < b")
    # Sets of such different sizes cannot be that similar.
    close = F.least("size_a", "size_b") >= SIMILARITY * F.greatest("size_a", "size_b")
    return every.where(close).select("a", "b"), crowded.select("bucket", "row", "size")


def candidates(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of rows (row, size, bands) that share a band."""
    bands = distinct.select("row", "size", F.explode("bands").alias("bucket"))
    pairs, crowded = _in_buckets(bands, "band-buckets")
    # Two bands of a set: in the first it is crowded, the second comes after it.
    again = crowded.select("row", "size", "bucket").join(distinct.select("row", "bands"), "row")
    later = F.slice("bands", F.array_position("bands", F.col("bucket")).cast("int") + 1, BANDS)
    twice = again.select("row", "size", "bucket", F.explode(later).alias("second"))
    more, _ = _in_buckets(twice.select(F.xxhash64("bucket", "second").alias("bucket"), "row", "size"), "two-band-buckets")
    return cut(pairs.unionByName(more).distinct(), "candidates")


def confirmed(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar enough; texts of (row, text) are read once more."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    sets = cut(_sets(rows.join(named, "row", "left_semi")), "shingle-sets")
    left = pairs.join(sets.select(F.col("row").alias("a"), F.col("set").alias("set_a")), "a")
    both = left.join(sets.select(F.col("row").alias("b"), F.col("set").alias("set_b")), "b")

    def run(batches):
        for batch in in_pieces(batches, 200):
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                one, two = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
                shared = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(shared >= SIMILARITY * (len(one) + len(two) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


# --- one of each ------------------------------------------------------------

def _to_least(marked: DataFrame, column: str) -> DataFrame:
    """Links of rows to the least row with an equal value."""
    least = marked.groupBy(column).agg(F.min("row").alias("b"))
    return marked.join(least, column).where("row <> b").select(F.col("row").alias("a"), "b")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of every component of near copies left; columns as given."""
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    )
    numbered = cut(numbered, "numbered")
    rows = numbered.select("row", F.col("doc")[text].alias("text"))
    marked = cut(sketches(rows), "sketches")
    distinct = cut(
        marked.groupBy("same").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("bands").alias("bands")),
        "distinct-sets",
    )
    similar = confirmed(rows, candidates(distinct.where("size > 0")))
    fps = cut(marked.groupBy("fp").agg(F.min("row").alias("row")), "fps")
    of = [fps.select(F.col("fp").alias(f"fp_{x}"), F.col("row").alias(x)) for x in "ab"]
    near = simhash.near_links(fps).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    anchored = near.join(of[0], "fp_a").join(of[1], "fp_b").select("a", "b")
    links = cut(
        similar.unionByName(anchored).unionByName(_to_least(marked, "same")).unionByName(_to_least(marked, "fp")), "links"
    )
    component = cut(connected_components(links).select(F.col("node").alias("row"), "component"), "components")
    named = numbered.select("row", F.col("doc")[key].alias("key")).join(component, "row")
    order = F.struct(F.col("key").isNull(), F.col("key"), F.col("row"))
    stays = named.groupBy("component").agg(F.min(order)["row"].alias("row"))
    gone = cut(component.join(stays, "row", "left_anti").select("row"), "gone")
    return numbered.join(gone, "row", "left_anti").select("doc.*")
