"""Near-duplicates by SimHash and anchor-point covering.

Fingerprints that differ in few bits are found through anchors, the words of a
covering code: every 64-bit value lies within the code's covering radius R of an
anchor. The code is two blocks of the perfect binary Golay code of length 23
(radius 3 each, so just one nearest anchor per block); the last 18 bits are one
block whose only word covers all. A fingerprint's home is its nearest anchor, and
it is copied to every anchor within R plus the threshold, measured block by block:
the distances beyond each block's radius add up to at most the threshold. If a
and b differ in at most the threshold's bits, b is so copied to the home of a, and
the two are compared there.

An anchor at home to more than ``MAX_HOME`` distinct fingerprints would compare
too many pairs. The fingerprints copied to such an anchor are linked instead
through the values at a distance of at most 1 from them, which is exact for
thresholds up to 2: two values within 2 bits share such a middle, and no two that
share one differ in more. A middle has 65 fingerprints at most, however many meet
at the anchor, so every link is found and no group is compared with itself.

Defined results: a null, empty or blank text has fingerprint zero and is linked
like any other; fewer than three words are one shingle; equal fingerprints are one
row in all of the search; rows with equal keys count as rows; a null key never
becomes a component's name unless all keys of it are null. Only the named columns
are read, so extra columns cannot clash.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import in_pieces
from .components import connected_components

SHINGLE_WORDS = 3
SEED = 42
THRESHOLD = 2
MAX_HOME = 64
#: Shingles of a text hashed at a time.
SHINGLE_BLOCK = 1 << 18

# Generator polynomial of the Golay code, and its length, dimension and radius.
GOLAY, LENGTH, DIMENSION, RADIUS = 0b101011100011, 23, 12, 3
BLOCKS = (64 - LENGTH, 64 - 2 * LENGTH)  # lowest bit of each block


# --- fingerprints -----------------------------------------------------------

def fingerprint(words: list[bytes], size: int = SHINGLE_WORDS) -> int:
    """SimHash of lower-cased words; a bit is set if it is in over half of the shingles' hashes."""
    if not words:
        return 0
    count = max(len(words) - size + 1, 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[:count].tolist()
    stops = (ends[min(size, len(words)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for at in range(0, count, SHINGLE_BLOCK):
        pairs = zip(starts[at:at + SHINGLE_BLOCK], stops[at:at + SHINGLE_BLOCK])
        hashes = np.array([digest(joined[s:e], SEED) for s, e in pairs], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(set_bits * 2 > count).tolist())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, fp) of whole texts; fp is the fingerprint as a signed long."""
    narrow = docs.select(F.col(key).alias(key), F.col(text).alias("text"))

    def run(batches):
        for batch in in_pieces(batches):
            values = []
            for body in batch.column(1).to_pylist():
                # Bytes are lower-cased in A-Z alone.
                values.append(fingerprint(body.encode().lower().split()) if body else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], names=[key, "fp"]
            )

    return narrow.mapInArrow(run, f"{key} {dict(narrow.dtypes)[key]}, fp long")


# --- the covering code ------------------------------------------------------

def _remainder(values: np.ndarray) -> np.ndarray:
    """Remainder of each value by the generator: 0 for words of the code."""
    rest = values.copy()
    for bit in range(LENGTH - 1, LENGTH - DIMENSION - 1, -1):
        rest ^= np.where((rest >> bit) & 1, GOLAY << (bit - (LENGTH - DIMENSION)), 0)
    return rest


@cache
def anchor_steps(reach: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each excess over the radius, the differences from a value to anchors, by remainder.

    Entry x has offsets (one per remainder, and the end) and differences: those of
    weight up to the radius for excess 0, of weight radius + x for excess x.
    """
    out = []
    patterns, last = [np.zeros(1, np.int64)], [np.full(1, -1)]
    for _ in range(RADIUS + reach):
        grown, highest = [], []
        for bit in range(LENGTH):
            chosen = patterns[-1][last[-1] < bit]
            grown.append(chosen | (1 << bit))
            highest.append(np.full(len(chosen), bit))
        patterns.append(np.concatenate(grown))
        last.append(np.concatenate(highest))
    levels = [np.concatenate(patterns[: RADIUS + 1]), *patterns[RADIUS + 1:]]
    for differences in levels:
        rest = _remainder(differences)
        order = np.argsort(rest, kind="stable")
        offsets = np.searchsorted(rest[order], np.arange((1 << (LENGTH - DIMENSION)) + 1))
        out.append((offsets, differences[order]))
    return out


def _anchors_of(values: np.ndarray, excess: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of one block at an excess: index of the value, and the anchor's message bits."""
    offsets, differences = anchor_steps(reach)[excess]
    rest = _remainder(values)
    counts = offsets[rest + 1] - offsets[rest]
    of = np.repeat(np.arange(len(values)), counts)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    words = values[of] ^ differences[offsets[rest][of] + inside]
    return of, words >> (LENGTH - DIMENSION)


def anchors(fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All anchors within radius + ``reach``: index of the fingerprint, anchor, is it the home."""
    blocks = [((fps.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << LENGTH) - 1)) for low in BLOCKS]
    out = []
    for first in range(reach + 1):
        of, high = _anchors_of(blocks[0], first, reach)
        for second in range(reach + 1 - first):
            again, low = _anchors_of(blocks[1][of], second, reach)
            anchor = (high[again] << DIMENSION) | low
            out.append((of[again], anchor, np.full(len(again), first + second == 0)))
    return tuple(np.concatenate(parts) for parts in zip(*out))


def _anchored(fps: DataFrame, reach: int) -> DataFrame:
    """Rows (anchor, fp) of distinct fingerprints for all anchors within reach."""

    def run(batches):
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 2048):
                part = values[at:at + 2048]
                of, anchor, _ = anchors(part, reach)
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchor, pa.int32()), "fp": part[of]})

    return fps.select("fp").mapInArrow(run, "anchor int, fp long")


# --- links ------------------------------------------------------------------

def near_links(fps: DataFrame, threshold: int = THRESHOLD, max_home: int = MAX_HOME) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints (column fp) within the threshold.

    Below a crowded anchor fingerprints are linked to the least at each middle,
    which joins the same components.
    """
    if not 0 <= threshold <= 2:
        raise ValueError("the way taken at crowded anchors is exact for thresholds up to 2")
    homes = cut(_anchored(fps, 0), "homes")
    crowded = homes.groupBy("anchor").count().where(F.col("count") > max_home).select("anchor")
    empty = F.lit(None).cast("long").alias("home")
    entries = homes.join(crowded, "anchor", "left_anti").select("anchor", F.col("fp").alias("home")).unionByName(
        crowded.select("anchor", empty)
    )
    # Spark sizes the copies as if they were as few as the fingerprints, but there are about 60 of
    # each: below its broadcast limit they would all be gathered in the driver. So both sides are sorted.
    copies = _anchored(fps, threshold).hint("merge")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("home"))) <= threshold
    meets = (copies["anchor"] == entries["anchor"]) & (F.col("home").isNull() | (near & (F.col("fp") != F.col("home"))))
    met = cut(copies.join(entries, meets).select("fp", "home").distinct(), "met")
    links = met.where("home is not null").select(F.col("fp").alias("a"), F.col("home").alias("b"))
    return links.unionByName(_middle_links(met.where("home is null").select("fp").distinct(), threshold))


def _middle_links(fps: DataFrame, threshold: int) -> DataFrame:
    """Links of fingerprints that share a value at a distance of at most half the threshold, rounded up.

    For a threshold of 1 a middle of two fingerprints that both differ from it is left out.
    """
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.expr("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    if threshold == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    rows = fps.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("middle"))
    least = rows.groupBy("middle").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    centre = F.array_min("fps") if threshold == 2 else F.when(F.array_contains("fps", F.col("middle")), F.col("middle"))
    starred = least.select(centre.alias("b"), F.explode("fps").alias("a"))
    return starred.where("b is not null and a <> b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, fp, component_id) of all documents; the id is the least key of the component."""
    marked = cut(fingerprints(docs, key, text), "fingerprints")
    distinct = cut(marked.groupBy("fp").agg(F.min(key).alias("least")), "distinct-fingerprints")
    links = cut(near_links(distinct, threshold), "links")
    of = connected_components(links).withColumnRenamed("node", "fp")
    grouped = distinct.join(of, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.select("fp", "component").join(names, "component").select("fp", "component_id")
    return marked.join(named, "fp").select(key, "fp", "component_id")


def digest_columns(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, threshold: int = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row of every component left, that with the least key; columns as given.

    Rows are numbered first and components are found over the numbers, so rows with
    equal keys or texts, or without a key, are rows of their own: of a component the row
    with the least key stays (null keys last, then the first row). No window or join
    goes by a key or a text that many rows may share.
    """
    numbered = cut(
        docs.select(
            F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
        ),
        "numbered",
    )
    rows = numbered.select("_row", F.col("_doc")[text].alias("_text"))
    found = near_duplicates(rows, threshold, "_row", "_text").select("_row", "component_id")
    named = found.join(numbered.select("_row", F.col("_doc")[key].alias("_key")), "_row")
    order = F.struct(F.col("_key").isNull(), F.col("_key"), F.col("_row"))
    stays = named.groupBy("component_id").agg(F.min(order)["_row"].alias("_row"))
    gone = cut(found.join(stays, "_row", "left_anti").select("_row"), "gone")
    return numbered.join(gone, "_row", "left_anti").select("_doc.*")
