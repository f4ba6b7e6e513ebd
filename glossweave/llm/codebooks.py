"""Vector code compression: product-quantisation codebooks over Hilbert-sorted flat blocks.

Every component x becomes the integer floor(256 * x). A vector is cut into
``parts`` equal consecutive parts; each part position has a codebook of
``entries`` entries, at first that part of the vectors with the smallest keys.
Each round assigns every part to its nearest entry (squared Euclidean distance,
ties to the lower index) and replaces every entry by the componentwise
floor(sum / count) of its parts; unused entries stay. Finally parts are assigned
once more.

The parts of one position are sorted along a Hilbert curve and cut into flat
blocks of ``block`` consecutive parts; a block stores the min/max box of its
parts and their sum. Each round, the box distances give every block a shortlist:
the entries whose least distance to the box is at most the smallest greatest
distance of any entry. Only those are evaluated, by small exact integer kernels;
a block whose shortlist has one entry adds its stored sum without looking at its
parts. The blocks are written once and read every round; the codebooks (parts x
entries x part length integers, bounded by the parameters) are the only thing that
goes through the driver.

Defined results: rows with a null vector, or a null or non-finite component, are
dropped; so are vectors whose length differs from that of the first codebook row
(the length must be a multiple of ``parts``). A null key is kept and sorts after
all others; repeated rows are assigned each. Fewer kept rows than entries make a
smaller codebook; an empty table gives no rows and no codebook. Labels may be
null: they form one group. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Parts of a flat block.
BLOCK = 256
#: Bits of a Hilbert coordinate, at most; fewer when parts are long.
HILBERT_BITS = 15


def finite_vector(vector: Column) -> Column:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & ok


def as_integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Distance along a Hilbert curve of every row of ``points`` (non-negative integers below
    2**bits), all rows stepped together: Skilling's transposition, then the bits interleaved."""
    x = points.astype(np.uint64).copy()
    n, d = x.shape
    top = np.uint64(1 << (bits - 1))
    q = top
    while q > 1:
        p = q - np.uint64(1)
        for i in range(d):
            high = (x[:, i] & q) != 0
            x[high, 0] ^= p
            low = ~high
            t = (x[low, 0] ^ x[low, i]) & p
            x[low, 0] ^= t
            x[low, i] ^= t
        q >>= np.uint64(1)
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.uint64)
    q = top
    while q > 1:
        t[(x[:, d - 1] & q) != 0] ^= q - np.uint64(1)
        q >>= np.uint64(1)
    x ^= t[:, None]
    key = np.zeros(n, np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << np.uint64(1)) | ((x[:, i] >> np.uint64(b)) & np.uint64(1))
    return key


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of every part; ties to the lower index."""
    diff = parts[:, None, :] - entries[None, :, :]
    dist = np.einsum("nkd,nkd->nk", diff, diff)
    at = np.argmin(dist, axis=1)
    return at, dist[np.arange(len(parts)), at]


def shortlist(lo: np.ndarray, hi: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Entries (ascending) that may be nearest to some point of the box [lo, hi]."""
    below = np.maximum(np.maximum(lo[None, :] - entries, entries - hi[None, :]), 0)
    least = (below * below).sum(axis=1)
    far = np.maximum((entries - lo[None, :]) ** 2, (entries - hi[None, :]) ** 2).sum(axis=1)
    return np.flatnonzero(least <= far.min())


@dataclass
class Compressed:
    """Codes of every kept row, and the final codebooks (parts x entries x part length)."""

    codes: DataFrame
    codebooks: np.ndarray

    def codebooks_sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.reshape(-1).tolist())).encode()).hexdigest()


def flat_blocks(rows: DataFrame, parts: int, width: int, lo: int, hi: int, block: int) -> DataFrame:
    """The parts of every position, Hilbert-sorted and cut into blocks with box and sum."""
    bits = max(1, min(HILBERT_BITS, 62 // max(width, 1)))
    span = max(hi - lo, 1)
    shift = max(0, int(span).bit_length() - bits)
    split = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("ints", p * width + 1, width))
    exploded = rows.select("_row", "_key", "_label", F.posexplode(split).alias("part", "vec"))

    def keyed(batches):
        for pdf in batches:
            vecs = np.array(pdf["vec"].tolist(), np.int64).reshape(len(pdf), width)
            grid = ((vecs - lo) >> shift).clip(0, (1 << bits) - 1)
            yield pdf.assign(hkey=hilbert_keys(grid, bits).astype(np.int64) if len(pdf) else np.zeros(0, np.int64))

    schema = "_row long, _key long, _label int, part int, vec array<long>, hkey long"
    # The row joins the sort key, so a vector that a third of all rows share still spreads over ranges.
    ordered = exploded.mapInPandas(keyed, schema).repartitionByRange("part", "hkey", "_row").sortWithinPartitions(
        "part", "hkey", "_row"
    )

    def cut_blocks(batches):
        task = TaskContext.get().partitionId()
        held: list[pd.DataFrame] = []
        number = 0

        def emit(frame):
            nonlocal number
            out = []
            for part, group in frame.groupby("part", sort=False):
                for at in range(0, len(group), block):
                    piece = group.iloc[at : at + block]
                    vecs = np.array(piece["vec"].tolist(), np.int64).reshape(len(piece), width)
                    out.append((int(part), (task << 32) | number, vecs.min(0).tolist(), vecs.max(0).tolist(),
                                vecs.sum(0).tolist(), len(piece), piece["_row"].tolist(), piece["_key"].tolist(),
                                piece["_label"].tolist(), vecs.reshape(-1).tolist()))
                    number += 1
            return pd.DataFrame(out, columns=BLOCK_COLUMNS)

        for pdf in batches:
            held.append(pdf)
            size = sum(map(len, held))
            if size >= 16 * block:
                frame = pd.concat(held)
                # Keep the tail of the last part, which the next batch continues.
                last = frame["part"].iloc[-1]
                tail = frame[frame["part"] == last]
                keep = len(tail) - len(tail) % block
                done = pd.concat([frame[frame["part"] != last], tail.iloc[:keep]])
                held = [tail.iloc[keep:]]
                if len(done):
                    yield emit(done)
        if held and sum(map(len, held)):
            yield emit(pd.concat(held))

    return ordered.mapInPandas(cut_blocks, BLOCK_SCHEMA)


BLOCK_COLUMNS = ["part", "block", "lo", "hi", "total", "n", "rows", "keys", "labels", "vecs"]
BLOCK_SCHEMA = (
    "part int, block long, lo array<long>, hi array<long>, total array<long>, n long, rows array<long>, "
    "keys array<long>, labels array<int>, vecs array<long>"
)


def _assigned(blocks: pd.DataFrame, books: np.ndarray, width: int):
    """(block row, entries of every part, distances or None) per block, through shortlists."""
    for row in blocks.itertuples(index=False):
        entries = books[row.part]
        short = shortlist(np.asarray(row.lo, np.int64), np.asarray(row.hi, np.int64), entries)
        if len(short) == 1:
            yield row, short[0], None
            continue
        vecs = np.asarray(row.vecs, np.int64).reshape(row.n, width)
        at, dist = nearest(vecs, entries[short])
        yield row, short[at], dist


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK,
) -> Compressed:
    """Train the codebooks and code every kept row: ``codes`` has key, label, codes (array of
    entry indexes by part) and error (sum of the final squared distances)."""
    spark = vectors.sparkSession
    kept = vectors.select(
        F.col(key).cast("long").alias("_key"), F.col(label).cast("int").alias("_label"), F.col(vector).alias("_vec")
    ).where(finite_vector(F.col("_vec")))
    kept = kept.select("_key", "_label", as_integers(F.col("_vec")).alias("ints"))
    # The first codebook: a bounded number of rows, however large the table.
    first = kept.orderBy(F.col("_key").asc_nulls_last(), "ints").limit(entries).collect()
    empty_codes = spark.createDataFrame([], "_key long, _label int, codes array<int>, error long")
    if not first:
        return Compressed(empty_codes, np.zeros((parts, 0, 0), np.int64))
    length = len(first[0].ints)
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    width = length // parts
    rows = kept.where(F.size("ints") == length).withColumn("_row", F.monotonically_increasing_id())
    bounds = rows.select(F.min(F.array_min("ints")).alias("lo"), F.max(F.array_max("ints")).alias("hi")).first()
    blocks = cut(flat_blocks(rows, parts, width, int(bounds.lo), int(bounds.hi), block), "flat-blocks")
    books = np.array([r.ints for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()

    for _ in range(rounds):
        books = _next_books(blocks, books, width)

    final = books

    def coded(batches):
        for pdf in batches:
            for row, at, dist in _assigned(pdf, final, width):
                n = row.n
                at = np.full(n, at) if np.ndim(at) == 0 else at
                if dist is None:
                    vecs = np.asarray(row.vecs, np.int64).reshape(n, width)
                    diff = vecs - final[row.part][at]
                    dist = (diff * diff).sum(1)
                yield pd.DataFrame({"_row": row.rows, "_key": row.keys, "_label": row.labels, "part": row.part,
                                    "entry": at.astype(np.int32), "dist": dist.astype(np.int64)})

    per_part = blocks.mapInPandas(coded, "_row long, _key long, _label int, part int, entry int, dist long")
    codes = per_part.groupBy("_row").agg(
        F.first("_key").alias("_key"), F.first("_label").alias("_label"),
        F.transform(F.array_sort(F.collect_list(F.struct("part", "entry"))), lambda s: s["entry"]).alias("codes"),
        F.sum("dist").alias("error"),
    )
    return Compressed(codes.drop("_row"), books)


def _next_books(blocks: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """One round: assign through the shortlists, then floor(sum / count) of every used entry."""
    parts, count = books.shape[0], books.shape[1]

    def sums(batches):
        total = np.zeros((parts, count, width), np.int64)
        used = np.zeros((parts, count), np.int64)
        for pdf in batches:
            for row, at, dist in _assigned(pdf, books, width):
                if dist is None:
                    total[row.part, at] += np.asarray(row.total, np.int64)
                    used[row.part, at] += row.n
                else:
                    vecs = np.asarray(row.vecs, np.int64).reshape(row.n, width)
                    np.add.at(total[row.part], at, vecs)
                    np.add.at(used[row.part], at, 1)
        p, e = np.nonzero(used)
        # At most parts x entries rows a task: the combine happens before the shuffle.
        yield pd.DataFrame({"part": p.astype(np.int32), "entry": e.astype(np.int32), "n": used[p, e],
                            "total": list(total[p, e])})

    summed = (
        blocks.mapInPandas(sums, "part int, entry int, n long, total array<long>")
        .select("part", "entry", "n", F.posexplode("total").alias("i", "s"))
        .groupBy("part", "entry", "i")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        .collect()
    )
    out = books.copy()
    for r in summed:
        out[r.part, r.entry, r.i] = r.s // r.n
    return out


def digest_columns(found: Compressed, key: str = "vec_id") -> DataFrame:
    """key, code (two hex digits an index), error, label_error, codebooks_sha256."""
    codes = cut(found.codes, "codes")
    per_label = cut(codes.groupBy("_label").agg(F.sum("error").alias("label_error")), "label-errors")
    hexed = F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")))
    return codes.join(per_label, codes["_label"].eqNullSafe(per_label["_label"]), "left").select(
        codes["_key"].alias(key), hexed.alias("code"), F.col("error").cast("long").alias("error"),
        F.col("label_error").cast("long").alias("label_error"), F.lit(found.codebooks_sha256()).alias("codebooks_sha256"),
    )
