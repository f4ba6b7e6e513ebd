"""Order, limit and batches of headwords.

The order is by lower-cased word, then word, then a unique column, so that a
word that occurs very often still spreads over many sort partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut

_INDEX_BITS = 33


def sort_keys(word: str = "word", tie: str | None = "page_id") -> list[Column]:
    keys = [F.lower(F.col(word)), F.col(word)]
    return keys + [F.col(tie)] if tie else keys


def sort_headwords(df: DataFrame, word: str = "word", tie: str | None = "page_id") -> DataFrame:
    return df.orderBy(*sort_keys(word, tie))


def with_position(df: DataFrame, keys: list[Column], name: str = "position") -> DataFrame:
    """Add the zero-based position of each row in the order of ``keys``.

    A range-partitioned sort numbers the rows inside each partition; the rows
    are written once, and the partition sizes, one small row each, become
    offsets. No task sees more than its own range. ``df`` should be narrow
    (keys and an identifier, not page bodies) and cheap to read twice, which
    sampling for the sort does.
    """
    numbered = cut(df.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright(F.col("_at"), _INDEX_BITS)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    index = F.col("_at").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    # One row per sort partition, so the broadcast is bounded by their number.
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + index).cast("long"))
        .drop("_at", "_part", "_offset")
    )


def assign_batches(df: DataFrame, size: int, word: str = "word", tie: str | None = "page_id") -> DataFrame:
    """Number consecutive slices of ``size`` rows in headword order, from 0."""
    placed = with_position(df, sort_keys(word, tie))
    return placed.withColumn("batch", F.floor(F.col("position") / size).cast("int"))


#: Rows of a key range that are sorted directly; rows sampled to cut a larger one; cuts a round.
SELECT_ROWS = 50_000
SAMPLE_ROWS = 10_000
CUTS = 100


def _key_literal(row, types: list[str]) -> Column:
    return F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(row, types))])


def nth_key(keys: DataFrame, n: int, seed: int = 7):
    """The n-th smallest (from 0) value of the one struct column ``k`` of ``keys``, or None if there
    are not so many rows; found without sorting the table.

    Each round cuts the current range of keys at up to ``CUTS`` keys sampled from it, counts
    the rows below, at and between the cuts (one small row per piece), and goes on in the
    piece that holds the rank; a cut that holds it is the answer. Every piece leaves out at
    least the rows of the cuts, so the range shrinks each round, also when many rows share a
    key. A range of at most ``SELECT_ROWS`` rows is sorted by itself.
    """
    types = [f.dataType.simpleString() for f in keys.schema["k"].dataType.fields]
    low = high = None
    count = keys.count()
    if n < 0 or n >= count:
        return None
    while True:
        part = keys
        if low is not None:
            part = part.where(F.col("k") > _key_literal(low, types))
        if high is not None:
            part = part.where(F.col("k") < _key_literal(high, types))
        if count <= SELECT_ROWS:
            return part.orderBy("k").limit(n + 1).agg(F.max("k").alias("k")).first().k
        fraction = min(1.0, SAMPLE_ROWS / count)
        sampled = [r.k for r in part.sample(fraction, seed).select("k").distinct().orderBy("k").collect()]
        seed += 1
        if not sampled:
            continue
        step = max(1, len(sampled) // CUTS)
        cuts = sampled[step - 1 :: step][:CUTS] or sampled[:1]
        piece = None
        for i, cut_at in reversed(list(enumerate(cuts))):
            at = _key_literal(cut_at, types)
            piece = F.when(F.col("k") < at, 2 * i).when(F.col("k").eqNullSafe(at), 2 * i + 1).otherwise(
                piece if piece is not None else F.lit(2 * len(cuts))
            )
        counted = dict(part.groupBy(piece.alias("piece")).count().collect())
        before = 0
        for j in range(2 * len(cuts) + 1):
            here = counted.get(j, 0)
            if n < before + here:
                break
            before += here
        if j % 2:
            return cuts[j // 2]
        n -= before
        count = here
        low = cuts[j // 2 - 1] if j > 0 else low
        high = cuts[j // 2] if j < 2 * len(cuts) else high


def limit_pages(pages: DataFrame, n: int, word: str = "word", tie: str = "page_id") -> DataFrame:
    """First ``n`` pages in headword order; no limit when ``n`` is not positive.
    Rows equal to the n-th in word and tie all stay.

    The key of the n-th page is selected by :func:`nth_key` from the names alone,
    in rounds of range counts, without a sort of all names; page bodies are then
    scanned once, behind a filter on that key, and never shuffled.
    """
    if n <= 0:
        return pages
    keys = sort_keys(word, tie)
    rank = F.struct(keys[0].alias("k0"), keys[1].alias("k1"), keys[2].alias("k2"))
    names = cut(pages.select(rank.alias("k")), "names")
    last = nth_key(names, n - 1)
    if last is None:
        return pages
    types = [f.dataType.simpleString() for f in names.schema["k"].dataType.fields]
    return pages.where(rank <= _key_literal(last, types))
