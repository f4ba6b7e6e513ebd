"""Sharding by jump consistent hashing.

The shard of a row follows from its key and the number of shards alone; there is
no ring table. When a shard is appended, only the rows that go into it move.

Defined results: a null key counts as the key -1; rows with equal keys share a
shard and get slots of their own; a null text has size 1 and checksum 0; an empty
table gives no rows. Only the columns named by the caller are read, so extra
columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.headwords import with_position
from ..session import cut

LAW = "key"
NULL_KEY = -1
# Constants of the published generator.
_MULTIPLIER = np.uint64(2862933555777941757)
_SPAN = float(1 << 31)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Bucket of every 64-bit key among ``shards``, all keys stepped together."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    bucket = np.full(len(state), -1, np.int64)
    ahead = np.zeros(len(state), np.int64)
    open_ = np.arange(len(state))
    while len(open_):
        bucket[open_] = ahead[open_]
        state[open_] = state[open_] * _MULTIPLIER + np.uint64(1)
        step = _SPAN / ((state[open_] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[open_] = np.floor((bucket[open_] + 1) * step).astype(np.int64)
        open_ = open_[ahead[open_] < shards]
    return bucket


def shard_of(key: Column, shards: int) -> Column:
    """Shard of an integer key. Only the key goes to Python, in Arrow batches."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(), shards).astype(np.int32))

    return jump(F.coalesce(key.cast("long"), F.lit(NULL_KEY)))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` counts the rows of a shard from 0 in key order. The narrow rows are
    written once and range-sorted by shard and key, with size, checksum and a row
    number behind them, so that a repeated key still spreads over many
    partitions; slots come from partition sizes, not from one window per shard.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).cast("long").alias(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    numbered = narrow.select(
        "*", shard_of(F.col(key), shards).alias("shard"), shard_of(F.col(key), shards + 1).alias("grown_shard")
    )
    stored = cut(numbered, "sharded")
    keys = [F.col(c) for c in ("shard", key, "size", "text_crc32", "_tie")]
    placed = with_position(stored, keys, "_position")
    counts = stored.groupBy("shard").agg(F.count("*").alias("_n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    # One row per shard: bounded by the parameter.
    first = counts.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        key, "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("_position") - F.col("_first")).alias("slot"), "grown_shard",
    )


def with_shards(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """The documents themselves with their ``shard``, no shuffle."""
    return docs.withColumn("shard", shard_of(F.col(key), shards))
