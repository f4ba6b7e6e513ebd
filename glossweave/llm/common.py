"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but ASCII white space; ``bytes.split`` cuts UTF-8 text at exactly these signs.
WORD = r"[^\x20\x09-\x0D]+"

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def in_pieces(batches: Batches, rows: int = 1_000) -> Batches:
    """Batches cut to at most ``rows`` rows. Whole texts are large rows; what a task
    makes of a batch, and sends back, is bounded so whatever the session's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_pieces(texts: pa.Array, most_bytes: int = 2 << 20) -> Iterator[list]:
    """Consecutive runs of an Arrow array of texts, as Python strings, of at most ``most_bytes``
    bytes (one text at least): only a run is ever held as Python objects, so what is made of
    it is bounded by its size, not by a number of rows."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if at > start and held + size > most_bytes:
            yield texts.slice(start, at - start).to_pylist()
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield texts.slice(start).to_pylist()


def held_out(key: Column, parts: int = 3, part: int = 1) -> Column:
    """Whether a row is kept from training: crc32 of the key's text, modulo ``parts``.

    A missing key is never learned from.
    """
    fold = F.crc32(key.cast("string").cast("binary")) % parts
    return F.coalesce(fold == part, F.lit(True))


def fold_case(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
