"""Counts a run reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scripts import SCRIPT_NAMES, in_scripts, is_page_name, script_counts
from .headwords import assign_batches
from .nodes import once


def run_stats(outcomes: DataFrame, batch_size: int) -> DataFrame:
    """Pages processed and skipped per batch.

    ``outcomes`` has ``word``, ``page_id`` and ``has_entry`` for every page. It
    should be a stored table: sorting reads it twice.
    """
    return (
        assign_batches(outcomes, batch_size)
        .groupBy("batch")
        .agg(
            F.count_if("has_entry").alias("processed"),
            F.count_if(~F.col("has_entry")).alias("skipped"),
        )
    )


def count_stages(files: DataFrame, scripts: Iterable[str], limit: int = 0) -> DataFrame:
    """Files found, left by the script filter, and left by the limit, in one pass."""
    counted = files.where(is_page_name(F.col("word"))).agg(
        F.count("*").alias("found"),
        F.count_if(in_scripts(F.col("word"), scripts)).alias("in_scripts"),
    )
    left = F.least(F.col("in_scripts"), F.lit(limit)) if limit > 0 else F.col("in_scripts")
    return counted.withColumn("after_limit", left.cast("long"))


def script_histogram(words: DataFrame, word: str = "word") -> DataFrame:
    """Characters per script over all words: one row per script."""
    counted = once(words.select(word), "_counts", script_counts(F.col(word)))
    totals = counted.agg(
        *[
            F.coalesce(F.sum(F.get("_counts", F.lit(i))), F.lit(0)).alias(name)
            for i, name in enumerate(SCRIPT_NAMES)
        ]
    )
    return totals.unpivot([], list(SCRIPT_NAMES), "script", "characters")
