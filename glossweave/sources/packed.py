"""Packed page tables laid out so that tests on names skip files and row groups.

The table is partitioned by the scripts of a headword and sorted by headword in
small row groups. A script test is then a test on the partition alone, and a limit
is a bound on a stored column, which Parquet statistics answer; bodies of other
pages are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scripts import SCRIPT_NAMES, dominant_script, is_in_script, is_page_name
from ..operators.headwords import with_position

ROW_GROUP_BYTES = 8 << 20
KEYS = ("lowered", "word", "page_id")


def script_label(word: Column) -> Column:
    """Scripts of the first character, a minus sign, the dominant script."""
    first = F.concat_ws("+", *[F.when(is_in_script(word, name), F.lit(name)) for name in SCRIPT_NAMES])
    return F.concat(first, F.lit("-"), dominant_script(word))


def label_in_scripts(label: Column, scripts: Iterable[str]) -> Column:
    """The script test of names, on their label."""
    wanted = list(scripts)
    if "all" in wanted:
        return F.lit(True)
    first = F.split(F.substring_index(label, "-", 1), r"\+")
    by_first = F.arrays_overlap(first, F.array(*map(F.lit, wanted)))
    return by_first | F.substring_index(label, "-", -1).isin(wanted)


def pack_pages(pages: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write pages (page_id, word, html) in this layout. Names that are no pages are left out."""
    word = F.col("word")
    laid = pages.where(is_page_name(word)).select(
        "page_id", "word", "html", F.lower(word).alias("lowered"), script_label(word).alias("scripts")
    )
    order = ["scripts", *KEYS]
    laid.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("scripts").option(
        "parquet.block.size", row_group_bytes
    ).parquet(path)


def scan_packed(spark: SparkSession, path: str, scripts: Iterable[str] = ("all",), limit: int = 0) -> DataFrame:
    """Pages of such a table: those in the scripts, the first ``limit`` of them by headword if positive."""
    kept = spark.read.parquet(path).where(label_in_scripts(F.col("scripts"), scripts))
    if limit > 0:
        placed = with_position(kept.select(*KEYS), [F.col(k) for k in KEYS]).where(F.col("position") == limit - 1)
        rank = F.struct(*KEYS)
        last = placed.agg(F.max(rank)).scalar()
        bound = placed.agg(F.max("lowered")).scalar()
        # The first test is one on a column, so it reaches the scan.
        kept = kept.where((bound.isNull() | (F.col("lowered") <= bound)) & (last.isNull() | (rank <= last)))
    return kept.select("page_id", "word", "html")
