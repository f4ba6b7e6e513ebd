"""Ingest pages in batches as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.headwords import limit_pages
from ..params import ConvertParams
from ..plans.convert import page_outcomes, select_named


def ingest_batches(
    pages: DataFrame, params: ConvertParams, out: str, checkpoint: str, code=None,
    keep: tuple[str, ...] = (),
) -> None:
    """Run a page stream to its end, one folder of outcomes per batch below ``out``.

    Names and scripts are tested before pages are batched. A batch that is
    repeated after a failure replaces its own folder, so every page is counted
    once. A limit needs the order of all pages: :func:`read_outcomes` applies it.
    """

    def store(batch: DataFrame, number: int) -> None:
        page_outcomes(batch, params, code, keep).write.mode("overwrite").parquet(
            f"{out}/batch={number}"
        )

    query = (
        select_named(pages, params).writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_outcomes(spark, out: str, limit: int = 0) -> DataFrame:
    """Outcomes of all batches with their ``batch`` number, of the first ``limit`` pages if that is positive."""
    return limit_pages(spark.read.option("basePath", out).parquet(out), limit)


def batch_stats(outcomes: DataFrame, batch: str = "batch") -> DataFrame:
    """Pages processed and skipped per batch of the stream."""
    return outcomes.groupBy(batch).agg(
        F.count_if("has_entry").alias("processed"),
        F.count_if(~F.col("has_entry")).alias("skipped"),
    )
