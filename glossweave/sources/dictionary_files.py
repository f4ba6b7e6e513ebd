"""Dictionary files read back into entry tables, record by record.

A record of DSL is a headword line and the indented lines after it; one of XDXF
runs from ``<ar>`` to ``</ar>`` over several lines. Files are read as lines, in
as many splits as Spark makes of them, and every line keeps its place: the
file, the start of its split, and its order inside the split. A line belongs
to the last record start before it in its split; lines at the head of a split,
before any start, continue the last record of the nearest earlier split that
has one. So records that cross split borders are joined again, and no task
holds more than a split, besides one row per split and the lines of a record.

Read entries have ``page_id`` = their place in the files (ascending in file
order), ``word`` as written (a space where the entry had an underscore) and
``definitions``. Header and footer lines are not entries. A written entry
without definitions reads back without them; an empty folder gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import html_unescape, let

DSL_DIRECTIVES = r"^#(NAME|INDEX_LANGUAGE|CONTENTS_LANGUAGE|CHARSET) "


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (start of the split), at (order inside the split), line."""
    return spark.read.text(path).select(
        F.input_file_name().alias("file"), F.input_file_block_start().alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"),
    )


def records(lines: DataFrame, starts: Column) -> DataFrame:
    """file, page_id, lines (array, in file order) of every record that ``starts`` opens.

    Records are numbered by the starts before them: in their split by a running count,
    and in all earlier splits by a sum over one small row per split.
    """
    lines = lines.withColumn("_start", starts)
    in_split = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("_seen", F.count_if("_start").over(in_split))
    splits = marked.groupBy("file", "block").agg(F.count_if("_start").alias("_n"))
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        "file", "block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_n").over(in_file) > 0, F.lit(False)).alias("_continues"),
    )
    # Lines before the first start of a split belong to the last record before it in the file, if any.
    keyed = marked.join(splits, ["file", "block"]).where((F.col("_seen") > 0) | F.col("_continues"))
    keyed = keyed.withColumn("page_id", (F.col("_before") + F.col("_seen") - 1).cast("long"))
    return keyed.groupBy("file", "page_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "line"))), lambda x: x["line"]).alias("lines")
    )


def _grouped(items: Column) -> Column:
    """(is_pos, text) items to definitions: each part of speech with the items after it."""

    def group(found: Column) -> Column:
        places = F.filter(
            F.transform(found, lambda x, i: F.when(x["pos"] | (i == 0), i)), lambda i: i.isNotNull()
        )
        return let(places, lambda opened: F.transform(opened, lambda i, n: F.struct(
            F.get(found, i)["text"].alias("pos"),
            F.transform(
                F.slice(found, i + 2, F.coalesce(F.get(opened, n + 1), F.size(found)) - i - 1), lambda x: x["text"]
            ).alias("defs"),
        )))

    return let(items, group)


def read_dsl(spark: SparkSession, path: str) -> DataFrame:
    starts = F.col("line").rlike(r"^\S") & ~F.col("line").rlike(DSL_DIRECTIVES)
    found = records(placed_lines(spark, path), starts)
    body = F.filter(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), lambda x: x.startswith("  "))
    items = F.transform(
        body,
        lambda x: F.struct(
            x.rlike(r"^  \[c\].*\[/c\]$").alias("pos"),
            F.when(x.rlike(r"^  \[c\].*\[/c\]$"), F.regexp_extract(x, r"^  \[c\](.*)\[/c\]$", 1))
            .otherwise(F.substring(x, 3, 1 << 30)).alias("text"),
        ),
    )
    return found.select("page_id", F.element_at("lines", 1).alias("word"), _grouped(items).alias("definitions"))


def read_xdxf(spark: SparkSession, path: str) -> DataFrame:
    found = records(placed_lines(spark, path), F.col("line").startswith("<ar><k>"))
    end = F.array_position("lines", "</ar>")
    body = F.slice("lines", 2, F.greatest(end - 2, F.lit(0)))
    items = F.transform(
        body,
        lambda x: F.struct(
            x.startswith("<pos>").alias("pos"), html_unescape(F.regexp_extract(x, r"^<(?:pos|def)>(.*)</(?:pos|def)>$", 1)).alias("text"),
        ),
    )
    word = html_unescape(F.regexp_extract(F.element_at("lines", 1), r"^<ar><k>(.*)</k>$", 1))
    return found.select("page_id", word.alias("word"), _grouped(items).alias("definitions"))


def read_dictionary(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Entries of the dictionary files at ``path`` (a file or a folder of parts), read anew by each use."""
    if fmt == "lingvo":
        return read_dsl(spark, path)
    if fmt == "xdxf":
        return read_xdxf(spark, path)
    raise ValueError(f"Unsupported output format: {fmt}")
