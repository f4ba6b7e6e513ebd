"""Dictionary files: header, one row per entry, footer."""

from __future__ import annotations

import os
import uuid
from functools import reduce
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import DSL_CHARSET, XDXF_DESCRIPTION, XDXF_DOCTYPE, XDXF_PROLOG
from ..functions.render import render_entry
from ..functions.text import dictionary_name, dsl_quote, html_escape, language_name
from ..operators.headwords import sort_keys
from ..params import ConvertParams
from ..session import cut

HEADER, BODY, FOOTER = 0, 1, 2


def dsl_header(name: Column, source: Column, target: Column) -> list[Column]:
    def field(tag: str, value: Column) -> Column:
        return F.concat(F.lit(f'#{tag} "'), dsl_quote(value), F.lit('"'))

    return [
        field("NAME", name),
        field("INDEX_LANGUAGE", source),
        field("CONTENTS_LANGUAGE", target),
        F.lit(DSL_CHARSET),
        F.lit(""),
    ]


def xdxf_header(name: Column, source: Column, target: Column) -> list[Column]:
    opening = F.concat(
        F.lit('<xdxf lang_from="'), F.lower(source), F.lit('" lang_to="'), F.lower(target),
        F.lit('" format="visual">'),
    )
    return [
        F.lit(XDXF_PROLOG),
        F.lit(XDXF_DOCTYPE),
        opening,
        F.concat(F.lit("<full_name>"), html_escape(name), F.lit("</full_name>")),
        F.lit(XDXF_DESCRIPTION),
        F.lit("<abbreviations>"),
        F.lit("</abbreviations>"),
        F.lit("<xdxf_body>"),
    ]


def header_lines(params: ConvertParams) -> list[Column]:
    names = params.language_names
    source, target = F.lit(params.source_lang), F.lit(params.target_lang)
    entry = F.lit(params.entry_lang) if params.entry_lang else None
    title = dictionary_name(F.lit(params.name), source, target, entry, names)
    build = dsl_header if params.fmt == "lingvo" else xdxf_header
    return build(title, language_name(source, names), language_name(target, names))


def footer_lines(params: ConvertParams) -> list[Column]:
    if params.fmt == "lingvo":
        return []
    return [F.lit("</xdxf_body>"), F.lit("</xdxf>")]


def _fixed_rows(spark: SparkSession, section: int, lines: list[Column], id_type: str, definitions: str) -> DataFrame:
    rows = spark.range(1).select(F.posexplode(F.array(*lines)).alias("line", "value"))
    return rows.select(
        F.lit(section).alias("section"), "line", F.lit("").alias("word"),
        F.lit(None).cast(id_type).alias("page_id"), F.lit(None).cast(definitions).alias("definitions"), "value",
    )


def _unrendered(entries: DataFrame, params: ConvertParams) -> DataFrame:
    """Rows of a dictionary file, ``value`` only in those of header and footer."""
    body = entries.select(
        F.lit(BODY).alias("section"), F.lit(0).alias("line"), "word", "page_id", "definitions",
        F.lit(None).cast("string").alias("value"),
    )
    spark, types = entries.sparkSession, dict(entries.dtypes)
    kinds = types["page_id"], types["definitions"]
    parts = [_fixed_rows(spark, HEADER, header_lines(params), *kinds), body]
    footer = footer_lines(params)
    if footer:
        parts.append(_fixed_rows(spark, FOOTER, footer, *kinds))
    return reduce(DataFrame.unionByName, parts)


def _value(params: ConvertParams) -> Column:
    rendered = render_entry(F.col("word"), F.col("definitions"), params.fmt, params.escape_dsl)
    return F.when(F.col("section") == BODY, rendered).otherwise(F.col("value")).alias("value")


def frame_output(entries: DataFrame, params: ConvertParams) -> DataFrame:
    """Rows of a dictionary file: ``section``, ``line``, ``word``, ``page_id``, ``value``.

    Not sorted; see :func:`output_order`.
    """
    return _unrendered(entries, params).select("section", "line", "word", "page_id", _value(params))


def output_order() -> list[Column]:
    return [F.col("section"), F.col("line"), *sort_keys()]


def write_dictionary(
    entries: DataFrame, params: ConvertParams, path: str, stored: bool = False
) -> None:
    """Write the dictionary below ``path`` as ordered text parts.

    The parts, joined in name order, are the file. Entries are stored once
    before the sort, unless they come from a table already (``stored``):
    sorting by range reads its input twice, and parsing pages is the costly step.
    """
    entries = entries.select("page_id", "word", "definitions")
    stored = entries if stored else cut(entries, "entries")
    # Rendered after the sort, which reads its input twice.
    lines = _unrendered(stored, params).orderBy(*output_order())
    lines.select(_value(params)).write.mode("overwrite").text(path)


def merge_dictionaries(runs: list[DataFrame]) -> DataFrame:
    """One entry table out of several runs: the entries of a word are those of the last run that has it.

    All of that run's entries of the word stay. Definitions of the last run are
    not shuffled, those of earlier runs once for each run after them. A run is
    read again for its words, so runs should be stored tables.
    """
    columns = ["page_id", "word", "definitions"]
    merged = runs[0].select(*columns)
    for run in runs[1:]:
        later = run.select("word").distinct()
        merged = merged.join(later, "word", "left_anti").select(*columns).unionByName(run.select(*columns))
    return merged


# --- one file, written in parallel --------------------------------------------

def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath


def _local(path: str) -> str | None:
    """The POSIX path of a ``file:`` location, None for other stores."""
    parsed = urlparse(path)
    return parsed.path if parsed.scheme in ("", "file") else None


def _put_in_place(rows) -> None:
    """Copy each part into the one file at its offset; parts go in parallel, a task writes only its own."""
    for row in rows:
        fd = os.open(row.target, os.O_WRONLY)
        try:
            at = row.offset
            with open(row.part, "rb") as part:
                while chunk := part.read(1 << 22):
                    os.pwrite(fd, chunk, at)
                    at += len(chunk)
            if at != row.offset + row.size:
                raise OSError(f"part {row.part} changed while it was copied")
        finally:
            os.close(fd)


def write_single_file(
    entries: DataFrame, params: ConvertParams, path: str, stored: bool = False
) -> None:
    """Write the dictionary as the one file ``path``.

    The ordered lines are written as parts in parallel, as by :func:`write_dictionary`.
    The byte length of each part gives its offset in the file (a prefix sum over the
    parts, one small row each); every part is then put at its offset by a task of its
    own, into a file of the whole length beside the target. Only when all parts stand is
    it moved over ``path``, so an old file stays whole until then. Stores with a
    ``concat`` of their own (HDFS) join the parts without copying them.
    """
    spark = entries.sparkSession
    staging = f"{path}.parts-{uuid.uuid4().hex}"
    write_dictionary(entries, params, staging, stored)
    fs, folder = _hadoop(spark, staging)
    listed = [s for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
    parts = sorted(((s.getPath().toString(), s.getLen()) for s in listed), key=lambda p: p[0].rsplit("/", 1)[1])
    sizes = spark.createDataFrame(list(enumerate(parts)), "n int, p struct<part:string,size:long>").select(
        "n", "p.*"
    )
    before = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))
    fresh = f"{path}.new-{uuid.uuid4().hex}"
    target_fs, target = _hadoop(spark, fresh)
    local = _local(fresh)
    if local is not None:
        total = sum(size for _, size in parts)
        with open(local, "wb") as out:
            out.truncate(total)
        jobs = placed.select(
            F.regexp_replace("part", "^file:", "").alias("part"), "size", "offset", F.lit(local).alias("target")
        )
        jobs.repartition(max(1, len(parts)), "n").foreachPartition(_put_in_place)
        os.replace(local, _local(path))
    else:
        # A store that joins files itself moves no bytes; the parts are its blocks.
        first, rest = parts[0][0], [p for p, _ in parts[1:]]
        jvm = spark._jvm
        target_fs.rename(jvm.org.apache.hadoop.fs.Path(first), target)
        if rest:
            target_fs.concat(target, [jvm.org.apache.hadoop.fs.Path(p) for p in rest])
        final = jvm.org.apache.hadoop.fs.Path(path)
        if target_fs.exists(final):
            target_fs.delete(final, False)
        target_fs.rename(target, final)
    fs.delete(folder, True)
