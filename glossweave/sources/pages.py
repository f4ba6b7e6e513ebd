"""Page tables: ``page_id`` (unique), ``word``, ``html``."""

from __future__ import annotations

import os
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scripts import is_page_name
from ..operators.headwords import with_position
from ..session import cut

# Bytes and files of one task that reads page files.
TASK_BYTES = 32 << 20
TASK_FILES = 250
# A slice of a stream has more files per task, up to this many, once it has so many tasks:
# starting a task costs as much as some dozens of files.
STREAM_TASKS = 64
STREAM_TASK_FILES = 1000
# Bytes of bodies that a task holds at a time.
PIECE_BYTES = 1 << 20
NAMES = "word string, length long"


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{os.path.abspath(path.removeprefix('file:'))}"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Names and lengths of the files directly below ``path``, all of them.

    Spark's file sources leave out names that start with an underscore, and files
    without content; a folder of pages has both. One task lists the folder.
    """
    folder = _uri(path)

    def run(batches):
        list(batches)
        store, root = fs.FileSystem.from_uri(folder)
        found = [i for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File]
        for at in range(0, len(found), 10_000):
            part = found[at:at + 10_000]
            yield pa.RecordBatch.from_pydict({"word": [i.base_name for i in part], "length": [i.size for i in part]})

    return spark.range(0, 1, 1, 1).mapInArrow(run, NAMES)


def _with_bodies(names: DataFrame, path: str, *more: str) -> DataFrame:
    """Page rows of file names. Only rows that are kept are read: the reader is a
    scalar function, so tests on names go below it.

    Bytes that are not UTF-8 become replacement characters.
    """
    folder = _uri(path)

    most = PIECE_BYTES

    @F.arrow_udf("binary")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        store, root = fs.FileSystem.from_uri(folder)
        for words in batches:
            bodies, held = [], 0
            for word in words.to_pylist():
                with store.open_input_stream(f"{root}/{word}", compression=None) as source:
                    bodies.append(source.read())
                held += len(bodies[-1])
                if held >= most:
                    yield pa.array(bodies, pa.binary())
                    bodies, held = [], 0
            if bodies:
                yield pa.array(bodies, pa.binary())

    return names.select(
        F.concat(F.lit(f"{path.rstrip('/')}/"), "word").alias("page_id"), "word", *more,
        F.make_valid_utf8(read("word").cast("string")).alias("html"),
    )


def scan_page_dir(
    spark: SparkSession, path: str, task_bytes: int = TASK_BYTES, task_files: int = TASK_FILES
) -> DataFrame:
    """One page per file directly below ``path``; the file name is the word.

    Names with a suffix and hidden names are no pages. Names are listed first, so
    that bodies are read by tasks of bounded size, and only of pages that pass the
    tests on names.
    """
    names = cut(list_files(spark, path), "names").where(is_page_name(F.col("word")))
    sums = names.agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).first()
    tasks = max(1, ceil(sums["files"] / task_files), ceil((sums["bytes"] or 0) / task_bytes))
    return _with_bodies(names.repartition(tasks), path)


def spread(table: DataFrame, min_tasks: int | None = None) -> DataFrame:
    """Give a small scanned table at least ``min_tasks`` tasks before costly parsing.

    Off by default. A file with one row group is read by one task, however many
    cores there are. A table of more than ``min_tasks`` splits is left as it is,
    so what may be shuffled is bounded by the parameter, not by the cluster.
    """
    if not min_tasks:
        return table
    split = table.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table if size > min_tasks * split else table.repartition(min_tasks)


def scan_pages(
    spark: SparkSession,
    path: str,
    word: str | Column = "word",
    html: str | Column = "html",
    page_id: str | Column = "page_id",
    min_tasks: int | None = None,
) -> DataFrame:
    """Pages of a packed Parquet table: the way to read very many pages.

    Write such tables sorted by headword and with small row groups, so that they
    split well and a limit on names skips row groups.
    """

    def named(value: str | Column, name: str) -> Column:
        return (F.col(value) if isinstance(value, str) else value).alias(name)

    table = spread(spark.read.parquet(path), min_tasks)
    return table.select(named(page_id, "page_id"), named(word, "word"), named(html, "html"))


def _slice_tasks(files: int) -> int:
    """Tasks of a slice: few files each, more once there are tasks enough."""
    return min(ceil(files / TASK_FILES), max(STREAM_TASKS, ceil(files / STREAM_TASK_FILES)))


def stream_page_dir(spark: SparkSession, path: str, files_per_batch: int, names: str) -> DataFrame:
    """The same pages as a stream that takes ``files_per_batch`` files at a time.

    ``names`` is a folder in which the names of the stream are kept, one file per
    slice of names in their order. A later call adds slices of the names that are
    new; each page has the number of its slice.
    """
    listed = list_files(spark, path).where(is_page_name(F.col("word"))).select("word")
    start = 0
    target = spark._jvm.org.apache.hadoop.fs.Path(names)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        known = spark.read.parquet(names)
        start = known.agg(F.max("slice") + 1).first()[0] or 0
        listed = listed.join(known.select("word"), "word", "left_anti")
    placed = with_position(cut(listed, "names"), [F.col("word")])
    slices = placed.select("word", (F.floor(F.col("position") / files_per_batch) + start).cast("long").alias("slice"))
    slices.repartition("slice").write.mode("append").partitionBy("slice").parquet(names)
    stream = spark.readStream.schema("word string, slice long").option("maxFilesPerTrigger", 1).parquet(names)
    # A slice of names is one file; its pages are read and parsed by several tasks.
    return _with_bodies(stream.repartition(_slice_tasks(files_per_batch)), path, "slice")
