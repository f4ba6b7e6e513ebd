"""Dictionary files read back record by record, also where records cross split borders."""

import pytest
from pyspark.sql import functions as F

from glossweave import ConvertParams
from glossweave.sources.dictionary_files import read_dictionary
from glossweave.sources.sinks import merge_dictionaries, write_single_file

TYPE = "page_id long, word string, definitions array<struct<pos:string,defs:array<string>>>"


def entries(spark, n, shift=0):
    rows = [
        (i, f"w{(i + shift) % 97}é", [("Noun", [f"d{i} <a> & \"q\"", "x" * (i % 50)]), ("Verb", [])][: 1 + i % 2])
        for i in range(n)
    ]
    return spark.createDataFrame(rows, TYPE)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("fmt", ["xdxf", "lingvo"])
def test_round_trip_across_splits(spark, tmp_path, small_splits, fmt):
    params = ConvertParams("en", "fr", name="D", fmt=fmt)
    first, again = str(tmp_path / "a"), str(tmp_path / "b")
    write_single_file(entries(spark, 400), params, first)
    read = read_dictionary(spark, first, fmt)
    assert spark.read.text(first).rdd.getNumPartitions() > 5
    write_single_file(read, params, again)
    assert open(first, encoding="utf-8").read() == open(again, encoding="utf-8").read()
    got = sorted((r.word, [(d.pos, list(d.defs)) for d in r.definitions]) for r in read.collect())
    want = sorted((r.word, [(d.pos, list(d.defs)) for d in r.definitions]) for r in entries(spark, 400).collect())
    assert got == want
    ids = [r.page_id for r in read.orderBy("page_id").collect()]
    assert ids == list(range(400))


def test_merge_of_files_equals_merge_of_tables(spark, tmp_path, small_splits):
    params = ConvertParams("en", "fr", name="D")
    runs = [entries(spark, 300), entries(spark, 120, shift=40)]
    paths = []
    for i, run in enumerate(runs):
        paths.append(str(tmp_path / f"run{i}"))
        write_single_file(run, params, paths[-1])
    from_files = merge_dictionaries([read_dictionary(spark, p, "xdxf") for p in paths])
    write_single_file(from_files, params, str(tmp_path / "files"))
    write_single_file(merge_dictionaries(runs), params, str(tmp_path / "tables"))
    assert open(tmp_path / "files", encoding="utf-8").read() == open(tmp_path / "tables", encoding="utf-8").read()


def test_nothing(spark, tmp_path):
    write_single_file(spark.createDataFrame([], TYPE), ConvertParams("en", "fr", fmt="lingvo"), str(tmp_path / "e"))
    assert read_dictionary(spark, str(tmp_path / "e"), "lingvo").count() == 0
    with pytest.raises(ValueError):
        read_dictionary(spark, str(tmp_path / "e"), "pdf")


def test_records_are_numbered_without_a_sort_of_all_of_them(spark, tmp_path, small_splits):
    params = ConvertParams("en", "fr", name="D")
    for name in ("b", "a"):
        write_single_file(entries(spark, 150), params, str(tmp_path / name))
    read = read_dictionary(spark, str(tmp_path / "[ab]"), "xdxf")
    assert "rangepartitioning" not in read._jdf.queryExecution().optimizedPlan().toString() + read._jdf.queryExecution().executedPlan().toString()
    rows = read.orderBy("page_id").collect()
    assert [r.page_id for r in rows] == list(range(300))
    assert [r.word for r in rows[:150]] == [r.word for r in rows[150:]] == sorted(r.word for r in rows[:150])
