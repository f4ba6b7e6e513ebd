"""One dictionary file written in parallel: byte for byte the ordered parts, committed once."""

import os

import pytest
from pyspark.sql import functions as F

from glossweave import ConvertParams
from glossweave.sources.sinks import write_dictionary, write_single_file
from test_output import DSL, ENTRIES, TYPE, XDXF, joined_parts


@pytest.mark.parametrize(
    "params, golden",
    [
        (ConvertParams("en", "ru", name='My "D"', fmt="lingvo"), DSL),
        (ConvertParams("en", "ru", entry_lang="es", name='My "D"'), XDXF),
    ],
)
def test_golden_file(spark, tmp_path, params, golden):
    entries = spark.createDataFrame(ENTRIES, TYPE)
    path = str(tmp_path / "dict.txt")
    with open(path, "w") as old:
        old.write("an older dictionary")
    write_single_file(entries, params, path)
    assert open(path, encoding="utf-8").read() == golden
    # Nothing is left beside it.
    assert sorted(os.listdir(tmp_path)) == ["dict.txt"]


def test_many_parts_in_order(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(5000).select(
            F.col("id").alias("page_id"), F.concat(F.lit("w"), F.hash("id").cast("string")).alias("word"),
            F.array(F.struct(F.lit("Noun").alias("pos"), F.array(F.lit("é" * 50)).alias("defs"))).alias("definitions"),
        )
        params = ConvertParams("en", "en", fmt="lingvo")
        write_dictionary(rows, params, str(tmp_path / "parts"))
        write_single_file(rows, params, str(tmp_path / "one.dsl"))
        assert open(tmp_path / "one.dsl", encoding="utf-8").read() == joined_parts(tmp_path / "parts")
        assert len(os.listdir(tmp_path / "parts")) > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_entries(spark, tmp_path):
    entries = spark.createDataFrame([], TYPE)
    write_single_file(entries, ConvertParams("en", "ru", entry_lang="es", name='My "D"'), str(tmp_path / "d.xdxf"))
    text = open(tmp_path / "d.xdxf", encoding="utf-8").read()
    assert text.startswith("<?xml") and text.endswith("</xdxf_body>\n</xdxf>\n") and text.count("<xdxf_body>") == 1
