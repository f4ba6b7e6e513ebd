"""Plans that must read and parse their input once, and only what they keep."""

from html import escape

import pytest
from pyspark.sql import functions as F

from glossweave import ConvertParams
from glossweave.functions.text import html_escape
from glossweave.plans import fixtures as B
from glossweave.plans.convert import select_pages
from glossweave.plans.queries import QUERIES
from glossweave.sources.packed import pack_pages, scan_packed
from glossweave.sources.pages import scan_page_dir, spread


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["section_end", "section_cascade", "definitions_long"])
def test_pages_are_read_and_parsed_once(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert plan.count("ArrowEvalPython") == 1 and plan.count("FileScan") == 1
    assert "Join" not in plan


def test_names_are_tested_before_bodies_are_read(spark, tmp_path):
    for name in ("word", "слово", "x.html"):
        (tmp_path / name).write_text("<ol>")
    pages = select_pages(scan_page_dir(spark, str(tmp_path)), ConvertParams("en", "en", scripts=("cyrillic",)))
    lines = plan_of(pages).split("\n")
    reader = next(i for i, line in enumerate(lines) if "ArrowEvalPython" in line)
    assert any("Filter" in line and "RLIKE" in line for line in lines[reader + 1:])
    assert [r.word for r in pages.collect()] == ["слово"]


def test_packed_tables_skip_what_names_exclude(spark, tmp_path):
    from pyspark.sql import functions as F

    word = F.when(F.col("id") % 2 == 0, F.concat(F.lit("слово"), F.lpad(F.col("id").cast("string"), 6, "0"))).otherwise(
        F.concat(F.lit("word"), F.col("id").cast("string"))
    )
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), word.alias("word"), F.sha2(F.col("id").cast("string"), 512).alias("html"))
    path = str(tmp_path / "packed")
    pack_pages(pages, path, row_group_bytes=64 << 10)
    found = scan_packed(spark, path, ["cyrillic"], 100)
    assert sorted(r.page_id for r in found.collect()) == list(range(0, 200, 2))
    plan = plan_of(found)
    assert "PartitionFilters: [(arrays_overlap" in plan and "scripts" in plan
    assert scan_packed(spark, path, ["all"]).count() == 20_000
    assert scan_packed(spark, path, ["greek"], 5).count() == 0
    # By statistics alone: the bound on the stored column leaves few row groups.
    bound = spark.read.parquet(path).where("lowered <= 'слово000200' and lowered > 'слово'")
    metrics = bound._jdf.queryExecution()
    assert "PushedFilters" in metrics.executedPlan().toString() and "LessThanOrEqual(lowered" in metrics.executedPlan().toString()


def test_spread_is_off_by_default_and_bounded(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    assert spread(table) is table
    assert "RoundRobin" in plan_of(spread(table, 4))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert spread(table, 4) is table
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_text_is_escaped_once_for_all_pages_of_a_document(spark, sf):
    rows = B.documents_as_words(spark.read.parquet(f"{sf}/documents.parquet"))
    pages = B.several_pages(rows, [B.section_body(m) for m in range(1, 9)])
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("&quot;") == 1
    page = B.rich_page(rows)._jdf.queryExecution().optimizedPlan().toString()
    # The text once and the source in three short lists.
    assert page.count("&quot;") <= 4


def test_escaping_replaces_all_signs_and_keeps_the_rest(spark):
    texts = ["", "plain", "a & b", "<&lt;>", "\"'&'\"", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", html_escape(F.col("t")).alias("e"))
    assert {r.t: r.e for r in rows.collect()} == {t: None if t is None else escape(t) for t in texts}


def test_letter_runs_by_number(spark):
    texts = ["", "a", " a", "ab cd ef", "1ab2cd3", "...", "é1\n\U0001d400x y", "a" * 200_000, None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select("text", *[B.letter_run(F.col("text"), i).alias(f"r{i}") for i in range(2)]).collect()
    for row in got:
        runs = [] if row.text is None else "".join(c if c.isalpha() else " " for c in row.text).split()
        want = [None, None] if row.text is None else [*runs, "", ""][:2]
        assert [row.r0, row.r1] == want
