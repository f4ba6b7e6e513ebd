import glob

import pytest
from pyspark.sql import functions as F

from glossweave import ConvertParams
from glossweave.functions.render import render_entry
from glossweave.plans.convert import convert
from glossweave.sources.pages import scan_page_dir
from glossweave.sources.sinks import merge_dictionaries, write_dictionary

TYPE = "page_id long, word string, definitions array<struct<pos:string,defs:array<string>>>"
ENTRIES = [
    (3, "zebra", [("Noun", ["animal"])]),
    (1, "Ice_cream", [("Noun", ["a <cold> thing", "b & \"c\""]), ("Verb [v]", ["d's"])]),
    (2, "apple", [("Noun", ["fruit"])]),
]

DSL = """#NAME "My \\"D\\" (English-Russian)"
#INDEX_LANGUAGE "English"
#CONTENTS_LANGUAGE "Russian"
#CHARSET UTF-8

apple
  [c]Noun[/c]
  fruit
Ice cream
  [c]Noun[/c]
  a <cold> thing
  b & "c"
  [c]Verb [v][/c]
  d's
zebra
  [c]Noun[/c]
  animal
"""
XDXF = """<?xml version="1.0" encoding="UTF-8" ?>
<!DOCTYPE xdxf SYSTEM "https://raw.github.com/soshial/xdxf_makedict/master/format_standard/xdxf_strict.dtd">
<xdxf lang_from="english" lang_to="russian" format="visual">
<full_name>My &quot;D&quot; (Spanish-Russian)</full_name>
<description>Converted from Wiktionary</description>
<abbreviations>
</abbreviations>
<xdxf_body>
<ar><k>apple</k>
<pos>Noun</pos>
<def>fruit</def>
</ar>
<ar><k>Ice cream</k>
<pos>Noun</pos>
<def>a &lt;cold&gt; thing</def>
<def>b &amp; &quot;c&quot;</def>
<pos>Verb [v]</pos>
<def>d&#x27;s</def>
</ar>
<ar><k>zebra</k>
<pos>Noun</pos>
<def>animal</def>
</ar>
</xdxf_body>
</xdxf>
"""


def joined_parts(path):
    return "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{path}/part-*")))


@pytest.mark.parametrize(
    "params, golden",
    [
        (ConvertParams("en", "ru", name='My "D"', fmt="lingvo"), DSL),
        (ConvertParams("en", "ru", entry_lang="es", name='My "D"'), XDXF),
    ],
)
def test_golden_files(spark, tmp_path, params, golden):
    entries = spark.createDataFrame(ENTRIES, TYPE)
    write_dictionary(entries, params, str(tmp_path / "out"))
    assert joined_parts(tmp_path / "out") == golden
    write_dictionary(entries, params, str(tmp_path / "out"))
    assert joined_parts(tmp_path / "out") == golden


def test_formats(spark):
    with pytest.raises(ValueError):
        ConvertParams("en", "en", fmt="pdf")
    with pytest.raises(ValueError):
        render_entry(F.lit("w"), F.lit(None), "pdf")
    entries = spark.createDataFrame(ENTRIES, TYPE)
    escaped = entries.where("page_id = 1").select(render_entry(F.col("word"), F.col("definitions"), "lingvo", True))
    assert "[c]Verb \\[v\\][/c]" in escaped.first()[0]


@pytest.fixture
def uncoalesced(spark):
    """Small shuffles keep their partitions, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_entries_stay_in_order(spark, tmp_path, uncoalesced):
    rows = spark.range(20000).select(
        F.col("id").alias("page_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), F.hash("id").cast("string"))).alias("word"),
        F.array(
            F.struct(F.lit("Noun").alias("pos"), F.array(F.col("id").cast("string")).alias("defs"))
        ).alias("definitions"),
    )
    write_dictionary(rows, ConvertParams("en", "en", fmt="lingvo"), str(tmp_path / "out"))
    lines = joined_parts(tmp_path / "out").split("\n")
    heads = lines[5::3][:20000]
    expected = sorted(((r.word.lower(), r.word, r.page_id) for r in rows.collect()))
    assert heads == [w for _, w, _ in expected]
    assert [d.strip() for d in lines[7::3]][:20000] == [str(i) for _, _, i in expected]
    # A third of the rows is one word, yet no part holds more than a share of it.
    hot = [open(p).read().count("hot\n") for p in glob.glob(f"{tmp_path}/out/part-*")]
    assert sum(hot) == 6667 and max(hot) < 6667


def test_merge_keeps_the_later_run(spark):
    first = spark.createDataFrame([*ENTRIES, (10, "zebra", [("Noun", ["again"])])], TYPE)
    second = spark.createDataFrame([(9, "apple", [("Verb", ["new"])]), (8, "pear", [("Noun", ["p"])]), (10, "apple", [])], TYPE)
    third = spark.createDataFrame([(1, "pear", [("Noun", ["q"])])], TYPE)

    def merged(*runs):
        frame = merge_dictionaries(list(runs))
        assert dict(frame.dtypes)["page_id"] == "bigint"
        return sorted((r.word, r.page_id) for r in frame.collect())

    kept = [("Ice_cream", 1), ("apple", 9), ("apple", 10), ("pear", 8), ("zebra", 3), ("zebra", 10)]
    assert merged(first, second) == kept
    assert merged(first, second, third) == sorted([*(k for k in kept if k[0] != "pear"), ("pear", 1)])
    assert merged(second) == [("apple", 9), ("apple", 10), ("pear", 8)]


def test_convert_directory(spark, tmp_path):
    source = tmp_path / "pages"
    source.mkdir()
    page = (
        '<details data-level="2"><h2><span id="en">x</span></h2><details data-level="3"><h3>Noun</h3>'
        "<ol><li>{}</li></ol></details></details>"
    )
    for name in ("beta", "Alpha_b", "слово", "x.html", ".hid", "e.g.", "a b", "100%"):
        (source / name).write_text(page.format(name.replace("<", "")), encoding="utf-8")
    (source / "broken").write_bytes(b"\xff\xfe<ol>")
    (source / "empty").write_bytes(b"")
    (source / "_under").write_text(page.format("u"))
    (source / "sub").mkdir()
    (source / "sub" / "deep").write_text(page.format("deep"))
    params = ConvertParams("en", "en", fmt="lingvo", scripts=("latin",), batch_size=3)
    stats = convert(scan_page_dir(spark, str(source)), params, str(tmp_path / "out"))
    assert joined_parts(tmp_path / "out").split("\n")[5:] == [
        " under", "  [c]Noun[/c]", "  u", "a b", "  [c]Noun[/c]", "  a b", "Alpha b", "  [c]Noun[/c]", "  Alpha_b",
        "beta", "  [c]Noun[/c]", "  beta", "e.g.", "  [c]Noun[/c]", "  e.g.", "",
    ]
    # "broken" and "empty" have no text to show.
    assert {(r.batch, r.processed, r.skipped) for r in stats.collect()} == {(0, 3, 0), (1, 2, 1), (2, 0, 1)}
    limited = ConvertParams("en", "en", fmt="lingvo", limit=2)
    convert(scan_page_dir(spark, str(source)), limited, str(tmp_path / "two"))
    # "100%" is first in the order of names, then "_under".
    assert joined_parts(tmp_path / "two").split("\n")[5::3][:2] == ["100%", " under"]
