"""Scalar functions against direct restatements in Python."""

import html
import random
import re
from itertools import product

from pyspark.sql import functions as F

from glossweave.constants import SPACES, UNTIDY
from glossweave.functions import text as X
from glossweave.functions.sql_names import register_functions

PIECES = list("&#x;0123456789abcAmptlgquo <>()., \n\t!?:\x1c\x85\xa0   ​") + [
    "&amp;", "&lt", "&notit;", "&#x41;", "&#65", "&#128;", "&#0;", "&#13;", "&#xD800;", "&#1114112;",
    "&copy", "&NotEqualTilde;", "&ampamp;", "&#x1F600;", "&fjlig;", "&#11;", "&#xfdd0;", "&nbsp;",
    "&#99999999999999;", "&#x0000041;", "<b>", "</b>", "( ", " )", " ,",
]


def samples(count=4000, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(count)]


def expected_clean(text):
    text = text.strip()
    text = re.sub(r"<[^>]+>", "", text)
    text = re.sub(r"\(\s+", "(", text)
    text = re.sub(r"\s+\)", ")", text)
    text = re.sub(r"\s+([,.;:!?])", r"\1", text)
    return html.unescape(re.sub(r"\s+", " ", text))


def test_spaces_are_those_of_str_isspace():
    assert set(SPACES) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_text_functions_on_random_strings(spark):
    t = F.col("t")
    frame = spark.createDataFrame([(s,) for s in samples()], "t string").select(
        t,
        X.clean_text(t).alias("clean"),
        X.html_unescape(t).alias("decoded"),
        X.html_escape(t).alias("escaped"),
        X.html_unescape(X.html_escape(t)).alias("back"),
        X.strip(t).alias("stripped"),
    )
    for row in frame.collect():
        assert row.clean == expected_clean(row.t), repr(row.t)
        assert row.decoded == html.unescape(row.t), repr(row.t)
        assert row.escaped == html.escape(row.t)
        assert row.back == row.t
        assert row.stripped == row.t.strip()


def test_sql_names_escape_like_the_column_function(spark):
    """Of a column and of an expression; every name is created, so no body holds a lambda."""
    assert "gw_html_escape" in register_functions(spark)
    frame = spark.createDataFrame([(s,) for s in [None, "", "plain", "&amp;<\"'>", *samples(500)]], "t string")
    call = "SELECT t, gw_html_escape(t) AS e, gw_html_escape(concat('<', t, upper(t))) AS of_more FROM {frame}"
    for row in spark.sql(call, frame=frame).collect():
        assert row.e == (None if row.t is None else html.escape(row.t)), repr(row.t)
        assert row.of_more == (None if row.t is None else html.escape(f"<{row.t}{row.t.upper()}")), repr(row.t)


def test_clean_text_of_nothing_is_empty(spark):
    frame = spark.createDataFrame([(None,), ("",), ("  ",)], "t string")
    assert [r[0] for r in frame.select(X.clean_text(F.col("t"))).collect()] == ["", "", ""]


def test_names(spark):
    frame = spark.createDataFrame([("en",), ("xx",), ("",), ("pt-BR",)], "c string")
    names = [r[0] for r in frame.select(X.language_name(F.col("c"))).collect()]
    assert names == ["English", "Xx", "Unknown", "Pt-br"]
    one = spark.range(1).select(
        X.headword(F.lit("ice_cream_a")), X.dsl_quote(F.lit('a"b')), X.capitalize(F.lit("eN")),
        X.dictionary_name(F.lit("D"), F.lit("en"), F.lit("ru"), F.lit("oc")),
        X.dictionary_name(F.lit("D"), F.lit("en"), F.lit("ru")),
        X.language_name(F.lit("en"), {"en": "Anglès"}),
    ).first()
    assert tuple(one) == (
        "ice cream a", 'a\\"b', "En", "D (Occitan-Russian)", "D (English-Russian)", "Anglès"
    )


def test_large_inputs_stay_fast(spark):
    """Inputs that make the plain patterns quadratic."""
    texts = ["<" * 200_000, "a" + " " * 200_000 + "b", ("(" + " " * 500) * 400]
    frame = spark.createDataFrame([(s,) for s in texts], "t string")
    lengths = [len(r[0]) for r in frame.select(X.clean_text(F.col("t"))).collect()]
    assert lengths == [200_000, 3, 400]


def test_untidy_finds_every_place_that_tidying_changes(spark):
    parts = ["", "a", " ", "(", ")", ",", "\t", "\x1c", "　", "\x85", "é"]
    rows = [("".join(p),) for p in product(parts, repeat=4)]
    changed = spark.createDataFrame(rows, "t string").select(
        "t", F.col("t").rlike(UNTIDY).alias("untidy"), (X._tidy_spaces(F.col("t")) != F.col("t")).alias("changed")
    )
    assert changed.where("untidy != changed").collect() == []
