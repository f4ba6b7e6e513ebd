"""Rule tables of a dictionary language, from files or built in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rule_texts import MORPHOLOGY

BOM = "\ufeff"


def _read_rule_files(spark: SparkSession, path: str, file_name: str) -> DataFrame:
    """``(lang, text)``: one row per language folder below ``path``."""
    files = spark.read.text(
        path, wholetext=True, pathGlobFilter=file_name, recursiveFileLookup=True
    )
    lang = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return files.select(lang.alias("lang"), F.col("value").alias("text"))


def _lines(texts: DataFrame) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("text", "^" + BOM, ""), r"\r", "")
    lines = texts.select("lang", F.posexplode(F.split(plain, "\n")).alias("line_no", "line"))
    return lines.select("lang", (F.col("line_no") + 1).alias("line_no"), "line")


def scan_collation(spark: SparkSession, path: str) -> DataFrame:
    """``(lang, ch, target)`` of all ``collates.txt`` files below ``path``."""
    return parse_collation(_read_rule_files(spark, path, "collates.txt"))


def parse_collation(texts: DataFrame) -> DataFrame:
    """Lines ``chars=TARGET``, split at the last equals sign; an empty target ignores."""
    target = F.substring_index("line", "=", -1)
    chars = F.left(F.col("line"), F.length("line") - F.length(target) - 1)
    return (
        _lines(texts)
        .where(F.contains(F.col("line"), F.lit("=")))
        .select("lang", F.explode(F.split(chars, "")).alias("ch"), target.alias("target"))
        .where(F.col("ch") != "")
    )


def scan_morphology(spark: SparkSession, path: str) -> DataFrame:
    """Rules of all ``morphems.txt`` files below ``path``; see :func:`parse_morphology`."""
    return parse_morphology(_read_rule_files(spark, path, "morphems.txt"))


def builtin_morphology(spark: SparkSession) -> DataFrame:
    rows = [(lang, text.strip("\n")) for lang, text in MORPHOLOGY.items()]
    return parse_morphology(spark.createDataFrame(rows, "lang string, text string"))


def _head_classes(head: Column, classes: Column) -> Column:
    """Allowed characters per position: null for any, a class, or one letter."""
    return F.transform(
        F.filter(F.split(head, ""), lambda c: c != ""),
        lambda c: F.when(c.isin("?", "."), F.lit(None))
        .when(c.rlike("^[0-9]$"), F.element_at(classes, c))
        .otherwise(c),
    )


def parse_morphology(texts: DataFrame) -> DataFrame:
    """One row per pair of ending and variant, in file order.

    ``pattern`` is the ending as written and ``replacement`` its variant. An
    ending is a ``head`` of per-position character sets and a literal ``tail``.
    ``rejected`` names what makes a row unusable and is null for good rows.
    """
    lines = _lines(texts)
    classes = (
        lines.where(F.col("line").rlike("^%[0-9]="))
        .groupBy("lang", F.substring("line", 2, 1).alias("digit"))
        .agg(F.max_by(F.substr("line", F.lit(4)), "line_no").alias("chars"))
        .groupBy("lang")
        .agg(F.map_from_entries(F.collect_list(F.struct("digit", "chars"))).alias("classes"))
    )
    rules = lines.where(F.col("line").rlike(r"^\^.*="))
    left = F.regexp_extract("line", r"^\^(.*)=[^=]*$", 1)
    pairs = (
        rules.select(
            "lang",
            F.col("line_no").alias("rule_no"),
            F.substring_index("line", "=", -1).alias("variants"),
            F.posexplode(F.split(left, "/")).alias("left_no", "pattern"),
        )
        .select(
            "lang", "rule_no", "left_no", "pattern",
            F.posexplode(F.split("variants", "/")).alias("right_no", "replacement"),
        )
        .join(classes, "lang", "left")
    )
    head = F.regexp_extract("pattern", r"^(.*[?.0-9])?([^?.0-9]*)$", 1)
    tail = F.regexp_extract("pattern", r"^(.*[?.0-9])?([^?.0-9]*)$", 2)
    known = F.coalesce(F.map_keys("classes"), F.array().cast("array<string>"))
    unknown = F.exists(
        F.filter(F.split("pattern", ""), lambda c: c.rlike("^[0-9]$")),
        lambda c: ~F.array_contains(known, c),
    )
    rejected = (
        F.when(F.col("pattern") == "", F.lit("empty ending"))
        .when(F.col("pattern").rlike(r"^[.?]+$"), F.lit("ending without letters"))
        .when(F.regexp_count("replacement", F.lit(r"\.")) > 1, F.lit("several dots in variant"))
        .when(unknown, F.lit("undefined class"))
    )
    return pairs.select(
        "lang", "rule_no",
        (F.col("left_no") + 1).alias("left_no"),
        (F.col("right_no") + 1).alias("right_no"),
        "pattern", "replacement",
        F.length("pattern").alias("size"),
        _head_classes(head, F.col("classes")).alias("head"),
        tail.alias("tail"),
        rejected.alias("rejected"),
    )
