"""Base forms of inflected words by ending rules, and their dictionary entries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.collation import language_key

# Slices of the words of a language in the join with its rules.
SALTS = 16
RULE_COLUMNS = ("lang", "rule_no", "left_no", "right_no", "replacement", "size", "head", "tail")


def accepted_rules(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("rejected").isNull()).drop("rejected")


def rejected_rules(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("rejected").isNotNull())


def _base_form(word: Column, size: Column, replacement: Column) -> Column:
    """The word with its ending replaced; a dot stands for the character of the
    ending at the same position."""
    kept = F.length(word) - size
    at = F.locate(".", replacement)
    source = F.substr(word, kept + at, F.lit(1))
    variant = F.when(at > 0, F.replace(replacement, F.lit("."), source)).otherwise(replacement)
    return F.concat(F.left(word, kept), variant)


def lemma_candidates(words: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidates per distinct ``(lang, word)``: the word itself, then variants.

    Priority is the order of ``rule_no``, ``left_no`` and ``right_no``; the word
    itself has zeros. Words meet rules by an equi join on the literal tail of the
    ending, not by testing every rule. Tails such as the empty one are shared by
    all words of a language, so rules are repeated for ``SALTS`` slices of words.
    """
    usable = accepted_rules(rules).select(*RULE_COLUMNS)
    longest = F.coalesce(usable.agg(F.max(F.length("tail"))).scalar(), F.lit(0))
    table = usable.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    distinct = words.select("lang", "word").distinct()
    sizes = F.sequence(F.lit(0), F.least(F.length("word"), longest))
    probes = distinct.select(
        "lang", "word", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int").alias("_salt"), F.explode(sizes).alias("_k")
    ).withColumn("tail", F.right(F.col("word"), F.col("_k")))
    start = F.length("word") - F.col("size")
    fits = F.forall(
        F.transform(
            F.col("head"),
            lambda allowed, i: allowed.isNull()
            | F.contains(allowed, F.substr(F.col("word"), start + i + 1, F.lit(1))),
        ),
        lambda ok: ok,
    )
    variants = (
        probes.join(table, ["lang", "tail", "_salt"])
        .where((F.length("word") >= F.col("size")) & fits)
        .select(
            "lang", "word", "rule_no", "left_no", "right_no",
            _base_form(F.col("word"), F.col("size"), F.col("replacement")).alias("candidate"),
        )
    )
    zero = F.lit(0)
    itself = distinct.select(
        "lang", "word", zero.alias("rule_no"), zero.alias("left_no"), zero.alias("right_no"),
        F.col("word").alias("candidate"),
    )
    return itself.unionByName(variants)


def lemma_lookup(
    candidates: DataFrame, headwords: DataFrame, collations: Mapping[str, Iterable[tuple[str, str]]]
) -> DataFrame:
    """Best headword per word: the first candidate that names one.

    Candidate and headword match when their keys by the language's collation are
    equal. Of the headwords with one key the smallest stands for all, so the right
    side has one row per key and the join never multiplies rows. Words of ignored
    characters alone have no key and match nothing.
    """
    collations = {lang: tuple(pairs) for lang, pairs in collations.items()}

    def keyed(df: DataFrame, word: str) -> DataFrame:
        key = language_key(F.col("lang"), F.col(word), collations)
        return df.withColumn("key", key).where(F.col("key") != "")

    listed = keyed(headwords.select("lang", "word"), "word").groupBy("lang", "key").agg(F.min("word").alias("headword"))
    hits = keyed(candidates, "candidate").join(listed, ["lang", "key"])
    rank = F.struct("rule_no", "left_no", "right_no")
    return hits.groupBy("lang", "word").agg(
        F.min_by("headword", rank).alias("headword"), F.min(rank).alias("rank")
    ).select("lang", "word", "headword", "rank.rule_no", "rank.left_no", "rank.right_no")
