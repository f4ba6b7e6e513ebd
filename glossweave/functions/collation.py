"""Collation keys: accents and case folded, punctuation ignored."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rule_texts import CYRILLIC, IGNORED, LATIN

Pairs = tuple[tuple[str, str], ...]


def _pairs(text: str) -> list[tuple[str, str]]:
    return [
        (char, target)
        for chars, _, target in (line.rpartition("=") for line in text.split())
        for char in chars
    ]


@cache
def latin_collation() -> Pairs:
    return tuple([(c, "") for c in IGNORED] + _pairs(LATIN))


@cache
def cyrillic_collation() -> Pairs:
    return tuple([(c, "") for c in IGNORED] + _pairs(CYRILLIC))


def builtin_collation(language: str) -> Pairs:
    return cyrillic_collation() if language in ("ru", "rus") else latin_collation()


def collation_pairs(rules: DataFrame) -> Pairs:
    """Rules of one language from a ``(ch, target)`` table: a row per character, so
    their number is bounded by that of code points."""
    return tuple((r.ch, r.target) for r in rules.select("ch", "target").distinct().toLocalIterator())


def translate_arguments(pairs: Iterable[tuple[str, str]]) -> tuple[str, str]:
    """``from`` and ``to`` strings; characters without a target come last in ``from``."""
    mapping = dict(pairs)
    long = [c for c, t in mapping.items() if len(t) > 1]
    if long:
        raise ValueError(f"targets must be one character: {long}")
    kept = [(c, t) for c, t in mapping.items() if t]
    dropped = [c for c, t in mapping.items() if not t]
    return "".join(c for c, _ in kept) + "".join(dropped), "".join(t for _, t in kept)


def collation_key(word: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    source, target = translate_arguments(pairs)
    return F.translate(word, source, target)


def language_key(lang: Column, word: Column, collations: Mapping[str, Iterable[tuple[str, str]]]) -> Column:
    """Key by the collation of the row's language; the word itself for a language without one."""
    key = word
    for name, pairs in collations.items():
        key = F.when(lang == name, collation_key(word, pairs)).otherwise(key)
    return key


def sort_by_collation(df: DataFrame, pairs: Iterable[tuple[str, str]], word: str = "word") -> DataFrame:
    return df.orderBy(collation_key(F.col(word), pairs), F.col(word))
