"""Writing systems: membership, histogram, dominant script, and name filters."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import SCRIPTS
from .text import let

SCRIPT_NAMES = tuple(name for name, _ in SCRIPTS)

# Text from the last dot, when that dot is neither the first nor the last character.
SUFFIX_PATTERN = r"^(.+)\.[^.]+$"


def _ranges(ranges: Iterable[tuple[int, int]]) -> str:
    return "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in ranges)


def script_class(scripts: Iterable[str]) -> str | None:
    """Character class of all listed scripts; unknown names add nothing."""
    wanted = set(scripts)
    body = "".join(_ranges(ranges) for name, ranges in SCRIPTS if name in wanted)
    return f"[{body}]" if body else None


def is_in_script(char: Column, script: str) -> Column:
    """Whether the first character of ``char`` belongs to ``script``."""
    pattern = script_class([script])
    return F.lit(False) if pattern is None else char.rlike("^" + pattern)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, SUFFIX_PATTERN, "$1")


def alphanumeric(text: Column) -> Column:
    """Letters and digits alone. Three ideographs are newer than the JVM's tables."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}\x{9FFD}-\x{9FFF}]", "")


def _by_script(
    word: Column, single: Callable[[int], Column], mixed: Callable[[Column], Column]
) -> Column:
    """``single(k)`` if script number k has every character, else ``mixed`` of all counts.

    Most words are of one script, and one anchored match finds that out; only
    the others are counted script by script. A character counts for the first
    script that lists it, so later scripts are tested without shared ranges.
    """
    taken: set[tuple[int, int]] = set()
    classes = []
    for _, ranges in SCRIPTS:
        classes.append(f"[{_ranges(r for r in ranges if r not in taken)}]+")
        taken.update(ranges)
    counts = F.array(*[F.length(word) - F.length(F.regexp_replace(word, c, "")) for c in classes])
    pure = [F.when(word.rlike(f"^{c}$"), single(k)) for k, c in enumerate(classes)]
    return F.coalesce(*pure, mixed(counts))


def script_counts(name: Column) -> Column:
    """Alphanumeric characters of the stem per script, an array in script order."""

    def count(word: Column) -> Column:
        def single(k: int) -> Column:
            return F.array(*[F.length(word) if i == k else F.lit(0) for i in range(len(SCRIPTS))])

        return _by_script(word, single, lambda counts: counts)

    return let(alphanumeric(stem(name)), count)


def dominant_script(name: Column) -> Column:
    """Most frequent script; ties go to the earlier one; ``unknown`` if none."""
    names = F.array(*[F.lit(s) for s in SCRIPT_NAMES])

    def largest(counts: Column) -> Column:
        ranked = F.transform(counts, lambda n, i: F.struct(n.alias("n"), (-i).alias("rank")))
        return let(
            F.array_max(ranked),
            lambda best: F.when(best["n"] > 0, F.get(names, -best["rank"])).otherwise("unknown"),
        )

    return let(
        alphanumeric(stem(name)),
        lambda word: _by_script(word, lambda k: F.lit(SCRIPT_NAMES[k]), largest),
    )


def in_scripts(name: Column, scripts: Iterable[str]) -> Column:
    """Kept if the first character or the dominant script is in a listed script."""
    scripts = list(scripts)
    if "all" in scripts:
        return F.lit(True)
    by_count = dominant_script(name).isin(scripts)
    pattern = script_class(scripts)
    return by_count if pattern is None else name.rlike("^" + pattern) | by_count


def is_page_name(name: Column) -> Column:
    """A page file has no suffix and is not hidden."""
    return ~name.rlike(SUFFIX_PATTERN) & ~name.startswith(".")
