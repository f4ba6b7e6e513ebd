"""Part-of-speech sections of a language section, and their definitions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..constants import EXCLUDED_SECTIONS
from ..functions.text import clean_text, contains_ci, let
from .axes import descendants, item_texts, list_items, node_at, span, text_content
from .nodes import has_level, has_tag, once

DEFINITIONS_TYPE = "array<struct<pos:string,defs:array<string>>>"
_LEVELS = ("3", "2", "4")


def _range(n: Column) -> Column:
    return F.struct(n["pre"].alias("pre"), n["fin"].alias("fin"))


def level_sections(below: Column, container: str = "details") -> Column:
    """Containers of level 3, then 2, then 4, each in document order."""

    def of_level(level: str) -> Column:
        found = F.filter(below, lambda n: has_tag(n, container) & has_level(n, level))
        return F.transform(found, _range)

    return F.concat(*[of_level(level) for level in _LEVELS])


def virtual_sections(nodes: Column, below: Column) -> Column:
    """Spans of ``h3`` and ``h4`` headings on pages without containers.

    A span runs over the following siblings up to the next heading of the same
    or a higher level, or to the end of the parent. Headings are sorted by
    parent, so that the next sibling heading is the next array element: the
    cost is that of one sort per page, not one search per heading.
    """

    def spans(stops: Column, tag: str) -> Column:
        ordered = F.array_sort(
            F.transform(
                stops,
                lambda n: F.struct(
                    n["parent"].alias("parent"), n["pre"].alias("pre"), n["tag"].alias("tag")
                ),
            )
        )

        def ends(sorted_stops: Column) -> Column:
            def end(h: Column, i: Column) -> Column:
                following = F.get(sorted_stops, i + 1)
                fin = F.when(following["parent"] == h["parent"], following["pre"] - 1)
                return F.struct(
                    h["pre"].alias("pre"),
                    F.coalesce(fin, node_at(nodes, h["parent"])["fin"]).alias("fin"),
                    h["tag"].alias("tag"),
                )

            return F.filter(F.transform(sorted_stops, end), lambda s: s["tag"] == tag)

        return F.transform(let(ordered, ends), _range)

    def both(headings: Column) -> Column:
        upper = F.filter(headings, lambda n: has_tag(n, "h2", "h3"))
        return F.array_sort(F.concat(spans(upper, "h3"), spans(headings, "h4")))

    return let(F.filter(below, lambda n: has_tag(n, "h2", "h3", "h4")), both)


def pos_sections(nodes: Column, section: Column, container: str = "details") -> Column:
    """Part-of-speech spans of a section, in order.

    Virtual spans are used only where no container with a level exists.
    """

    def choose(below: Column) -> Column:
        return let(
            level_sections(below, container),
            lambda found: F.when(F.size(found) > 0, found).otherwise(virtual_sections(nodes, below)),
        )

    return F.when(section.isNotNull(), let(descendants(nodes, section), choose))


def heading_of(nodes: Column, part: Column) -> Column:
    """First heading element of a span."""
    return F.get(
        F.filter(
            span(nodes, part["pre"], part["fin"]), lambda n: has_tag(n, "h2", "h3", "h4")
        ),
        F.lit(0),
    )


def has_list(nodes: Column, part: Column) -> Column:
    return F.exists(span(nodes, part["pre"], part["fin"]), lambda n: has_tag(n, "ol"))


def is_excluded(pos: Column, excluded: Iterable[str]) -> Column:
    """Any excluded name occurs in the heading, in any case."""
    test = F.lit(False)
    for name in excluded:
        test = test | contains_ci(pos, F.lit(name))
    return test


def headed_sections(nodes: Column, parts: Column) -> Column:
    """Spans with their order number and cleaned heading; headless ones go."""
    headed = F.transform(
        parts,
        lambda p, i: let(
            heading_of(nodes, p),
            lambda h: F.when(
                h.isNotNull(),
                F.struct(
                    i.alias("ord"),
                    p["pre"].alias("pre"),
                    p["fin"].alias("fin"),
                    clean_text(text_content(nodes, h)).alias("pos"),
                ),
            ),
        ),
    )
    return F.filter(headed, lambda p: p.isNotNull())


def keep_sections(nodes: Column, headed: Column, excluded: Iterable[str]) -> Column:
    """Drop excluded sections and sections without an ordered list."""
    wanted = F.filter(headed, lambda p: ~is_excluded(p["pos"], excluded))
    return F.filter(wanted, lambda p: has_list(nodes, p))


def with_items(nodes: Column, kept: Column, dedupe_nested: bool = False) -> Column:
    """List items of each section as ``defs``; sections without items go."""
    filled = F.transform(
        kept,
        lambda p: F.struct(
            p["ord"].alias("ord"),
            p["pos"].alias("pos"),
            list_items(nodes, p["pre"], p["fin"], dedupe_nested).alias("defs"),
        ),
    )
    return F.filter(filled, lambda p: F.size(p["defs"]) > 0)


def with_texts(nodes: Column, folded: Column) -> Column:
    """Texts in place of the list items of each part of speech."""
    return F.transform(
        folded, lambda p: F.struct(p["pos"].alias("pos"), item_texts(nodes, p["defs"]).alias("defs"))
    )


def fold_last_wins(parts: Column) -> Column:
    """One element per part of speech: the last one's texts at the first one's place.

    ``parts`` has ``ord``, ``pos`` and ``defs``. Sorting by name brings repeats
    together, so first and last of each run are found by their neighbours.
    """

    def fold(by_name: Column) -> Column:
        def differs(i: Column, p: Column) -> Column:
            neighbour = F.get(by_name, i)
            return neighbour.isNull() | (neighbour["pos"] != p["pos"])

        first = F.filter(by_name, lambda p, i: differs(i - 1, p))
        last = F.filter(by_name, lambda p, i: differs(i + 1, p))
        merged = F.zip_with(
            first,
            last,
            lambda f, l: F.struct(
                f["ord"].alias("ord"), l["pos"].alias("pos"), l["defs"].alias("defs")
            ),
        )
        return F.transform(
            F.array_sort(merged),
            lambda p: F.struct(p["pos"].alias("pos"), p["defs"].alias("defs")),
        )

    by_name = F.array_sort(
        F.transform(
            parts,
            lambda p: F.struct(
                p["pos"].alias("pos"), p["ord"].alias("ord"), p["defs"].alias("defs")
            ),
        )
    )
    return let(by_name, fold)


def extract_definitions(
    nodes: Column,
    section: Column,
    excluded: Iterable[str] = EXCLUDED_SECTIONS,
    dedupe_nested: bool = False,
    container: str = "details",
) -> Column:
    """Ordered ``(pos, defs)`` list of a language section, empty if there is none."""
    excluded = tuple(excluded)
    found = let(
        pos_sections(nodes, section, container),
        # Texts are taken after the fold, which drops the items of repeated parts of speech.
        lambda parts: with_texts(
            nodes,
            fold_last_wins(
                with_items(
                    nodes,
                    keep_sections(nodes, headed_sections(nodes, parts), excluded),
                    dedupe_nested,
                )
            ),
        ),
    )
    return F.when(has_list(nodes, section), found).otherwise(
        F.array().cast(DEFINITIONS_TYPE)
    )


@lru_cache(maxsize=64)
def _definitions_column(_application: str, options: tuple) -> Column:
    """The whole expression; building it is much slower than using it again."""
    return extract_definitions(F.col("nodes"), F.col("section"), **dict(options))


def with_definitions(df: DataFrame, **options) -> DataFrame:
    """Add ``definitions`` to rows with ``nodes`` and ``section``.

    Options are those of :func:`extract_definitions`.
    """
    application = df.sparkSession.sparkContext.applicationId
    chosen = {k: tuple(v) if isinstance(v, (list, set, frozenset)) else v for k, v in options.items()}
    return once(df, "definitions", _definitions_column(application, tuple(sorted(chosen.items()))))


def filter_has_definitions(df: DataFrame, name: str = "definitions") -> DataFrame:
    return df.where(F.size(name) > 0)


def to_long(entries: DataFrame) -> DataFrame:
    """One row per definition, with the positions of the nested form."""
    parts = entries.select("*", F.posexplode_outer("definitions").alias("pos_ord", "_part"))
    rows = parts.select(
        "*", F.col("_part.pos").alias("pos"), F.posexplode_outer("_part.defs").alias("def_ord", "definition")
    )
    return rows.where(F.col("def_ord").isNotNull()).drop("definitions", "_part")


# --- the same folds on rows, for definitions kept in long tables ------------

def fold_rows(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: first ``ord`` and the ``defs`` of the last ``ord``.

    Partial aggregation keeps one candidate per key and task, so a key with
    very many rows is no burden.
    """
    return parts.groupBy(*keys).agg(
        F.min("ord").alias("ord"), F.max_by("defs", "ord").alias("defs")
    )


def last_per_key(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The whole last row per key, with the key's first ``ord`` as ``first_ord``.

    What a window over each key would pick, by partial aggregation instead: no
    task has to sort all rows of a key that occurs very often.
    """
    others = [c for c in parts.columns if c not in keys]
    latest = F.max_by(F.struct(*others), "ord").alias("_row")
    picked = parts.groupBy(*keys).agg(latest, F.min("ord").alias("first_ord"))
    return picked.select(*keys, "_row.*", "first_ord")


def section_ends(headings: DataFrame, page: str = "page_id") -> DataFrame:
    """Add ``stop`` and ``stopped_by``: number and text of the next sibling heading
    that ends each ``h3`` or ``h4`` span.

    A window holds the headings below one element of one page. Rows are read
    backwards, so the frame grows by one row at a time.
    """
    after = (
        W.partitionBy(page, "parent")
        .orderBy(F.desc("pre"))
        .rowsBetween(W.unboundedPreceding, W.currentRow - 1)
    )
    heading = F.struct("pre", "content")
    upper = F.min(F.when(F.col("tag").isin("h2", "h3"), heading)).over(after)
    any_level = F.min(F.when(F.col("tag").isin("h2", "h3", "h4"), heading)).over(after)
    found = headings.withColumn("_stop", F.when(F.col("tag") == "h3", upper).when(F.col("tag") == "h4", any_level))
    return found.withColumns({"stop": F.col("_stop.pre"), "stopped_by": F.col("_stop.content")}).drop("_stop")
