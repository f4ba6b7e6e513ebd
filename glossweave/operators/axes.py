"""Tree axes over node arrays. Page-local: none of them moves rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, strip
from .nodes import TEXT, has_tag, once


def node_at(nodes: Column, pre: Column) -> Column:
    return F.get(nodes, pre)


def span(nodes: Column, pre: Column, fin: Column) -> Column:
    """Nodes numbered ``pre`` to ``fin``."""
    return F.slice(nodes, pre + 1, fin - pre + 1)


def descendants(nodes: Column, element: Column, *tags: str) -> Column:
    """Nodes below ``element`` in document order, never the element itself."""
    below = F.slice(nodes, element["pre"] + 2, element["fin"] - element["pre"])
    return F.filter(below, lambda n: has_tag(n, *tags)) if tags else below


def nearest_container(nodes: Column, element: Column) -> Column:
    """Nearest ancestor-or-self with the container tag, null if there is none."""
    return node_at(nodes, element["near"])


def parent(nodes: Column, element: Column) -> Column:
    return F.when(element["parent"] >= 0, node_at(nodes, element["parent"]))


def _joined_text(nodes: Column, element: Column) -> Column:
    texts = F.transform(
        F.filter(span(nodes, element["pre"], element["fin"]), lambda n: has_tag(n, TEXT)),
        lambda n: n["text"],
    )
    return F.array_join(texts, " ")


def text_content(nodes: Column, element: Column) -> Column:
    """Text below an element, text nodes joined by one space, ends stripped."""
    return strip(_joined_text(nodes, element))


def list_items(nodes: Column, pre: Column, fin: Column, dedupe_nested: bool = False) -> Column:
    """``li`` elements of every ``ol`` numbered ``pre`` to ``fin``.

    An item below several nested lists comes once per list, outer list first,
    unless ``dedupe_nested`` asks for each item once.
    """
    lists = F.filter(span(nodes, pre, fin), lambda n: has_tag(n, "ol"))
    items = F.flatten(
        F.transform(
            lists,
            lambda ol: F.transform(
                descendants(nodes, ol, "li"),
                lambda li: F.struct(li["pre"].alias("pre"), li["fin"].alias("fin")),
            ),
        )
    )
    return F.array_distinct(items) if dedupe_nested else items


def item_texts(nodes: Column, items: Column) -> Column:
    # Cleaning strips the ends.
    return F.transform(items, lambda li: clean_text(_joined_text(nodes, li)))


def explode_elements(df: DataFrame, *tags: str, nodes: str = "nodes", keep_nodes: bool = False) -> DataFrame:
    """One row per element with one of ``tags``, in long form.

    ``content`` is the element's text and ``container`` the node found by
    :func:`nearest_container`. The text is taken inside the array, before the
    explode, so a page's nodes are not copied once per element.
    """
    array = F.col(nodes)
    found = F.transform(
        F.filter(array, lambda n: has_tag(n, *tags)),
        lambda n, i: F.struct(
            (i + 1).alias("ord"),
            n["pre"].alias("pre"),
            n["fin"].alias("fin"),
            n["parent"].alias("parent"),
            n["depth"].alias("depth"),
            n["tag"].alias("tag"),
            n["id"].alias("id"),
            n["cls"].alias("cls"),
            n["lang"].alias("lang"),
            text_content(array, n).alias("content"),
            nearest_container(array, n)["tag"].alias("container"),
            n["near"].alias("container_pre"),
        ),
    )
    rows = once(df, "_found", found)
    if not keep_nodes:
        rows = rows.drop(nodes)
    return rows.select("*", F.explode_outer("_found").alias("_el")).where(
        F.col("_el").isNotNull()
    ).select("*", "_el.*").drop("_found", "_el")
