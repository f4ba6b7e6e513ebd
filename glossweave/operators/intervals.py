"""Tree axes on node tables: interval joins, and ancestors by any tag.

A subtree is the interval [pre, fin] of document order, so "x is below a" is
a.pre < x.pre <= a.fin. Two node tables are joined on that containment by
binned intervals: every node lies in the bin pre // width, and an outer node is
copied to each bin its interval touches. The join is then an equality on
(page, bin) with a containment test on the pairs of one bin: a hash or
sort-merge join, never a nested loop, and a page with many nodes is spread over
its bins. An outer node costs one row per bin it spans; a pair is found exactly
once, in the bin of the inner node.

``nearest_with_tag`` is the array form of the same axis for any tag asked at
query time: from a node it climbs the parent pointers, at most depth + 1 steps,
so the tag need not be known while pages are parsed.

Defined results: an outer node without descendants meets nothing; pages without
nodes give no rows; null tags match no tag; the columns of the two sides are
renamed with ``outer_`` and ``inner_`` before the join, so names never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .axes import text_content
from .nodes import has_tag, once

#: Nodes of a bin.
BIN = 64


def nearest_with_tag(nodes: Column, element: Column, *tags: str, self_included: bool = True) -> Column:
    """Nearest ancestor (or the element itself) with one of ``tags``, null if none."""
    start = element["pre"] if self_included else element["parent"]

    def step(at, _):
        node = F.get(nodes, at)
        return F.when((at >= 0) & ~F.coalesce(has_tag(node, *tags), F.lit(False)), node["parent"]).otherwise(at)

    found = F.aggregate(F.sequence(F.lit(0), F.greatest(element["depth"], F.lit(0))), start.cast("int"), step)
    return F.when(found >= 0, F.get(nodes, found))


def elements(pages: DataFrame, tags: tuple[str, ...], key: str = "page_id", nodes: str = "nodes") -> DataFrame:
    """Node table of the elements with ``tags``: key, tag, ord (1-based among its tag in the
    page), pre, fin, parent, depth and text content; numbered inside each page's row."""
    array = F.col(nodes)

    def numbered(tag):
        return F.transform(
            F.filter(array, lambda n: has_tag(n, tag)),
            lambda n, i: F.struct(
                n["tag"].alias("tag"), (i + 1).alias("ord"), n["pre"].alias("pre"), n["fin"].alias("fin"),
                n["parent"].alias("parent"), n["depth"].alias("depth"), text_content(array, n).alias("content"),
            ),
        )

    per_tag = [numbered(t) for t in tags]
    rows = once(pages.select(key, nodes), "_els", F.flatten(F.array(*per_tag)))
    return rows.select(key, F.explode("_els").alias("_el")).select(key, "_el.*")


def _renamed(df: DataFrame, prefix: str, key: str) -> DataFrame:
    return df.select(key, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c != key])


def interval_join(outer: DataFrame, inner: DataFrame, key: str = "page_id", self_included: bool = False,
                  width: int = BIN) -> DataFrame:
    """Pairs of an outer node and an inner node within its subtree (the node itself too if
    ``self_included``), by binned intervals. Both sides need key, pre and fin."""
    o = _renamed(outer, "outer_", key)
    i = _renamed(inner, "inner_", key)
    low = F.col("outer_pre") + (0 if self_included else 1)
    first, last = F.floor(low / width), F.floor(F.col("outer_fin") / width)
    bins = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    o = o.withColumn("_bin", F.explode(bins))
    i = i.withColumn("_bin", F.floor(F.col("inner_pre") / width))
    inside = (F.col("inner_pre") >= low) & (F.col("inner_pre") <= F.col("outer_fin"))
    return o.join(i, [key, "_bin"]).where(inside).drop("_bin")


def descendant_pairs(pages: DataFrame, outer_tags: tuple[str, ...], inner_tags: tuple[str, ...],
                     key: str = "page_id", width: int = BIN) -> DataFrame:
    """Every (outer, inner) pair of an inner element below an outer one: an inner element
    below k nested outer ones comes k times, outer first in document order."""
    found = cut(elements(pages, tuple(dict.fromkeys(outer_tags + inner_tags)), key), "elements")
    outer = found.where(F.col("tag").isin(*outer_tags)).drop("content")
    inner = found.where(F.col("tag").isin(*inner_tags))
    return interval_join(outer, inner, key, width=width)


def nearest_ancestors(pages: DataFrame, target_tags: tuple[str, ...], tags: tuple[str, ...],
                      key: str = "page_id", width: int = BIN) -> DataFrame:
    """For every element with ``target_tags``: its key, tag, ord, and per asked tag t the ord of
    its nearest ancestor-or-self with tag t (column ``t``, null if none), from one parse."""
    found = cut(elements(pages, tuple(dict.fromkeys(target_tags + tags)), key), "elements")
    targets = found.where(F.col("tag").isin(*target_tags)).select(key, "tag", "ord", "pre", "fin")
    above = found.where(F.col("tag").isin(*tags)).select(key, "tag", "ord", "pre", "fin")
    pairs = interval_join(above, targets, key, self_included=True, width=width)
    # Ancestors of one node are nested: the nearest one of a tag has the largest pre.
    nearest = pairs.groupBy(key, "inner_pre").agg(
        *[F.max(F.when(F.col("outer_tag") == t, F.struct("outer_pre", "outer_ord")))["outer_ord"].alias(t) for t in tags]
    )
    return targets.join(nearest.withColumnRenamed("inner_pre", "pre"), [key, "pre"], "left").select(
        key, "tag", "ord", *tags
    )
