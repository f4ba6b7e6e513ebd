"""HTML pages to arrays of tree nodes.

``pre`` is the document-order number of a node and its array index, ``fin`` the
largest ``pre`` of its subtree, so a subtree is one contiguous slice. ``near``
is the ``pre`` of the nearest node with the container tag, the node itself
included, which saves walking up the tree later.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_tree import TEXT, in_pieces, pages_to_arrow

NODE_TYPE = (
    "array<struct<pre:int,fin:int,parent:int,depth:int,tag:string,"
    "id:string,cls:string,lang:string,level:string,text:string,near:int>>"
)
def html_nodes(html: Column, container: str = "details") -> Column:
    """Nodes of each page, null for a page without content.

    A scalar Arrow UDF, so filters on other columns still reach the scan. A batch of the
    session, up to 10,000 large rows, is parsed and sent back in pieces of bounded size.
    """

    @F.arrow_udf(NODE_TYPE)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            for piece in in_pieces(pages):
                yield pages_to_arrow(piece, container)

    return parse(html)


def with_nodes(
    pages: DataFrame, container: str = "details", required: str | None = "ol", nodes: str = "nodes"
) -> DataFrame:
    """Replace ``html`` by ``nodes``.

    Pages that cannot hold the ``required`` tag are dropped before they reach
    Python; the test is a necessary condition, so no result is lost.
    """
    if required:
        pages = pages.where(F.col("html").rlike(rf"(?i)<{required}[\s/>]"))
    return pages.withColumn(nodes, html_nodes(F.col("html"), container)).drop("html")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later steps use without computing it again.

    The optimizer inlines a projected column into filters and lambdas that use
    it. It does not look through a generator, so the value passes one.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


# --- node predicates --------------------------------------------------------

def has_tag(node: Column, *tags: str) -> Column:
    return node["tag"] == tags[0] if len(tags) == 1 else node["tag"].isin(*tags)


def has_id(node: Column, value) -> Column:
    return node["id"] == value


def id_contains(node: Column, value) -> Column:
    return F.contains(node["id"], F.lit(value))


def class_contains(node: Column, value) -> Column:
    return F.contains(node["cls"], F.lit(value))


def lang_contains(node: Column, value) -> Column:
    return F.contains(node["lang"], F.lit(value))


def has_level(node: Column, level: str) -> Column:
    return node["level"] == level
