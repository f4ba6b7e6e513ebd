"""Relational axes (interval joins) and ancestors by any tag, against the array form and brute force."""

import random

from pyspark.sql import functions as F

from glossweave.operators import intervals as I
from glossweave.operators import nodes as N
from glossweave.operators.axes import list_items

from test_nodes import random_tree, to_html

NESTED = (
    "<html><body><ol><li>a<ol><li>b</li><li>c<ol><li>d</li></ol></li></ol></li><li>e<ul><li>f</li></ul></li></ol>"
    "<div><ol><li>g</li></ol></div></body></html>"
)


def parsed(spark, pages, *htmls):
    return N.with_nodes(pages(*[("w", h) for h in htmls]), required=None)


def brute_pairs(nodes, outer, inner):
    return sorted(
        (o.pre, i.pre) for o in nodes for i in nodes if o.tag in outer and i.tag in inner and o.pre < i.pre <= o.fin
    )


def test_list_items_equal_the_array_form(spark, pages):
    rows = parsed(spark, pages, NESTED)
    pairs = I.descendant_pairs(rows, ("ol",), ("li",)).orderBy("outer_pre", "inner_pre").collect()
    items = rows.select(list_items(F.col("nodes"), F.lit(0), F.lit(10_000)).alias("i")).first().i
    assert [p.inner_pre for p in pairs] == [i.pre for i in items]
    # An item below three nested lists comes three times.
    assert [p.inner_content for p in pairs].count("d") == 3


def test_random_trees_against_brute_force(spark, pages):
    rng = random.Random(5)
    htmls = [to_html(("html", {}, [("body", {}, [random_tree(rng) for _ in range(3)])])) for _ in range(60)]
    rows = parsed(spark, pages, *htmls)
    got = {}
    for p in I.descendant_pairs(rows, ("ol", "ul", "div"), ("li", "span", "b"), width=4).collect():
        got.setdefault(p.page_id, []).append((p.outer_pre, p.inner_pre))
    for page in rows.collect():
        assert sorted(got.get(page.page_id, [])) == brute_pairs(page.nodes, ("ol", "ul", "div"), ("li", "span", "b"))


def test_two_tags_from_one_parse(spark, pages):
    rng = random.Random(9)
    htmls = [to_html(("html", {}, [("body", {}, [random_tree(rng) for _ in range(3)])])) for _ in range(40)]
    rows = parsed(spark, pages, *htmls)
    joined = {
        (r.page_id, r.tag, r.ord): (r.ol, r.div)
        for r in I.nearest_ancestors(rows, ("li", "b", "ol"), ("ol", "div"), width=4).collect()
    }
    nodes = F.col("nodes")

    def numbered(tag):
        found = F.filter(nodes, lambda n: N.has_tag(n, tag))
        return F.map_from_arrays(F.transform(found, lambda n: n["pre"]), F.transform(found, lambda n, i: i + 1))

    climbed = {}
    for tag in ("li", "b", "ol"):
        found = F.transform(
            F.filter(nodes, lambda n: N.has_tag(n, tag)),
            lambda n, i: F.struct(
                (i + 1).alias("ord"),
                F.element_at(numbered("ol"), I.nearest_with_tag(nodes, n, "ol")["pre"]).alias("ol"),
                F.element_at(numbered("div"), I.nearest_with_tag(nodes, n, "div")["pre"]).alias("div"),
            ),
        )
        for r in rows.select("page_id", F.explode(found).alias("e")).collect():
            climbed[(r.page_id, tag, r.e.ord)] = (r.e.ol, r.e.div)
    assert joined == climbed
    # Brute force on the parsed nodes: the nearest ancestor-or-self walks up the parents.
    for page in rows.collect():
        ords = {}
        for n in page.nodes:
            ords.setdefault(n.tag, []).append(n.pre)
        for tag in ("li", "b", "ol"):
            for k, pre in enumerate(ords.get(tag, []), 1):
                want = []
                for t in ("ol", "div"):
                    at = pre
                    while at >= 0 and page.nodes[at].tag != t:
                        at = page.nodes[at].parent
                    want.append(ords[t].index(at) + 1 if at >= 0 else None)
                assert joined[(page.page_id, tag, k)] == tuple(want)


def test_no_nested_loop_in_the_plans(spark, pages):
    rows = parsed(spark, pages, NESTED)
    for df in (I.descendant_pairs(rows, ("ol",), ("li",)), I.nearest_ancestors(rows, ("li",), ("ol", "div"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_odd_pages(spark, pages):
    rows = parsed(spark, pages, "", None, "<li>x</li>", "<ol></ol>").withColumn("outer_pre", F.lit("clash"))
    pairs = I.descendant_pairs(rows, ("ol",), ("li",)).collect()
    assert pairs == []
    found = I.nearest_ancestors(rows, ("li",), ("ol",)).collect()
    assert [(r.tag, r.ol) for r in found] == [("li", None)]
