"""The node array against an independent tree on well-formed pages, and repairs."""

import random
from html import escape

import pyarrow as pa
from pyspark.sql import functions as F

from glossweave.operators import axes as A
from glossweave.operators import nodes as N
from glossweave.operators.html_tree import PIECE_BYTES, in_pieces

TAGS = ("div", "span", "ol", "ul", "li", "details", "b", "h3", "section")


def random_tree(rng, depth=0):
    """Nested ``(tag, attrs, children)``; children are trees or texts."""
    children = []
    for _ in range(rng.randint(0, 4)):
        if depth < 5 and rng.random() < 0.6:
            # Nestings that a recovering parser would change are avoided.
            child = random_tree(rng, depth + 1)
            if child[0] != "li":
                children.append(child)
        elif not children or not isinstance(children[-1], str):
            children.append(rng.choice(["text", "a & b", "<x>", "é", "  pad "]))
    attrs = rng.choice([{}, {"id": "i&1"}, {"class": "a b", "lang": "en"}, {"data-level": "3"}])
    return rng.choice(TAGS), attrs, children


def to_html(tree):
    if isinstance(tree, str):
        return escape(tree)
    tag, attrs, children = tree
    written = "".join(f' {k}="{escape(v)}"' for k, v in attrs.items())
    return f"<{tag}{written}>" + "".join(to_html(c) for c in children) + f"</{tag}>"


def flatten(tree, parent, depth, near, out):
    pre = len(out)
    if isinstance(tree, str):
        out.append([pre, pre, parent, depth, "#text", None, None, None, None, tree, near])
        return
    tag, attrs, children = tree
    near = pre if tag == "details" else near
    row = [pre, None, parent, depth, tag, *(attrs.get(k) for k in ("id", "class", "lang", "data-level")), None, near]
    out.append(row)
    for child in children:
        flatten(child, pre, depth + 1, near, out)
    row[1] = len(out) - 1


def test_random_trees(spark, pages):
    rng = random.Random(11)
    trees = [("html", {}, [("body", {}, [random_tree(rng)])]) for _ in range(200)]
    rows = N.with_nodes(pages(*[("w", to_html(t)) for t in trees]), required=None).orderBy("page_id").collect()
    for tree, row in zip(trees, rows):
        expected = []
        flatten(tree, -1, 0, None, expected)
        assert [list(n) for n in row.nodes] == expected, to_html(tree)


def tags(spark, pages, html, container="details"):
    nodes = N.with_nodes(pages(("w", html)), container, required=None).first().nodes
    return nodes and [(n.depth, n.text if n.tag == "#text" else n.tag) for n in nodes if n.depth > 1]


def test_repairs(spark, pages):
    def check(html, expected):
        assert tags(spark, pages, html) == expected

    check("<p>a<p>b", [(2, "p"), (3, "a"), (2, "p"), (3, "b")])
    check("<ol><li>a<li>b</ol>c", [(2, "ol"), (3, "li"), (4, "a"), (3, "li"), (4, "b"), (2, "c")])
    check("<dl><dt>t<dd>d</dl>", [(2, "dl"), (3, "dt"), (4, "t"), (3, "dd"), (4, "d")])
    check("<p><b>x<br><p>y</p>", [(2, "p"), (3, "b"), (4, "x"), (4, "br"), (2, "p"), (3, "y")])
    check("</i><div>a</b></div>b", [(2, "div"), (3, "a"), (2, "b")])
    check("<div><b>x</div>y", [(2, "div"), (3, "b"), (4, "x"), (2, "y")])
    check("<b><div>x</b>y</div>", [(2, "b"), (3, "div"), (4, "xy")])
    check("a<!-- c -->b&amp;c<!-- <p> -->", [(2, "ab&c")])
    check("<div/>x<img src=a>y", [(2, "div"), (2, "x"), (2, "img"), (2, "y")])
    check('<p title="a>b" id=q>x', [(2, "p"), (3, "x")])
    check("<DIV>x</Div>", [(2, "div"), (3, "x")])
    check("1 < 2 &amp;lt; 3", [(2, "1 < 2 &lt; 3")])
    check("<div><script>if (a</b>) '<p>'</script>z</div>", [(2, "div"), (3, "script"), (4, "if (a</b>) '<p>'"), (3, "z")])


def test_document_shape(spark, pages):
    html = '<!DOCTYPE html><html lang="en"><head><title>t</title></head><body class="c">x</body></html> '
    nodes = N.with_nodes(pages(("w", html)), required=None).first().nodes
    assert [(n.tag, n.parent) for n in nodes] == [
        ("html", -1), ("head", 0), ("title", 1), ("#text", 2), ("body", 0), ("#text", 4)
    ]
    assert nodes[0].lang == "en" and nodes[4].cls == "c"
    assert tags(spark, pages, "") is None and tags(spark, pages, " \n") is None


def test_required_tag_drops_pages_before_parsing(spark, pages):
    frame = N.with_nodes(pages(("a", "<OL><li>x"), ("b", "<old>"), ("c", "none")))
    assert [r.word for r in frame.collect()] == ["a"]


def test_axes(spark, pages):
    html = "<details><ol><li>a<ol><li>b</li></ol></li><li>c <i>d</i>e</li></ol></details><li>out</li>"
    nodes = F.col("nodes")
    items = A.list_items(nodes, F.lit(0), F.lit(100))
    once = A.list_items(nodes, F.lit(0), F.lit(100), dedupe_nested=True)
    row = N.with_nodes(pages(("w", html))).select(
        A.item_texts(nodes, items).alias("items"),
        A.item_texts(nodes, once).alias("once"),
    ).first()
    assert row["items"] == ["a b", "b", "c d e", "b"]
    assert row["once"] == ["a b", "b", "c d e"]
    rows = A.explode_elements(N.with_nodes(pages(("w", html))), "li").orderBy("ord").collect()
    assert [(r.content, r.container) for r in rows] == [
        ("a b", "details"), ("b", "details"), ("c  d e", "details"), ("out", None)
    ]


def test_page_parser_runs_once(spark, pages):
    """A second use of the nodes must not parse the pages again."""
    frame = A.explode_elements(N.with_nodes(pages(("w", "<ol><li>x"))), "li").where("content <> ''")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_pages_of_one_batch_are_parsed_in_pieces_of_bounded_size(spark):
    page = "<ol><li>" + "x" * 300 + "</li></ol>"
    batch = [page * 1_000, None, "", page, page * 9_000, page * 1_000, page]
    sizes = [[len(p or "") for p in piece] for piece in in_pieces(pa.array(batch))]
    assert [s for piece in sizes for s in piece] == [len(p or "") for p in batch]
    assert len(sizes) > 1 and all(sum(s) <= PIECE_BYTES or len(s) == 1 for s in sizes)
    assert list(in_pieces(pa.array([], pa.string()))) == []
    rows = spark.createDataFrame(list(enumerate(batch)), "page_id long, html string").coalesce(1)
    found = N.with_nodes(rows, required=None).selectExpr("page_id", "size(filter(nodes, n -> n.tag = 'li')) AS n")
    assert {r.page_id: r.n for r in found.collect()} == {
        0: 1_000, 1: None, 2: None, 3: 1, 4: 9_000, 5: 1_000, 6: 1
    }
