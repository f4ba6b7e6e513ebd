from pyspark.sql import functions as F

from glossweave import ConvertParams
from glossweave.operators import definitions as D
from glossweave.operators import nodes as N
from glossweave.operators.axes import explode_elements
from glossweave.operators.sections import with_section
from glossweave.plans.convert import extract_entries

EN = ConvertParams("en", "en")


def part(level, heading, body):
    return f'<details data-level="{level}"><summary><h3>{heading}</h3></summary>{body}</details>'


def section(body, code="en"):
    return f'<details data-level="2"><summary><h2><span id="{code}">L</span></h2></summary>{body}</details>'


def entries(pages, *rows, params=EN):
    found = extract_entries(pages(*rows), params).orderBy("page_id").collect()
    return {r.word: [(d.pos, list(d.defs)) for d in r.definitions] for r in found}


def ol(*items):
    return "<ol>" + "".join(f"<li>{i}</li>" for i in items) + "</ol>"


def test_levels_come_in_fixed_order(pages):
    html = section(part(4, "C", ol("c")) + part(2, "B", ol("b")) + part(3, "A", ol("a")))
    assert entries(pages, ("w", html)) == {"w": [("A", ["a"]), ("B", ["b"]), ("C", ["c"])]}


def test_last_list_of_a_heading_wins_at_the_first_place(pages):
    html = section(part(3, "N", ol("1")) + part(3, "V", ol("2")) + part(3, "N", ol("3", "4")))
    assert entries(pages, ("w", html)) == {"w": [("N", ["3", "4"]), ("V", ["2"])]}


def test_excluded_by_substring_in_any_case(pages):
    html = section(
        part(3, "Translations", ol("x")) + part(3, "references and notes", ol("x")) + part(3, "Noun", ol("n"))
    )
    assert entries(pages, ("w", html)) == {"w": [("Noun", ["n"])]}
    own = ConvertParams("en", "en", excluded_sections=("NOUN",))
    assert [p for p, _ in entries(pages, ("w", html), params=own)["w"]] == ["Translations", "references and notes"]


def test_pages_without_result_are_dropped(pages):
    rows = [
        ("no list", section(part(3, "Noun", "<p>x</p>"))),
        ("empty list", section(part(3, "Noun", "<ol></ol>"))),
        ("no heading", section('<details data-level="3">' + ol("x") + "</details>")),
        ("no language", section(part(3, "Noun", ol("x")), "ru").replace(">L<", ">R<")),
        ("empty", ""),
        ("kept", section(part(3, "Noun", ol("x")))),
    ]
    assert list(entries(pages, *rows)) == ["kept"]


def test_text_is_cleaned(pages):
    body = ol("a <b>b</b> , c ( d ) .", "x y", "&amp;lt;b&amp;gt; &amp;amp;amp;", "fo<b>o</b>")
    got = entries(pages, ("w", section(part(3, "Noun ( n )", body))))
    assert got == {"w": [("Noun (n)", ["a b, c (d).", "x y", "<b> &amp;", "fo o"])]}


def test_virtual_sections(pages):
    html = (
        '<div lang="en"><div class="mw-parser-output"><h2>T</h2><h3>N</h3>text' + ol("a")
        + "<h4>S</h4>" + ol("b") + "<h5>D</h5>" + ol("c") + "<h4>S2</h4>" + ol("d")
        + "<h3>V</h3>" + ol("e") + "<h2>End</h2>" + ol("f") + "</div></div>"
    )
    assert entries(pages, ("w", html)) == {
        "w": [("N", list("abcd")), ("S", ["b", "c"]), ("S2", ["d"]), ("V", ["e"])]
    }


def test_virtual_spans_agree_with_window_form(spark, pages):
    """The array form and the window form stop at the same headings."""
    html = "<div class='mw-parser-output' lang='en'>" + "".join(
        f"<h{n}>t{i}</h{n}>" + ("<div><h3>in</h3><h4>in</h4></div>" if i % 5 == 0 else "")
        for i, n in enumerate([3, 4, 4, 3, 2, 4, 3, 3, 4, 2, 2, 3, 4, 5, 3])
    ) + ol("x") + "</div>"
    frame = with_section(N.with_nodes(pages(("w", html))), "en").withColumn(
        "spans", D.pos_sections(F.col("nodes"), F.col("section"))
    )
    row = frame.first()
    nodes = row.nodes
    spans = {s.pre: s.fin for s in row.spans}
    heads = [(n.pre, n.parent, n.tag) for n in nodes if n.tag in ("h2", "h3", "h4")]
    expected = {}
    for pre, parent, tag in heads:
        if tag != "h2":
            later = [p for p, q, t in heads if q == parent and p > pre and t <= tag]
            expected[pre] = later[0] - 1 if later else nodes[parent].fin
    assert spans == expected
    table = spark.createDataFrame([(0, *h) for h in heads], "page_id int, pre int, parent int, tag string")
    for r in D.section_ends(table.withColumn("content", F.col("tag"))).where("tag <> 'h2'").collect():
        assert (r.stop - 1 if r.stop is not None else nodes[r.parent].fin) == expected[r.pre]


def test_nested_lists(pages):
    html = section(part(3, "N", "<ol><li>a<ol><li>b<ul><li>c</li></ul></li></ol></li></ol>"))
    assert entries(pages, ("w", html)) == {"w": [("N", ["a b c", "b c", "c", "b c", "c"])]}
    once = ConvertParams("en", "en", dedupe_nested=True)
    assert entries(pages, ("w", html), params=once) == {"w": [("N", ["a b c", "b c", "c"])]}


def test_long_form_keeps_positions(spark, pages):
    html = section(part(3, "A", ol("1", "2")) + part(3, "B", ol("3")))
    rows = D.to_long(extract_entries(pages(("w", html)), EN)).orderBy("pos_ord", "def_ord").collect()
    assert [(r.pos_ord, r.pos, r.def_ord, r.definition) for r in rows] == [
        (0, "A", 0, "1"), (0, "A", 1, "2"), (1, "B", 0, "3")
    ]


def test_row_folds_agree(spark):
    rows = [("w", "N", 0, "a"), ("w", "V", 1, "b"), ("w", "N", 2, "c"), ("x", "N", 0, "d")]
    frame = spark.createDataFrame(rows, "word string, pos string, ord int, defs string")
    folded = {(r.word, r.pos): (r.ord, r.defs) for r in D.fold_rows(frame, ["word", "pos"]).collect()}
    assert folded == {("w", "N"): (0, "c"), ("w", "V"): (1, "b"), ("x", "N"): (0, "d")}
    window = {
        (r.word, r.pos): (r.first_ord, r.defs) for r in D.last_per_key(frame, ["word", "pos"]).collect()
    }
    assert window == folded


def test_texts_are_taken_after_the_fold(spark, pages):
    """The items of a repeated heading go before their texts are joined and cleaned."""
    html = section(part(3, "N", ol("a  b")) + part(3, "N", ol("c ,")))
    nodes = N.with_nodes(pages(("w", html)))
    parts = F.filter("nodes", lambda n: N.has_level(n, "3"))
    kept = D.with_items(F.col("nodes"), D.headed_sections(F.col("nodes"), parts))
    row = nodes.select(D.fold_last_wins(kept).alias("f"), D.with_texts(F.col("nodes"), D.fold_last_wins(kept)).alias("d")).first()
    assert [(p.pos, len(p.defs), p.defs[0].asDict().keys()) for p in row.f] == [("N", 1, {"pre", "fin"})]
    assert [(p.pos, list(p.defs)) for p in row.d] == [("N", ["c,"])]
