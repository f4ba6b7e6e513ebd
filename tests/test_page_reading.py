"""What reading very many page files costs: tasks, bodies held, and tokens looked at."""

from pyspark.sql import functions as F

from glossweave.functions.text import html_escape
from glossweave.operators import html_tree
from glossweave.plans import fixtures as B
from glossweave.sources import pages as P


def test_tasks_of_a_slice():
    assert [P._slice_tasks(n) for n in (1, 250, 251, 16_000)] == [1, 1, 2, 64]
    # From here on a task has more files, so that fewer are started.
    assert P._slice_tasks(40_000) == 64
    assert P._slice_tasks(770_000) == 770


def test_bodies_come_in_pieces(spark, tmp_path, monkeypatch):
    bodies = {f"w{i}": "x" * (i * 7 % 23) for i in range(40)}
    for word, body in bodies.items():
        (tmp_path / word).write_text(body)
    monkeypatch.setattr(P, "PIECE_BYTES", 20)
    rows = P.scan_page_dir(spark, str(tmp_path)).collect()
    assert {r.word: r.html for r in rows} == bodies


class _Counted:
    def __init__(self, pattern):
        self.pattern, self.calls = pattern, 0

    def match(self, *args):
        self.calls += 1
        return self.pattern.match(*args)


def _tree(page):
    rows = html_tree.pages_to_arrow([page], "div").to_pylist()[0]
    return [(n["parent"], n["tag"], n["id"], n["text"], n["near"]) for n in rows]


def test_tokens_are_told_once(monkeypatch):
    counted = _Counted(html_tree._TOKEN)
    monkeypatch.setattr(html_tree, "_TOKEN", counted)
    page = "<ol>" + "<li id='a'>x &amp; y</li>" * 500 + "</ol>"
    assert len(_tree(page)) == 2 + 1 + 2 * 500
    assert counted.calls == 4


def test_tags_that_end_elsewhere():
    page = (
        "a<!-- <p> -->b<div id='x>y'>1 < 2<!--></div><DIV ID=q id=z lang='>'>t</DIV >"
        "<script>if (a<b) {}</script>u<br/><div id=\"open>v</div>\"/>w<"
    )
    assert _tree(page) == [
        (-1, "html", None, None, None), (0, "body", None, None, None), (1, "#text", None, "ab", None),
        (1, "div", "x>y", None, 3), (3, "#text", None, "1 < 2", 3),
    ]
    rest = page.replace("<!-->", "")
    assert _tree(rest)[5:] == [
        (1, "div", "q", None, 5), (5, "#text", None, "t", 5), (1, "script", None, None, None),
        (7, "#text", None, "if (a<b) {}", None), (1, "#text", None, "u", None), (1, "br", None, None, None),
        (1, "div", "open>v</div>", None, 11), (1, "#text", None, "w<", None),
    ]


def test_items_and_escapes(spark):
    texts = ["", "a", "\n", "a\n\nb\n", "x<y\n\"q\" & 'p'>", "é\n中", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select("text", html_escape(F.col("text")).alias("e"), B.items(F.col("text")).alias("i"))
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "split" not in plan
    for row in got.collect():
        if row.text is None:
            assert row.e is None and row.i is None
            continue
        want = row.text
        for sign, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            want = want.replace(sign, reference)
        assert row.e == want
        assert row.i == "".join(f"<li>{line}</li>" for line in want.split("\n"))
