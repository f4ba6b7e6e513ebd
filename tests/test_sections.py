from glossweave.operators import nodes as N
from glossweave.operators.sections import with_section

LIST = "<ol><li>x</li></ol>"


def found(pages, html, code, **options):
    row = with_section(N.with_nodes(pages(("w", html))), code, **options).first()
    if row.section is None:
        return None
    node = row.nodes[row.section.pre]
    assert node.fin == row.section.fin
    return row.section.method, node.tag, node.id


def test_each_method(pages):
    def box(heading, attrs=""):
        return f'<details id="other"><h2>zzz</h2></details><details id="hit">{heading}{LIST}</details>'

    assert found(pages, box('<h2><span id="ca">q</span></h2>'), "ca") == (1, "details", "hit")
    assert found(pages, box('<h2><span id="Ca">q</span></h2>'), "ca") == (2, "details", "hit")
    assert found(pages, box('<h3 id="Old_English">q</h3>'), "en") == (3, "details", "hit")
    assert found(pages, box("<h2>In FRENCH</h2>"), "en") == (4, "details", "hit")
    assert found(pages, box('<h4><span class="mw-headline">English</span></h4>'), "en") == (5, "details", "hit")
    assert found(
        pages, '<div><div id="title_0"></div><details id="hit"><h3>English</h3></details></div>' + LIST, "en"
    ) == (6, "details", "hit")
    assert found(
        pages, f'<div id="c" class="mw-parser-output"><p lang="ru">q</p>{LIST}</div>', "ru"
    ) == (7, "div", "c")
    assert found(pages, box("<h3>English</h3>"), "en") == (8, "details", "hit")
    assert found(pages, box("<h3>q</h3>"), "en") is None


def test_first_span_only(pages):
    """The first span with the id decides, even when only a later one has a container."""
    html = f'<span id="ru">a</span><details><span id="ru">b</span>{LIST}</details>'
    assert found(pages, html, "ru") is None


def test_unlisted_code_has_no_name(pages):
    html = f'<details id="hit"><h2>Klingon (tlh)</h2>{LIST}</details>'
    assert found(pages, html, "tlh") == (4, "details", "hit")
    assert found(pages, html, "xx") is None
    assert found(pages, html, "xx", names={"xx": "Klingon"}) == (4, "details", "hit")


def test_strict_matches_whole_words(pages):
    html = f'<details id="hit"><h2>French</h2>{LIST}</details>'
    assert found(pages, html, "en") == (4, "details", "hit")
    assert found(pages, html, "en", strict=True) is None
    assert found(pages, html.replace("French", "Old English"), "en", strict=True) == (4, "details", "hit")
    other = f'<details id="hit"><h3 id="Old_English">q</h3>{LIST}</details>'
    assert found(pages, other, "en", strict=True) is None


def test_page_level_strict(pages):
    html = f'<div class="mw-parser-output content">{LIST}</div>'
    assert found(pages, html, "en") == (7, "div", None)
    assert found(pages, html, "en", strict=True) is None
    marked = html.replace("<ol>", '<ol lang="en-GB">')
    assert found(pages, marked, "en", strict=True) == (7, "div", None)
