"""Dictionary pages built from table rows.

The given tables hold no dictionary pages, so pages are put together from
documents by string expressions: one page per document, with its whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import capitalize, html_escape, language_name
from ..operators.nodes import once

LANGUAGE, NAME = "lang", "lang_name"
# The text's list items, which several parts of a page and several pages show.
ITEMS = "text_items"


def _join(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def items(text: Column) -> Column:
    """One ``li`` per line."""
    return _join("<li>", F.replace(html_escape(text), F.lit("\n"), F.lit("</li><li>")), "</li>")


def ordered(text: Column) -> Column:
    return in_list(items(text))


def in_list(items: Column) -> Column:
    return _join("<ol>", items, "</ol>")


def text_list() -> Column:
    """The whole text as a list, in bodies given to :func:`_page` and :func:`several_pages`."""
    return in_list(F.col(ITEMS))


def _with_items(rows: DataFrame) -> DataFrame:
    return once(rows, ITEMS, items(F.col("text")))


def part(level: int, heading: str | Column, body: Column | str, tag: str = "h3") -> Column:
    title = _join("<summary>", f"<{tag}>", heading, f"</{tag}>", "</summary>")
    return _join(f'<details data-level="{level}">', title, body, "</details>")


def letter_run(text: Column, number: int) -> Column:
    """A text's run of letters by its number from 0, found without looking at what follows it; empty if there is none."""
    before = r"\p{L}++\P{L}++" * number
    return F.regexp_extract(text, rf"\A\P{{L}}*+{before}(\p{{L}}++)", 1)


def documents_as_words(documents: DataFrame) -> DataFrame:
    """``page_id``, ``word`` and the text columns pages are made of."""
    first = F.regexp_extract("text", r"\p{L}+", 0)
    return documents.select(
        F.col("doc_id").alias("page_id"),
        F.concat(first, F.lit("_"), F.col("source")).alias("word"),
        "text", LANGUAGE, "source",
        language_name(F.col(LANGUAGE)).alias(NAME),
    )


def _page(rows: DataFrame, body: Column) -> DataFrame:
    # Built once: the list test of the parser would repeat the expression.
    return once(_with_items(rows), "html", _html(body)).select("page_id", "word", LANGUAGE, "html")


def _other_language() -> Column:
    """A section in a language that no document has."""
    return F.lit(
        '<details data-level="2"><summary><h2><span id="ca">Català</span></h2></summary>'
        "<ol><li>decoy</li></ol></details>"
    )


def _language_page(heading: Column, body: Column) -> Column:
    opened = _join('<details data-level="2"><summary>', heading, "</summary>")
    return _join(_other_language(), opened, body, "</details>")


def section_body(method: int) -> Column:
    """Body on which only the given method finds the section of the document's language."""
    code, name = F.col(LANGUAGE), F.col(NAME)
    noun = part(3, "Noun", text_list())
    if method == 1:
        body = _language_page(_join('<h2><span id="', code, '">', name, "</span></h2>"), noun)
    elif method == 2:
        heading = _join('<h2><span id="', capitalize(code), '">', name, "</span></h2>")
        body = _language_page(heading, noun)
    elif method == 3:
        body = _language_page(_join('<h2 id="Old_', name, '">', name, "</h2>"), noun)
    elif method == 4:
        body = _language_page(_join("<h2>", name, "</h2>"), noun)
    elif method == 5:
        heading = _join('<h4><span class="x mw-headline">', name, "</span></h4>")
        body = _language_page(heading, noun)
    elif method == 6:
        block = _join("<details><h3>", name, "</h3>", noun, "</details>")
        body = _join(_other_language(), '<div><div id="title_0">t</div>', block, "</div>")
    elif method == 7:
        opened = _join('<div class="mw-parser-output" lang="', code, '"><h3>', name, "</h3>")
        body = _join(opened, "<p>Noun</p>", text_list(), "</div>")
    else:
        block = _join("<details><h3>", name, "</h3>", noun, "</details>")
        body = _join(_other_language(), block)
    return body


def section_page(rows: DataFrame, method: int) -> DataFrame:
    return _page(rows, section_body(method))


def _html(body: Column) -> Column:
    return _join("<!DOCTYPE html><html><head><title>x</title></head><body>", body, "</body></html>")


def several_pages(rows: DataFrame, bodies: list[Column], words: list[Column] | None = None) -> DataFrame:
    """A page per row and body, from one reading of the rows; ``page_no`` counts bodies from 0."""
    words = words or [F.col("word")] * len(bodies)
    pages = [F.struct(w.alias("word"), _html(b).alias("html")) for w, b in zip(words, bodies)]
    exploded = _with_items(rows).select("page_id", LANGUAGE, F.posexplode(F.array(*pages)).alias("page_no", "_page"))
    return exploded.select("page_id", "_page.word", LANGUAGE, "page_no", "_page.html")


def _in_language(body: Column) -> Column:
    heading = _join('<h2><span id="', F.col(LANGUAGE), '">', F.col(NAME), "</span></h2>")
    return _language_page(heading, body)


def rich_body() -> Column:
    """Sections of all levels, excluded ones, and ones that give nothing."""
    source, word = F.col("source"), F.col("word")
    nested = _join("<ol><li>outer<ol>", items(source), "</ol></li></ol>")
    body = _join(
        part(4, "Adjective", nested, "h4"),
        part(2, "Verb", ordered(source)),
        part(3, "Noun ( n )", text_list()),
        part(3, _join("Translations of ", word), text_list()),
        part(3, "Empty", "<p>nothing</p>"),
        '<details data-level="3"><ol><li>no heading</li></ol></details>',
        part(3, "Bare", "<ol></ol>"),
        part(3, "see ALSO", ordered(source)),
    )
    return _in_language(body)


def rich_page(rows: DataFrame) -> DataFrame:
    return _page(rows, rich_body())


def etymology_page(rows: DataFrame) -> DataFrame:
    """Level 4 sections, one of them excluded, inside a level 3 section."""
    source, word = F.col("source"), F.col("word")
    inner = _join(
        text_list(),
        part(4, "Noun", ordered(source), "h4"),
        part(4, "Translations", ordered(word), "h4"),
    )
    return _page(rows, _in_language(part(3, "Etymology", inner)))


def repeated_body() -> Column:
    """Two sections with the same heading."""
    body = _join(
        part(3, "Noun", text_list()),
        part(3, "Verb", ordered(F.col("source"))),
        part(3, "Noun", ordered(F.col("word"))),
    )
    return _in_language(body)


def repeated_page(rows: DataFrame) -> DataFrame:
    return _page(rows, repeated_body())


def flat_page(rows: DataFrame) -> DataFrame:
    """Headings and lists as siblings, without containers."""
    source, word, code = F.col("source"), F.col("word"), F.col(LANGUAGE)
    body = _join(
        '<div class="mw-parser-output" lang="', code, '">',
        "<h3>Noun</h3><p>x</p>", text_list(),
        "<h4>Usage</h4>", ordered(source),
        "<h5>Deep</h5>", ordered(code),
        "<h3>Verb</h3>", ordered(word),
        "<h2>End</h2><ol><li>outside</li></ol>",
        "<div><h3>Wrapped</h3></div><ol><li>outside too</li></ol></div>",
    )
    return _page(rows, body)


def write_page_files(pages: DataFrame, path: str, folders: bool = False, name: str = "") -> None:
    """One file per page, named by its word: the layout :func:`scan_page_dir` reads.

    With ``folders`` the word is a folder and ``name`` the file in it, as rule files are.
    Each task writes its own rows; a repeated task writes the same files again.
    """

    def write(batches):
        from pyarrow import RecordBatch, array
        from pyarrow.fs import FileSystem

        target = path if "://" in path else f"file://{path}"
        system, folder = FileSystem.from_uri(target)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            # Bodies are UTF-8 already: their bytes are written as they are.
            for word, html in zip(batch.column("word"), batch.column("html")):
                at = f"{folder}/{word.as_py()}"
                if folders:
                    system.create_dir(at, recursive=True)
                with system.open_output_stream(f"{at}/{name}" if folders else at, compression=None) as out:
                    out.write(html.as_buffer())
            yield RecordBatch.from_arrays([array([batch.num_rows], "int64")], ["written"])

    pages.select("word", "html").mapInArrow(write, "written long").write.format("noop").mode(
        "overwrite"
    ).save()


def words_of(documents: DataFrame) -> DataFrame:
    """Distinct tokens between white space, in all documents."""
    tokens = F.explode(F.split("text", r"\s+"))
    return documents.select(tokens.alias("word")).where(F.col("word") != "").distinct()


# --- fixed values: stand-in alphabets to get words in other scripts ---------
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC_ALPHABET = "абвгдежзийклмнопрстуфхцчшщ"
GREEK_ALPHABET = "αβγδεζηθικλμνξοπρστυφχψωϊϋ"
VOWELS = "aeiou"
MIXED_SIGNS = "漢字かなカ"


def word_by_language(word: Column) -> Column:
    """Words of French documents in Cyrillic letters, of German ones in Greek letters."""
    lowered = F.lower(word)
    return (
        F.when(F.col(LANGUAGE) == "fr", F.translate(lowered, ALPHABET, CYRILLIC_ALPHABET))
        .when(F.col(LANGUAGE) == "de", F.translate(lowered, ALPHABET, GREEK_ALPHABET))
        .otherwise(word)
    )


def words_in_scripts(documents: DataFrame) -> DataFrame:
    """Each distinct token as it is, in Cyrillic, in Greek, and with vowels replaced."""
    word = F.col("word")
    forms = F.array(
        word,
        F.translate(word, ALPHABET, CYRILLIC_ALPHABET),
        F.translate(word, ALPHABET, GREEK_ALPHABET),
        F.translate(word, VOWELS, MIXED_SIGNS),
    )
    return words_of(documents).select(F.posexplode(forms).alias("form", "word"))


def letter_words(texts: DataFrame, lang: str | Column = "lang") -> DataFrame:
    """``(lang, word)`` of every lower-case letter run."""
    runs = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    code = F.col(lang) if isinstance(lang, str) else lang
    return texts.select(code.alias("lang"), F.explode(runs).alias("word"))
