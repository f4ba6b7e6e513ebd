"""Entry rows to dictionary text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import headword, html_escape

_DSL_SPECIAL = r"([\\\[\]{}~@^#()])"


def _lines(definitions: Column, heading, item) -> Column:
    """Heading line and item lines of every part of speech, in order."""
    blocks = F.transform(
        definitions,
        lambda d: F.concat(F.array(heading(d["pos"])), F.transform(d["defs"], item)),
    )
    return F.flatten(blocks)


def render_dsl(word: Column, definitions: Column, escape: bool = False) -> Column:
    """Lingvo DSL lines of one entry, without the final newline."""

    def body(text: Column) -> Column:
        return F.regexp_replace(text, _DSL_SPECIAL, r"\\$1") if escape else text

    lines = _lines(
        definitions,
        lambda pos: F.concat(F.lit("  [c]"), body(pos), F.lit("[/c]")),
        lambda text: F.concat(F.lit("  "), body(text)),
    )
    return F.array_join(F.concat(F.array(body(headword(word))), lines), "\n")


def render_xdxf(word: Column, definitions: Column) -> Column:
    """XDXF article of one entry, without the final newline."""

    def tagged(tag: str):
        return lambda text: F.concat(F.lit(f"<{tag}>"), html_escape(text), F.lit(f"</{tag}>"))

    head = F.concat(F.lit("<ar><k>"), html_escape(headword(word)), F.lit("</k>"))
    lines = _lines(definitions, tagged("pos"), tagged("def"))
    return F.array_join(F.concat(F.array(head), lines, F.array(F.lit("</ar>"))), "\n")


def render_entry(word: Column, definitions: Column, fmt: str, escape_dsl: bool = False) -> Column:
    if fmt == "lingvo":
        return render_dsl(word, definitions, escape_dsl)
    if fmt == "xdxf":
        return render_xdxf(word, definitions)
    raise ValueError(f"Unsupported output format: {fmt}")
