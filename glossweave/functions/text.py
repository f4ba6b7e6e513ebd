"""Scalar text functions, all plain Column expressions that run in the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import LANGUAGE_NAMES, SPACES, UNTIDY, UNTIDY_SPACES

# Order matters: the ampersand first.
_MARKUP = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
_ANY_MARKUP = "[&<>\"']"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Plain reuse of a Column inside a lambda would compute it once per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _replaced(text: Column, old: str, new: str) -> Column:
    """Replace ``old``. Looking whether it is there is much faster than replacing it."""
    return let(text, lambda t: F.when(F.contains(t, F.lit(old)), F.replace(t, F.lit(old), F.lit(new))).otherwise(t))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def _drop_tags(text: Column) -> Column:
    """Delete ``<...>`` runs. Text after the last ``>`` cannot hold one, and is
    kept away from the pattern, which would be quadratic on it."""

    def cut_tail(tail: Column) -> Column:
        head = F.left(text, F.length(text) - F.length(tail))
        return F.concat(F.regexp_replace(head, "<[^>]+>", ""), tail)

    return F.when(
        text.contains("<") & text.contains(">"), let(F.substring_index(text, ">", -1), cut_tail)
    ).otherwise(text)


def _tidy_spaces(text: Column) -> Column:
    out = F.regexp_replace(text, UNTIDY_SPACES, " ")
    out = _replaced(out, "( ", "(")
    out = _replaced(out, " )", ")")
    return F.regexp_replace(out, " (?=[,.;:!?])", "")


def clean_text(text: Column) -> Column:
    """Strip, drop tags, tidy spaces around brackets and punctuation, unescape.

    White space runs become one space first; the bracket and punctuation rules
    then each look at one character, so no input makes them slow. Most texts are
    tidy, which one search tells.
    """
    out = let(strip(text), _drop_tags)
    out = let(out, lambda t: F.when(t.rlike(UNTIDY), _tidy_spaces(t)).otherwise(t))
    return F.coalesce(html_unescape(out), F.lit(""))


def html_escape(text: Column) -> Column:
    """Most texts have no such sign, which one search tells."""

    def escape(t: Column) -> Column:
        out = t
        for char, reference in _MARKUP:
            out = _replaced(out, char, reference)
        return F.when(t.rlike(_ANY_MARKUP), out).otherwise(t)

    return let(text, escape)


def html_escape_plain(text: Column) -> Column:
    """:func:`html_escape` without a lambda. Each use of ``text`` computes it anew, so it should be a plain column."""
    out = text
    for char, reference in _MARKUP:
        out = F.replace(out, F.lit(char), F.lit(reference))
    return F.when(text.rlike(_ANY_MARKUP), out).otherwise(text)


@cache
def _reference_tables() -> tuple[str, str, str, str]:
    """Lookup tables for character references, derived from public rules.

    Named references come from the standard library's HTML5 table, nested by
    first letter because Spark looks a key up by scanning. Numbers 128 to 159
    mean what they mean in Windows-1252.
    """
    by_letter: dict[str, dict[str, str]] = {}
    for name, value in html5.items():
        by_letter.setdefault(name[0], {})[name] = value
    bare = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
    numbers = {"0": "\ufffd", "13": "\r"}
    for code in range(0x80, 0xA0):
        try:
            numbers[str(code)] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            numbers[str(code)] = chr(code)
    return (
        json.dumps(by_letter),
        "^(" + "|".join(bare) + ")",
        json.dumps({n: html5[n] for n in bare}),
        json.dumps(numbers),
    )


def _code_point(number: Column) -> Column:
    """Text of a numeric reference; ``number`` is null when out of range."""
    numbers = F.from_json(F.lit(_reference_tables()[3]), "map<string,string>")
    character = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    noncharacter = (
        number.between(0x1, 0x8)
        | (number == 0xB)
        | number.between(0xE, 0x1F)
        | number.between(0x7F, 0x9F)
        | number.between(0xFDD0, 0xFDEF)
        | (F.pmod(number, F.lit(0x10000)) >= 0xFFFE)
    )
    return (
        F.when(
            number.isNull() | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), F.lit("\ufffd")
        )
        .when(
            (number == 0) | (number == 13) | number.between(0x80, 0x9F),
            F.element_at(numbers, number.cast("string")),
        )
        .when(noncharacter, F.lit(""))
        .otherwise(character)
    )


def _decode_reference(after: Column) -> Column:
    """Text for one ``&`` and what follows it up to the next ``&``."""
    names_json, bare_pattern, bare_json, _ = _reference_tables()
    names = F.from_json(F.lit(names_json), "map<string,map<string,string>>")
    bare = F.from_json(F.lit(bare_json), "map<string,string>")
    token_pattern = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\x{c} <&#;]{1,32};?)"

    def numeric(token: Column) -> Column:
        hexadecimal = F.lower(F.substring(token, 2, 1)) == "x"
        digits = F.regexp_extract(token, "^#[xX]?0*([0-9a-fA-F]*)", 1)
        digits = F.when(digits == "", "0").otherwise(digits)
        number = F.when(
            F.length(digits) <= 8,
            F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits),
        ).try_cast("long")
        return let(number, _code_point)

    def named(token: Column) -> Column:
        whole = F.element_at(F.element_at(names, F.left(token, F.lit(1))), token)
        prefix = F.regexp_extract(token, bare_pattern, 1)
        shortened = F.when(
            prefix != "",
            F.concat(F.element_at(bare, prefix), F.substr(token, F.length(prefix) + 1)),
        )
        return F.coalesce(whole, shortened, F.concat(F.lit("&"), token))

    def decode(token: Column) -> Column:
        text = (
            F.when(token == "", F.lit("&"))
            .when(token.startswith("#"), numeric(token))
            .otherwise(named(token))
        )
        return F.concat(text, F.substr(after, F.length(token) + 1))

    return let(F.regexp_extract(after, token_pattern, 1), decode)


def html_unescape(text: Column) -> Column:
    """Decode HTML5 named and numeric character references, one level."""

    def decode(parts: Column) -> Column:
        rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.concat(
            F.element_at(parts, 1), F.array_join(F.transform(rest, _decode_reference), "")
        )

    return let(
        text, lambda t: F.when(t.contains("&"), let(F.split(t, "&", -1), decode)).otherwise(t)
    )


def headword(word: Column) -> Column:
    return F.replace(word, F.lit("_"), F.lit(" "))


def dsl_quote(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def capitalize(text: Column) -> Column:
    """First character upper case, the rest lower case.

    For language codes: the few characters whose title case is not their upper
    case, such as a sharp s or a digraph, get upper case here.
    """
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def contains_ci(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def language_names(names: dict[str, str] | None = None) -> Column:
    pairs = (names if names is not None else LANGUAGE_NAMES).items()
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def language_name(code: Column, names: dict[str, str] | None = None) -> Column:
    """Name for a code; an unlisted code is capitalized, no code is Unknown."""
    listed = F.element_at(language_names(names), code)
    return F.coalesce(listed, F.nullif(capitalize(code), F.lit("")), F.lit("Unknown"))


def dictionary_name(
    name: Column, source: Column, target: Column, entry: Column | None = None,
    names: dict[str, str] | None = None,
) -> Column:
    """``name (from-to)``, where the entry language goes before the source one."""
    shown = source if entry is None else F.coalesce(F.nullif(entry, F.lit("")), source)
    return F.concat(
        name, F.lit(" ("), language_name(shown, names), F.lit("-"), language_name(target, names), F.lit(")")
    )
