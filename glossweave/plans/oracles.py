"""The same results as :mod:`.queries`, in SQL over the given tables.

Constructed pages never appear here: what they must yield follows from the
document rows they are made of.
"""

from __future__ import annotations

from ..constants import LANGUAGE_NAMES, SCRIPTS, SPACE_CLASS
from ..functions.collation import builtin_collation, translate_arguments
from ..rule_texts import MORPHOLOGY
from . import fixtures as B
from .queries import BATCH_SIZE, CONVERT_LIMIT, CONVERT_XDXF, PAGE_LIMIT, RULE_LANGUAGES, STREAM_BATCHES, WANTED_SCRIPTS

ORACLES: dict[str, str] = {}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- text -------------------------------------------------------------------

def strip(e: str) -> str:
    return (
        f"regexp_replace(regexp_replace({e}, '^{SPACE_CLASS}+', ''), '{SPACE_CLASS}+$', '')"
    )


def unescape(e: str) -> str:
    """References that occur in the tables, the ampersand last."""
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        e = f"regexp_replace({e}, '&{name};?', '{char}', 'g')"
    return e


def clean(e: str, decode: bool = False) -> str:
    """The text rules in their original order."""
    e = f"regexp_replace({strip(e)}, '<[^>]+>', '', 'g')"
    e = f"regexp_replace({e}, '\\({SPACE_CLASS}+', '(', 'g')"
    e = f"regexp_replace({e}, '{SPACE_CLASS}+\\)', ')', 'g')"
    e = f"regexp_replace({e}, '{SPACE_CLASS}+([,.;:!?])', '\\1', 'g')"
    e = f"regexp_replace({e}, '{SPACE_CLASS}+', ' ', 'g')"
    return unescape(e) if decode else e


def escape(e: str) -> str:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        e = f"replace({e}, '{char}', '{name}')"
    return e


def capitalized(e: str) -> str:
    return f"(upper(left({e}, 1)) || lower(substr({e}, 2)))"


def lang_name(e: str) -> str:
    cases = " ".join(f"WHEN {_quote(k)} THEN {_quote(v)}" for k, v in LANGUAGE_NAMES.items())
    return f"(CASE {e} {cases} WHEN '' THEN 'Unknown' ELSE {capitalized(e)} END)"


ORACLES["clean_text"] = f"SELECT doc_id, {clean('text')} AS cleaned FROM documents"
ORACLES["clean_html"] = f"SELECT page_id, {clean('html', True)} AS cleaned FROM pages"
ORACLES["html_unescape"] = f"SELECT page_id, {unescape('html')} AS decoded FROM pages"
ORACLES["html_escape"] = f"SELECT page_id, {escape('html')} AS escaped FROM pages"
_NAME = "p_name || '_' || p_brand || '_\"q\"'"
ORACLES["headword"] = f"""
SELECT p_partkey, replace({_NAME}, '_', ' ') AS headword, replace({_NAME}, '"', '\\"') AS quoted FROM part
"""
ORACLES["language_name"] = f"""
SELECT doc_id, {lang_name('lang')} AS name, {lang_name('source')} AS unlisted, 'Unknown' AS missing
FROM documents
"""
ORACLES["dictionary_name"] = f"""
SELECT doc_id, source || ' (' || {lang_name('lang')} || '-Russian)' AS plain,
       source || ' (' || {lang_name('source')} || '-' || {lang_name('lang')} || ')' AS with_entry
FROM documents
"""
ORACLES["case_functions"] = f"""
SELECT doc_id, {capitalized('source')} AS capitalized, lower(text) AS lowered,
       contains(lower(text), 'the') AS has_the
FROM documents
"""
ORACLES["text_strip"] = f"SELECT doc_id, {strip('text')} AS stripped FROM documents"

# --- names and scripts ------------------------------------------------------
_SEGMENTS = """
SELECT page_id, CAST(generate_subscripts(string_split(url, '/'), 1) - 1 AS INTEGER) AS segment,
       unnest(string_split(url, '/')) AS name
FROM pages
"""
ORACLES["page_name_filter"] = f"""
SELECT page_id, segment, name,
       NOT (regexp_matches(name, '^(?s:.+)\\.[^.]+$')) AND NOT starts_with(name, '.') AS kept
FROM ({_SEGMENTS})
"""
ORACLES["stem_name"] = f"""
SELECT page_id, segment, regexp_replace(name, '^(.+)\\.[^.]+$', '\\1') AS stem FROM ({_SEGMENTS})
"""

_WORDS = """
SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents)
WHERE word <> ''
"""
_FORMS = f"""
SELECT 0 AS form, word FROM ({_WORDS})
UNION ALL SELECT 1, translate(word, '{B.ALPHABET}', '{B.CYRILLIC_ALPHABET}') FROM ({_WORDS})
UNION ALL SELECT 2, translate(word, '{B.ALPHABET}', '{B.GREEK_ALPHABET}') FROM ({_WORDS})
UNION ALL SELECT 3, translate(word, '{B.VOWELS}', '{B.MIXED_SIGNS}') FROM ({_WORDS})
"""


def _class_body(name: str, without: tuple = ()) -> str:
    ranges = [r for r in dict(SCRIPTS)[name] if r not in without]
    return "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in ranges)


def script_count(name: str) -> str:
    """Alphanumeric characters of the stem that are left after removing all others."""
    without = dict(SCRIPTS)["chinese"] if name == "japanese" else ()
    base = "regexp_replace(regexp_replace(word, '^(.+)\\.[^.]+$', '\\1'), '[^\\p{L}\\p{N}]', '', 'g')"
    left = f"length(regexp_replace({base}, '[^{_class_body(name, without)}]', '', 'g'))"
    return f"CAST({left} AS INTEGER)"


_SCRIPT_NAMES = [name for name, _ in SCRIPTS]


def counted(rows: str, columns: str) -> str:
    """Rows with the counts of all scripts in ``word``."""
    return f"SELECT {columns}, " + ", ".join(f"{script_count(n)} AS {n}" for n in _SCRIPT_NAMES) + f" FROM ({rows})"


_COUNTED = counted(_FORMS, "form, word")
_DOMINANT = (
    f"CASE WHEN greatest({', '.join(_SCRIPT_NAMES)}) = 0 THEN 'unknown' "
    + " ".join(f"WHEN {n} = greatest({', '.join(_SCRIPT_NAMES)}) THEN '{n}'" for n in _SCRIPT_NAMES)
    + " END"
)
ORACLES["char_in_script"] = "SELECT form, word, " + ", ".join(
    f"regexp_matches(word, '^[{_class_body(n)}]') AS {n}" for n in _SCRIPT_NAMES
) + f", false AS unlisted FROM ({_FORMS})"
ORACLES["alphanumeric_part"] = (
    f"SELECT form, word, regexp_replace(word, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS kept FROM ({_FORMS})"
)
ORACLES["word_script_counts"] = (
    f"SELECT form, word, {', '.join(_SCRIPT_NAMES)} FROM ({_COUNTED})"
)
ORACLES["script_histogram"] = " UNION ALL ".join(
    f"SELECT '{n}' AS script, CAST(coalesce(sum({n}), 0) AS BIGINT) AS characters FROM ({_COUNTED})"
    for n in _SCRIPT_NAMES
)
ORACLES["word_dominant_script"] = f"SELECT form, word, {_DOMINANT} AS script FROM ({_COUNTED})"


def in_scripts(scripts) -> str:
    names = ", ".join(f"'{n}'" for n in scripts)
    return f"(regexp_matches(word, '^[{''.join(_class_body(n) for n in scripts)}]') OR {_DOMINANT} IN ({names}))"


_IN_SCRIPTS = in_scripts(WANTED_SCRIPTS)
ORACLES["script_filter"] = f"SELECT form, word FROM ({_COUNTED}) WHERE {_IN_SCRIPTS}"
ORACLES["stage_counts"] = f"""
SELECT count(*) AS found, count(*) FILTER (WHERE {_IN_SCRIPTS}) AS in_scripts,
       least(count(*) FILTER (WHERE {_IN_SCRIPTS}), 1000) AS after_limit
FROM ({_COUNTED})
WHERE NOT regexp_matches(word, '^.+\\.[^.]+$') AND NOT starts_with(word, '.')
"""

# --- nodes ------------------------------------------------------------------


def tag_count(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(html, '{pattern}')) AS INTEGER)"


def tag_text(e: str) -> str:
    return strip(unescape(f"regexp_replace({e}, '<[^>]+>', '', 'g')"))


def extracted(pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all(html, '{pattern}', {group})"


ORACLES["node_counts"] = f"""
SELECT page_id, {tag_count('<li>')} AS li, {tag_count('<a ')} AS a, {tag_count('<h1>')} AS h1,
       {tag_count('<p>')} AS p
FROM pages
"""


def _elements(pattern: str) -> str:
    return f"""
SELECT page_id, CAST(generate_subscripts({extracted(pattern, 0)}, 1) AS INTEGER) AS ord, unnest({extracted(pattern, 0)}) AS e
FROM pages
"""


ORACLES["node_text"] = f"""
SELECT page_id, regexp_extract(e, '^<([a-z0-9]+)', 1) AS tag, ord, {tag_text('e')} AS content
FROM ({_elements('<li>.*?</li>|<h1>.*?</h1>')})
"""
ORACLES["nearest_list"] = f"""
SELECT page_id, ord, regexp_extract(e, '^<([a-z0-9]+)', 1) AS tag, {tag_text('e')} AS content,
       CASE WHEN starts_with(e, '<a ') THEN 'ul' END AS container
FROM ({_elements('<a .*?</a>|<h1>.*?</h1>')})
"""
ORACLES["nearest_article"] = f"""
SELECT page_id, 'li' AS tag, CAST(NULL AS VARCHAR) AS container, CAST({tag_count('<li>')} AS BIGINT) AS n
FROM pages WHERE contains(html, '<li>')
UNION ALL
SELECT page_id, 'h1', 'article', {tag_count('<h1>')} FROM pages WHERE contains(html, '<h1>')
UNION ALL
SELECT page_id, 'p', 'article', {tag_count('<p>')} FROM pages WHERE contains(html, '<p>')
"""
def _placed(tag: str, pattern: str) -> str:
    """Every match of ``pattern`` in a page: its number, text and place (code points before it)."""
    return f"""
    SELECT page_id, '{tag}' AS tag, CAST(k AS INTEGER) AS ord, e,
           CAST(sum(length(g) + length(e)) OVER (PARTITION BY page_id ORDER BY k) - length(e) AS BIGINT) AS pos
    FROM (SELECT page_id, unnest(ms) AS e, unnest(gs[1:len(ms)]) AS g, unnest(range(1, len(ms) + 1)) AS k
          FROM (SELECT page_id, regexp_extract_all(html, '{pattern}') AS ms, string_split_regex(html, '{pattern}') AS gs
                FROM pages))"""


def _spans(tag: str) -> str:
    """Where each element of a tag that never nests opens and closes."""
    return f"""
    SELECT o.page_id, o.tag, o.ord, o.pos AS start, c.pos AS stop
    FROM ({_placed(tag, f'<{tag}[ >]')}) o JOIN ({_placed(tag, f'</{tag}>')}) c ON o.page_id = c.page_id AND o.ord = c.ord"""


_TARGETS = {"a": "<a .*?</a>", "li": "<li>.*?</li>", "h1": "<h1>.*?</h1>", "p": "<p[ >]"}
_SPANS = " UNION ALL ".join(_spans(t) for t in ("ul", "ol", "article"))

ORACLES["interval_items"] = f"""
WITH s AS ({_SPANS}),
     t AS ({" UNION ALL ".join(_placed(t, _TARGETS[t]) for t in ("li", "a", "h1"))})
SELECT t.page_id, s.tag AS outer_tag, s.ord AS outer_ord, t.tag AS inner_tag, t.ord AS inner_ord, {tag_text('t.e')} AS content
FROM t JOIN s ON t.page_id = s.page_id AND s.start < t.pos AND t.pos < s.stop
"""
ORACLES["any_ancestor"] = f"""
WITH s AS ({" UNION ALL ".join(_spans(t) for t in ("ul", "article"))}),
     t AS ({" UNION ALL ".join(_placed(t, _TARGETS[t]) for t in ("a", "li", "h1", "p"))})
SELECT t.page_id, t.tag, t.ord,
       (SELECT max_by(s.ord, s.start) FROM s WHERE s.tag = 'ul' AND s.page_id = t.page_id AND s.start <= t.pos AND t.pos < s.stop) AS ul,
       (SELECT max_by(s.ord, s.start) FROM s WHERE s.tag = 'article' AND s.page_id = t.page_id AND s.start <= t.pos
           AND t.pos < s.stop) AS article
FROM t
"""
ORACLES["any_ancestor_joined"] = ORACLES["any_ancestor"]

ORACLES["descendant_items"] = f"""
SELECT page_id,
       coalesce(array_to_string(list_transform({extracted('<li>(.*?)</li>')}, lambda x: {tag_text('x')}), '|'), '') AS items,
       {tag_count('<p>')} AS paragraphs
FROM pages
"""
ORACLES["node_predicates"] = f"""
SELECT page_id, contains(html, '<html lang="en">') AS is_en,
       contains(regexp_extract(html, '<html lang="([a-z]*)">', 1), 'e') AS lang_has_e,
       {tag_count('class="ad"')} AS ads, {tag_count('<(div|article)[ >]')} AS blocks
FROM pages
"""
ORACLES["document_order"] = f"""
SELECT page_id, array_to_string({extracted('<(ul|li|div|article|h1|p|footer)[ >]')}, ' ') AS tags FROM pages
"""
ORACLES["first_in_doc_order"] = f"""
SELECT page_id, {tag_text("regexp_extract(html, '<a .*?</a>')")} AS content, 'ul' AS container FROM pages
"""

# --- sections ---------------------------------------------------------------
_ROWS = f"""
SELECT doc_id AS page_id, regexp_extract(text, '\\p{{L}}+') || '_' || source AS word, text, lang, source,
       {lang_name('lang')} AS lang_name
FROM documents
"""
_SECTION_TEXT = clean("lang_name || ' Noun ' || text")
for _method in range(1, 9):
    ORACLES[f"section_m{_method}"] = (
        f"SELECT page_id, {_method} AS method, {_SECTION_TEXT} AS section_text FROM ({_ROWS})"
    )
ORACLES["section_cascade"] = f"""
SELECT page_id, CAST(method AS INTEGER) AS method, {_SECTION_TEXT} AS section_text
FROM ({_ROWS}) CROSS JOIN range(1, 9) AS m(method)
"""
ORACLES["section_strict"] = f"""
SELECT page_id, CAST(page_no AS INTEGER) AS page_no, CASE page_no WHEN 0 THEN 1 ELSE 4 END AS method
FROM ({_ROWS}) CROSS JOIN range(0, 3) AS p(page_no)
"""
ORACLES["section_required"] = f"SELECT page_id, word FROM ({_ROWS}) WHERE lang = 'es'"

_LINE_COUNT = "CAST(len(string_split(text, chr(10))) AS INTEGER)"
# ord, heading, has list, items
_RICH_PARTS = [
    ("'Noun (n)'", True, _LINE_COUNT),
    (clean("'Translations of ' || word"), True, _LINE_COUNT),
    ("'Empty'", False, "0"),
    ("NULL", True, "1"),
    ("'Bare'", True, "0"),
    ("'see ALSO'", True, "1"),
    ("'Verb'", True, "1"),
    ("'Adjective'", True, "3"),
]
_PARTS = " UNION ALL ".join(
    f"SELECT page_id, {i} AS ord, {pos} AS pos, {str(listed).lower()} AS has_list, {items} AS items FROM ({_ROWS})"
    for i, (pos, listed, items) in enumerate(_RICH_PARTS)
)
ORACLES["pos_sections"] = f"SELECT page_id, ord, pos FROM ({_PARTS})"
ORACLES["section_has_heading"] = f"SELECT page_id, pos FROM ({_PARTS}) WHERE pos IS NOT NULL"
ORACLES["excluded_sections"] = f"""
SELECT page_id, pos FROM ({_PARTS})
WHERE pos IS NOT NULL AND NOT contains(pos, 'Translations') AND pos <> 'see ALSO'
"""
ORACLES["section_has_list"] = f"SELECT page_id, ord, pos FROM ({_PARTS}) WHERE has_list"
ORACLES["nonempty_items"] = f"SELECT page_id, ord, items FROM ({_PARTS}) WHERE items > 0"
ORACLES["virtual_sections"] = " UNION ALL ".join(
    f"SELECT page_id, {i} AS ord, '{pos}' AS pos, {items} AS items FROM ({_ROWS})"
    for i, (pos, items) in enumerate(
        [("Noun", _LINE_COUNT + " + 2"), ("Usage", "2"), ("Verb", "1"), ("Wrapped", "0")]
    )
)
ORACLES["section_end"] = " UNION ALL ".join(
    f"SELECT page_id, '{tag}' AS tag, '{heading}' AS heading, {stop} AS stopped_by FROM ({_ROWS})"
    for tag, heading, stop in [
        ("h3", "Noun", "'Verb'"), ("h4", "Usage", "'Verb'"), ("h3", "Verb", "'End'"),
        ("h3", "Wrapped", "CAST(NULL AS VARCHAR)"),
    ]
)

# --- definitions ------------------------------------------------------------


def lines(column: str, pos_ord: int, pos: str, first: int | str = 0) -> str:
    """Definition rows of a list with one item per line of ``column``."""
    split = f"string_split({column}, chr(10))"
    return f"""
SELECT page_id, word, {pos_ord} AS pos_ord, '{pos}' AS pos, CAST(n - 1 + {first} AS INTEGER) AS def_ord, {clean('line')} AS definition
FROM (SELECT *, generate_subscripts({split}, 1) AS n, unnest({split}) AS line FROM ({_ROWS}))
"""


_ADJECTIVE = [("'outer ' || source", 0), ("source", 1), ("source", 2)]
_RICH = " UNION ALL ".join(
    [
        lines("text", 0, "Noun (n)"),
        lines("source", 1, "Verb"),
        lines("'outer ' || source", 2, "Adjective"),
        lines("source", 2, "Adjective", 1),
        lines("source", 2, "Adjective", 2),
    ]
)
_REPEATED = " UNION ALL ".join([lines("word", 0, "Noun"), lines("source", 1, "Verb")])
ORACLES["definitions_long"] = _RICH
ORACLES["nested_items"] = " UNION ALL ".join(
    [
        lines("text", 0, "Etymology"),
        lines("source", 0, "Etymology", _LINE_COUNT),
        lines("word", 0, "Etymology", f"{_LINE_COUNT} + 1"),
        lines("source", 1, "Noun"),
    ]
)
ORACLES["flat_definitions"] = " UNION ALL ".join(
    [
        lines("text", 0, "Noun"),
        lines("source", 0, "Noun", _LINE_COUNT),
        lines("lang", 0, "Noun", f"{_LINE_COUNT} + 1"),
        lines("source", 1, "Usage"),
        lines("lang", 1, "Usage", 1),
        lines("word", 2, "Verb"),
    ]
)
ORACLES["fold_last_wins"] = _REPEATED
_LINE_PARTS = """
SELECT doc_id, lang, CAST(n - 1 AS INTEGER) AS n, CAST(n - 1 AS INTEGER) AS ord, defs
FROM (SELECT doc_id, lang, generate_subscripts(string_split(text, chr(10)), 1) AS n,
             unnest(string_split(text, chr(10))) AS defs FROM documents)
"""
ORACLES["fold_rows"] = f"""
SELECT doc_id, lang, min(ord) AS ord, arg_max(defs, ord) AS defs FROM ({_LINE_PARTS}) GROUP BY doc_id, lang
"""
ORACLES["last_per_key"] = f"""
SELECT doc_id, lang, n, ord, defs, min(ord) OVER (PARTITION BY doc_id, lang) AS first_ord
FROM ({_LINE_PARTS})
QUALIFY row_number() OVER (PARTITION BY doc_id, lang ORDER BY ord DESC) = 1
"""


def joined(value: str, separator: str) -> str:
    """Rich definitions of a page as one text: heading groups in order."""
    return f"string_agg({value}, {separator} ORDER BY pos_ord, def_ord)"


ORACLES["entries"] = f"""
SELECT page_id, word, string_agg(pos || ': ' || defs, ' / ' ORDER BY pos_ord) AS entry
FROM (SELECT page_id, word, pos_ord, pos, {joined('definition', "'; '")} AS defs
      FROM ({_RICH}) GROUP BY page_id, word, pos_ord, pos)
GROUP BY page_id, word
"""
ORACLES["pages_with_definitions"] = (
    f"SELECT page_id, word, 3 AS parts FROM ({_ROWS}) WHERE lang = 'es'"
)
ORACLES["custom_exclusions"] = f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos_ord) - 1 AS INTEGER) AS pos_ord, pos,
       CAST(n AS BIGINT) AS n FROM (
  SELECT page_id, 0 AS pos_ord, {clean("'Translations of ' || word")} AS pos, {_LINE_COUNT} AS n FROM ({_ROWS})
  UNION ALL SELECT page_id, 1, 'see ALSO', 1 FROM ({_ROWS})
  UNION ALL SELECT page_id, 2, 'Adjective', 3 FROM ({_ROWS}))
WHERE NOT contains(lower(pos), 'noun') AND NOT contains(lower(pos), 'verb')
"""
ORACLES["deduped_nested"] = " UNION ALL ".join(
    [
        lines("text", 0, "Noun (n)"),
        lines("source", 1, "Verb"),
        lines("'outer ' || source", 2, "Adjective"),
        lines("source", 2, "Adjective", 1),
    ]
)

# --- output -----------------------------------------------------------------
_NL = "chr(10)"


def rendered(definitions: str, heading: str, item: str, head: str, foot: str) -> str:
    return f"""
SELECT page_id, word, {head} || {_NL} || string_agg(block, {_NL} ORDER BY pos_ord){foot} AS value
FROM (SELECT page_id, word, pos_ord, {heading} || {_NL} || {joined(item, _NL)} AS block
      FROM ({definitions}) GROUP BY page_id, word, pos_ord, pos)
GROUP BY page_id, word
"""


def dsl(definitions: str) -> str:
    return rendered(
        definitions, "'  [c]' || pos || '[/c]'", "'  ' || definition", "replace(word, '_', ' ')", ""
    )


def xdxf(definitions: str) -> str:
    word = escape("replace(word, '_', ' ')")
    return rendered(
        definitions,
        f"'<pos>' || {escape('pos')} || '</pos>'",
        f"'<def>' || {escape('definition')} || '</def>'",
        f"'<ar><k>' || {word} || '</k>'",
        f" || {_NL} || '</ar>'",
    )


ORACLES["rendered_dsl"] = f"SELECT page_id, value FROM ({dsl(_RICH)})"
ORACLES["rendered_xdxf"] = f"SELECT page_id, value FROM ({xdxf(_RICH)})"

_DSL_HEADER = [
    '#NAME "My \\"Dictionary\\" (Français-Xx)"',
    '#INDEX_LANGUAGE "English"',
    '#CONTENTS_LANGUAGE "Xx"',
    "#CHARSET UTF-8",
    "",
]
_XDXF_HEADER = [
    '<?xml version="1.0" encoding="UTF-8" ?>',
    '<!DOCTYPE xdxf SYSTEM "https://raw.github.com/soshial/xdxf_makedict/master/format_standard/xdxf_strict.dtd">',
    '<xdxf lang_from="english" lang_to="spanish" format="visual">',
    "<full_name>My &quot;Dictionary&quot; &amp; more (English-Spanish)</full_name>",
    "<description>Converted from Wiktionary</description>",
    "<abbreviations>",
    "</abbreviations>",
    "<xdxf_body>",
]
_XDXF_FOOTER = ["</xdxf_body>", "</xdxf>"]


def framed(body: str, header: list[str], footer: list[str]) -> str:
    fixed = [(0, i, v) for i, v in enumerate(header)] + [(2, i, v) for i, v in enumerate(footer)]
    values = ", ".join(f"({s}, {i}, '', NULL, {_quote(v)})" for s, i, v in fixed)
    return f"""
SELECT section, line, word, page_id, value FROM (VALUES {values}) AS t(section, line, word, page_id, value)
UNION ALL SELECT 1, 0, word, page_id, value FROM ({body})
"""


_FRAMED_XDXF = framed(xdxf(_REPEATED), _XDXF_HEADER, _XDXF_FOOTER)
_FRAMED_DSL = framed(dsl(_REPEATED), _DSL_HEADER, [])
ORACLES["framed_xdxf"] = _FRAMED_XDXF
ORACLES["framed_dsl"] = _FRAMED_DSL
ORACLES["written_xdxf"] = f"SELECT unnest(string_split(value, {_NL})) AS value FROM ({_FRAMED_XDXF})"
ORACLES["written_dsl"] = f"SELECT unnest(string_split(value, {_NL})) AS value FROM ({_FRAMED_DSL})"
ORACLES["single_file_xdxf"] = ORACLES["written_xdxf"]
ORACLES["single_file_dsl"] = ORACLES["written_dsl"]
_LETTER_RUNS = "regexp_extract_all(text, '\\p{L}+')"
_RUN_WORDS = f"""
SELECT page_id, coalesce(lower({_LETTER_RUNS}[1]), '') AS first_word, coalesce(lower({_LETTER_RUNS}[2]), '') AS second_word
FROM ({_ROWS})
"""
ORACLES["merged_files"] = f"""
SELECT second_word AS word, 2 AS parts FROM ({_RUN_WORDS})
UNION ALL
SELECT first_word, 3 FROM ({_RUN_WORDS})
WHERE first_word NOT IN (SELECT second_word FROM ({_RUN_WORDS}))
"""
ORACLES["merged_dictionary"] = f"""
SELECT page_id, second_word AS word, 2 AS parts FROM ({_RUN_WORDS})
UNION ALL
SELECT page_id, first_word, 3 FROM ({_RUN_WORDS})
WHERE first_word NOT IN (SELECT second_word FROM ({_RUN_WORDS}))
"""

# --- the whole conversion ---------------------------------------------------


def by_language(e: str) -> str:
    return f"""CASE lang WHEN 'fr' THEN translate(lower({e}), '{B.ALPHABET}', '{B.CYRILLIC_ALPHABET}')
        WHEN 'de' THEN translate(lower({e}), '{B.ALPHABET}', '{B.GREEK_ALPHABET}') ELSE {e} END"""


_NAMED = f"SELECT page_id, {by_language('word')} AS word, text, lang, source FROM ({_ROWS})"


def selected(scripts, limit: int) -> str:
    """Pages that pass the script test, the first ``limit`` of them in headword order."""
    rows = counted(_NAMED, "page_id, word, text, lang, source")
    return f"""
SELECT page_id, word, text, lang, source FROM ({rows}) WHERE {in_scripts(scripts)}
ORDER BY lower(word), word, page_id LIMIT {limit}
"""


def without_noun_and_verb(rows: str) -> str:
    """Definition rows of rich pages whose noun and verb sections are excluded."""
    split = "string_split(text, chr(10))"
    return f"""
SELECT page_id, word, 0 AS pos_ord, {clean("'Translations of ' || word")} AS pos, n - 1 AS def_ord, {clean('line')} AS definition
FROM (SELECT *, generate_subscripts({split}, 1) AS n, unnest({split}) AS line FROM ({rows}))
UNION ALL SELECT page_id, word, 1, 'see ALSO', 0, source FROM ({rows})
UNION ALL SELECT page_id, word, 2, 'Adjective', 0, 'outer ' || source FROM ({rows})
UNION ALL SELECT page_id, word, 2, 'Adjective', 1, source FROM ({rows})
UNION ALL SELECT page_id, word, 2, 'Adjective', 2, source FROM ({rows})
"""


def dsl_escaped(e: str) -> str:
    return f"regexp_replace({e}, '([\\\\\\[\\]{{}}~@^#()])', '\\\\\\1', 'g')"


_XDXF_PAGES = f"SELECT * FROM ({selected(CONVERT_XDXF.scripts, CONVERT_LIMIT)}) WHERE lang = 'fr'"
_DSL_PAGES = f"SELECT * FROM ({selected(('greek',), CONVERT_LIMIT)}) WHERE lang = 'de'"
_CONVERTED_XDXF = framed(
    xdxf(without_noun_and_verb(_XDXF_PAGES)),
    [line.replace("spanish", "russian").replace("English-Spanish", "Français-Russian").replace(" &amp; more", " &amp; more") for line in _XDXF_HEADER],
    _XDXF_FOOTER,
)
_CONVERTED_DSL = framed(
    rendered(
        without_noun_and_verb(_DSL_PAGES),
        f"'  [c]' || {dsl_escaped('pos')} || '[/c]'", f"'  ' || {dsl_escaped('definition')}",
        dsl_escaped("replace(word, '_', ' ')"), "",
    ),
    [line.replace("Français-Xx", "German-Xx") for line in _DSL_HEADER],
    [],
)
ORACLES["converted_xdxf"] = f"SELECT unnest(string_split(value, {_NL})) AS value FROM ({_CONVERTED_XDXF})"
ORACLES["converted_dsl"] = f"SELECT unnest(string_split(value, {_NL})) AS value FROM ({_CONVERTED_DSL})"
_CONVERT_PLACED = f"""
SELECT lang, CAST((row_number() OVER (ORDER BY {"lower(word), word, page_id"}) - 1) // {CONVERT_XDXF.batch_size} AS INTEGER) AS batch
FROM ({selected(CONVERT_XDXF.scripts, CONVERT_LIMIT)})
"""
ORACLES["conversion_counts"] = f"""
SELECT 'found' AS stage, CAST(NULL AS INTEGER) AS batch, count(*) AS pages FROM ({_NAMED})
UNION ALL SELECT 'in_scripts', NULL, count(*) FROM ({selected(CONVERT_XDXF.scripts, 1 << 60)})
UNION ALL SELECT 'after_limit', NULL, count(*) FROM ({selected(CONVERT_XDXF.scripts, CONVERT_LIMIT)})
UNION ALL SELECT 'processed', batch, count(*) FILTER (WHERE lang = 'fr') FROM ({_CONVERT_PLACED}) GROUP BY batch
UNION ALL SELECT 'skipped', batch, count(*) FILTER (WHERE lang <> 'fr') FROM ({_CONVERT_PLACED}) GROUP BY batch
UNION ALL SELECT 'processed', NULL, count(*) FILTER (WHERE lang = 'fr') FROM ({_CONVERT_PLACED})
UNION ALL SELECT 'skipped', NULL, count(*) FILTER (WHERE lang <> 'fr') FROM ({_CONVERT_PLACED})
"""

# --- order, limit, batches, counts ------------------------------------------
_ORDER = "lower(word), word, page_id"
_PLACED = f"SELECT page_id, word, text, row_number() OVER (ORDER BY {_ORDER}) - 1 AS position FROM ({_ROWS})"
ORACLES["sorted_headwords"] = f"SELECT page_id, word, position FROM ({_PLACED})"
ORACLES["limited_pages"] = (
    f"SELECT page_id, word, text FROM ({_ROWS}) ORDER BY {_ORDER} LIMIT {PAGE_LIMIT}"
)
ORACLES["batch_assignment"] = f"""
SELECT page_id, word, position, CAST(position // {BATCH_SIZE} AS INTEGER) AS batch FROM ({_PLACED})
"""
ORACLES["run_stats"] = f"""
SELECT CAST(place // {BATCH_SIZE} AS INTEGER) AS batch, count(*) FILTER (WHERE lang = 'es') AS processed,
       count(*) FILTER (WHERE lang <> 'es') AS skipped
FROM (SELECT lang, row_number() OVER (ORDER BY {_ORDER}) - 1 AS place FROM ({_ROWS}))
GROUP BY ALL
"""

# --- collation and morphology -----------------------------------------------


def translated(e: str, language: str) -> str:
    source, target = translate_arguments(builtin_collation(language))
    return f"translate({e}, {_quote(source)}, {_quote(target)})"


ORACLES["collation_keys"] = f"""
SELECT form, word, {translated('word', 'eng')} AS latin_key, {translated('word', 'rus')} AS cyrillic_key
FROM ({_FORMS})
"""
ORACLES["collation_order"] = f"""
SELECT word, key, row_number() OVER (ORDER BY key, word) - 1 AS position
FROM (SELECT word, {translated('word', 'eng')} AS key FROM ({_WORDS}))
"""


def rule_values(language: str) -> str:
    """Rules of one language as regular expressions, one per ending and variant."""
    text = MORPHOLOGY[language]
    classes = {x[1]: x[3:] for x in text.split("\n") if x.startswith("%")}
    rows = []
    for number, line in enumerate(text.strip("\n").split("\n"), 1):
        if not line.startswith("^"):
            continue
        left, right = line[1:].split("=")
        for i, ending in enumerate(left.split("/"), 1):
            groups = "".join(
                "(.)" if c in "?." else f"([{classes[c]}])" if c.isdigit() else f"({c})" for c in ending
            )
            if not ending.strip("?.") or any(c.isdigit() and c not in classes for c in ending):
                continue
            for j, variant in enumerate(right.split("/"), 1):
                if variant.count(".") > 1:
                    continue
                signs = [f"\\{k + 2}" if k < len(ending) else "" for k in range(len(variant))]
                target = "\\1" + "".join(signs[k] if c == "." else c for k, c in enumerate(variant))
                rows.append(
                    f"({_quote(language)}, {number}, {i}, {j}, {_quote('^(.*)' + groups + '$')}, {_quote(target)})"
                )
    return ", ".join(rows)


_LETTERS = "unnest(regexp_extract_all(lower(text), '\\p{L}+'))"


def ruled(rows: str) -> str:
    """Letter runs of rows (lang, text) by rule language, Cyrillic ones for ``rus``."""
    codes = ", ".join(f"('{lang}', '{code}')" for lang, many in RULE_LANGUAGES.items() for code in many)
    return f"""
SELECT DISTINCT code AS lang,
       CASE code WHEN 'rus' THEN translate(word, '{B.ALPHABET}', '{B.CYRILLIC_ALPHABET}') ELSE word END AS word
FROM (SELECT lang, {_LETTERS} AS word FROM ({rows})) JOIN (VALUES {codes}) AS c(doc_lang, code) ON lang = doc_lang
"""


_RULED = ruled("SELECT lang, text FROM documents")
_CANDIDATES = f"""
SELECT lang, word, 0 AS rule_no, 0 AS left_no, 0 AS right_no, word AS candidate FROM ({_RULED})
UNION ALL
SELECT w.lang, w.word, r.rule_no, r.left_no, r.right_no, regexp_replace(w.word, r.pattern, r.variant)
FROM ({_RULED}) AS w
JOIN (VALUES {', '.join(filter(None, map(rule_values, MORPHOLOGY)))})
  AS r(lang, rule_no, left_no, right_no, pattern, variant)
  ON w.lang = r.lang AND regexp_matches(w.word, r.pattern)
"""
ORACLES["lemma_candidates"] = _CANDIDATES
_EVERY_LANGUAGE = ", ".join(f"('{lang}')" for lang in RULE_LANGUAGES)
_HEADWORDS = ruled(f"SELECT l.lang, b.text FROM benchmark b CROSS JOIN (VALUES {_EVERY_LANGUAGE}) AS l(lang)")


def keyed(e: str) -> str:
    return f"CASE lang WHEN 'rus' THEN {translated(e, 'rus')} ELSE {translated(e, 'eng')} END"


ORACLES["scanned_collation"] = f"SELECT lang, word, {keyed('word')} AS key FROM ({_RULED})"
ORACLES["lemma_lookup"] = f"""
SELECT c.lang, c.word, h.headword, c.rule_no, c.left_no, c.right_no
FROM (SELECT *, {keyed('candidate')} AS key FROM ({_CANDIDATES})) AS c
JOIN (SELECT lang, {keyed('word')} AS key, min(word) AS headword FROM ({_HEADWORDS}) GROUP BY ALL) AS h
  ON c.lang = h.lang AND c.key = h.key AND c.key <> ''
QUALIFY row_number() OVER (PARTITION BY c.lang, c.word ORDER BY c.rule_no, c.left_no, c.right_no) = 1
"""

# --- sources ----------------------------------------------------------------
ORACLES["packed_scan"] = "SELECT page_id, url AS word, html FROM pages"
ORACLES["packed_selection"] = f"SELECT page_id, word FROM ({selected(CONVERT_XDXF.scripts, CONVERT_LIMIT)})"
ORACLES["page_dir_roundtrip"] = """
SELECT 'word ' || page_id AS word, html FROM pages
UNION ALL SELECT '_' || page_id, html FROM pages
UNION ALL SELECT 'nothing', ''
"""
_FILES = f"SELECT page_id, {by_language("word || '_' || page_id")} AS word, text, lang, source FROM ({_ROWS})"
_SLICED = f"""
SELECT *, (row_number() OVER (ORDER BY word) - 1) // (SELECT (count(*) + {STREAM_BATCHES} - 1) // {STREAM_BATCHES} FROM documents) AS slice
FROM ({_FILES})
"""
_STREAMED = f"""
SELECT * FROM ({counted(_SLICED, "page_id, word, text, lang, source, slice")}) WHERE {in_scripts(("cyrillic", "latin"))}
"""
_FRENCH = f"SELECT page_id, word, text, source FROM ({_STREAMED}) WHERE lang = 'fr'"


def french_lines(column: str, pos_ord: int, pos: str, first: int = 0) -> str:
    split = f"string_split({column}, chr(10))"
    return f"""
SELECT word, {pos_ord} AS pos_ord, '{pos}' AS pos, CAST(n - 1 + {first} AS INTEGER) AS def_ord, {clean('line')} AS definition
FROM (SELECT *, generate_subscripts({split}, 1) AS n, unnest({split}) AS line FROM ({_FRENCH}))
"""


ORACLES["streamed_ingest"] = " UNION ALL ".join(
    [french_lines("text", 0, "Noun (n)"), french_lines("source", 1, "Verb")]
    + [french_lines(e, 2, "Adjective", first) for e, first in _ADJECTIVE]
)
ORACLES["streamed_counts"] = f"""
SELECT slice, count(*) FILTER (WHERE lang = 'fr') AS processed, count(*) FILTER (WHERE lang <> 'fr') AS skipped
FROM ({_STREAMED}) GROUP BY slice
"""

# --- SQL names --------------------------------------------------------------
ORACLES["sql_functions"] = f"""
SELECT doc_id, {strip('text')} AS stripped, {escape('text')} AS escaped, source || ' x' AS word, source || '\\"' AS quoted,
    {capitalized('source')} AS capitalized, contains(lower(text), 'the') AS has_the, {lang_name('lang')} AS language,
    source || ' (' || {lang_name('lang')} || '-Russian)' AS title, source AS stem,
    regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS letters, true AS is_page,
    {translated('text', 'eng')} AS latin_key, {translated('text', 'rus')} AS cyrillic_key,
    regexp_matches(text, '^[{_class_body('latin')}]') AS latin, regexp_matches(text, '^[{_class_body('greek')}]') AS greek
FROM documents
"""
