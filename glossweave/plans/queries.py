"""Every operator as a query over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.collation import builtin_collation, collation_key, collation_pairs, language_key
from ..functions.render import render_dsl, render_xdxf
from ..functions.scripts import (
    SCRIPT_NAMES,
    alphanumeric,
    dominant_script,
    in_scripts,
    is_in_script,
    is_page_name,
    script_counts,
    stem,
)
from ..functions.sql_names import register_functions
from ..operators import definitions as D
from ..operators import headwords as H
from ..operators import intervals as I
from ..operators import morphology as M
from ..operators import nodes as N
from ..operators import stats as ST
from ..operators.axes import (
    descendants,
    explode_elements,
    list_items,
    nearest_container,
    text_content,
)
from ..operators.sections import with_section
from ..params import ConvertParams
from ..session import cut, new_scratch_path
from ..rule_texts import MORPHOLOGY
from ..sources.packed import pack_pages, scan_packed
from ..sources.pages import scan_page_dir, scan_pages, spread, stream_page_dir
from ..sources.rules import builtin_morphology, scan_collation, scan_morphology
from ..sources.dictionary_files import read_dictionary
from ..sources.sinks import frame_output, merge_dictionaries, write_dictionary, write_single_file
from ..streaming.ingest import batch_stats, ingest_batches, read_outcomes
from . import fixtures as B
from .convert import conversion_counts as count_conversion
from .convert import convert, extract_entries, page_outcomes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PARAMS = ConvertParams(source_lang="en", target_lang="es", name='My "Dictionary" & more')
DSL_PARAMS = ConvertParams(
    source_lang="en", target_lang="xx", entry_lang="fr", name='My "Dictionary"', fmt="lingvo"
)
BATCH_SIZE = 100
PAGE_LIMIT = 50
WANTED_SCRIPTS = ("cyrillic", "japanese")
# Which rules words of a document language meet; French ones as they are and in Cyrillic letters.
RULE_LANGUAGES = {"en": ("eng",), "es": ("es",), "de": ("oc",), "fr": ("ca", "rus")}
# Tasks for the costly work on tables of few splits.
MIN_TASKS = 16
STREAM_BATCHES = 4
CONVERT_LIMIT = 150
CONVERT_XDXF = ConvertParams(
    source_lang="en", target_lang="ru", entry_lang="fr", name='My "Dictionary" & more', limit=CONVERT_LIMIT,
    scripts=("cyrillic", "greek"), excluded_sections=("noun", "VERB"), batch_size=40,
)
CONVERT_DSL = ConvertParams(
    source_lang="en", target_lang="xx", entry_lang="de", name='My "Dictionary"', fmt="lingvo", limit=CONVERT_LIMIT,
    scripts=("greek",), excluded_sections=("noun", "VERB"), escape_dsl=True,
)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for work that is costly per row."""
    return spread(_documents(spark, sf), MIN_TASKS)


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as the raw material of pages that are going to be parsed."""
    return B.documents_as_words(_texts(spark, sf))


def _own_language() -> Column:
    return F.col("lang")


# --- scalar functions -------------------------------------------------------

@query
def clean_text(spark, sf):
    return _texts(spark, sf).select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


@query
def clean_html(spark, sf):
    pages = spread(table(spark, sf, "pages"), MIN_TASKS)
    return pages.select("page_id", X.clean_text(F.col("html")).alias("cleaned"))


@query
def html_unescape(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.html_unescape(F.col("html")).alias("decoded"))


@query
def html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.html_escape(F.col("html")).alias("escaped"))


@query
def headword(spark, sf):
    name = F.concat_ws("_", "p_name", "p_brand", F.lit('"q"'))
    return table(spark, sf, "part").select(
        "p_partkey", X.headword(name).alias("headword"), X.dsl_quote(name).alias("quoted")
    )


@query
def language_name(spark, sf):
    docs = _documents(spark, sf)
    return docs.select(
        "doc_id",
        X.language_name(F.col("lang")).alias("name"),
        X.language_name(F.col("source")).alias("unlisted"),
        X.language_name(F.lit("")).alias("missing"),
    )


@query
def dictionary_name(spark, sf):
    docs = _documents(spark, sf)
    return docs.select(
        "doc_id",
        X.dictionary_name(F.col("source"), F.col("lang"), F.lit("ru")).alias("plain"),
        X.dictionary_name(F.col("source"), F.lit("ca"), F.col("lang"), F.col("source")).alias("with_entry"),
    )


@query
def case_functions(spark, sf):
    docs = _documents(spark, sf)
    return docs.select(
        "doc_id",
        X.capitalize(F.col("source")).alias("capitalized"),
        F.lower("text").alias("lowered"),
        X.contains_ci(F.col("text"), F.lit("THE")).alias("has_the"),
    )


@query
def text_strip(spark, sf):
    padded = F.concat(F.lit(" \t "), F.col("text"), F.lit("  \n"))
    return _documents(spark, sf).select("doc_id", X.strip(padded).alias("stripped"))


@query
def sql_functions(spark, sf):
    """The scalar functions called by their SQL names."""
    register_functions(spark)
    return spark.sql(
        """
        SELECT doc_id, gw_strip(text) AS stripped, gw_html_escape(text) AS escaped,
            gw_headword(concat(source, '_x')) AS word, gw_dsl_quote(concat(source, '"')) AS quoted,
            gw_capitalize(source) AS capitalized, gw_contains_ci(text, 'THE') AS has_the,
            gw_language_name(lang) AS language, gw_dictionary_name(source, lang, 'ru', '') AS title,
            gw_stem(concat(source, '.x')) AS stem, gw_alphanumeric(text) AS letters,
            gw_is_page_name(source) AS is_page, gw_latin_key(text) AS latin_key,
            gw_cyrillic_key(text) AS cyrillic_key, gw_is_latin(text) AS latin, gw_is_greek(text) AS greek
        FROM {documents}
        """,
        documents=_documents(spark, sf),
    )


# --- names and scripts ------------------------------------------------------

@query
def page_name_filter(spark, sf):
    names = table(spark, sf, "pages").select("page_id", F.posexplode(F.split("url", "/")).alias("segment", "name"))
    return names.select("page_id", "segment", "name", is_page_name(F.col("name")).alias("kept"))


@query
def stem_name(spark, sf):
    names = table(spark, sf, "pages").select("page_id", F.posexplode(F.split("url", "/")).alias("segment", "name"))
    return names.select("page_id", "segment", stem(F.col("name")).alias("stem"))


@query
def char_in_script(spark, sf):
    words = B.words_in_scripts(_texts(spark, sf))
    first = F.left(F.col("word"), F.lit(1))
    listed = [is_in_script(first, name).alias(name) for name in SCRIPT_NAMES]
    return words.select("form", "word", *listed, is_in_script(first, "klingon").alias("unlisted"))


@query
def alphanumeric_part(spark, sf):
    words = B.words_in_scripts(_texts(spark, sf))
    return words.select("form", "word", alphanumeric(F.col("word")).alias("kept"))


@query
def word_script_counts(spark, sf):
    words = B.words_in_scripts(_texts(spark, sf))
    counted = N.once(words, "counts", script_counts(F.col("word")))
    return counted.select(
        "form", "word", *[F.get("counts", F.lit(i)).alias(name) for i, name in enumerate(SCRIPT_NAMES)]
    )


@query
def script_histogram(spark, sf):
    return ST.script_histogram(B.words_in_scripts(_texts(spark, sf)))


@query
def word_dominant_script(spark, sf):
    return B.words_in_scripts(_texts(spark, sf)).select(
        "form", "word", dominant_script(F.col("word")).alias("script")
    )


@query
def script_filter(spark, sf):
    words = B.words_in_scripts(_texts(spark, sf))
    return words.where(in_scripts(F.col("word"), WANTED_SCRIPTS))


@query
def stage_counts(spark, sf):
    words = B.words_in_scripts(_texts(spark, sf)).select("word")
    return ST.count_stages(words, WANTED_SCRIPTS, limit=1000)


# --- nodes and axes ---------------------------------------------------------

def _nodes(spark, sf, container):
    pages = spread(table(spark, sf, "pages"), MIN_TASKS)
    return N.with_nodes(pages, container=container, required=None)


@query
def node_counts(spark, sf):
    nodes = F.col("nodes")

    def count(*tags):
        return F.size(F.filter(nodes, lambda n: N.has_tag(n, *tags)))

    return _nodes(spark, sf, "ul").select(
        "page_id", count("li").alias("li"), count("a").alias("a"), count("h1").alias("h1"), count("p").alias("p"),
    )


@query
def node_text(spark, sf):
    return explode_elements(_nodes(spark, sf, "ul"), "li", "h1").select(
        "page_id", "tag", "ord", "content"
    )


@query
def nearest_list(spark, sf):
    return explode_elements(_nodes(spark, sf, "ul"), "a", "h1").select(
        "page_id", "ord", "tag", "content", "container"
    )


@query
def nearest_article(spark, sf):
    found = explode_elements(_nodes(spark, sf, "article"), "li", "h1", "p")
    return found.groupBy("page_id", "tag", "container").agg(F.count("*").alias("n"))


@query
def interval_items(spark, sf):
    """J2/J3 in relational form: list items and links below lists, headings below articles."""
    pairs = I.descendant_pairs(_nodes(spark, sf, "details"), ("ul", "ol", "article"), ("li", "a", "h1"))
    return pairs.select(
        "page_id", "outer_tag", "outer_ord", "inner_tag", "inner_ord", F.col("inner_content").alias("content")
    )


ANCESTOR_TARGETS = ("a", "li", "h1", "p")
ANCESTOR_TAGS = ("ul", "article")


@query
def any_ancestor(spark, sf):
    """J1 for tags asked at query time, two at once, by parent pointers in each page's nodes."""
    nodes = F.col("nodes")

    def numbered(tag):
        found = F.filter(nodes, lambda n: N.has_tag(n, tag))
        return F.map_from_arrays(F.transform(found, lambda n: n["pre"]), F.transform(found, lambda n, i: i + 1))

    def targets(tag):
        return F.transform(
            F.filter(nodes, lambda n: N.has_tag(n, tag)),
            lambda n, i: F.struct(
                n["tag"].alias("tag"), (i + 1).alias("ord"),
                *[F.element_at(numbered(t), I.nearest_with_tag(nodes, n, t)["pre"]).alias(t) for t in ANCESTOR_TAGS],
            ),
        )

    rows = _nodes(spark, sf, "details").select(
        "page_id", F.explode(F.flatten(F.array(*map(targets, ANCESTOR_TARGETS)))).alias("_t")
    )
    return rows.select("page_id", "_t.*")


@query
def any_ancestor_joined(spark, sf):
    """J1 for two tags in relational form: an interval join of the node tables and the nearest per tag."""
    return I.nearest_ancestors(_nodes(spark, sf, "details"), ANCESTOR_TARGETS, ANCESTOR_TAGS)


@query
def descendant_items(spark, sf):
    nodes = F.col("nodes")

    def below(outer, inner):
        first = F.get(F.filter(nodes, lambda n: N.has_tag(n, outer)), F.lit(0))
        return X.let(first, lambda e: descendants(nodes, e, inner))

    items = F.transform(below("ul", "li"), lambda n: text_content(nodes, n))
    return _nodes(spark, sf, "ul").select(
        "page_id",
        F.array_join(items, "|").alias("items"),
        F.size(below("article", "p")).alias("paragraphs"),
    )


@query
def node_predicates(spark, sf):
    nodes = F.col("nodes")
    return _nodes(spark, sf, "ul").select(
        "page_id",
        F.exists(nodes, lambda n: N.has_tag(n, "html") & (n["lang"] == "en")).alias("is_en"),
        F.exists(nodes, lambda n: F.coalesce(N.lang_contains(n, "e"), F.lit(False))).alias("lang_has_e"),
        F.size(F.filter(nodes, lambda n: N.class_contains(n, "ad"))).alias("ads"),
        F.size(F.filter(nodes, lambda n: N.has_tag(n, "div", "article"))).alias("blocks"),
    )


@query
def document_order(spark, sf):
    nodes = F.col("nodes")
    ordered = F.filter(nodes, lambda n: N.has_tag(n, "ul", "li", "div", "article", "h1", "p", "footer"))
    return _nodes(spark, sf, "ul").select(
        "page_id", F.array_join(F.transform(ordered, lambda n: n["tag"]), " ").alias("tags")
    )


@query
def first_in_doc_order(spark, sf):
    nodes = F.col("nodes")
    first = F.get(F.filter(nodes, lambda n: N.has_tag(n, "a")), F.lit(0))
    return _nodes(spark, sf, "ul").select(
        "page_id",
        X.let(first, lambda n: text_content(nodes, n)).alias("content"),
        X.let(first, lambda n: nearest_container(nodes, n)["tag"]).alias("container"),
    )


# --- language sections ------------------------------------------------------

def _sections(pages: DataFrame, only: int | None) -> DataFrame:
    found = with_section(N.with_nodes(pages), _own_language(), only=only)
    nodes = F.col("nodes")
    return found.where(F.col("section").isNotNull()).select(
        "page_id",
        F.col("section.method").alias("method"),
        X.clean_text(text_content(nodes, F.col("section"))).alias("section_text"),
    )


def _section_query(method: int) -> Query:
    def run(spark, sf):
        return _sections(B.section_page(_rows(spark, sf), method), method)

    return run


for _method in range(1, 9):
    QUERIES[f"section_m{_method}"] = _section_query(_method)


@query
def section_cascade(spark, sf):
    """All layouts of every document, from one reading of the documents."""
    return _sections(B.several_pages(_rows(spark, sf), [B.section_body(m) for m in range(1, 9)]), None)


@query
def section_strict(spark, sf):
    """Layouts that name another language's code or name inside a word, by whole words only."""
    pages = B.several_pages(_rows(spark, sf), [B.section_body(m) for m in (1, 3, 4)])
    found = with_section(N.with_nodes(pages), _own_language(), strict=True)
    return found.where(F.col("section").isNotNull()).select("page_id", "page_no", F.col("section.method").alias("method"))


@query
def section_required(spark, sf):
    """Pages kept when one language is asked for on pages of several languages."""
    pages = B.section_page(_rows(spark, sf), 1)
    found = with_section(N.with_nodes(pages), "es", only=1)
    return found.where(F.col("section").isNotNull()).select("page_id", "word")


# --- part-of-speech sections ------------------------------------------------

def _parts(pages: DataFrame) -> DataFrame:
    """One row per part-of-speech span: its number, heading and tests."""
    nodes = F.col("nodes")
    found = with_section(N.with_nodes(pages), _own_language())
    spans = N.once(found, "parts", D.pos_sections(nodes, F.col("section")))

    def describe(p, i):
        heading = D.heading_of(nodes, p)
        texts = list_items(nodes, p["pre"], p["fin"])
        title = X.let(heading, lambda h: X.clean_text(text_content(nodes, h)))
        return F.struct(
            i.alias("ord"),
            heading.isNotNull().alias("has_heading"),
            F.when(heading.isNotNull(), title).alias("pos"),
            D.has_list(nodes, p).alias("has_list"),
            F.size(texts).alias("items"),
        )

    rows = N.once(spans, "_rows", F.transform("parts", describe))
    return rows.select("page_id", F.explode_outer("_rows").alias("_row")).select("page_id", "_row.*")


@query
def pos_sections(spark, sf):
    return _parts(B.rich_page(_rows(spark, sf))).select("page_id", "ord", "pos")


@query
def section_has_heading(spark, sf):
    return _parts(B.rich_page(_rows(spark, sf))).where("has_heading").select("page_id", "pos")


@query
def excluded_sections(spark, sf):
    parts = _parts(B.rich_page(_rows(spark, sf))).where("has_heading")
    kept = parts.where(~D.is_excluded(F.col("pos"), PARAMS.excluded_sections))
    return kept.select("page_id", "pos")


@query
def section_has_list(spark, sf):
    return _parts(B.rich_page(_rows(spark, sf))).where("has_list").select("page_id", "ord", "pos")


@query
def nonempty_items(spark, sf):
    return _parts(B.rich_page(_rows(spark, sf))).where("items > 0").select("page_id", "ord", "items")


@query
def virtual_sections(spark, sf):
    return _parts(B.flat_page(_rows(spark, sf))).select("page_id", "ord", "pos", "items")


@query
def section_end(spark, sf):
    """Window form of the end of a virtual section, as text of the next heading."""
    headings = explode_elements(N.with_nodes(B.flat_page(_rows(spark, sf))), "h2", "h3", "h4")
    ends = D.section_ends(headings).where(F.col("tag") != "h2")
    return ends.select("page_id", "tag", F.col("content").alias("heading"), "stopped_by")


# --- definitions ------------------------------------------------------------

def _entries(pages: DataFrame) -> DataFrame:
    return extract_entries(pages, PARAMS, _own_language())


@query
def definitions_long(spark, sf):
    return D.to_long(_entries(B.rich_page(_rows(spark, sf))))


@query
def nested_items(spark, sf):
    return D.to_long(_entries(B.etymology_page(_rows(spark, sf))))


@query
def flat_definitions(spark, sf):
    return D.to_long(_entries(B.flat_page(_rows(spark, sf))))


@query
def fold_last_wins(spark, sf):
    return D.to_long(_entries(B.repeated_page(_rows(spark, sf))))


def _line_parts(spark, sf) -> DataFrame:
    """Lines of documents as repeated parts of the document's language."""
    lines = F.posexplode(F.split("text", "\n"))
    return _documents(spark, sf).select("doc_id", "lang", lines.alias("n", "defs")).withColumn("ord", F.col("n"))


@query
def fold_rows(spark, sf):
    return D.fold_rows(_line_parts(spark, sf), ["doc_id", "lang"])


@query
def last_per_key(spark, sf):
    return D.last_per_key(_line_parts(spark, sf), ["doc_id", "lang"])


@query
def entries(spark, sf):
    flat = F.transform(
        "definitions", lambda d: F.concat(d["pos"], F.lit(": "), F.array_join(d["defs"], "; "))
    )
    return _entries(B.rich_page(_rows(spark, sf))).select(
        "page_id", "word", F.array_join(flat, " / ").alias("entry")
    )


@query
def pages_with_definitions(spark, sf):
    """Pages that give an entry when only Spanish is asked for."""
    pages = B.rich_page(_rows(spark, sf))
    asked = ConvertParams(source_lang="en", target_lang="en", entry_lang="es")
    return extract_entries(pages, asked).select("page_id", "word", F.size("definitions").alias("parts"))


@query
def custom_exclusions(spark, sf):
    asked = ConvertParams("en", "en", excluded_sections=("noun", "VERB"))
    found = extract_entries(B.rich_page(_rows(spark, sf)), asked, _own_language())
    return D.to_long(found).groupBy("page_id", "pos_ord", "pos").agg(F.count("*").alias("n"))


@query
def deduped_nested(spark, sf):
    asked = ConvertParams("en", "en", dedupe_nested=True)
    found = extract_entries(B.rich_page(_rows(spark, sf)), asked, _own_language())
    return D.to_long(found)


# --- output -----------------------------------------------------------------

@query
def rendered_dsl(spark, sf):
    return _entries(B.rich_page(_rows(spark, sf))).select(
        "page_id", render_dsl(F.col("word"), F.col("definitions")).alias("value")
    )


@query
def rendered_xdxf(spark, sf):
    return _entries(B.rich_page(_rows(spark, sf))).select(
        "page_id", render_xdxf(F.col("word"), F.col("definitions")).alias("value")
    )


@query
def framed_xdxf(spark, sf):
    return frame_output(_entries(B.repeated_page(_rows(spark, sf))), PARAMS)


@query
def framed_dsl(spark, sf):
    return frame_output(_entries(B.repeated_page(_rows(spark, sf))), DSL_PARAMS)


def _written(spark, sf, params) -> DataFrame:
    path = new_scratch_path(spark, "dictionary")
    write_dictionary(_entries(B.repeated_page(_rows(spark, sf))), params, path)
    return spark.read.text(path)


@query
def written_xdxf(spark, sf):
    return _written(spark, sf, PARAMS)


@query
def written_dsl(spark, sf):
    return _written(spark, sf, DSL_PARAMS)


def _single(spark, sf, params) -> DataFrame:
    path = f"{new_scratch_path(spark, 'dictionary')}.{'dsl' if params.fmt == 'lingvo' else 'xdxf'}"
    write_single_file(_entries(B.repeated_page(_rows(spark, sf))), params, path)
    return spark.read.text(path)


@query
def single_file_xdxf(spark, sf):
    return _single(spark, sf, PARAMS)


@query
def single_file_dsl(spark, sf):
    return _single(spark, sf, DSL_PARAMS)


def _two_runs(spark, sf) -> list[DataFrame]:
    """Two runs over all documents, under the first and the second word of the text; words overlap in part."""
    words = [F.coalesce(F.lower(B.letter_run(F.col("text"), i)), F.lit("")) for i in range(2)]
    pages = B.several_pages(_rows(spark, sf), [B.rich_body(), B.repeated_body()], words)
    entries = cut(extract_entries(pages, PARAMS, _own_language(), keep=("page_no",)), "runs")
    return [entries.where(F.col("page_no") == i) for i in range(2)]


@query
def merged_dictionary(spark, sf):
    return merge_dictionaries(_two_runs(spark, sf)).select("page_id", "word", F.size("definitions").alias("parts"))


@query
def merged_files(spark, sf):
    """U4 over files: both runs written as dictionary files, read back, merged, written and read again."""
    def written(entries, stored=False):
        path = f"{new_scratch_path(spark, 'run')}.xdxf"
        write_single_file(entries, PARAMS, path, stored)
        return read_dictionary(spark, path, PARAMS.fmt)

    first, second = [written(run, stored=True) for run in _two_runs(spark, sf)]
    merged = written(merge_dictionaries([first, cut(second, "read")]))
    return merged.select("word", F.size("definitions").alias("parts"))


# --- the whole conversion ---------------------------------------------------

def _dictionary_pages(spark, sf) -> DataFrame:
    """A page of every document, its word in the letters its language stands for."""
    rows = _rows(spark, sf)
    return B.rich_page(rows.withColumn("word", B.word_by_language(F.col("word"))))


def _converted(spark, sf, params) -> DataFrame:
    path = new_scratch_path(spark, "converted")
    convert(_dictionary_pages(spark, sf), params, path)
    return spark.read.text(path)


@query
def converted_xdxf(spark, sf):
    return _converted(spark, sf, CONVERT_XDXF)


@query
def converted_dsl(spark, sf):
    return _converted(spark, sf, CONVERT_DSL)


@query
def conversion_counts(spark, sf):
    pages = _dictionary_pages(spark, sf)
    stats = convert(pages, CONVERT_XDXF, new_scratch_path(spark, "converted"))
    return count_conversion(pages, CONVERT_XDXF, stats)


# --- order, limit, batches, counts ------------------------------------------

@query
def sorted_headwords(spark, sf):
    return H.with_position(_rows(spark, sf).select("page_id", "word"), H.sort_keys())


@query
def limited_pages(spark, sf):
    return H.limit_pages(_rows(spark, sf).select("page_id", "word", "text"), PAGE_LIMIT)


@query
def batch_assignment(spark, sf):
    return H.assign_batches(_rows(spark, sf).select("page_id", "word"), BATCH_SIZE)


@query
def run_stats(spark, sf):
    asked = ConvertParams(source_lang="en", target_lang="en", entry_lang="es")
    outcomes = page_outcomes(B.rich_page(_rows(spark, sf)), asked)
    stored = cut(outcomes.select("page_id", "word", "has_entry"), "outcomes")
    return ST.run_stats(stored, BATCH_SIZE)


# --- collation and morphology -----------------------------------------------

@query
def collation_keys(spark, sf):
    pairs = builtin_collation("eng")
    russian = builtin_collation("rus")
    words = B.words_in_scripts(_texts(spark, sf))
    return words.select(
        "form", "word",
        collation_key(F.col("word"), pairs).alias("latin_key"),
        collation_key(F.col("word"), russian).alias("cyrillic_key"),
    )


@query
def collation_order(spark, sf):
    words = B.words_of(_texts(spark, sf))
    keyed = words.select("word", collation_key(F.col("word"), builtin_collation("eng")).alias("key"))
    return H.with_position(keyed, [F.col("key"), F.col("word")])


def _ruled_words(spark, sf, texts: DataFrame) -> DataFrame:
    """Letter runs by rule language; ``rus`` gets them in Cyrillic letters."""
    codes = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for p in RULE_LANGUAGES.items() for x in p])
    ruled = texts.select("text", F.explode(F.element_at(codes, F.col("lang"))).alias("lang"))
    words = B.letter_words(ruled)
    cyrillic = F.translate(F.col("word"), B.ALPHABET, B.CYRILLIC_ALPHABET)
    return words.select("lang", F.when(F.col("lang") == "rus", cyrillic).otherwise(F.col("word")).alias("word"))


def _all_rule_languages(texts: DataFrame) -> DataFrame:
    """Every text once for each language of documents."""
    return texts.select("text", F.explode(F.array(*map(F.lit, RULE_LANGUAGES))).alias("lang"))


def _collation_text(language: str) -> str:
    """A collation as the lines of a rule file: characters, an equals sign, their target."""
    targets: dict[str, str] = {}
    for char, target in builtin_collation(language):
        targets[target] = targets.get(target, "") + char
    return "\ufeff" + "\r\n".join(f"{chars}={target}" for target, chars in targets.items())


@query
def scanned_collation(spark, sf):
    """Keys of headwords by collations that were written to files and read back."""
    texts = {lang: _collation_text(lang) for lang in MORPHOLOGY}
    path = new_scratch_path(spark, "rule-files")
    B.write_page_files(_rule_rows(spark, texts), path, folders=True, name="collates.txt")
    rules = scan_collation(spark, path)
    pairs = {lang: collation_pairs(rules.where(F.col("lang") == lang)) for lang in texts}
    words = _ruled_words(spark, sf, _texts(spark, sf)).distinct()
    return words.select("lang", "word", language_key(F.col("lang"), F.col("word"), pairs).alias("key"))


def _rule_rows(spark, texts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(texts.items()), "word string, html string")


def _scanned_rules(spark) -> DataFrame:
    path = new_scratch_path(spark, "rule-files")
    B.write_page_files(_rule_rows(spark, {k: v.strip("\n") for k, v in MORPHOLOGY.items()}), path, folders=True, name="morphems.txt")
    return scan_morphology(spark, path)


@query
def lemma_candidates(spark, sf):
    """Base forms of all words by the rules of five languages, read from files."""
    return M.lemma_candidates(_ruled_words(spark, sf, _texts(spark, sf)), cut(_scanned_rules(spark), "rules"))


@query
def lemma_lookup(spark, sf):
    candidates = M.lemma_candidates(_ruled_words(spark, sf, _texts(spark, sf)), cut(builtin_morphology(spark), "rules"))
    headwords = _ruled_words(spark, sf, _all_rule_languages(table(spark, sf, "benchmark")))
    return M.lemma_lookup(candidates, headwords, {lang: builtin_collation(lang) for lang in MORPHOLOGY})


# --- sources and stream -----------------------------------------------------

@query
def packed_scan(spark, sf):
    return scan_pages(spark, f"{sf}/pages.parquet", word="url")


@query
def packed_selection(spark, sf):
    """Pages of two scripts and a limit from a packed table, found by its layout."""
    path = new_scratch_path(spark, "packed")
    pack_pages(_dictionary_pages(spark, sf), path)
    found = scan_packed(spark, path, CONVERT_XDXF.scripts, CONVERT_LIMIT)
    return found.select("page_id", "word")


@query
def page_dir_roundtrip(spark, sf):
    """Plain names, names with an underscore first, names with a suffix (no pages), and a file without content."""
    path = new_scratch_path(spark, "page-files")
    pages = table(spark, sf, "pages")
    for name in (F.concat(F.lit("word "), "page_id"), F.concat(F.lit("_"), "page_id"), F.concat("page_id", F.lit(".html"))):
        B.write_page_files(pages.select(name.alias("word"), "html"), path)
    B.write_page_files(spark.range(1).select(F.lit("nothing").alias("word"), F.lit("").alias("html")), path)
    return scan_page_dir(spark, path).select("word", "html")


def _streamed(spark, sf) -> DataFrame:
    """Outcomes of a stream of page files in slices of names, Greek names left out."""
    documents = _documents(spark, sf)
    rows = _rows(spark, sf)
    name = F.concat_ws("_", "word", "page_id")
    folder = new_scratch_path(spark, "page-files")
    pages = B.rich_page(rows.withColumn("word", B.word_by_language(name)))
    B.write_page_files(pages.select("word", "html"), folder)
    size = -(-documents.count() // STREAM_BATCHES)
    stream = stream_page_dir(spark, folder, size, new_scratch_path(spark, "names"))
    out = new_scratch_path(spark, "outcomes")
    asked = ConvertParams(source_lang="en", target_lang="en", entry_lang="fr", scripts=("cyrillic", "latin"))
    ingest_batches(stream, asked, out, new_scratch_path(spark, "stream"), keep=("slice",))
    return read_outcomes(spark, out)


@query
def streamed_ingest(spark, sf):
    done = _streamed(spark, sf).where("has_entry").select(F.col("word").alias("page_id"), "word", "definitions")
    return D.to_long(done).drop("page_id")


@query
def streamed_counts(spark, sf):
    return batch_stats(_streamed(spark, sf), "slice")
