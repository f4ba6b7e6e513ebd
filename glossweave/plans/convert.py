"""Pages to dictionary entries, and the whole conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scripts import in_scripts, is_page_name
from ..operators.definitions import filter_has_definitions, with_definitions
from ..operators.headwords import limit_pages
from ..operators.nodes import html_nodes, with_nodes
from ..operators.sections import filter_has_section, with_section
from ..operators.stats import count_stages, run_stats
from ..params import ConvertParams
from ..session import cut
from ..sources.sinks import write_dictionary


def select_named(pages: DataFrame, params: ConvertParams) -> DataFrame:
    """Pages whose names pass: a page's name, in a wanted script. No body is read."""
    word = F.col("word")
    return pages.where(is_page_name(word) & in_scripts(word, params.scripts))


def select_pages(pages: DataFrame, params: ConvertParams) -> DataFrame:
    """Pages to parse: name, script and limit tests, none of which reads a body."""
    return limit_pages(select_named(pages, params), params.limit)


def _define(parsed: DataFrame, params: ConvertParams, keep: tuple[str, ...] = ()) -> DataFrame:
    defined = with_definitions(
        parsed, excluded=params.excluded_sections, dedupe_nested=params.dedupe_nested
    )
    return defined.select("page_id", "word", *keep, "definitions")


def extract_entries(pages: DataFrame, params: ConvertParams, code=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``page_id``, ``word`` and non-empty ``definitions``; one narrow stage, no shuffle.

    ``code`` may be a column with each page's own language, ``keep`` names more
    columns to keep.
    """
    found = filter_has_section(
        with_section(
            with_nodes(pages),
            params.section_lang if code is None else code,
            names=params.language_names,
            strict=params.strict,
        )
    )
    return filter_has_definitions(_define(found, params, keep))


def page_outcomes(
    pages: DataFrame, params: ConvertParams, code=None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``definitions`` of every page, empty where it gives no entry.

    A body without a list is not sent to the parser.
    """
    html = F.col("html")
    listed = F.when(html.rlike(r"(?i)<ol[\s/>]"), html)
    parsed = pages.withColumn("nodes", html_nodes(listed)).drop("html")
    found = with_section(
        parsed,
        params.section_lang if code is None else code,
        names=params.language_names,
        strict=params.strict,
    )
    outcome = _define(found, params, keep)
    return outcome.withColumn("has_entry", F.coalesce(F.size("definitions") > 0, F.lit(False)))


def convert(pages: DataFrame, params: ConvertParams, path: str) -> DataFrame:
    """Write the dictionary of ``pages`` below ``path``; returns counts per batch.

    Pages are parsed once; the outcome is stored and serves both the dictionary
    and the counts.
    """
    outcomes = cut(page_outcomes(select_pages(pages, params), params), "outcomes")
    entries = outcomes.where("has_entry")
    write_dictionary(entries, params, path, stored=True)
    return run_stats(outcomes.select("page_id", "word", "has_entry"), params.batch_size)


def conversion_counts(pages: DataFrame, params: ConvertParams, stats: DataFrame) -> DataFrame:
    """Rows (stage, batch, pages): files found, left by scripts and by the limit, then
    processed and skipped per batch and in total (batch null). ``stats`` is what
    :func:`convert` returns."""
    none = F.lit(None).cast("int").alias("batch")
    names = count_stages(pages.select("word"), params.scripts, params.limit)
    stages = names.unpivot([], ["found", "in_scripts", "after_limit"], "stage", "pages").select("stage", none, "pages")
    batches = stats.unpivot(["batch"], ["processed", "skipped"], "stage", "pages").select("stage", "batch", "pages")
    totals = batches.groupBy("stage").agg(F.sum("pages").alias("pages")).select("stage", none, "pages")
    return stages.unionByName(batches).unionByName(totals)
