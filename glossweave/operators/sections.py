"""The section of one language on a page.

Page layouts differ, so eight ways of finding the section are tried in order
and the first hit wins. All work on the node array of one page.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LANGUAGE_NAMES
from ..functions.text import capitalize, language_names, let
from .axes import descendants, nearest_container, node_at, text_content
from .nodes import class_contains, has_id, has_tag, id_contains, lang_contains, once

SECTION_TYPE = "struct<method:int,pre:int,fin:int>"


class SectionFinder:
    """The eight methods for one page.

    ``code`` and ``name`` are columns; ``name`` is null for an unlisted code.
    ``strict`` matches codes and names as whole words only; by default ``en``
    is found inside ``French``, as a plain substring.
    """

    def __init__(
        self,
        nodes: Column,
        code: Column,
        name: Column,
        strict: bool = False,
        container: str = "details",
        content_tag: str = "div",
        content_class: str | None = "mw-parser-output",
        candidates: Column | None = None,
    ) -> None:
        self.nodes = nodes
        # What the methods look for, filtered once per page by the caller.
        self.candidates = nodes if candidates is None else candidates
        self.code = code
        self.name = name
        self.strict = strict
        self.container = container
        self.content_tag = content_tag
        self.content_class = content_class
        self.methods: list[Callable[[], Column]] = [
            self.by_span_id,
            self.by_capitalized_span_id,
            self.by_heading_id,
            self.by_h2_text,
            self.by_headline_class,
            self.by_title_block,
            self.by_page_language,
            self.by_any_container,
        ]

    # -- helpers -----------------------------------------------------------

    def _select(self, test: Callable[[Column], Column]) -> Column:
        return F.filter(self.candidates, test)

    def _first(self, elements: Column, test: Callable[[Column], Column] | None = None) -> Column:
        return F.get(F.filter(elements, test) if test else elements, F.lit(0))

    def _result(self, method: int, element: Column) -> Column:
        return let(
            element,
            lambda e: F.when(
                e.isNotNull(),
                F.struct(F.lit(method).alias("method"), e["pre"].alias("pre"), e["fin"].alias("fin")),
            ),
        )

    def _in_container(self, method: int, element: Column) -> Column:
        return self._result(method, nearest_container(self.nodes, element))

    def _holds(self, text: Column, part: Column) -> Column:
        if not self.strict:
            return F.contains(text, part)
        return F.regexp_like(text, F.concat(F.lit(r"(?U)\b\Q"), part, F.lit(r"\E\b")))

    def _names_language(self, element: Column) -> Column:
        """Text holds the code or the language name, in any case."""
        return let(
            F.lower(text_content(self.nodes, element)),
            lambda text: self._holds(text, F.lower(self.code))
            | F.coalesce(self._holds(text, F.lower(self.name)), F.lit(False)),
        )

    # -- methods -----------------------------------------------------------

    def by_span_id(self) -> Column:
        span = self._first(self._select(lambda n: has_tag(n, "span") & has_id(n, self.code)))
        return self._in_container(1, span)

    def by_capitalized_span_id(self) -> Column:
        wanted = capitalize(self.code)
        span = self._first(self._select(lambda n: has_tag(n, "span") & has_id(n, wanted)))
        return self._in_container(2, span)

    def by_heading_id(self) -> Column:
        def named(n: Column) -> Column:
            match = (n["id"] == self.name) if self.strict else id_contains(n, self.name)
            return has_tag(n, "h2", "h3") & n["near"].isNotNull() & match

        return self._in_container(3, self._first(self._select(named)))

    def by_h2_text(self) -> Column:
        heading = self._first(
            self._select(
                lambda n: has_tag(n, "h2") & n["near"].isNotNull() & self._names_language(n)
            )
        )
        return self._in_container(4, heading)

    def by_headline_class(self) -> Column:
        def named(n: Column) -> Column:
            text = F.lower(text_content(self.nodes, n))
            return (
                has_tag(n, "span")
                & class_contains(n, "mw-headline")
                & n["near"].isNotNull()
                & self._holds(text, F.lower(self.name))
            )

        return self._in_container(5, self._first(self._select(named)))

    def by_title_block(self) -> Column:
        title = self._first(self._select(lambda n: has_tag(n, "div") & has_id(n, "title_0")))
        heading = let(
            node_at(self.nodes, title["parent"]),
            lambda block: self._first(
                descendants(self.nodes, block, "h2", "h3"),
                lambda n: n["near"].isNotNull() & self._names_language(n),
            ),
        )
        return self._in_container(6, heading)

    def by_page_language(self) -> Column:
        def marks(n: Column) -> Column:
            if self.strict:
                word = F.concat(F.lit(r"(?:^|\s)\Q"), self.code, F.lit(r"\E(?:\s|$)"))
                by_class = F.regexp_like(n["cls"], word)
                by_lang = (n["lang"] == self.code) | n["lang"].startswith(
                    F.concat(self.code, F.lit("-"))
                )
            else:
                by_class, by_lang = class_contains(n, self.code), lang_contains(n, self.code)
            return F.coalesce(by_class, F.lit(False)) | F.coalesce(by_lang, F.lit(False))

        def is_content(n: Column) -> Column:
            tagged = has_tag(n, self.content_tag)
            return tagged & class_contains(n, self.content_class) if self.content_class else tagged

        content = F.when(F.exists(self.nodes, marks), self._first(self._select(is_content)))
        return self._result(7, content)

    def by_any_container(self) -> Column:
        def named(n: Column) -> Column:
            heading = self._first(descendants(self.nodes, n, "h2", "h3"))
            return F.coalesce(let(heading, self._names_language), F.lit(False))

        containers = self._select(lambda n: has_tag(n, self.container))
        return self._result(8, self._first(containers, named))

    def method(self, number: int) -> Column:
        """Result of one method alone."""
        return self.methods[number - 1]()

    def find(self) -> Column:
        """First result of all methods; later ones run only if earlier ones fail."""
        return F.coalesce(*[m() for m in self.methods])


@lru_cache(maxsize=64)
def _section_column(
    _application: str, code: str | None, name: str | None, only: int | None, options: tuple
) -> Column:
    """The search expression; building it is much slower than using it again."""
    if code is None:
        columns = F.col("_language.code"), F.col("_language.name")
    else:
        columns = F.lit(code), F.lit(name).cast("string")
    finder = SectionFinder(F.col("nodes"), *columns, candidates=F.col("_candidates"), **dict(options))
    return finder.find() if only is None else finder.method(only)


def with_section(
    df: DataFrame,
    code: str | Column,
    names: dict[str, str] | None = None,
    only: int | None = None,
    **options,
) -> DataFrame:
    """Add ``section`` to rows with ``nodes``, null where none is found.

    ``code`` may be a column, so that each page looks for its own language.
    ``only`` restricts the search to one method; other options are those of
    :class:`SectionFinder`.
    """
    names = LANGUAGE_NAMES if names is None else names
    application = df.sparkSession.sparkContext.applicationId
    chosen = tuple(sorted(options.items()))
    tags = ("span", "h2", "h3", "div", options.get("container", "details"), options.get("content_tag", "div"))
    df = once(df, "_candidates", F.filter("nodes", lambda n: n["text"].isNull() & n["tag"].isin(*dict.fromkeys(tags))))
    if isinstance(code, str):
        return once(df, "section", _section_column(application, code, names.get(code), only, chosen)).drop("_candidates")
    language = F.struct(code.alias("code"), F.element_at(language_names(names), code).alias("name"))
    found = _section_column(application, None, None, only, chosen)
    return once(once(df, "_language", language), "section", found).drop("_language", "_candidates")


def filter_has_section(df: DataFrame) -> DataFrame:
    return df.where(F.col("section").isNotNull())
