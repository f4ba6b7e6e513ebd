"""Options of a conversion run."""

from __future__ import annotations

from dataclasses import dataclass, field

from .constants import EXCLUDED_SECTIONS, LANGUAGE_NAMES

FORMATS = ("lingvo", "xdxf")


@dataclass(frozen=True)
class ConvertParams:
    """What to extract and how to write it.

    ``source_lang`` is the language of the pages, ``entry_lang`` the language
    whose section is extracted (the source language when unset), and
    ``target_lang`` only appears in names and headers.
    """

    source_lang: str
    target_lang: str
    entry_lang: str | None = None
    name: str = "Wiktionary Dictionary"
    fmt: str = "xdxf"
    limit: int = 0
    batch_size: int = 10000
    scripts: tuple[str, ...] = ("all",)
    excluded_sections: tuple[str, ...] = EXCLUDED_SECTIONS
    language_names: dict[str, str] = field(default_factory=lambda: dict(LANGUAGE_NAMES))
    strict: bool = False
    dedupe_nested: bool = False
    escape_dsl: bool = False

    def __post_init__(self) -> None:
        if self.fmt not in FORMATS:
            raise ValueError(f"Unsupported output format: {self.fmt}")

    @property
    def section_lang(self) -> str:
        return self.entry_lang or self.source_lang
