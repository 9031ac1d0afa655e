"""Settings of a conversion; values enter plans as literals."""

from __future__ import annotations

from dataclasses import dataclass, replace

TABLE_MODES = ("markdown", "html", "csv", "text", "drop")
FOOTNOTE_MODES = ("inline", "end", "drop")


@dataclass(frozen=True)
class Options:
    keep_headers: bool = False
    table_mode: str = "markdown"
    footnote_mode: str = "inline"
    pages: tuple[int, int] | None = None
    password: str | None = None
    detect_headings: bool = True
    detect_tables: bool = True
    detect_unruled_tables: bool = True
    detect_lists: bool = True
    detect_captions: bool = True
    detect_footnotes: bool = True
    detect_columns: bool = True
    dehyphenate: bool = True
    normalize_unicode: bool = True
    escape_markdown: bool = True
    min_heading_ratio: float = 1.12
    max_heading_level: int = 6
    max_heading_chars: int = 200
    normalize_heading_levels: bool = True
    header_band: float = 0.10
    footer_band: float = 0.12
    artifact_page_ratio: float = 0.6
    artifact_min_pages: int = 3
    word_gap_ratio: float = 0.22
    line_tolerance_ratio: float = 0.45
    para_gap_ratio: float = 1.45

    def __post_init__(self) -> None:
        checks = {
            f"table_mode must be one of {TABLE_MODES}": self.table_mode in TABLE_MODES,
            f"footnote_mode must be one of {FOOTNOTE_MODES}": self.footnote_mode in FOOTNOTE_MODES,
            "max_heading_level must be 1 to 6": 1 <= self.max_heading_level <= 6,
            "min_heading_ratio must be 1 or more": self.min_heading_ratio >= 1,
            "bands must be from 0 to under 0.5": 0 <= self.header_band < 0.5 and 0 <= self.footer_band < 0.5,
            "artifact_page_ratio must be over 0 and up to 1": 0 < self.artifact_page_ratio <= 1,
            "pages must be a range from 1 or more": self.pages is None or 1 <= self.pages[0] <= self.pages[1],
        }
        for message, good in checks.items():
            if not good:
                raise ValueError(message)

    def with_(self, **changes) -> Options:
        return replace(self, **changes)
