"""Options and limits of a conversion."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace


def _env(name: str, default: int) -> int:
    try:
        return int(os.environ.get(f"SHEAFWORK_{name}", default))
    except ValueError:
        return default


@dataclass(frozen=True)
class Limits:
    max_file_bytes: int = field(default_factory=lambda: _env("MAX_FILE_BYTES", 50 << 20))
    max_pdf_pages: int = field(default_factory=lambda: _env("MAX_PDF_PAGES", 2000))
    max_slides: int = field(default_factory=lambda: _env("MAX_SLIDES", 1000))
    max_sheet_rows: int = field(default_factory=lambda: _env("MAX_SHEET_ROWS", 20_000))
    max_sheet_cols: int = field(default_factory=lambda: _env("MAX_SHEET_COLS", 256))
    max_table_cells: int = field(default_factory=lambda: _env("MAX_TABLE_CELLS", 1_000_000))
    max_csv_rows: int = field(default_factory=lambda: _env("MAX_CSV_ROWS", 50_000))
    max_archive_members: int = field(default_factory=lambda: _env("MAX_ARCHIVE_MEMBERS", 500))
    max_archive_ratio: int = field(default_factory=lambda: _env("MAX_ARCHIVE_RATIO", 200))
    max_archive_bytes: int = field(default_factory=lambda: _env("MAX_ARCHIVE_BYTES", 400 << 20))
    max_recursion_depth: int = field(default_factory=lambda: _env("MAX_RECURSION_DEPTH", 3))
    max_assets: int = field(default_factory=lambda: _env("MAX_ASSETS", 500))
    min_asset_bytes: int = field(default_factory=lambda: _env("MIN_ASSET_BYTES", 2048))


@dataclass(frozen=True)
class ConvertOptions:
    frontmatter: bool = True
    page_anchors: bool = True
    heading_offset: int = 0
    detect_headings: bool = True
    table_format: str = "pipe"
    keep_page_breaks: bool = True
    wrap_width: int = 0
    images: str = "reference"
    asset_dir: str = "assets"
    chunk: bool = False
    chunk_size: int = 1200
    chunk_overlap: int = 120
    ocr: bool = False
    include_hidden_sheets: bool = False
    include_speaker_notes: bool = True
    limits: Limits = field(default_factory=Limits)

    def with_(self, **changes: object) -> ConvertOptions:
        return replace(self, **changes)

    def clamped(self) -> ConvertOptions:
        """Chunk settings inside the ranges that the service accepts."""
        return self.with_(chunk_size=min(8000, max(200, self.chunk_size)), chunk_overlap=min(2000, max(0, self.chunk_overlap)))
