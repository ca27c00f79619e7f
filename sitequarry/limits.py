"""Limits and budgets, checked when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields


class _Checked:
    _infinite: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for f in fields(self):  # type: ignore[arg-type]
            v = getattr(self, f.name)
            if isinstance(v, bool) or not isinstance(v, (int, float)) or math.isnan(v) or v < (0 if f.name.startswith(("lastmod", "max_redirects")) else 1e-9):
                raise ValueError(f"{f.name} must be a positive number, not {v!r}")
            if math.isinf(v) and f.name not in self._infinite:
                raise ValueError(f"{f.name} must be finite")


@dataclass(frozen=True)
class FetchLimits(_Checked):
    timeout: float = 30
    max_redirects: int = 5
    max_bytes: int = 500 << 20


@dataclass(frozen=True)
class IndexLimits(_Checked):
    max_depth: int = 3
    max_children: int = 50_000
    max_total_sitemaps: float = math.inf
    max_total_urls: float = math.inf
    _infinite = ("max_total_sitemaps", "max_total_urls")


@dataclass(frozen=True)
class DiscoveryLimits(_Checked):
    max_candidates: int = 50


@dataclass(frozen=True)
class ArchiveLimits(_Checked):
    max_archive_bytes: int = 50 << 20
    max_file_count: int = 100
    max_decompressed_bytes: int = 200 << 20


@dataclass(frozen=True)
class ProtocolLimits(_Checked):
    max_url_count: int = 50_000
    max_uncompressed_bytes: int = 52_428_800
    lastmod_identical_ratio: float = 1.0
    lastmod_generated_tolerance: float = 86_400
    max_images_per_url: int = 1000
    max_news_per_file: int = 1000
    max_video_tags: int = 32


@dataclass(frozen=True)
class PageBudget(_Checked):
    max_pages: int = 1000
    max_requests: int = 5000
    max_bytes: int = 200 << 20
    page_body_cap: int = 1 << 20
    max_seconds: float = 600


#: Sources of one call; the list API raises beyond it.
MAX_SUBMITTED = 25
