"""Page specifications such as ``2-5,9``: one-based, inclusive, ranges may descend, repeats are kept."""

from __future__ import annotations

import re


def parse_pages(spec: str | None, count: int | None = None) -> list[int] | None:
    """Zero-based page indices in the order given; None (all pages) for an absent or blank spec.

    A malformed part is an error before any part is checked against count; then the first page out of range is.
    """
    if spec is None or not spec.strip():
        return None
    parts = [p.strip() for p in spec.split(",") if p.strip()]
    pages: list[int] = []
    for part in parts:
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        if not m:
            raise ValueError(f"malformed page range: {part!r}")
        first, last = int(m[1]), int(m[2] or m[1])
        step = 1 if last >= first else -1
        pages.extend(range(first - 1, last - 1 + step, step))
    for page in pages:
        if page < 0 or (count is not None and page >= count):
            raise ValueError(f"page {page + 1} is out of range")
    return pages


def single_page(page: int, count: int) -> int:
    """Zero-based index of a one-based page."""
    if not 1 <= page <= count:
        raise ValueError(f"page {page} is out of range 1-{count}")
    return page - 1
