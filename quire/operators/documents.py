"""Verbs that write documents, over tables of files: each file becomes a draft, is changed, and is a file again.

Files are rows (path, content). A result has ``part`` (from 0, for verbs that make several files) and ``error``: a file that a
verb cannot be applied to keeps its row, without content and with the reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources import pdf_edit
from quire.sources.pdf_edit import Draft

SCHEMA = "path string, part bigint, content binary, error string"
HELD_BYTES = 32 << 20
Made = bytes | Draft | Iterable[bytes] | None


def _rows(path: str, make: Callable[[], Made]) -> Iterator[tuple[str, int, bytes | None, str | None]]:
    try:
        made = make()
        parts = [made] if isinstance(made, bytes | Draft) else made or []
        for i, part in enumerate(parts):
            yield path, i, part.save() if isinstance(part, Draft) else part, None
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError) as e:
        yield path, 0, None, f"{type(e).__name__}: {e}"


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def made() -> pa.RecordBatch:
        kinds = pa.string(), pa.int64(), pa.binary(), pa.string()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["path", "part", "content", "error"])

    for row in rows:
        held.append(row)
        size += len(row[2] or b"")
        if size > HELD_BYTES:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def changed(files: DataFrame, change: Callable[[Draft, str], Any], password: str = "") -> DataFrame:
    """change(draft, path) for each file; it works in place, or returns the bytes of one file or of several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(path: str, content: bytes) -> Made:
            draft = Draft(content, password)
            made = change(draft, path)
            return draft if made is None or isinstance(made, int | list) else made

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                    yield from _rows(path, lambda path=path, content=content: one(path, content.as_py()))

        yield from _batched(rows())

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def split(files: DataFrame, every: int = 1) -> DataFrame:
    """Files of ``every`` pages each."""
    return changed(files, lambda draft, _: (part.save() for part in pdf_edit.split(draft, every)))


def merged(files: DataFrame, path: Column, *order: str) -> DataFrame:
    """One file for each ``path``: the pages of its files by the order columns. A merged file is one row, as files are."""
    grouped = files.groupBy(path.cast("string").alias("path")).agg(F.array_sort(F.collect_list(F.struct(*order, "content"))).alias("files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name, parts in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                    yield from _rows(name, lambda parts=parts: pdf_edit.merge(p.as_py() for p in parts))

        yield from _batched(rows())

    return grouped.select("path", F.col("files.content").alias("content")).mapInArrow(run, SCHEMA)


def written_from(rows: DataFrame, path: Column, value: Column, make: Callable[[Any], bytes]) -> DataFrame:
    """A new file from a value of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for batch in batches:
                for name, one in zip(batch["path"].to_pylist(), batch["value"], strict=True):
                    yield from _rows(name, lambda one=one: make(one.as_py()))

        yield from _batched(made())

    return rows.select(path.cast("string").alias("path"), value.alias("value")).mapInArrow(run, SCHEMA)
