"""Folds over the words of one page at a time, many pages to an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

HELD_ROWS = 20_000


class Box(NamedTuple):
    """A word and its place."""

    seq: int
    block: int
    line: int
    text: str
    x0: float
    y0: float
    x1: float
    y1: float


def by_page(words: DataFrame, fold: Callable[[list[Box]], Iterable[tuple]], columns: str, in_order: bool = False) -> DataFrame:
    """(doc_id, page, columns) rows that fold makes of each page's words in their order.

    words has (doc_id, page, seq, block, line, text, x0, y0, x1, y1). With in_order a page's words already follow one
    another, as a reader gives them: nothing is shuffled then. A page is held whole, as in any renderer.
    """
    kind = words.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, page bigint, {columns}"
    rows = words.select("doc_id", "page", *Box._fields)
    if not in_order:
        rows = rows.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "seq")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key: tuple | None = None
        held: list[Box] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for doc, page, *word in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (doc, page) != key:
                    if held:
                        out.extend((*key, *row) for row in fold(held))
                    key, held = (doc, page), []
                held.append(Box(*word))
            if len(out) >= HELD_ROWS:
                yield made()
                out = []
        if held:
            out.extend((*key, *row) for row in fold(held))
        if out:
            yield made()

    return rows.mapInArrow(run, schema)


def united(boxes: Iterable[Box]) -> tuple[float, float, float, float]:
    """The least box around some words."""
    boxes = list(boxes)
    return min(b.x0 for b in boxes), min(b.y0 for b in boxes), max(b.x1 for b in boxes), max(b.y1 for b in boxes)

