"""Array folds in Spark expressions whose cost stays linear."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def running_spans(items: Column, start: Callable[[Column, Column], Column], stop: Callable[[Column, Column], Column], keep: Callable[[Column, Column], Column], make: Callable[..., Column], span_type: str) -> Column:
    """Spans of items in a row, each placed by where the one before it ended (``at``, at first 0).

    start(item, at) and stop(item, start) place an item, and at becomes its stop; make(start, stop, item, at) is the
    struct, of type span_type, of an item for which keep(item, at) holds. Spans gather in chunks, as adding to one
    growing array would copy it each time.
    """
    none, nothing = F.array().cast(f"array<{span_type}>"), F.array().cast(f"array<array<{span_type}>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("chunk"), nothing.alias("done"))

    def advance(state: Column, item: Column) -> Column:
        first = start(item, state.at)
        last = stop(item, first)
        one = F.array(make(first, last, item, state.at)).cast(f"array<{span_type}>")
        kept, full = keep(item, state.at), F.size(state.chunk) >= CHUNK
        chunk = F.when(~kept, state.chunk).when(full, one).otherwise(F.concat(state.chunk, one))
        done = F.when(kept & full, F.concat(state.done, F.array(state.chunk))).otherwise(state.done)
        return F.struct(last.cast("int").alias("at"), chunk.alias("chunk"), done.alias("done"))

    return F.aggregate(items, zero, advance, lambda s: F.flatten(F.concat(s.done, F.array(s.chunk))))


def free_name(columns: list[str], name: str) -> str:
    """The name, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
