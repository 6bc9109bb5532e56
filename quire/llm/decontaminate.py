"""Benchmark decontamination by greedy string tiling.

Tokens are runs of word characters in lower case, so case and punctuation do not hide a passage. Seeds are the
benchmark items' windows of ``least`` tokens (an item with fewer is one seed). A document's windows are rolled over
with a Karp-Rabin hash and joined to the seeds; equal ones, confirmed token by token through exact token numbers,
line up on diagonals into maximal matches. Tiling then marks the longest match, cuts the others where they overlap
what is marked, and goes on until none of at least ``least`` tokens is left; of equally long matches the one that starts
first in the item, then first in the document, is marked. Each token lies in one tile at most,
and the order of tiles is free, so passages whose sentences were moved about are caught as well. A document is
contaminated by an item if its tiles cover ``coverage`` of the item's tokens or more.

Up to ``BLOCK_TOKENS`` tokens of items go to every worker, and documents are tiled in one scan without a shuffle, so
a passage in a third of all rows is no hot key. More items stay tables: the seeds of both sides are joined, and only
documents and items that share one meet, to be tiled pair by pair. To cover a share c of an item's n tokens takes
ceil(c n / k) of its windows of k tokens at least, so an item is filed under all windows but as many less one, the most
frequent among items: boilerplate of many items brings no pairs about. Both ways give the same rows.

Null or empty texts match nothing, so an empty table gives an empty result; whole texts are read, however long;
a repeated document row is reported once for each copy, a repeated benchmark row once.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm.scratch import written
from quire.llm.text_arrays import tidy

TOKEN = re.compile(r"\w+")
BLOCK_TOKENS = 2_000_000
LEAST = 5
COVERAGE = 0.6
_BASE = np.uint64(0x100000001B3)


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def rolled(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash, modulo 2**64, of the k token numbers from each position on."""
    n = len(ids) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        out *= _BASE
        out += ids[j : j + n].astype(np.uint64)
    return out


class Seeds:
    """A block of items: token numbers, and the items' windows sorted by hash, one table for each window length."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int) -> None:
        self.number: dict[str, int] = {}
        self.items = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int64) for _, words in items]
        self.keys = [key for key, _ in items]
        self.tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in sorted({min(least, len(x)) for x in self.items if len(x)}):
            own = [i for i, x in enumerate(self.items) if min(least, len(x)) == k]
            hashes = [rolled(self.items[i], k) for i in own]
            item = np.repeat(own, [len(h) for h in hashes])
            at = np.concatenate([np.arange(len(h)) for h in hashes])
            order = np.argsort(np.concatenate(hashes), kind="stable")
            self.tables.append((k, np.concatenate(hashes)[order], item[order], at[order]))

    def pairs(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(window length, items, item positions, document positions) of all equal windows."""
        known = ids > 0
        for k, hashes, item, at in self.tables:
            n = len(ids) - k + 1
            if n <= 0:
                continue
            full = np.ones(n, bool)
            for j in range(k):
                full &= known[j : j + n]
            where = np.flatnonzero(full)
            if not len(where):
                continue
            own = rolled(ids, k)[where]
            low = np.searchsorted(hashes, own)
            count = np.searchsorted(hashes, own, "right") - low
            where, low, count = where[count > 0], low[count > 0], count[count > 0]
            if not len(where):
                continue
            pick = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            yield k, item[pick], at[pick], np.repeat(where, count)


def tile(p: np.ndarray, t: np.ndarray, k: int, size: int) -> list[tuple[int, int, int]]:
    """Tiles (item position, document position, length) from equal windows of k tokens at (p, t)."""
    order = np.lexsort((p, t - p))
    p, t = p[order], t[order]
    starts = np.flatnonzero(np.concatenate(([True], (np.diff(p) != 1) | (np.diff(t) != 1))))
    stops = np.append(starts[1:], len(p))
    heap = [(-int(b - a + k - 1), int(p[a]), int(t[a])) for a, b in zip(starts, stops, strict=True)]
    heapq.heapify(heap)
    marked_p, marked_t, tiles = np.zeros(size, bool), set(), []
    while heap:
        length, a, b = heapq.heappop(heap)
        length = -length
        free = [not marked_p[a + i] and b + i not in marked_t for i in range(length)]
        if all(free):
            tiles.append((a, b, length))
            marked_p[a : a + length] = True
            marked_t.update(range(b, b + length))
            continue
        i = 0
        while i < length:
            j = i
            while j < length and free[j]:
                j += 1
            if j - i >= k:
                heapq.heappush(heap, (i - j, a + i, b + i))
            i = j + 1
    return tiles


def matches(text: str | None, seeds: Seeds, coverage: float) -> Iterator[tuple[int, int, int, int]]:
    """(item, covered tokens, item tokens, tiles) of the items that the text covers enough of."""
    number = seeds.number
    ids = np.fromiter((number.get(w, 0) for w in tokens(text)), np.int64)
    for k, item, p, t in seeds.pairs(ids):
        order = np.argsort(item, kind="stable")
        item, p, t = item[order], p[order], t[order]
        edge = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1], [True])))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own = seeds.items[item[a]]
            same = np.ones(b - a, bool)
            for j in range(k):
                same &= own[p[a:b] + j] == ids[t[a:b] + j]
            pp, tt = p[a:b][same], t[a:b][same]
            reach = np.zeros(len(own) + 1, np.int64)  # no tiling covers more than all windows together
            np.add.at(reach, pp, 1)
            np.add.at(reach, pp + k, -1)
            if (np.cumsum(reach)[:-1] > 0).sum() < coverage * len(own):
                continue
            tiles = tile(pp, tt, k, len(own))
            covered = sum(x[2] for x in tiles)
            if covered >= coverage * len(own):
                yield int(item[a]), covered, len(own), len(tiles)


def items_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, text, n) of the benchmark's distinct rows with tokens; n is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([len(tokens(x)) for x in batch["text"].to_pylist()], pa.int64())
            full = pa.RecordBatch.from_arrays([*batch.columns, n], names=["item", "text", "n"])
            yield full.filter(pc.greater(n, 0))

    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()
    return rows.mapInArrow(tidy(run), f"item {benchmark.schema[item_col].dataType.simpleString()}, text string, n bigint")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: int = LEAST,
    coverage: float = COVERAGE,
) -> DataFrame:
    """(id_col, item_col, covered, item_tokens, n_tiles, coverage), a row for each document and item it leaks."""
    items = written(items_of(benchmark, item_col, item_text_col), "items")
    size = items.agg(F.sum("n")).first()[0] or 0
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = _scanned(rows, items, least, coverage) if size <= BLOCK_TOKENS else _joined(rows, items, least, coverage)
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def _schema(rows: DataFrame, items: DataFrame) -> str:
    kinds = (rows.schema["id"].dataType.simpleString(), items.schema["item"].dataType.simpleString())
    return "id {}, item {}, covered bigint, item_tokens bigint, n_tiles bigint, coverage double".format(*kinds)


def _batch(ids: pa.Array, rows: list[int], items: pa.Array, hits: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = [pa.array([x[j] for x in hits], pa.int64()) for j in (1, 2, 3)]
    share = pa.array([x[1] / x[2] for x in hits], pa.float64())
    return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), items, *columns, share], names=["id", "item", "covered", "item_tokens", "n_tiles", "coverage"])


def _text(value: pa.Scalar) -> str:
    return (value.as_py() or b"").decode("utf-8", "replace")


def _scanned(rows: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    """All items at every worker."""
    block = [(r[0], tokens(r[1])) for r in items.select("item", "text").collect()]
    key_type = to_arrow_type(items.schema["item"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(block, least)
        for batch in batches:
            at, found = [], []
            for i, raw in enumerate(batch.column(1).cast(pa.large_binary())):
                for hit in matches(_text(raw), seeds, coverage):
                    at.append(i)
                    found.append(hit)
            yield _batch(batch.column(0), at, pa.array([seeds.keys[x[0]] for x in found], key_type), found)

    return rows.mapInArrow(tidy(run), _schema(rows, items))


def window_hashes(words: list[str], k: int) -> np.ndarray:
    """The rolled hash of each window of k tokens, alike in every process."""
    return rolled(np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64), k)


def _windows(rows: DataFrame, keys: list[str], sizes: list[int] | None, least: int, distinct: bool) -> DataFrame:
    """(keys, k, h) of the windows of each text: of k tokens for the given sizes, or of as many as the item's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for i, raw in enumerate(batch["text"].cast(pa.large_binary())):
                words = tokens(_text(raw))
                for k in sizes or [min(least, len(words))]:
                    h = window_hashes(words, k) if k <= len(words) else np.zeros(0, np.uint64)
                    h = np.unique(h) if distinct else h
                    at.append(np.full(len(h), i))
                    size.append(np.full(len(h), k))
                    hashes.append(h)
            own = pa.array(np.concatenate(at))
            columns = [*(batch[x].take(own) for x in keys), pa.array(np.concatenate(size)), pa.array(np.concatenate(hashes).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "k", "h"])

    return rows.select("text", *keys).mapInArrow(tidy(run), ", ".join(f"{x} bigint" for x in [*keys, "k", "h"]))


def _joined(rows: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    """Items as a table: seeds meet in a join, and documents meet the items that they share one with."""
    known = items.withColumns({"ih": F.xxhash64("item", "text"), "ig": F.xxhash64(F.lit(7), "item", "text")})
    windows = written(_windows(known, ["ih", "ig"], None, least, False), "item_windows")
    often = windows.groupBy("k", "h").agg(F.countDistinct("ih", "ig").alias("often"))
    place = Window.partitionBy("ih", "ig").orderBy("often", "h")
    ranked = windows.join(often, ["k", "h"]).withColumns({"place": F.row_number().over(place), "of": F.count("*").over(Window.partitionBy("ih", "ig"))})
    needed = F.ceil(F.ceil(F.lit(coverage) * (F.col("of") + F.col("k") - 1) - F.lit(1e-9)) / F.col("k"))
    seeds = written(ranked.where(F.col("place") <= F.col("of") - F.greatest(needed, F.lit(1)) + 1).select("k", "h", "ih", "ig").distinct(), "seeds")
    sizes = sorted(r[0] for r in seeds.select("k").distinct().collect())  # ``least`` numbers at most
    keyed = rows.withColumns({"dk": F.coalesce(F.xxhash64("id"), F.lit(0)), "th": F.xxhash64(F.lit(7), "id", "text")})
    pairs = _windows(keyed, ["dk", "th"], sizes, least, True).join(seeds, ["k", "h"]).select("dk", "th", "ih", "ig").distinct()
    pairs = written(pairs, "pairs")
    both = pairs.join(known.withColumnRenamed("text", "own"), ["ih", "ig"]).join(keyed, ["dk", "th"]).select("id", "text", "item", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seeds_ = None, None
        for batch in batches:
            at, found = [], []
            for i, (raw, own) in enumerate(zip(batch["text"].cast(pa.large_binary()), batch["own"].to_pylist(), strict=True)):
                if own != last:
                    last, seeds_ = own, Seeds([(0, tokens(own))], least)
                for hit in matches(_text(raw), seeds_, coverage):
                    at.append(i)
                    found.append(hit)
            yield _batch(batch["id"], at, batch["item"].take(pa.array(at, pa.int64())), found)

    return both.mapInArrow(tidy(run), _schema(rows, items))
