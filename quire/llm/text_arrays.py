"""Whole-column text kernels over Arrow buffers.

The non-native operators read a batch's text as one UTF-8 byte buffer with document offsets and work on
numpy arrays of word positions and 64-bit hashes, so that no Python string is made for a word. A word is a
maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``; those bytes never occur inside a multi-byte
UTF-8 sequence, hence byte-wise splitting equals splitting by code points.

A null text counts as an empty one. Work is cut into slices of about ``SLICE_BYTES``; a document is never cut,
so memory is bounded by the larger of the slice and the longest document.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Slice(NamedTuple):
    """Documents ``first`` to ``last`` (exclusive) of a batch: their bytes and the bounds of each in them."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray


class Words(NamedTuple):
    """Word i is ``data[start[i]:end[i]]``; document d has the words ``bounds[d]`` to ``bounds[d + 1]``."""

    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column's documents in order, about ``most`` bytes at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, len(column))
        yield Slice(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def split_words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Words of each document; a document's bound also ends a word."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(bounds), np.int64))
    space = _SPACE[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = space[:-1]
    after[:-1] = space[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    before[inner] = True
    after[inner - 1] = True
    np.logical_not(space, out=space)
    start, end = np.flatnonzero(space & before), np.flatnonzero(space & after) + 1
    return Words(start, end, np.searchsorted(start, bounds))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            pair.append(np.cumprod(p))
        have = (pair[0], pair[1])
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A 64-bit polynomial hash of ``values[start:end]`` for each pair, all from one prefix sum."""
    power, inverse = powers(base, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(_STEP))


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    return span_hashes(data, words.start, words.end)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions of the slice have none."""
    n = max(0, len(hashes) - k + 1)
    first = np.arange(n)
    return span_hashes(hashes, first, first + k, _STEP)


def gram_mask(bounds: np.ndarray, k: int) -> np.ndarray:
    """Which of those positions have all k words in one document."""
    total = int(bounds[-1])
    mask = np.ones(max(0, total - k + 1), bool)
    for back in range(1, k):  # a start less than k words before a document's end
        at = bounds[1:] - back
        at = at[(at >= bounds[:-1]) & (at < len(mask))]
        mask[at] = False
    return mask


def owners(bounds: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def code_points(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A slice's code points, and the bounds of its documents in them; malformed bytes become U+FFFD."""
    lead = (data & 0xC0) != 0x80
    points = np.concatenate(([0], np.cumsum(lead)))[bounds]
    try:
        text = data.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        each = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)]
        text = "".join(each)
        points = np.concatenate(([0], np.cumsum([len(x) for x in each], dtype=np.int64)))
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), points


def give_back() -> None:
    """Return freed memory to the system: workers live on, and what one stage has used would stay theirs in the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving memory back at its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied
