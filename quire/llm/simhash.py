"""SimHash near-duplicates: exact Hamming links by a pigeonring-filtered segment index.

Fingerprints. Each k-word shingle (lower-cased A-Z, words joined by one space, repeats included; with fewer than
k words the whole sequence) gets its XXH64 with seed 42. A bit is 1 if set in over half of them. A text without
words, or a null text, has fingerprint zero and is linked like any other.

Links. With the 64 bits in m segments, two fingerprints at most t bits apart agree in m - t segments or more, so
each fingerprint is filed once for every choice of m - t segments and candidates share a file entry. The
pigeonring principle (Qin and Xiao, 2018) then asks for a segment from which every chain of consecutive segments,
around the ring, differs in at most its share of t bits; only pairs with such a chain get the full Hamming check.
Both conditions are necessary for a link, so none is lost at any size. m follows the number of distinct
fingerprints so that entries stay short: candidates grow in proportion to the rows.

Large entries (a cluster of texts with many slightly different fingerprints) are not paired off: only what
connects them is sought, from a growing front against the members that are not yet reached. Equal fingerprints
are one node. Links leave an entry as a spanning forest, so at most its size less one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import connected_components
from quire.llm.scratch import written
from quire.llm.text_arrays import gram_mask, slices, split_words, tidy

BITS = 64
SMALL_ENTRY = 64  # members up to which an entry's pairs are formed at once
PAIR_BLOCK = 200_000  # pairs compared at once: bounds a worker's memory


def fingerprints(texts: pa.Array | pa.ChunkedArray, k: int) -> np.ndarray:
    """The 64-bit SimHash of each text as unsigned integers."""
    out, xxh = [], xxhash.xxh64_intdigest
    for part in slices(texts):
        data = part.data.copy()
        data[(data >= 65) & (data <= 90)] += 32
        words = split_words(data, part.bounds)
        raw = data.tobytes()
        joined = b" ".join([raw[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)])
        size = words.end - words.start
        start = np.cumsum(size + 1) - size - 1
        end = start + size
        count = np.diff(words.bounds)
        first = np.flatnonzero(gram_mask(words.bounds, k))
        hashes = [xxh(joined[a:b], 42) for a, b in zip(start[first].tolist(), end[first + k - 1].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        grams = np.maximum(count - k + 1, 0)
        stop = np.cumsum(grams)
        prints = np.zeros(len(count), np.uint64)
        for d in np.flatnonzero(count).tolist():
            if grams[d]:
                ones = bits[stop[d] - grams[d] : stop[d]].sum(0, dtype=np.int64)
                prints[d] = np.packbits(ones * 2 > grams[d]).view(">u8")[0]
            else:
                prints[d] = xxh(joined[start[words.bounds[d]] : end[words.bounds[d + 1] - 1]], 42)
        out.append(prints)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """(id_col, fp), fp being the fingerprint's bits as a signed long; one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array(fingerprints(batch.column(1), k).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, fp bigint")


def segments(m: int) -> list[tuple[int, int]]:
    """(shift, width) of m nearly equal segments, lowest bits first."""
    edge = [round(i * BITS / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def segment_count(n: int, distance: int) -> int:
    """The fewest segments whose shared ones carry 20 bits, and about as many as n distinct fingerprints need."""
    m = distance + 1
    while m < distance + 5 and (m - distance) * BITS / m < max(20, np.log2(max(n, 1))):
        m += 1
    return m


def chain_viable(diff: np.ndarray, m: int, distance: int) -> np.ndarray:
    """Which XOR differences have a start segment from which each chain of l segments differs in l * distance / m
    bits at most."""
    each = np.stack([np.bitwise_count((diff >> np.uint64(s)) & np.uint64((1 << w) - 1)) for s, w in segments(m)]).astype(np.int16)
    viable = np.zeros(len(diff), bool)
    for first in range(m):
        alive, total = np.ones(len(diff), bool), np.zeros(len(diff), np.int16)
        for length in range(1, m + 1):
            total = total + each[(first + length - 1) % m]
            alive &= total * m <= length * distance
        viable |= alive
    return viable


def linked(diff: np.ndarray, m: int, distance: int) -> np.ndarray:
    """The chain filter, then the full Hamming check of what passes."""
    out = np.zeros(len(diff), bool)
    passed = np.flatnonzero(chain_viable(diff, m, distance))
    out[passed] = np.bitwise_count(diff[passed]) <= distance
    return out


def _spread(members: np.ndarray, m: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of one large entry: fronts against the members that no front has reached."""
    rest = members
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = []
            for pivot in front:
                hit = linked(rest ^ pivot, m, distance)
                if hit.any():
                    got, rest = rest[hit], rest[~hit]
                    reached.append(got)
                    yield np.full(len(got), pivot), got
                    if not len(rest):
                        break
            front = np.concatenate(reached) if reached else front[:0]


def _forest(entry: np.ndarray, a: np.ndarray, b: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Those of an entry's links (in order) that join two parts of it; fewer than three never close a circle."""
    edge = np.flatnonzero(np.concatenate(([True], entry[1:] != entry[:-1], [True]))) if len(entry) else np.zeros(1, np.int64)
    keep = np.ones(len(hit), bool)
    for k in np.flatnonzero(np.diff(edge) > 2).tolist():
        root: dict[int, int] = {}
        for x in range(edge[k], edge[k + 1]):
            p, q = int(a[x]), int(b[x])
            while root.get(p, p) != p:
                p = root[p]
            while root.get(q, q) != q:
                q = root[q]
            keep[x] = p != q
            root[max(p, q)] = min(p, q)
    return hit[keep]


def entry_links(keys: np.ndarray, prints: np.ndarray, m: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints of equal keys (sorted together)."""
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    size = np.diff(edge)
    left, right = [], []
    for n in np.unique(size[(size > 1) & (size <= SMALL_ENTRY)]).tolist():
        first = edge[:-1][size == n]
        i, j = np.triu_indices(n, 1)
        block = max(1, PAIR_BLOCK // len(i))
        for at in range(0, len(first), block):
            a = (first[at : at + block, None] + i).ravel()
            b = (first[at : at + block, None] + j).ravel()
            hit = np.flatnonzero(linked(prints[a] ^ prints[b], m, distance))
            hit = _forest(hit // len(i), a[hit], b[hit], hit)
            left.append(prints[a[hit]])
            right.append(prints[b[hit]])
    for k in np.flatnonzero(size > SMALL_ENTRY).tolist():
        for a, b in _spread(prints[edge[k] : edge[k + 1]], m, distance):
            left.append(a)
            right.append(b)
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def links(prints: DataFrame, n: int, distance: int = 4) -> DataFrame:
    """(a, b) links that connect distinct fingerprints ``fp`` just as all pairs at most ``distance`` bits apart do,
    whatever n, the number of fingerprints, makes of the index."""
    m = segment_count(n, distance)
    parts = segments(m)
    masks = []
    for chosen in combinations(range(m), m - distance):
        mask = sum(((1 << parts[i][1]) - 1) << parts[i][0] for i in chosen)
        masks.append(mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask)
    entries = prints.select("fp", F.posexplode(F.array([F.col("fp").bitwiseAND(F.lit(x)) for x in masks])).alias("seed", "key"))
    entries = entries.repartition("seed", "key").sortWithinPartitions("seed", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def found(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            fp, seed, key = (np.concatenate(x) for x in zip(*parts, strict=True))
            change = (seed[1:] != seed[:-1]) | (key[1:] != key[:-1])
            entry = np.concatenate(([0], np.cumsum(change)))
            a, b = entry_links(entry, fp.view(np.uint64), m, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:  # an entry that may go on in the next batch waits for it
            if not batch.num_rows:
                continue
            fp, seed, key = (batch.column(i).to_numpy() for i in range(3))
            open_from = int(np.flatnonzero(np.concatenate(([True], (seed[1:] != seed[:-1]) | (key[1:] != key[:-1]))))[-1])
            goes_on = open_from == 0 and held and held[-1][1][-1] == seed[0] and held[-1][2][-1] == key[0]
            if not goes_on:
                yield found([*held, (fp[:open_from], seed[:open_from], key[:open_from])])
                held = []
            held.append((fp[open_from:], seed[open_from:], key[open_from:]))
        if held:
            yield found(held)

    return entries.mapInArrow(tidy(run), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, distance: int = 4) -> DataFrame:
    """(id_col, fp, component_id) for every row: component_id is the smallest id reachable over links.

    Rows with a null id keep their fingerprint and link like others but never name a component; a component of
    null ids only has a null name. Repeated rows share one node. Other columns of docs are not read.
    """
    rows = written(with_fingerprint(docs, id_col, text_col, k), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    roots = connected_components(links(nodes.select("fp"), nodes.count(), distance)).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = written(placed, "placed")
    named = written(placed.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    return rows.join(placed.join(named, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, distance: int = 6) -> DataFrame:
    """The rows of docs without the near copies: of each component the row with its smallest id stays.

    Rows with a null id always stay. Of rows that repeat an id, every one goes or stays with that id.
    """
    found = near_duplicates(docs, id_col, text_col, k, distance)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
