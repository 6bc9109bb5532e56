"""Near copies: SimHash links first, checked exactly, then every other pair of at least a given Jaccard similarity.

Sets. Each k-word shingle (words lower-cased A-Z; with fewer than k words the whole sequence) is a 64-bit hash; a
text is the set of them. Texts of equal sets are one node, named by a hash of the set; all without words are one.

SimHash. The nodes' fingerprints go through the segment index, the pigeonring chains and the Hamming check of
``simhash.links``; what it links is checked by the sets themselves. Similar sets may have fingerprints further apart
(a median of 10 bits), so all that this leaves apart goes on to the prefix filter.

Prefix filter. In any order of all shingles, two sets of similarity t or more share one of the first n - ceil(t n) + 1 of
each (n its size), so each set is filed under those and every similar pair meets (no pair is lost,
whatever the order and the number of rows). The order puts shingles that are frequent in a sample of the texts
last: boilerplate of many texts stays out of the index, and the sample decides about speed only. A pair that meets
must fit by size and by what can still follow in both, and by its sketches; then its whole sets are compared.

Sketches. A set's shingles are counted by their leading bits, modulo 256, in a power of two of buckets between a
quarter and a half of its size. Whatever the sets, they differ in at least as many shingles as their counts do, so
a pair whose counts differ in more than similar sets may is settled without its sets.

Large entries (a cluster of many slightly different texts) go in rounds: in a fixed random order of an entry's members,
first those up to ``ROUNDS[0]`` places apart, with the pairs of SimHash. Then each set of an entry of more than ``DIRECT`` in
several components takes a pivot, the member with most shingles from the entry on (mostly the text that others were made from),
and is compared with it: one pair a set. Sets of one pivot that are still apart meet by their differences from it (X and Y
differ in as many shingles as their differences do), again by a prefix filter, with the edits' own shingles first. Two
sets far from each other that lie about a common text share all of that text and hardly an edit, so pairs do not grow with
the square of such a cluster. Sets of different pivots, or of none, that meet are compared as they are. A pair that meets is thus
compared, already connected, or excluded by a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import simhash
from quire.llm.components import connected_components
from quire.llm.scratch import TEXT_ROWS, batches_of, small_side, written
from quire.llm.text_arrays import gram_hashes, gram_mask, mix, owners, slices, span_hashes, split_words, tidy, word_hashes

SIMILAR = (4, 5)  # the least similarity, as a fraction
ROUNDS = (16, 1 << 62)  # places apart in an entry up to which its members are paired, round by round
DIRECT = 256  # members of an entry up to which all pairs still apart are compared as they are
DISTANCE = 4  # bits between SimHashes up to which the first links are sought: speed only, as the rest is exact
SAMPLE_SHARE, SAMPLE_ROWS = 16, 20_000  # the order's sample, one text in so many, so many at least: speed only
FREQUENT, MOST_FREQUENT = 3, 500_000
LEAST_BITS = 4
PAIRS_HELD = 1 << 17
_STEP = 0xD6E8FEB86659FD93 | 1


def shingle_sets(texts: pa.Array | pa.ChunkedArray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per slice of the texts: their shingle sets one after another (each sorted) and the bounds of each."""
    for part in slices(texts):
        data = part.data.copy()
        data[(data >= 65) & (data <= 90)] += 32
        words = split_words(data, part.bounds)
        hashes, count = word_hashes(data, words), np.diff(words.bounds)
        first = np.flatnonzero(gram_mask(words.bounds, k))
        short = np.flatnonzero((count > 0) & (count < k))
        own = np.concatenate((owners(words.bounds)[first], short))
        grams = np.concatenate((gram_hashes(hashes, k)[first], span_hashes(hashes, words.bounds[short], words.bounds[short + 1], _STEP)))
        order = np.lexsort((grams, own))
        own, grams = own[order], grams[order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (grams[1:] != grams[:-1])
        yield grams[new], np.concatenate(([0], np.cumsum(np.bincount(own[new], minlength=len(count)))))


def set_keys(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The name of each set."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(grams), dtype=np.uint64)))
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64) * np.uint64(_STEP))


def how_often(grams: np.ndarray, frequent: np.ndarray, often: np.ndarray) -> np.ndarray:
    """How often each shingle is in the sample, 0 for those that are not frequent."""
    if not len(frequent) or not len(grams):
        return np.zeros(len(grams), np.int64)
    at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
    return np.where(frequent[at] == grams, often[at], 0)


def prefixes(grams: np.ndarray, bounds: np.ndarray, frequent: np.ndarray, often: np.ndarray, similar: tuple[int, int] = SIMILAR) -> tuple[np.ndarray, ...]:
    """(set, shingle, size, place in the order) of the shingles that each set is filed under."""
    size = np.diff(bounds)
    own = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((grams, how_often(grams, frequent, often), own))
    place = np.arange(len(grams)) - bounds[:-1][own]
    n = size[own]
    first = np.flatnonzero(place <= n - -(-similar[0] * n // similar[1]))
    return own[first], grams[order[first]], n[first], place[first]


def least_overlap(sizes: np.ndarray, similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """The fewest common shingles of two similar sets of these sizes together."""
    return -(-similar[0] * sizes // sum(similar))


def sketches(grams: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Of each set the numbers of its shingles by their leading bits, modulo 256."""
    size = np.diff(bounds)
    bits = np.maximum(np.log2(np.maximum(size, 1)).astype(np.int64) - 1, LEAST_BITS)
    start = np.concatenate(([0], np.cumsum(1 << bits)))
    own = np.repeat(np.arange(len(size)), size)
    at = start[own] + (grams >> (64 - bits[own]).astype(np.uint64)).astype(np.int64)
    counts = np.bincount(at, minlength=start[-1]).astype(np.uint8).tobytes()
    return [counts[a:b] for a, b in zip(start.tolist(), start[1:].tolist(), strict=False)]


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """The fewest shingles that only one of two sets with these sketches can have."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = a.reshape(len(b), -1).sum(1, dtype=np.uint8)
    apart = a - b
    return int(np.minimum(apart, -apart).sum())


def difference(grams: np.ndarray, pivot: np.ndarray, frequent: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The shingles that only one of a set and its pivot has: the set's own first, each part by how rare we expect them."""
    own, gone = np.setdiff1d(grams, pivot, assume_unique=True), np.setdiff1d(pivot, grams, assume_unique=True)
    own = own[np.lexsort((own, how_often(own, frequent, often)))]
    return np.concatenate((own, gone[np.lexsort((gone, -how_often(gone, frequent, often)))]))


def is_near(d: int, n: int, pivot: int) -> bool:
    """Whether a set of n shingles, d of them and of its pivot's in one only, is similar to the pivot."""
    return d * sum(SIMILAR) <= (n + pivot) * (SIMILAR[1] - SIMILAR[0])


def difference_prefix(d: int, n: int, pivot: int, near: bool) -> tuple[int, int]:
    """How many of a difference of d shingles are filed, for all partners and for those far from the pivot (SIMILAR being 4/5).

    Of a similar pair one is far from the pivot, or both are linked to it. With x, y the sizes of the differences, X
    far: 9 x > X + P, and the differences share s shingles with 18 s >= 9 (x + y) - X - Y > 9 y + P - Y. That bounds Y's
    prefix from X's side. A far X needs s >= x - X / 4 besides, as s <= y and Y <= 5 X / 4; of its prefixes the longer one is
    for partners near the pivot.
    """
    short = d - (9 * d + pivot - n) // 18
    return (short if near else max(short, d - max(1, -(-(4 * d - n) // 4)) + 1)), short


def _table(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64) if x.dtype != np.uint64 else x.view(np.int64)) for x in columns], names=names)


def _by_entry(entries: DataFrame, made, names: list[str]) -> DataFrame:  # noqa: ANN001
    """made(columns, edges) over whole entries (rows of one ``sh``, sorted by key); it yields lists of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def found() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            sh, key = columns[:2]
            new = np.ones(len(sh), bool)
            new[1:] = (sh[1:] != sh[:-1]) | (key[1:] != key[:-1])  # copies filed by several tasks
            columns = [x[new] for x in columns]
            edge = np.flatnonzero(np.concatenate(([True], columns[0][1:] != columns[0][:-1], [True])))
            for out in made(columns, edge):
                if len(out[0]):
                    yield _table(out, names)

        for batch in batches:  # an entry that may go on in the next batch waits for it
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
            sh = columns[0]
            last = int(np.searchsorted(sh, sh[-1]))
            if last or (held and held[-1][0][-1] != sh[0]):
                held.append([x[:last] for x in columns])
                yield from found()
                held = []
            held.append([x[last:] for x in columns])
        if held:
            yield from found()

    sorted_ = entries.repartition("sh").sortWithinPartitions("sh", "key")
    return sorted_.mapInArrow(tidy(run), ", ".join(f"{x} bigint" for x in names))


def _shared(columns: list[np.ndarray], edge: np.ndarray) -> Iterator[list[np.ndarray]]:
    """The rows of entries that have several members, with their number."""
    size = np.repeat(np.diff(edge), np.diff(edge))
    yield [x[size > 1] for x in [*columns, size]]


def _fits(columns: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, key, n, place = columns[:4]
    fit = np.minimum(n[a] - place[a], n[b] - place[b]) >= least_overlap(n[a] + n[b])
    a, b = key[a[fit]], key[b[fit]]
    return np.minimum(a, b), np.maximum(a, b)


def _mixed(column: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Which entries have more than one value."""
    return np.logical_or.reduceat(column != np.repeat(column[edge[:-1]], np.diff(edge)), edge[:-1])


def _pivots(columns: list[np.ndarray], edge: np.ndarray) -> Iterator[list[np.ndarray]]:
    """(key, pivot) for the members of entries with several roots: the member with most shingles from the entry on."""
    _, key, n, place, root = columns
    size = np.diff(edge)
    entry = np.repeat(np.arange(len(size)), size)
    first = np.lexsort((key, place, place - n, entry))[edge[:-1]]
    some = np.repeat(_mixed(root, edge) & (size > DIRECT), size)
    yield [key[some], np.repeat(key[first], size)[some]]


def _meeting_by_difference(columns: list[np.ndarray], edge: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Pairs of different roots, one of them far from the pivot, whose differences may share enough."""
    _, key, n, place, d, near, short, root = columns
    far, early = near == 0, place < short
    held: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 2]
    for k in np.flatnonzero(_mixed(root, edge)).tolist():
        at = np.arange(edge[k], edge[k + 1])
        close, both = at[~far[at] & early[at]], at[far[at] & early[at]]
        for x in at[far[at]].tolist():
            others = np.concatenate((close, both[both > x])) if early[x] else close
            others = others[root[others] != root[x]]
            least = -(-(9 * (d[x] + d[others]) - n[x] - n[others]) // 18)
            y = key[others[np.minimum(d[x] - place[x], d[others] - place[others]) >= least]]
            held.append([np.minimum(key[x], y), np.maximum(key[x], y)])
            if sum(len(one) for one, _ in held) > PAIRS_HELD:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _meeting(columns: list[np.ndarray], edge: np.ndarray, low: int, high: int) -> Iterator[list[np.ndarray]]:
    """Pairs of members ``low`` to ``high`` places apart in their entry, but for those of one root (or one pivot)."""
    size = np.diff(edge)
    end = np.repeat(edge[1:], size)
    at = np.arange(len(end))
    for column in columns[4:]:  # what is settled as a whole goes at once
        at = at[np.repeat(_mixed(column, edge), size)[at]]
    held: list[list[np.ndarray]] = []
    for apart in range(low, high + 1):
        at = at[at + apart < end[at]]
        if not len(at):
            break
        a, b = at, at + apart
        for column in columns[4:]:
            other = column[a] != column[b]
            a, b = a[other], b[other]
        held.append([*_fits(columns, a, b)])
        if sum(len(x) for x, _ in held) > PAIRS_HELD:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """The rows of docs without the near copies: of each component the row with its smallest id stays.

    Rows with a null id always stay. Of rows that repeat an id, every one goes or stays with that id.
    """
    found = near_copies(docs, id_col, text_col, k)
    gone = written(found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "gone")
    return docs.join(small_side(gone), id_col, "left_anti")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """(id_col, component_id) for every row: component_id is the smallest id reachable over links."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array(simhash.fingerprints(batch.column(1), k).view(np.int64))
            keys, made, sizes = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.int64)]
            for grams, bounds in shingle_sets(batch.column(1), k):
                keys.append(set_keys(grams, bounds))
                made += sketches(grams, bounds)
                sizes.append(np.diff(bounds))
            columns = [batch.column(0), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sizes)), pa.array(made, pa.binary()), prints]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "key", "n", "sketch", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    with batches_of(docs.sparkSession, TEXT_ROWS):
        rows = written(docs.select(id_col, text_col).mapInArrow(tidy(names), f"`{id_col}` {kind}, key bigint, n bigint, sketch binary, fp bigint"), "set_names")
    nodes = written(rows.groupBy("key").agg(F.min(id_col).alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("fp").alias("fp")), "nodes")
    rows = rows.select(id_col, "key")
    roots = connected_components(links(docs.select(id_col, text_col), nodes, rows.count(), k)).withColumnRenamed("node", "key")
    placed = written(nodes.join(roots, "key", "left").select("key", "least", F.coalesce("root", "key").alias("root")), "placed")
    named = written(placed.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    return rows.join(placed.join(named, "root").select("key", "component_id"), "key").select(id_col, "component_id")


def links(docs: DataFrame, nodes: DataFrame, n: int, k: int = 5) -> DataFrame:
    """(a, b) names of sets in one component; they connect just what all similar pairs do.

    docs has an id and a text in n rows or about as many, nodes each set's name, ``least`` id, size, sketch and SimHash.
    """
    texts = docs.select(docs.columns[1])
    frequent, often = _frequent(texts, n, k)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for grams, bounds in shingle_sets(batch.column(0), k):
                keys = set_keys(grams, bounds)
                new = np.zeros(len(keys), bool)
                new[np.unique(keys, return_index=True)[1]] = True
                new &= np.array([x not in seen for x in keys.tolist()], bool)
                seen.update(keys.tolist())
                own, sh, size, place = prefixes(grams, bounds, frequent, often)
                own, sh, size, place = (x[new[own]] for x in (own, sh, size, place))
                yield _table([sh, keys[own], size, place], ["sh", "key", "n", "place"])

    entries = texts.mapInArrow(tidy(file), "sh bigint, key bigint, n bigint, place bigint")
    shared = written(_by_entry(entries, _shared, ["sh", "key", "n", "place", "members"]), "shared")
    pairs = _by_entry(shared.select("sh", "key", "n", "place"), lambda *x: _meeting(*x, 1, ROUNDS[0]), ["a", "b"])
    found = _similar(docs, nodes, _by_simhash(nodes).unionByName(pairs), k)
    large = shared.where(F.col("members") > ROUNDS[0] + 1)
    if not large.first():
        return found
    entries = written(_rooted(large, found), "large")
    roots = entries.select("key", "root").distinct()
    chosen = written(_chosen(_by_entry(entries, _pivots, ["key", "pivot"]), roots), "chosen")
    crossing = entries.join(small_side(chosen), "key", "left").select("sh", "key", "n", "place", "root", F.coalesce("pivot", "key").alias("pivot"))
    crossing = _by_entry(crossing, lambda *x: _meeting(*x, 1, ROUNDS[1]), ["a", "b"])
    if not chosen.first():
        return found.unionByName(_similar(docs, nodes, crossing, k))
    differ = _differences(docs, nodes, chosen.join(roots, "key"), frequent, often, k)
    near = differ.where("near = 1 and key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b"))
    return found.unionByName(near).unionByName(_similar(docs, nodes, crossing.unionByName(_by_difference(differ)), k))


def _by_simhash(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that SimHash links: equal fingerprints with one of them, and that one with its neighbours'."""
    first = written(nodes.groupBy("fp").agg(F.min("key").alias("key")), "fingerprints")
    linked = written(simhash.links(first.select("fp"), first.count(), DISTANCE), "simhash_links").toDF("left", "right")
    one, two = first.toDF("left", "a"), first.toDF("right", "b")
    equal = nodes.select("fp", F.col("key").alias("b")).join(first.toDF("fp", "a"), "fp").where("a <> b")
    pairs = linked.join(one, "left").join(two, "right").select("a", "b").unionByName(equal.select("a", "b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _chosen(pivots: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, pivot) from the pivots of each key's entries: the commonest, and of a component's pivots its commonest."""
    most = lambda df, by, x: df.groupBy(by).agg(F.max(F.struct("count", x))[x].alias(x))
    own = written(most(pivots.groupBy("key", "pivot").count(), "key", "pivot"), "own_pivots")
    count = own.groupBy("pivot").count().join(roots.toDF("pivot", "root"), "pivot")
    one = count.select("pivot", "root").join(most(count, "root", "pivot").toDF("root", "one"), "root")
    return own.join(one, "pivot").select("key", F.col("one").alias("pivot"))


def _rooted(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Entries with each member's component over the links found so far."""
    roots = connected_components(found).withColumnRenamed("node", "key")
    return entries.join(roots, "key", "left").select("sh", "key", "n", "place", F.coalesce("root", "key").alias("root"))


def _differences(docs: DataFrame, nodes: DataFrame, chosen: DataFrame, frequent: np.ndarray, often: np.ndarray, k: int) -> DataFrame:
    """(key, pivot, root, n, size of the pivot, near, difference) for each set (key, pivot, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for whole, pivot in zip(batch.column(3), batch.column(4), strict=True):
                grams, other = np.frombuffer(whole.as_buffer(), np.uint64), np.frombuffer(pivot.as_buffer(), np.uint64)
                apart = difference(grams, other, frequent, often)
                rows.append((len(grams), len(other), int(is_near(len(apart), len(grams), len(other))), apart.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            made = [pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["key", "pivot", "root", "n", "size", "near", "apart"])

    need = written(chosen.select(F.explode(F.array("key", "pivot")).alias("key")).distinct(), "differing")
    with batches_of(docs.sparkSession, TEXT_ROWS):
        sets = written(_sets(docs, nodes, need, k), "member_sets")
    both = chosen.join(sets, "key").join(sets.toDF("pivot", "other"), "pivot").select("key", "pivot", "root", "grams", "other")
    return written(both.mapInArrow(tidy(run), "key bigint, pivot bigint, root bigint, n bigint, size bigint, near bigint, apart binary"), "differences")


def _by_difference(differ: DataFrame) -> DataFrame:
    """Pairs (a, b) of one pivot that may be similar and are not both near it."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, pivot, root, n, size, near = (batch.column(i).to_numpy() for i in range(6))
            filed, short, d = [np.zeros(0, np.uint64)], np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            for i, x in enumerate(batch.column(6)):
                apart = np.frombuffer(x.as_buffer(), np.uint64)
                d[i] = len(apart)
                long, short[i] = difference_prefix(len(apart), int(n[i]), int(size[i]), bool(near[i]))
                filed.append(apart[:long])
            count = np.array([len(x) for x in filed[1:]], np.int64)
            own = np.repeat(np.arange(len(key)), count)
            place = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            sh = mix(np.concatenate(filed) ^ mix(pivot.view(np.uint64))[own])
            names = ["sh", "key", "n", "place", "d", "near", "short", "root"]
            yield _table([sh, key[own], n[own], place, d[own], near[own], short[own], root[own]], names)

    entries = differ.mapInArrow(tidy(file), "sh bigint, key bigint, n bigint, place bigint, d bigint, near bigint, short bigint, root bigint")
    return _by_entry(entries, _meeting_by_difference, ["a", "b"])


def _frequent(texts: DataFrame, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles frequent in a sample of the texts (sorted), and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams, _ in shingle_sets(batch.column(0), k):
                yield _table([grams], ["sh"])

    part = texts.where(F.pmod(F.xxhash64(*texts.columns), F.lit(max(1, min(SAMPLE_SHARE, n // SAMPLE_ROWS)))) == 0)
    counted = part.mapInArrow(tidy(run), "sh bigint").groupBy("sh").count().where(F.col("count") >= FREQUENT)
    table = counted.orderBy(F.desc("count"), "sh").limit(MOST_FREQUENT).toArrow()
    grams, often = table["sh"].to_numpy().view(np.uint64), table["count"].to_numpy()
    order = np.argsort(grams)
    return grams[order], often[order]


def _compared(pairs: DataFrame, sides: DataFrame, column: str, similar, name: str) -> DataFrame:  # noqa: ANN001
    """Those of the pairs (a, b) for which similar(left, right) holds, given ``column`` of sides for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [similar(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    one, two = sides.select(F.col("key").alias("a"), F.col(column).alias("left")), sides.select(F.col("key").alias("b"), F.col(column).alias("right"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right")
    return written(both.mapInArrow(tidy(run), "a bigint, b bigint"), name)


def _close(left: pa.Buffer, right: pa.Buffer) -> bool:
    """Whether sketches (8 bytes of the set's size before each) leave room for similar sets."""
    a, b = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    n = int(a[:8].view(">i8")[0]) + int(b[:8].view(">i8")[0])
    return least_difference(a[8:], b[8:]) <= n - 2 * int(least_overlap(np.int64(n)))


def _overlap(left: pa.Buffer, right: pa.Buffer) -> bool:
    a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    return len(np.intersect1d(a, b, assume_unique=True)) >= least_overlap(np.int64(len(a) + len(b)))


def _similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Those of the pairs whose sets are similar; only the sets of pairs that their sketches leave are made, of one id each."""
    sized = nodes.select("key", F.concat(F.unhex(F.lpad(F.hex("n"), 16, "0")), "sketch").alias("sketch"))
    pairs = _compared(written(pairs.distinct(), "met"), sized, "sketch", _close, "pairs")
    need = written(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "compared")
    with batches_of(docs.sparkSession, TEXT_ROWS):
        sets = written(_sets(docs, nodes, need, k), "sets")
    return _compared(pairs, sets, "grams", _overlap, "similar")


def _sets(docs: DataFrame, nodes: DataFrame, need: DataFrame, k: int) -> DataFrame:
    """(key, grams) of the sets named in need (a stored table), made from the text of one id each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams, bounds in shingle_sets(batch.column(0), k):
                keys, new = np.unique(set_keys(grams, bounds), return_index=True)
                whole = pa.array([grams[bounds[i] : bounds[i + 1]].tobytes() for i in new.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), whole], names=["key", "grams"])

    id_col, text_col = docs.columns
    least = written(need.join(nodes, "key").where("least is not null").select("least").distinct(), "least")
    texts = docs.join(small_side(least), docs[id_col] == least["least"], "left_semi").unionByName(docs.where(F.col(id_col).isNull())).select(text_col)
    return texts.mapInArrow(tidy(sets), "key bigint, grams binary").join(small_side(need), "key", "left_semi").dropDuplicates(["key"])
