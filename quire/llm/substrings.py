"""Repeated substrings over words, on a compacted de Bruijn graph.

The question: which words are covered by a window of ``window`` consecutive words of one document whose sequence
starts anywhere else too. The graph's nodes are word k-mers and each window is a path over its edges. Hashing and
counting every window would shuffle the corpus many times over, so paths are compacted first, as sequence
assemblers do: every window has a minimizer, the k-mer of least hash in it, and consecutive windows with the same
minimizer form one nonbranching path. Equal windows have equal minimizers at equal places, so

1. each path is a row (minimizer, content hash, document, first window, number of windows) -- one for about a
   dozen words;
2. paths whose minimizer occurs once anywhere are settled: none of their windows repeats;
3. among the rest, joined by minimizer, paths of equal content repeat as a whole;
4. a path whose content is unique but whose minimizer is not (the ends of a repeated span, where documents
   branch) is expanded into its windows at its source coordinates, and those are counted by hash.

All grouping keys are pairs of independent 64-bit hashes (minimizer and content, or minimizer and window), so
equal keys stand for equal word sequences. Groups are only ever counted, combined before the shuffle, and
memberships come back by joins that can be split, so a passage in a third of all rows is no hot task.

A null text has no words. A row's key is its id with a hash of id and text: rows that repeat one another count as
separate sources of their windows, and all of them get the same result. Windows are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.scratch import release, remove, stored, written
from quire.llm.text_arrays import gram_hashes, mix, owners, slices, span_hashes, split_words, word_hashes

K = 8
_CONTENT = 0xA24BAED4963EE407 | 1
_SINGLE = 0x9FB21C651E98DF25 | 1


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value, the leftmost of equal ones, among ``width`` from each position on."""
    best, at, span = values, np.arange(len(values)), 1

    def join(shift: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = best[: len(best) - shift], best[shift:]
        right = b < a
        return np.where(right, b, a), np.where(right, at[shift:], at[: len(at) - shift])

    while span * 2 <= width:
        best, at = join(span)
        span *= 2
    if span < width:
        best, at = join(width - span)
    return at


def paths(data: np.ndarray, bounds: np.ndarray, window: int, k: int = K) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, minimizer, content hash) of each path of a slice."""
    words = split_words(data, bounds)
    counts = np.diff(words.bounds)
    hashes = word_hashes(data, words)
    if len(hashes) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    grams = gram_hashes(hashes, k)
    at = _least(grams, window - k + 1)  # for every window start of the slice, across documents too
    own = owners(words.bounds)
    last = words.bounds[1:] - window
    start = np.flatnonzero(np.arange(len(at)) <= np.repeat(last, counts)[: len(at)])
    doc, least = own[start], at[start]
    new = np.ones(len(start), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(start)))
    begin = start[first]
    content = span_hashes(mix(hashes), begin, begin + size + window - 1, _CONTENT)
    return doc[first], begin - words.bounds[doc[first]], size, grams[least[first]], content


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and the row key (dk, th)."""
    own = F.coalesce(F.xxhash64(F.col(id_col)), F.lit(0)).alias("dk")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), own, F.xxhash64(F.lit(7), F.col(id_col), F.col(text_col)).alias("th"))


def _find_paths(keyed: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                doc, first, size, minimizer, content = paths(part.data, part.bounds, window)
                rows = pa.array(doc + part.first)
                columns = [batch.column(1).take(rows), batch.column(2).take(rows), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(minimizer.view(np.int64)), pa.array(content.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["dk", "th", "a", "n", "m", "c"])

    return keyed.select("text", "dk", "th").mapInArrow(run, "dk bigint, th bigint, a int, n int, m bigint, c bigint")


def _expand(keyed: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(dk, th, at, m, w, alone) of each window of the wanted paths, read at their source coordinates."""
    lists = wanted.groupBy("dk", "th").agg(F.collect_list(F.struct("a", "n", "m", "alone")).alias("spans"))
    joined = keyed.select("dk", "th", "text").join(lists, ["dk", "th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(3)
            for part in slices(batch.column(2)):
                own = spans.slice(part.first, part.last - part.first)
                flat = own.flatten()
                a, n, m = (flat.field(x).to_numpy() for x in ("a", "n", "m"))
                alone = flat.field("alone").to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))
                words = split_words(part.data, part.bounds)
                hashes = word_hashes(part.data, words)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(a, n) + step
                start = np.repeat(words.bounds[doc], n) + at
                w = span_hashes(mix(hashes), start, start + window, _SINGLE)
                row = pa.array(np.repeat(doc, n) + part.first)
                columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array(at.astype(np.int32)), pa.array(np.repeat(m, n)), pa.array(w.view(np.int64)), pa.array(np.repeat(alone, n))]
                yield pa.RecordBatch.from_arrays(columns, names=["dk", "th", "at", "m", "w", "alone"])

    return joined.mapInArrow(run, "dk bigint, th bigint, at int, m bigint, w bigint, alone boolean")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """(dk, th, first, size): the windows first to first + size - 1 of the row with that key repeat somewhere."""
    keyed = _keyed(docs, id_col, text_col)
    found, place = stored(_find_paths(keyed, window), "paths")
    # 2. minimizers that occur more than once, and whether with different contents
    shared = found.groupBy("m").agg(F.count("*").alias("times"), F.min("c").alias("low"), F.max("c").alias("high"))
    shared = written(shared.where("times > 1").select("m", (F.col("low") != F.col("high")).alias("branches")), "shared")
    rest = written(found.join(shared, "m"), "shared-paths")
    remove(docs.sparkSession, place)  # what follows reads the shared ones only
    release(docs.sparkSession)
    # 3. whole paths that repeat
    contents = rest.groupBy("m", "c", "branches").agg(F.count("*").alias("times"), F.min(F.struct("dk", "th", "a", "n")).alias("one"))
    contents = written(contents, "contents")
    whole = rest.join(contents.where("times > 1").select("m", "c"), ["m", "c"]).select("dk", "th", F.col("a").alias("first"), F.col("n").alias("size"))
    # 4. windows of the paths that branch
    wanted = contents.where("branches").select("one.*", "m", (F.col("times") == 1).alias("alone"))
    single = written(_expand(keyed, wanted, window), "windows")
    twice = written(single.groupBy("m", "w").agg(F.count("*").alias("times")).where("times > 1").select("m", "w"), "twice")
    release(docs.sparkSession)
    parts = single.where("alone").join(twice, ["m", "w"]).select("dk", "th", F.col("at").alias("first"), F.lit(1).alias("size"))
    return whole.unionByName(parts)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256, kept) of each row; ``kept`` is what is left, joined by spaces."""
    spans = repeated_spans(docs, id_col, text_col, window).groupBy("dk", "th").agg(F.collect_list(F.struct("first", "size")).alias("spans"))
    joined = _keyed(docs, id_col, text_col).join(spans, ["dk", "th"], "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2)
            for part in slices(batch.column(1)):
                words = split_words(part.data, part.bounds)
                raw = part.data.tobytes()
                cut = np.zeros(len(words.start) + 1, np.int64)
                here = own.slice(part.first, part.last - part.first)
                flat = here.flatten()
                if len(flat):
                    count = np.array([len(x) if x.is_valid else 0 for x in here])
                    base = np.repeat(words.bounds[:-1], count)
                    first = flat.field("first").to_numpy() + base
                    np.add.at(cut, first, 1)
                    np.add.at(cut, first + flat.field("size").to_numpy() + window - 1, -1)
                gone = np.cumsum(cut)[:-1] > 0
                start, end = words.start.tolist(), words.end.tolist()
                kept, removed = [], []
                for a, b in zip(words.bounds.tolist(), words.bounds[1:].tolist(), strict=False):
                    dropped = gone[a:b]
                    removed.append(int(dropped.sum()))
                    if not removed[-1]:
                        kept.append(b" ".join([raw[start[i] : end[i]] for i in range(a, b)]))
                    else:
                        kept.append(b" ".join([raw[start[i] : end[i]] for i in (np.flatnonzero(~dropped) + a).tolist()]))
                digests = [hashlib.sha256(x).hexdigest() for x in kept]
                columns = [batch.column(0).slice(part.first, part.last - part.first), pa.array(np.diff(words.bounds)), pa.array(removed, pa.int64()), pa.array(digests), pa.array(kept, pa.binary()).cast(pa.string(), safe=False)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "n_removed", "kept_sha256", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
