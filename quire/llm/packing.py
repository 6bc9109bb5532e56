"""Packing documents into fixed windows by minimum bin slack.

Documents become token ids with an end id and are cut at multiples of the window, so each leaves at most one piece
shorter than it. Only how many pieces of each length there are (at most ``window`` numbers, whatever the corpus)
goes to the driver. There a window is filled by the longest remaining length and the multiset of remaining lengths
that comes closest to what is left: subset sums over a bitset, a class of equal lengths at a time with its count,
then back-tracking for the counts. A pattern is used as often as its lengths last, so each search uses up a length
class and the number of searches does not grow with the corpus.

Pieces of one length are interchangeable: each gets its rank among them (numbered within hashed sub-groups, so a
length that many documents share is spread over many tasks) and the patterns' runs of ranks say where it lies.

A null text is an empty one: one piece, the end id. Ids and other columns may repeat or be null. An empty table
packs into nothing.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.scratch import written
from quire.llm.text_arrays import tidy

WINDOW = 1024
_encoders: dict[str, object] = {}


class Encoder:
    """Ids of a byte-level BPE given as a tokenizers JSON file; as there, a special token's string in a text is that token.

    The same vocabulary and split rule run in tiktoken, several times as fast and with the same ids; a text on
    which that gives up (its split rule has a limit on one run of white space) goes through tokenizers itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocabulary, added = whole["model"]["vocab"], {x["content"]: x["id"] for x in whole.get("added_tokens", [])}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in vocabulary.items() if word not in added and all(c in byte_of for c in word)}
        # Fixed value: the split rule of this family of vocabularies.
        rule = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=rule, mergeable_ranks=ranks, special_tokens=added)

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # the split rule's limit on backtracking
            if self.slow is None:  # seldom needed, so seldom in a worker's memory
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str) -> Encoder:
    """One encoder a process for each vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens): each document's ids and the end id, cut at the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, raw in enumerate(batch.column(1).cast(pa.large_binary())):
                text = (raw.as_py() or b"").decode("utf-8", "replace")
                ids = np.append(own.ids(text), end_id).astype("<u4")
                data = memoryview(ids.tobytes())
                for at in range(0, len(ids), window):
                    size = min(window, len(ids) - at)
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + size)]))
                    total.append(len(ids))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "length", "ids_crc32", "doc_tokens"])
        _encoders.clear()  # made anew in a third of a second

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, none more often than counted, whose sum comes closest to room from below."""
    reach, steps = 1, []
    within = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        steps.append((length, reach))
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            reach |= (reach << length * take) & within
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            chosen[length] = n
    return chosen


def patterns(counts: dict[int, int], window: int = WINDOW) -> Iterator[tuple[dict[int, int], int]]:
    """(lengths with their numbers, how many windows they fill) until all pieces are used."""
    left = {length: n for length, n in counts.items() if n}
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest(left, window - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[length] // n for length, n in chosen.items())
        yield chosen, times
        for length, n in chosen.items():
            left[length] -= times * n
            if not left[length]:
                del left[length]


def layout(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a sequence, first sequence, offset) for each pattern and length."""
    used, sequence, out = dict.fromkeys(counts, 0), 0, []
    for chosen, times in patterns(counts, window):
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            out.append((length, used[length], used[length] + times * n, n, sequence, offset))
            used[length] += times * n
            offset += n * length
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """The pieces with their ``sequence_id`` and ``offset`` there."""
    cut = written(pieces(docs, tokenizer_path, id_col, text_col, window, end_id), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    parts = max(256, sum(counts.values()) // 20_000)
    spread = cut.withColumn("part", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(parts)))
    groups = spread.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    groups = groups.select("length", "part", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "part").orderBy(id_col, "start", "ids_crc32", "doc_tokens"))
    ranked = spread.withColumn("number", number).join(groups, ["length", "part"]).withColumn("rank", F.col("before") + F.col("number") - 1)
    runs = docs.sparkSession.createDataFrame(layout(counts, window), "length bigint, first bigint, stop bigint, each bigint, sequence bigint, at bigint")
    # at most a few runs for each of the window's lengths, whatever the corpus
    placed = ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop"))).drop(runs["length"])
    k = F.col("rank") - F.col("first")
    return placed.select(
        id_col,
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("sequence") + F.floor(k / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + (k % F.col("each")) * F.col("length")).cast("bigint").alias("offset"),
    )
