"""Quality rules: base statistics, and bands on the perplexity of a character n-gram model per language.

Model. Texts become symbols of an alphabet of 256: the 26 letters (a capital counts as one class of its own), space,
line break, digit, some marks, and 192 classes by code point for all else, so that the letters of one script stay
apart. An interpolated modified Kneser-Ney model of order ``ORDER`` per language is counted and estimated by Spark. Workers
count 6-grams, the shuffle adds them up: how many distinct ones there are grows with the corpus, and at no point has one
process all of them. Every row counts but those with more than one symbol in ``SYMBOL_WORDS`` words, since junk must
not teach the model that judges it; a language that has no other rows is counted whole. Rows that do not train still
name their n-grams, with a count of 0, so every n-gram of the corpus gets its log-probability once and for all.

Estimation. N-grams are dealt by language and the three symbols before the last. All that orders 4 to 6 need of an n-gram
(its context's total and continuations, its suffixes) has the same three, so each group is estimated by itself; lower
orders, of at most 2**24 n-grams a language, and the discounts are summed up first. The result is a table of n-grams
and log-probabilities, kept as arrays sorted by key and looked up by binary search.

Scoring. Up to ``MODEL_ROWS`` rows every worker gets the table, as a broadcast that it reads in place and that is gone once the
scores are written. A larger one stays partitioned: documents are dealt into
chunks of a language, each chunk asks for its distinct n-grams once, a join answers, and chunk and answers meet in
one task. Both ways give the same figures.

Copies. A text that occurs several times in a language trains its model once. Near copies still teach the high orders a
text by heart, so no group of them may decide what is usual: the upper band starts at the third quartile, and the lower
band looks at the model of order ``LOWER``, whose counts are numbers of distinct neighbours.

Bands. log_ppl is the mean negative log-probability of a character and low_ppl that of the lower model, so their
sampling error falls with the root of the text's length. Over the distinct rows that pass the base rules, each language
gives its quartiles, and those of the distances from the median times sqrt(chars). A text is rejected if its low_ppl lies
twice ``width`` times the lower one of these over sqrt(chars), and ``slack``, below the median, or its log_ppl as many times the
upper one above the third quartile (texts that mix languages are clean, yet lie somewhat above).

A null text is an empty one; a null language is one of its own. Rows are judged one by one, so repeated rows
get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.llm.scratch import TEXT_ROWS, small_side, written
from quire.llm.text_arrays import code_points, gram_hashes, gram_mask, mix, owners, slices, span_hashes, split_words, tidy, word_hashes

ORDER, LOWER = 6, 3  # LOWER: the highest order that is summed up first
SYMBOL_BITS = 8
SYMBOLS_MASK = (1 << SYMBOL_BITS * LOWER) - 1
MODEL_ROWS = 8 << 20  # of 12 bytes, handed to every worker at most
SCORED_BYTES = 1 << 18  # of texts scored at once, beside the model
CHUNK_CHARS = 8 << 20  # of a chunk of documents that meets its part of a larger model
LEAST_SPREAD = 0.5
PPL_GRID, Z_GRID = 10_000, 100  # quantiles are exact over values on these grids: few distinct ones, in any order
HELD_KEYS = 1 << 20  # distinct n-grams that a worker adds up before it passes them on
ROWS_A_BATCH = 1 << 16
WINDOW = 8
# The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
SYMBOL_WORDS = 10
_alphabet: list[np.ndarray] = []


def alphabet() -> np.ndarray:
    """Symbol 1 to 255 of each code point below 2**16; 0 stands before a text's start."""
    if not _alphabet:
        table = (64 + np.arange(0x10000) % 192).astype(np.uint8)
        table[:128] = 39
        for i in range(26):
            table[97 + i], table[65 + i] = 1 + i, 40
        table[[9, 11, 12, 13, 32]] = 27
        table[10] = 28
        table[48:58] = 29
        for symbol, chars in {30: ".", 31: ",", 32: ";:", 33: "!?", 34: "\"'", 35: "()[]{}", 36: "-_", 37: "#*$%&", 38: "|<>"}.items():
            table[[ord(c) for c in chars]] = symbol
        _alphabet.append(table)
    return _alphabet[0]


def gram_keys(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-gram ending at each code point, and the documents' bounds in them."""
    points, bounds = code_points(data, bounds)
    symbols = alphabet()[np.minimum(points, 0xFFFF)].astype(np.int64)
    within = np.arange(len(symbols)) - np.repeat(bounds[:-1], np.diff(bounds))
    keys = symbols.copy()
    for back in range(1, ORDER):
        shifted = np.zeros(len(symbols), np.int64)
        shifted[back:] = symbols[:-back] if back < len(symbols) else 0
        shifted[within < back] = 0
        keys |= shifted << (SYMBOL_BITS * back)
    return keys, bounds


def named(lang_col: str) -> Column:
    """A language's name that is never null."""
    return F.when(F.col(lang_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(lang_col).cast("string")))


def first_copies(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(text, lang, first): first holds for one id of each text of a language, the smallest.

    Only texts that occur more than once are joined back.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), named(lang_col).alias("lang"))
    rows = rows.withColumns({"h": F.xxhash64("text", "lang"), "g": F.xxhash64(F.lit(7), "text", "lang")})
    several = rows.groupBy("h", "g").agg(F.count("*").alias("copies"), F.min("id").alias("least")).where("copies > 1").drop("copies")
    several = written(several.withColumn("found", F.lit(True)), "copies")
    marked = rows.join(small_side(several), ["h", "g"], "left")
    return marked.select("text", "lang", (F.col("found").isNull() | F.col("id").eqNullSafe(F.col("least"))).alias("first"))


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, key, n) of rows (text, lang, first): how often each n-gram of a language occurs in the texts that train its
    model, which may be never."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                counts = held.pop(lang)
                for at in range(0, len(counts[0]), ROWS_A_BATCH):
                    part = [x[at : at + ROWS_A_BATCH].astype(np.int64) for x in counts]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part[0]), pa.string()), *map(pa.array, part)], names=["lang", "key", "n", "once"])

        for batch in batches:
            langs, first = np.array(batch.column(1).to_pylist() + [None], object)[:-1], batch.column(2).to_numpy(zero_copy_only=False)
            for part in slices(batch.column(0)):
                keys, bounds = gram_keys(part.data, part.bounds)
                own = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                once, here = first[part.first : part.last], langs[part.first : part.last]
                trains = once & few_symbols(part.data, part.bounds)
                for lang in set(here.tolist()):
                    member = (here == lang)[own]
                    if member.any():
                        key, at = np.unique(keys[member], return_inverse=True)
                        new = [key, *(np.bincount(at, x[own[member]], len(key)).astype(np.int32) for x in (trains, once))]
                        held[lang] = _added(held[lang], new) if lang in held else new
            if sum(len(x[0]) for x in held.values()) > HELD_KEYS:
                yield from out()
        yield from out()

    counted = rows.select("text", "lang", "first").mapInArrow(tidy(run), "lang string, key bigint, n bigint, once bigint")
    counted = written(counted.groupBy("lang", "key").agg(*(F.sum(x).alias(x) for x in ("n", "once"))), "grams", TEXT_ROWS)
    taught = {r[0] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0").collect()}
    return counted.withColumn("n", F.when(F.col("lang").isin(list(taught)), F.col("n")).otherwise(F.col("once"))).drop("once")


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    key, at = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    return [key, *(np.bincount(at, np.concatenate((x, y)), len(key)).astype(np.int32) for x, y in zip(a[1:], b[1:], strict=True))]


def few_symbols(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which documents have one symbol in ``SYMBOL_WORDS`` words at most."""
    words = np.diff(split_words(data, bounds).bounds)
    return SYMBOL_WORDS * _symbols(data, bounds) <= words


def _symbols(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    marked = np.zeros(256, bool)
    marked[list(SYMBOLS)] = True
    return np.diff(np.concatenate(([0], np.cumsum(marked[data])))[bounds])


class Order(NamedTuple):
    """Sorted n-grams with the log-probability of their last symbol, and sorted contexts with log back-off."""

    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


def _discounts(c: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 1, 2, and 3 or more, from the numbers of n-grams counted 1, 2, 3, 4 times."""
    if min(c) == 0:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = c[0] / (c[0] + 2 * c[1])
    raw = [1 - 2 * y * c[1] / c[0], 2 - 3 * y * c[2] / c[1], 3 - 4 * y * c[3] / c[2]]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(raw, 1))])


def tallies(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def continued(keys: np.ndarray, counts: np.ndarray, top: int, least: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted n-grams and counts of orders ``top`` down to ``least``: below the first, the numbers of distinct left neighbours."""
    out = {top: (keys, counts)}
    for n in range(top - 1, least - 1, -1):
        out[n] = np.unique(out[n + 1][0] & ((1 << SYMBOL_BITS * n) - 1), return_counts=True)
    return out


def estimate(by_order: dict[int, tuple[np.ndarray, np.ndarray]], cuts: dict[int, np.ndarray], below: list[Order]) -> list[Order]:
    """The orders in ``below`` and those of by_order, interpolated."""
    out = list(below)
    for n in sorted(by_order):
        key, count = by_order[n]
        cut = cuts[n][np.minimum(count, 3)]
        context, at = np.unique(key >> SYMBOL_BITS, return_inverse=True)
        total = np.bincount(at, count)
        left = np.bincount(at, cut) / total
        if n == 1:
            lower = np.full(len(key), 1 / (1 << SYMBOL_BITS))
        else:
            lower = np.exp(out[-1].logp[np.searchsorted(out[-1].keys, key & ((1 << SYMBOL_BITS * (n - 1)) - 1))])
        out.append(Order(key, np.log((count - cut) / total[at] + left[at] * lower), context, np.log(left)))
    return out


def log_probability(model: list[Order], keys: np.ndarray) -> np.ndarray:
    """Natural log-probability of the last symbol of each n-gram, backing off where it was never seen."""
    out = np.zeros(len(keys))
    open_ = np.arange(len(keys))
    rest = keys.astype(np.int64)
    for n in range(len(model), 0, -1):
        order = model[n - 1]
        key = rest & ((1 << SYMBOL_BITS * n) - 1)
        if not len(order.keys):
            continue
        at = np.minimum(np.searchsorted(order.keys, key), len(order.keys) - 1)
        hit = order.keys[at] == key
        out[open_[hit]] += order.logp[at[hit]]
        open_, rest, key = open_[~hit], rest[~hit], key[~hit]
        if not len(open_):
            return out
        context = key >> SYMBOL_BITS
        at = np.minimum(np.searchsorted(order.contexts, context), len(order.contexts) - 1)
        known = order.contexts[at] == context
        out[open_[known]] += order.backoff[at[known]]
    out[open_] -= np.log(1 << SYMBOL_BITS)
    return out


def _by_group(counts: DataFrame, made, schema: str) -> DataFrame:  # noqa: ANN001
    """made(lang, sorted keys, counts) over whole groups of n-grams of a language with the same symbols before the last."""
    middle = F.shiftright("key", SYMBOL_BITS).bitwiseAND(SYMBOLS_MASK)
    dealt = counts.select("lang", middle.alias("middle"), "key", "n").repartition("lang", "middle").sortWithinPartitions("lang", "middle")
    names = [x.split()[0] for x in schema.split(", ")]

    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        for lang in pc.unique(table["lang"]).to_pylist():
            own = table.filter(pc.equal(table["lang"], lang))
            keys, n = own["key"].to_numpy(), own["n"].to_numpy()
            order = np.argsort(keys)
            for out in made(lang, keys[order], n[order]):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out[0]), pa.string()), *map(pa.array, out)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = (batch["lang"][-1].as_py(), batch["middle"][-1].as_py())
            lang = np.array(batch["lang"].to_pylist(), object)
            first = int(np.argmax((lang == last[0]) & (batch["middle"].to_numpy() == last[1])))  # the last group may go on
            if first or (held and (held[-1]["lang"][0].as_py(), held[-1]["middle"][0].as_py()) != last):
                yield from found([*held, batch.slice(0, first)])
                held = []
            held.append(batch.slice(first))
        if held:
            yield from found(held)

    return dealt.mapInArrow(tidy(run), schema)


def log_probabilities(counts: DataFrame) -> tuple[DataFrame, dict[str, list[Order]]]:
    """(lang, key, logp) of every n-gram in counts, and the orders up to ``LOWER`` of each language."""

    def summed(lang: str, keys: np.ndarray, n: np.ndarray) -> Iterator[list[np.ndarray]]:
        orders = continued(keys[n > 0], n[n > 0], ORDER, LOWER)
        low, times = orders.pop(LOWER)
        number = np.repeat(sorted(orders), 4)
        yield [number, np.tile(np.arange(1, 5), len(orders)), np.concatenate([tallies(orders[k][1]) for k in sorted(orders)])]
        yield [np.full(len(low), LOWER), low, times]

    sums = _by_group(counts, summed, "lang string, order bigint, key bigint, n bigint")
    sums = sums.groupBy("lang", "order", "key").agg(F.sum("n").alias("n")).toArrow().sort_by("key")
    lower: dict[str, tuple[list[Order], dict[int, np.ndarray]]] = {}
    for lang in pc.unique(sums["lang"]).to_pylist():
        own = sums.filter(pc.equal(sums["lang"], lang))
        order, key, n = (own[x].to_numpy() for x in ("order", "key", "n"))
        cuts = {k: _discounts(n[order == k].tolist()) for k in range(LOWER + 1, ORDER + 1)}
        orders = continued(key[order == LOWER], n[order == LOWER], LOWER, 1)
        lower[lang] = estimate(orders, {k: _discounts(tallies(x[1])) for k, x in orders.items()}, []), cuts

    def known(lang: str, keys: np.ndarray, n: np.ndarray) -> Iterator[list[np.ndarray]]:
        below, cuts = lower[lang]
        model = estimate(continued(keys[n > 0], n[n > 0], ORDER, LOWER + 1), cuts, below)
        yield [keys, log_probability(model, keys).astype(np.float32)]

    return _by_group(counts, known, "lang string, key bigint, logp float"), {lang: x[0] for lang, x in lower.items()}


def base_statistics(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document of a slice."""
    docs = len(bounds) - 1
    words = split_words(data, bounds)
    n_words = np.diff(words.bounds)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    own = owners(words.bounds)
    chars = np.bincount(own, lead[words.end] - lead[words.start], docs).astype(np.int64)
    n_symbols = _symbols(data, bounds)

    breaks = np.flatnonzero(data == 10)
    start = np.concatenate((bounds[:-1], breaks + 1))
    end_ = np.concatenate((breaks, bounds[1:]))
    start.sort()
    end_.sort()  # the k-th line starts at the k-th start and stops at the k-th end
    line_of = np.searchsorted(bounds, start, "right") - 1
    full = np.searchsorted(words.start, end_) > np.searchsorted(words.start, start)
    start, end_, line_of = start[full], end_[full], line_of[full]
    key = mix(span_hashes(data, start, end_) ^ mix(line_of.astype(np.uint64) + np.uint64(1)))
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    n_dup = np.bincount(line_of[~first], minlength=docs)

    repeat = np.zeros(docs, np.int64)
    at = np.flatnonzero(gram_mask(words.bounds, WINDOW))
    if len(at):
        key = mix(gram_hashes(word_hashes(data, words), WINDOW)[at] ^ mix(own[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(own) + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + WINDOW, -1)
        repeat = np.bincount(own, np.cumsum(edge)[:-1] > 0, docs).astype(np.int64)
    return [n_words, chars, n_symbols, n_dup, repeat]


STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


Lookup = tuple[np.ndarray, np.ndarray, list["Order"]]
PPL = ["log_ppl", "low_ppl"]


def _scored(ids: pa.Array, texts: pa.Array, langs: list[str], model: dict[str, Lookup], names: list[str]) -> pa.RecordBatch:
    """Statistics, characters, log_ppl and low_ppl of each text; model has all n-grams of its texts."""
    columns: list[list[np.ndarray]] = [[] for _ in range(len(STATISTICS) + 1 + len(PPL))]
    for part in slices(texts, SCORED_BYTES):
        keys, bounds = gram_keys(part.data, part.bounds)
        size = np.diff(bounds)
        own = np.repeat(np.arange(len(size)), size)
        here = np.array(langs[part.first : part.last] + [None], object)[:-1]
        logp = [np.zeros(len(keys)) for _ in PPL]
        for lang in set(here.tolist()):
            member = np.flatnonzero((here == lang)[own])
            if len(member):
                own_keys, at = np.unique(keys[member], return_inverse=True)
                known, values, below = model[lang]
                logp[0][member] = values[np.searchsorted(known, own_keys)][at]
                short, place = np.unique(own_keys & SYMBOLS_MASK, return_inverse=True)
                logp[1][member] = log_probability(below, short)[place][at]
        ppl = [np.where(size > 0, np.bincount(own, -x, len(size)) / np.maximum(size, 1), np.nan) for x in logp]
        for to, x in zip(columns, [*base_statistics(part.data, part.bounds), size, *ppl], strict=True):
            to.append(x)
    arrays = [np.concatenate(x) if x else np.zeros(0) for x in columns]
    out = [pa.array(x.astype(np.int64)) for x in arrays[: -len(PPL)]] + [pc.if_else(pa.array(~np.isnan(x)), pa.array(x.astype(np.float64)), None) for x in arrays[-len(PPL) :]]
    return pa.RecordBatch.from_arrays([ids, pa.array(langs, pa.string()), *out], names=names)


def _sorted(table: pa.Table, below: list[Order]) -> Lookup:
    keys, logp = table["key"].to_numpy(), table["logp"].to_numpy()
    order = np.argsort(keys)
    return keys[order], logp[order], below


def score(docs: DataFrame, counts: DataFrame, id_col: str, text_col: str, lang_col: str, model_rows: int = MODEL_ROWS) -> DataFrame:
    """(id_col, lang, statistics, chars, log_ppl, low_ppl) of each row, stored; the last two are null for a text without characters."""
    id_kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_kind}, lang string, " + ", ".join(f"{x} bigint" for x in STATISTICS) + ", chars bigint, log_ppl double, low_ppl double"
    names = [id_col, "lang", *STATISTICS, "chars", *PPL]
    table, lower = log_probabilities(counts)
    model = written(table, "model")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), named(lang_col).alias("lang"))
    if model.count() <= model_rows:
        # not in the function itself: a worker would keep its pickled bytes beside the arrays made from them
        given = docs.sparkSession.sparkContext.broadcast({lang: _sorted(model.where(F.col("lang") == lang).select("key", "logp").toArrow(), below) for lang, below in lower.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _scored(batch["id"], batch["text"], batch["lang"].to_pylist(), given.value, names)

        scored = written(rows.mapInArrow(tidy(run), schema), "scored", TEXT_ROWS)
        given.destroy()
        return scored

    chunks = 1 + (rows.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0) // CHUNK_CHARS
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk, langs = batch["chunk"].to_numpy(), np.array(batch["lang"].to_pylist() + [None], object)[:-1]
            for part in slices(batch["text"]):
                keys, bounds = gram_keys(part.data, part.bounds)
                own = np.repeat(np.arange(part.first, part.last), np.diff(bounds))
                for lang in set(langs[part.first : part.last].tolist()):
                    member = (langs == lang)[own]
                    both = np.unique(np.stack((chunk[own[member]], keys[member])), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * both.shape[1], pa.string()), pa.array(both[0]), pa.array(both[1])], names=["lang", "chunk", "key"])

    answers = rows.mapInArrow(tidy(asked), "lang string, chunk bigint, key bigint").distinct().join(model, ["lang", "key"])

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        lang = left["lang"][0].as_py() if left.num_rows else ""
        own = {lang: _sorted(right, lower.get(lang, []))}
        return pa.Table.from_batches([_scored(b["id"], b["text"], b["lang"].to_pylist(), own, names) for b in left.combine_chunks().to_batches()], arrow)

    return written(rows.groupBy("lang", "chunk").cogroup(answers.groupBy("lang", "chunk")).applyInArrow(met, schema), "scored")


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    least_words: int = 20,
    most_repeated: int = 30,
    width: float = 4.0,
    slack: float = 0.3,
    model_rows: int = MODEL_ROWS,
) -> DataFrame:
    """Statistics, ``base_failed``, ``log_ppl`` and ``kept`` of every row of docs."""
    docs = docs.select(id_col, text_col, lang_col)
    counts = count_grams(first_copies(docs, id_col, text_col, lang_col))
    scored = score(docs, counts, id_col, text_col, lang_col, model_rows)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    kind, root = docs.schema[lang_col].dataType, F.sqrt(F.greatest("chars", F.lit(1)))
    sound = scored.where("not base_failed and chars > 0").select("lang", "chars", *PPL).distinct()
    quarter = lambda c, grid, at: F.percentile(F.floor(c * grid) / grid, at)
    middle = sound.groupBy(F.col("lang").alias("of")).agg(quarter(F.col("log_ppl"), PPL_GRID, [0.5, 0.75]).alias("m"), quarter(F.col("low_ppl"), PPL_GRID, 0.5).alias("low"))
    middle = small_side(written(middle, "middle"))  # a row a language
    away = [quarter((F.col(x) - m) * root, Z_GRID, [0.25, 0.75]).alias(f"q_{x}") for x, m in zip(PPL, (F.col("m")[0], F.col("low")), strict=True)]
    spread = sound.join(middle, F.col("lang") == F.col("of")).groupBy("of", "m", "low").agg(*away)
    half = F.col("q_log_ppl")[1], -F.col("q_low_ppl")[0]  # the quartile on the band's side of the median
    spread = written(spread, "spread")
    reach = [2 * width * F.greatest(x, F.lit(LEAST_SPREAD / 2)) for x in half]
    bands = spread.select(F.col("of").alias("band"), F.col("m")[1].alias("high"), "low", reach[0].alias("over"), reach[1].alias("under"))
    inside = (F.col("low_ppl") >= F.col("low") - F.col("under") / root - slack) & (F.col("log_ppl") <= F.col("high") + F.col("over") / root + slack)
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    lang = F.when(F.col("lang") != "", F.substring("lang", 2, 1 << 30)).cast(kind)
    return scored.join(small_side(bands), F.col("lang") == F.col("band"), "left").withColumns({"kept": kept, "lang": lang}).drop("band", "high", "low", "over", "under")
