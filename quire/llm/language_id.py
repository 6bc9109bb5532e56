"""Language identification with string kernels.

Kernel. A text is the set of its letter n-grams of lengths 1 to ``MAX_N`` (the blended spectrum, presence only):
letters are folded to lower case and every run of other characters is one space. k(x, y) is the number of n-grams
that both have, over the root of the product of their numbers.

Training. Landmarks are a few texts of each language. With K the kernel between texts and landmarks and G that
among landmarks, Nystroem features are K G^(-1/2); one ridge regression per language fits +1 against -1 on them.
The training texts are a sample of at most about ``per_language`` texts of each language, drawn by a hash of the
id; that bound and ``landmarks`` are the only ones, and prediction reads every whole text.

Scoring. Landmark sets, G^(-1/2) and the ridge weights fold into one matrix from n-grams to languages, so a
batch of texts is a 0/1 matrix times that matrix, each row divided by the root of its number of n-grams.

A text that is null or has no letter gets ``und`` and score 0; with nothing to learn from, every text does.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.text_arrays import code_points, slices

MAX_N = 3
UNKNOWN = "und"
BATCH = 256
_fold: list[np.ndarray] = []


class Model(NamedTuple):
    """weights[i] are the languages' weights of the n-gram grams[i]; grams are sorted."""

    languages: list[str]
    grams: np.ndarray
    weights: np.ndarray


def _folding() -> np.ndarray:
    """Symbol of each basic-plane code point: its lower-case letter, or a space."""
    if not _fold:
        table = np.full(0x10001, 32, np.uint16)
        for i in range(0x10000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        table[0x10000] = 0xFFFF
        _fold.append(table)
    return _fold[0]


def gram_sets(texts: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """The sorted distinct n-grams of each text, packed 16 bits a symbol; none for a text without a letter."""
    fold = _folding()
    for part in slices(texts):
        points, bounds = code_points(part.data, part.bounds)
        symbols = fold[np.minimum(points, 0x10000)].copy()
        for i in np.flatnonzero(points > 0xFFFF).tolist():
            symbols[i] = 0xFFFF if chr(points[i]).isalpha() else 32
        for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            s = symbols[a:b]
            blank = s == 32
            if blank.all():
                yield np.zeros(0, np.uint64)
                continue
            again = np.zeros(len(s), bool)
            again[1:] = blank[1:] & blank[:-1]
            s = s[~again].astype(np.uint64)
            codes, grams = s, [s]
            for n in range(1, MAX_N):
                codes = (codes[:-1] << np.uint64(16)) | s[n:]
                grams.append(codes)
            yield np.unique(np.concatenate(grams))


def presence(sets: list[np.ndarray], grams: np.ndarray) -> np.ndarray:
    """0/1 matrix: a row for each text, a column for each known n-gram."""
    out = np.zeros((len(sets), len(grams)), np.float32)
    if len(grams):
        for row, own in enumerate(sets):
            at = np.searchsorted(grams, own)
            at[at == len(grams)] = 0
            out[row, at[grams[at] == own]] = 1
    return out


def fit(texts: list[str], languages: list[str], landmarks: int = 40, ridge: float = 1e-3) -> Model:
    """Train on (text, language) pairs, whose order decides which become landmarks."""
    sets = list(gram_sets(pa.array(texts, pa.large_string())))
    usable = [i for i, own in enumerate(sets) if len(own)]
    sets, labels = [sets[i] for i in usable], [languages[i] for i in usable]
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))
    chosen = [i for name in names for i in [k for k, x in enumerate(labels) if x == name][:landmarks]]
    grams = np.unique(np.concatenate([sets[i] for i in chosen]))
    size = np.array([len(x) for x in sets], np.float64)
    x = presence(sets, grams)
    marks = x[chosen] / np.sqrt(size[chosen])[:, None].astype(np.float32)
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = value > 1e-6 * value[-1]
    half = (vector[:, keep] / np.sqrt(value[keep])) @ vector[:, keep].T
    kernel = (x @ marks.T).astype(np.float64) / np.sqrt(size)[:, None]
    phi = kernel @ half
    sign = np.where(np.array(labels)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    beta = np.linalg.solve(phi.T @ phi + ridge * len(labels) * np.eye(phi.shape[1]), phi.T @ sign)
    return Model(names, grams, (marks.T.astype(np.float64) @ (half @ beta)).astype(np.float32))


def score(texts: pa.Array | pa.ChunkedArray, model: Model) -> tuple[list[str], np.ndarray]:
    """Best language and score of each text; the score is the softmax of the regressions' margins."""
    found: list[str] = []
    scores: list[np.ndarray] = []
    held: list[np.ndarray] = []

    def close() -> None:
        size = np.array([len(x) for x in held], np.float64)
        if not model.languages:
            found.extend([UNKNOWN] * len(held))
            scores.append(np.zeros(len(held)))
            return
        margin = (presence(held, model.grams) @ model.weights) / np.sqrt(np.maximum(size, 1))[:, None]
        best = margin.argmax(1)
        soft = np.exp(2 * (margin - margin.max(1, keepdims=True)))
        found.extend(model.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), size.tolist(), strict=True))
        scores.append(np.where(size > 0, 1 / soft.sum(1), 0.0))

    for own in gram_sets(texts):
        held.append(own)
        if len(held) == BATCH:
            close()
            held = []
    if held:
        close()
    return found, np.concatenate(scores) if scores else np.zeros(0)


def training_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> list[tuple[str, str]]:
    """About ``per_language`` texts of each language (all, if it has fewer), chosen by a hash of the id."""
    counts = {r[0]: r[1] for r in docs.where(F.col(lang_col).isNotNull()).groupBy(lang_col).count().collect()}
    if not counts:
        return []
    part = (F.xxhash64(F.col(id_col).cast("string"), F.lit("lang")) / F.lit(float(1 << 64))) + 0.5
    share = F.coalesce(*[F.when(F.col(lang_col) == k, F.lit(min(1.0, per_language / n))) for k, n in counts.items()])
    chosen = docs.where(F.col(text_col).isNotNull() & (part < share)).select(text_col, lang_col, part.alias("part"))
    rows = chosen.orderBy("part", lang_col).limit(2 * per_language * len(counts)).collect()
    return [(r[0], r[1]) for r in rows]


def identify(
    docs: DataFrame,
    train: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 200,
    landmarks: int = 40,
) -> DataFrame:
    """(id_col, lang_pred, score) for each row of docs, learned from train's text_col and non-null lang_col only.

    Languages are few (a model holds landmarks of each); rows that repeat are scored alike; other columns are
    neither read nor returned.
    """
    pairs = training_texts(train, id_col, text_col, lang_col, per_language)
    model = fit([t for t, _ in pairs], [x for _, x in pairs], landmarks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = score(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores)], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
