"""Toxicity by non-negative positive-unlabelled learning.

Features of a text are the words (runs of letters, lower case) that it has, and the starts of 4, 5 and 6 letters
of its words, each present or not, hashed into 2**``HASH_BITS`` places. A linear model is trained in numpy from
confirmed toxic texts P and texts U of unknown label with the non-negative risk of Kiryo et al. (2017),

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]),    l(z) = log(1 + exp(-z)),

by accelerated proximal gradient steps with a soft threshold that keeps only features which matter. When the
second term falls below zero the step climbs it instead, as the paper has it, so rare words of a few texts are not
learned by heart. The class prior is the share of label 1 among the labelled training rows.

Training reads at most ``most_positive`` and about ``most_unlabelled`` texts, drawn by a hash of the id (those two
bounds are documented parameters); scoring reads every whole text. A null or empty text is scored by the
intercept. Without a positive every score is 0. Repeated rows score alike; labels that are null count as none, and of
several labels of an id the greatest counts. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.language_id import _folding
from quire.llm.text_arrays import code_points, owners, slices, span_hashes, split_words

HASH_BITS = 20
STARTS = (4, 5, 6)


class Model(NamedTuple):
    weights: np.ndarray
    intercept: float


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) of every feature occurrence of a slice; occurrences may repeat."""
    points, bounds = code_points(data, bounds)
    letters = _folding()[np.minimum(points, 0x10000)]
    # the word splitter looks at bytes: letters are marked 1, all else is a space
    words = split_words(np.where(letters == 32, 32, 1).astype(np.uint8), bounds)
    doc, start, end = owners(words.bounds), words.start, words.end
    docs, hashes = [doc], [span_hashes(letters, start, end)]
    for size in STARTS:
        long = end - start > size
        docs.append(doc[long])
        hashes.append(span_hashes(letters, start[long], start[long] + size, 0xC2B2AE3D27D4EB4F | size << 8 | 1))
    return np.concatenate(docs), (np.concatenate(hashes) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place) pairs of all texts, by row."""
    rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part in slices(pa.array(texts, pa.large_string())):
        doc, place = features(part.data, part.bounds)
        both = np.unique((doc + part.first) << HASH_BITS | place)
        rows.append(both >> HASH_BITS)
        places.append(both & ((1 << HASH_BITS) - 1))
    return np.concatenate(rows), np.concatenate(places)


class Sums:
    """Sums of a 0/1 matrix, given as (row, column) pairs, with a vector on either side."""

    def __init__(self, row: np.ndarray, column: np.ndarray, rows: int, columns: int) -> None:
        self.shape = rows, columns
        self.sides = []
        for own, other, n in ((row, column, rows), (column, row, columns)):
            order = np.argsort(own, kind="stable")
            own = own[order]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
            self.sides.append((other[order], first, own[first], n))

    def _of(self, side: int, x: np.ndarray) -> np.ndarray:
        other, first, own, n = self.sides[side]
        out = np.zeros(n)
        if len(first):
            out[own] = np.add.reduceat(x[other], first)
        return out

    def by_row(self, x: np.ndarray) -> np.ndarray:
        return self._of(0, x)

    def by_column(self, x: np.ndarray) -> np.ndarray:
        return self._of(1, x)


def risk_slope(g: np.ndarray, p: int, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of margins g, of which the first p are positive texts', and the slope of the step."""
    n = len(g)
    rising = 1 / (1 + np.exp(-np.clip(g, -30, 30)))  # derivative of l(-g)
    loss = np.logaddexp(0, g)
    rest = loss[p:].mean() - prior * loss[:p].mean()
    slope = np.zeros(n)
    if rest >= 0:
        slope[p:] = rising[p:] / (n - p)
        slope[:p] = -prior / p  # of l(g) and of -l(-g) together
    else:
        slope[p:] = -rising[p:] / (n - p)
        slope[:p] = prior * rising[:p] / p
    return prior * np.logaddexp(0, -g[:p]).mean() + max(0.0, rest), slope


def _descend(row: np.ndarray, column: np.ndarray, size: int, n: int, p: int, prior: float, steps: int, penalty: float) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient (FISTA) on the non-negative risk of n texts, of which the first p are positive."""
    sums = Sums(row, column, n, size)
    share = np.zeros(n)
    share[p:] = 1 / (n - p)
    probe = np.ones(size + 1)
    for _ in range(15):  # the largest curvature, by power iteration
        g = (probe[-1] + sums.by_row(probe[:-1])) * share
        probe = np.append(sums.by_column(g), g.sum())
        curvature = np.linalg.norm(probe)
        probe /= max(curvature, 1e-12)
    rate = 4 / max(curvature, 1e-12)
    w, b = np.zeros(size), float(np.log(prior / max(1 - prior, 1e-6)))
    at_w, at_b, pace = w, b, 1.0
    for _ in range(steps):
        _, slope = risk_slope(at_b + sums.by_row(at_w), p, prior)
        new_w = at_w - rate * sums.by_column(slope)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - rate * penalty, 0)
        new_b = at_b - rate * slope.sum()
        next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        push = (pace - 1) / next_pace
        at_w, at_b = new_w + push * (new_w - w), new_b + push * (new_b - b)
        w, b, pace = new_w, new_b, next_pace
    return w, b


def fit(positive: list[str], unlabelled: list[str], prior: float, steps: int = 600, penalty: float = 2e-4, least_texts: int = 3) -> Model:
    """Minimise the non-negative risk; features of fewer than ``least_texts`` texts are left out."""
    weights = np.zeros(1 << HASH_BITS, np.float32)
    if not positive or not unlabelled or prior <= 0:
        return Model(weights, -np.inf)
    row, place = matrix(positive + unlabelled)
    n, p = len(positive) + len(unlabelled), len(positive)
    known, column, count = np.unique(place, return_inverse=True, return_counts=True)
    often = count >= least_texts
    keep = often[column]
    row, column, known = row[keep], (np.cumsum(often) - 1)[column[keep]], known[often]
    w, b = _descend(row, column, len(known), n, p, prior, steps, penalty)
    weights[known] = w
    return Model(weights, b)


def score(texts: pa.Array | pa.ChunkedArray, model: Model) -> np.ndarray:
    """Probability of label 1 for each text."""
    if model.intercept == -np.inf:
        return np.zeros(len(texts))
    out = [np.zeros(0)]
    for part in slices(texts):
        doc, place = features(part.data, part.bounds)
        some = model.weights[place] != 0
        both = np.unique(doc[some] << HASH_BITS | place[some])
        g = model.intercept + np.bincount(both >> HASH_BITS, model.weights[both & ((1 << HASH_BITS) - 1)], part.last - part.first)
        out.append(1 / (1 + np.exp(-np.clip(g, -500, 500))))
    return np.concatenate(out)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most_positive: int, most_unlabelled: int) -> Model:
    """Model from the rows of docs (all of them training rows) and labels by id."""
    docs = docs.select(id_col, text_col)
    part = (F.xxhash64(F.col(id_col).cast("string"), F.lit("pu")) / F.lit(float(1 << 64))) + 0.5
    own = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("toxic")).where("toxic is not null")
    labelled, toxic = own.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0))).first()
    if not toxic:
        return fit([], [], 0)
    chosen = own.where("toxic = 1").select(F.col(id_col).alias("chosen")).orderBy(F.xxhash64("chosen"), "chosen").limit(most_positive)
    positive = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("chosen")).select(text_col, F.xxhash64("chosen", text_col).alias("part")).orderBy("part", text_col).limit(2 * most_positive)
    rows = docs.count()
    drawn = docs.where(part < min(1.0, most_unlabelled / max(rows, 1))).select(text_col, part.alias("part")).orderBy("part", text_col).limit(2 * most_unlabelled)
    texts = lambda df: sorted((r[0] or "") for r in df.collect())
    return fit(texts(positive), texts(drawn), toxic / labelled)


def toxicity(
    docs: DataFrame,
    train_docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_positive: int = 1500,
    most_unlabelled: int = 5000,
    threshold: float = 0.7,
) -> DataFrame:
    """(id_col, score, predicted) for each row of docs; labels of other rows than train_docs' must not be given."""
    model = train(train_docs, labels, id_col, text_col, label_col, most_positive, most_unlabelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1), model))], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
