import random

import numpy as np
import pyarrow as pa

from quire.llm import toxicity as t


def test_learns_from_positive_and_unlabelled():
    rng = random.Random(1)
    words = ["w" + "".join(rng.choices("abcdefgh", k=4)) for _ in range(200)]
    text = lambda bad: " ".join(rng.choices(words, k=40) + (rng.choices(["vile", "awful"], k=2) if bad else []))
    positive = [text(True) for _ in range(150)]
    unlabelled = [text(i % 8 == 0) for i in range(800)]
    model = t.fit(positive, unlabelled, 1 / 8)
    scores = t.score(pa.array([text(True) for _ in range(50)] + [text(False) for _ in range(200)] + ["", None]), model)
    assert (scores[:50] >= 0.7).mean() > 0.95 and (scores[50:] >= 0.7).mean() < 0.02


def plain_risk(g, p, prior):
    loss = lambda z: np.logaddexp(0, -z)
    return prior * loss(g[:p]).mean() + max(0.0, loss(-g[p:]).mean() - prior * loss(-g[:p]).mean())


def test_slope_of_the_risk():
    """The step's slopes against differences of the risk; below zero the step climbs the second term."""
    rng = np.random.default_rng(0)
    n, p, prior = 12, 4, 0.3
    g = rng.normal(size=n)
    risk, slope = t.risk_slope(g, p, prior)
    assert abs(risk - plain_risk(g, p, prior)) < 1e-12
    for i in range(n):
        e = np.zeros(n)
        e[i] = 1e-6
        assert abs((plain_risk(g + e, p, prior) - plain_risk(g - e, p, prior)) / 2e-6 - slope[i]) < 1e-6
    g[p:] -= 20
    rest = lambda g: np.logaddexp(0, g[p:]).mean() - prior * np.logaddexp(0, g[:p]).mean()
    assert rest(g) < 0
    _, slope = t.risk_slope(g, p, prior)
    assert abs((rest(g + 1e-6 * (np.arange(n) == 0)) - rest(g - 1e-6 * (np.arange(n) == 0))) / 2e-6 + slope[0]) < 1e-6


def plain_descent(x, p, prior, steps, penalty):
    """The same steps with a dense matrix, written out."""
    n, size = x.shape
    share = np.array([0.0] * p + [1 / (n - p)] * (n - p))
    probe = np.ones(size + 1)
    full = np.hstack([x, np.ones((n, 1))])
    for _ in range(15):
        probe = full.T @ (share * (full @ probe))
        curvature = np.linalg.norm(probe)
        probe = probe / curvature
    rate, v, last, pace = 4 / curvature, np.append(np.zeros(size), np.log(prior / (1 - prior))), None, 1.0
    last = v
    for _ in range(steps):
        g = full @ v
        _, slope = t.risk_slope(g, p, prior)
        new = v - rate * full.T @ slope
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        next_pace = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        v, last, pace = new + (pace - 1) / next_pace * (new - last), new, next_pace
    return last[:-1], last[-1]


def test_descent_like_a_dense_one():
    rng = np.random.default_rng(5)
    n, p, size, prior = 60, 15, 25, 0.2
    x = (rng.random((n, size)) < 0.2).astype(float)
    x[:p, 0] = 1
    row, column = np.nonzero(x)
    w, b = t._descend(row, column, size, n, p, prior, 80, 1e-3)
    want_w, want_b = plain_descent(x, p, prior, 80, 1e-3)
    assert np.allclose(w, want_w, atol=1e-8) and abs(b - want_b) < 1e-8
    start = plain_risk(np.full(n, np.log(prior / (1 - prior))), p, prior)
    assert plain_risk(x @ w + b, p, prior) < start and w[0] > 0


def test_held_out_ranking(spark):
    from quire.llm.queries import op5_toxicity

    d = "/root/testdata/sf0.1"
    rows = op5_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    score, toxic = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    rank = score.argsort().argsort() + 1
    k = toxic.sum()
    assert (rank[toxic == 1].sum() - k * (k + 1) / 2) / (k * (len(rows) - k)) > 0.95
    flagged = np.array([r.predicted for r in rows]) == 1
    assert toxic[flagged].mean() > 0.8


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 1), (2, 1, 0), (None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    found = t.toxicity(odd_docs, odd_docs, labels).collect()
    assert len(found) == odd_docs.count() and all(0 <= r.score <= 1 for r in found)
    assert all(r.score == 0 for r in t.toxicity(odd_docs, odd_docs, labels.limit(0)).collect())
    assert t.toxicity(no_docs, no_docs, labels).count() == 0
