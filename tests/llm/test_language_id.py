import math
import random
import re

import numpy as np
import pyarrow as pa

from quire.llm import language_id as li


def test_kernel_classifier_learns_letters_not_marks():
    texts = ["the cat and the dog and the tree"] * 5 + ["der hund und die katze und der baum"] * 5
    model = li.fit(texts, ["en"] * 5 + ["de"] * 5, landmarks=3)
    found, scores = li.score(pa.array(["The tree!", "Der Baum?", None, "123 ,.", ""]), model)
    assert found == ["en", "de", "und", "und", "und"]
    assert scores[2:].tolist() == [0, 0, 0] and all(0.5 < s <= 1 for s in scores[:2])


def plain_margins(train, labels, landmarks, ridge, probe):
    """Kernel ridge regression on Nystroem features, written out with sets of n-grams."""
    def grams(t):
        s = re.sub(r" +", " ", "".join(c.lower() if c.isalpha() else " " for c in t))
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}

    k = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    sets, names = [grams(t) for t in train], sorted(set(labels))
    marks = [sets[i] for name in names for i in [j for j, x in enumerate(labels) if x == name][:landmarks]]
    gram = np.array([[k(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(gram)
    keep = value > 1e-6 * value[-1]
    half = vector[:, keep] @ np.diag(value[keep] ** -0.5) @ vector[:, keep].T
    phi = np.array([[k(a, b) for b in marks] for a in sets]) @ half
    sign = np.array([[1.0 if x == name else -1.0 for name in names] for x in labels])
    beta = np.linalg.solve(phi.T @ phi + ridge * len(sets) * np.eye(phi.shape[1]), phi.T @ sign)
    return names, np.array([[k(grams(t), b) for b in marks] for t in probe]) @ half @ beta


def test_fit_and_score_like_plain_kernel_ridge():
    rng = random.Random(3)
    syllables = {"aa": ["an", "the", "ing", "er"], "bb": ["sch", "ei", "un", "en"], "cc": ["ció", "os", "la", "que"]}
    text = lambda lang: " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(4, 12)))
    labels = [lang for lang in syllables for _ in range(9)]
    train, probe = [text(x) for x in labels], [text(x) for x in [*syllables] * 6] + ["an la sch", "Ei!! 12 la"]
    names, margins = plain_margins(train, labels, 4, 1e-3, probe)
    found, scores = li.score(pa.array(probe), li.fit(train, labels, landmarks=4, ridge=1e-3))
    assert found == [names[i] for i in margins.argmax(1)]
    soft = np.exp(2 * (margins - margins.max(1, keepdims=True)))
    assert np.allclose(scores, 1 / soft.sum(1), atol=1e-3)


def test_held_out_accuracy(spark):
    from quire.llm.queries import op1_language_id

    d = "/root/testdata/sf0.01"
    rows = op1_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_odd_documents(odd_docs, no_docs):
    found = li.identify(odd_docs, odd_docs).collect()
    assert len(found) == odd_docs.count()
    assert {r.lang_pred for r in found if r.doc_id in (3, 4, 6, 9)} == {"und"}
    assert li.identify(no_docs, odd_docs).count() == 0
    assert {r.lang_pred for r in li.identify(odd_docs, no_docs).collect()} == {"und"}
