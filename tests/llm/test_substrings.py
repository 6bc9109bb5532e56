import collections
import hashlib
import random
import re

import pytest

from quire.llm.substrings import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    count = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_like_counting_all_windows(spark, seed):
    rng = random.Random(seed)
    passages = [[f"p{i}w{j % rng.choice((3, 50))}" for j in range(rng.randint(20, 90))] for i in range(6)]
    texts = []
    for i in range(60):
        parts = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 10)
            parts += [p[a : len(p) - rng.randint(0, 10)], [f"x{i}{k}" for k in range(rng.randint(0, 5))]]
        texts.append(" ".join(w for p in parts for w in p))
    texts += ["for " * 100, "for " * 40, "a b " * 60, texts[3], texts[3], None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in remove_repeats(df).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts, 35)


def test_odd_documents(odd_docs, no_docs):
    rows = odd_docs.collect()
    want = sorted((r.doc_id or -1, *b) for r, b in zip(rows, brute([r.text for r in rows], 35), strict=True))
    found = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in remove_repeats(odd_docs).collect())
    assert found == want
    assert remove_repeats(no_docs).count() == 0
