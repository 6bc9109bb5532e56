import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.classic.dataframe import DataFrame

from quire.llm import quality as q
from quire.llm.scratch import BATCH_ROWS, TEXT_ROWS, written
from quire.llm.text_arrays import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(t):
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)]


def test_base_statistics_like_brute_force():
    rng = random.Random(2)
    texts = ["", "\n\n", "a\na\n a\na", "x " * 40, "é# \n é# \n| |"]
    texts += [" ".join(rng.choice("abc\n") for _ in range(rng.randint(0, 80))) for _ in range(80)]
    got = []
    for part in slices(pa.array(texts), most=64):
        got += np.stack(q.base_statistics(part.data, part.bounds), 1).tolist()
    assert got == [statistics(t) for t in texts]


def kneser_ney(texts):
    """A plain dictionary version of the interpolated model, for probabilities of symbols after contexts."""
    n = q.ORDER
    counts = collections.Counter()
    for t in texts:
        s = [0] * (n - 1) + [int(q.alphabet()[min(ord(c), 65535)]) for c in t]
        counts.update(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
    orders = {n: counts}
    for k in range(n - 1, 0, -1):
        orders[k] = collections.Counter(g[1:] for g in orders[k + 1])
    cut = {k: q._discounts(q.tallies(np.array(list(c.values())))) for k, c in orders.items()}

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / 256
        own = {g: c for g, c in orders[k].items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        if not total:
            return p(gram[1:])
        d = lambda c: cut[k][min(c, 3)]
        c = own.get(gram, 0)
        return (c - (d(c) if c else 0)) / total + sum(map(d, own.values())) / total * p(gram[1:])

    return p


def test_model_like_dictionary_version(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcab d.") for _ in range(60)) for _ in range(12)]
    others = ["abc dz. ab | | |", "zzzz #", ""]  # of many symbols: judged, not learned
    rows = [(i, t, lang) for i, t in enumerate(texts + others + texts[:3]) for lang in ("en", None)]  # copies train once
    df = spark.createDataFrame(rows, "id bigint, text string, lang string").repartition(3)
    table, lower = q.log_probabilities(q.count_grams(q.first_copies(df, "id", "text", "lang")))
    table = table.collect()
    p = kneser_ney(texts)
    seen = set()
    for r in table:
        gram = tuple(r.key >> q.SYMBOL_BITS * i & 255 for i in range(q.ORDER - 1, -1, -1))
        assert math.isclose(math.exp(r.logp), p(gram), rel_tol=1e-5)
        low = q.log_probability(lower[r.lang], np.array([r.key & q.SYMBOLS_MASK]))[0]
        assert math.isclose(math.exp(low), p(gram[-q.LOWER :]), rel_tol=1e-5)
        seen.add((r.lang, gram))
    assert len(seen) == len(table)
    want = set()
    for t in texts + others:
        s = [0] * (q.ORDER - 1) + [int(q.alphabet()[ord(c)]) for c in t]
        want |= {(lang, tuple(s[i : i + q.ORDER])) for i in range(len(t)) for lang in ("=en", "")}
    assert seen == want
    for context in [(1, 2, 3), (0, 0, 0, 0, 0)]:
        assert math.isclose(sum(p((*context, s)) for s in range(256)), 1, rel_tol=1e-9)


def test_large_model_gives_the_same(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(q, "CHUNK_CHARS", 30_000)
    rows = lambda df: sorted((repr(tuple(r)) for r in df.collect()))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (odd_docs, docs):
        assert rows(q.judge(df, model_rows=0)) == rows(q.judge(df))


def test_gibberish_is_rejected_and_clean_text_kept(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice(["an", "the", "re", "on", "er", "st"]) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    clean = [" ".join(rng.choices(words, k=120)) for _ in range(300)]
    noise = ["".join(rng.choice("qzxj#&wvk ") for _ in range(600)) for _ in range(3)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + noise)], "doc_id bigint, text string, lang string")
    kept = {r.doc_id: r.kept for r in q.judge(df).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[300 + i] for i in range(3))


def test_junk_of_usual_character_sequences_is_rejected(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["an", "the", "re", "on", "er", "st"]) for _ in range(rng.randint(1, 3)))
    clean = [" ".join(word() for _ in range(120)) for _ in range(200)]
    tables = [" | ".join(word() for _ in range(80)) for _ in range(10)]
    marked = [" ".join(word() + rng.choice(["%%%", "&&&", "***"]) for _ in range(80)) for _ in range(10)]
    rows = [(i, t, "en") for i, t in enumerate(clean + tables + marked)]
    rows += [(1000 + i, t, "sym") for i, t in enumerate(tables)]  # a language of nothing else is counted whole
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in q.judge(df).collect()}
    assert len(got) == len(rows) and all(got[i].kept for i in range(200))
    assert not [i for i in range(200, 220) if got[i].kept]
    assert all(got[1000 + i].kept and got[1000 + i].n_words == 159 for i in range(10))


def test_odd_documents(odd_docs, no_docs):
    rows = {r.doc_id: r for r in q.judge(odd_docs).collect()}
    assert q.judge(odd_docs).count() == odd_docs.count()
    assert rows[3].base_failed and not rows[3].kept and rows[3].n_words == 0
    assert rows[4].n_words == 0 and rows[9].n_words == 0 and rows[9].log_ppl is not None
    assert rows[5].n_words == 30_000
    assert q.judge(no_docs).count() == 0
    assert q.judge(odd_docs.where("doc_id in (3, 4)")).count() == 2


def test_no_function_carries_the_model(spark, monkeypatch):
    """A worker keeps the bytes of a function beside what it makes of them."""
    shipped = []
    plain = DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda df, run, *a, **b: shipped.append(len(cloudpickle.dumps(run))) or plain(df, run, *a, **b))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = q.count_grams(q.first_copies(docs, "doc_id", "text", "lang"))
    assert q.score(docs, counts, "doc_id", "text", "lang").count() == docs.count()
    assert len(shipped) == 4 and shipped[-1] < 100_000 < counts.count()
    assert spark.conf.get(BATCH_ROWS) == "10000"


def test_texts_reach_workers_in_small_batches(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    def sizes(*rows):
        return {r.n for r in written(spark.range(0, 12_000, 1, 1).mapInArrow(run, "n bigint"), "sizes", *rows).collect()}

    assert sizes(TEXT_ROWS) == {TEXT_ROWS} and sizes() == {10_000, 2_000}
