import random

from quire.llm import decontaminate as dc


def brute_tiles(p, t, least):
    """Greedy string tiling straight from its definition."""
    marked_p, marked_t, tiles = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(p)):
            for b in range(len(t)):
                k = 0
                while a + k < len(p) and b + k < len(t) and p[a + k] == t[b + k] and a + k not in marked_p and b + k not in marked_t:
                    k += 1
                if k > best[0]:
                    best = (k, a, b)
        k, a, b = best
        if k < least:
            return len(marked_p), tiles
        marked_p.update(range(a, a + k))
        marked_t.update(range(b, b + k))
        tiles += 1


def test_tiling_like_its_definition():
    rng = random.Random(3)
    for _ in range(200):
        item = [rng.choice("abcdefghij") for _ in range(rng.randint(6, 25))]
        text = [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 20))]
        for _ in range(rng.randint(1, 3)):
            a = rng.randint(0, len(item) - 3)
            text += item[a : a + rng.randint(3, 15)] + [rng.choice("xyz")]
        seeds = dc.Seeds([(7, item)], 3)
        found = list(dc.matches(" ".join(text), seeds, 0.0))
        covered, tiles = brute_tiles(item, text, 3)
        assert ((found[0][1], found[0][3]) if found else (0, 0)) == (covered, tiles)


def test_reordered_passage_is_caught_and_clean_text_is_not(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "alpha beta gamma delta epsilon zeta")
    docs = [(1, f"intro words {c}. More here: {a.upper()}! And, {b}"), (2, f"{a} only"), (3, None), (4, ""), (5, f"{a} {b} {c}"), (5, f"{a} {b} {c}"), (None, f"{b} {c} {a}")]
    items = [(10, f"{a}, {b}; {c}."), (10, f"{a}, {b}; {c}."), (11, None), (12, "???"), (13, "five six")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    rows = sorted((r.doc_id or 0, r.item_id, r.covered, r.n_tiles) for r in dc.contaminated(d, i).collect())
    assert [r for r in rows if r[1] == 10] == [(0, 10, 18, 2), (1, 10, 18, 3), (5, 10, 18, 1), (5, 10, 18, 1)]
    assert {r[0] for r in rows if r[1] == 13} == {0, 1, 2, 5}
    assert dc.contaminated(d, i.limit(0)).count() == 0 and dc.contaminated(d.limit(0), i).count() == 0


def test_joined_items_give_what_scanned_ones_give(spark, odd_docs, monkeypatch):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    i = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(map(tuple, dc.contaminated(d, i).collect()))
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "alpha beta gamma delta epsilon zeta")
    few = spark.createDataFrame([(1, f"{c} and {a} and {b}"), (1, f"{c} and {a} and {b}"), (None, f"{b} {a}"), (2, "x y z five six"), (3, None), (4, " ".join([a] * 300))], "doc_id bigint, text string")
    items = spark.createDataFrame([("p", f"{a} {b} {c}"), ("p", f"{a} {b} {c}"), ("q", "five six"), ("r", None), ("s", " ".join([a] * 3)), (None, b)], "item_id string, text string")
    key = lambda df: sorted(map(repr, map(tuple, df.collect())))
    small = key(dc.contaminated(few, items))
    monkeypatch.setattr(dc, "BLOCK_TOKENS", -1)
    assert whole and sorted(map(tuple, dc.contaminated(d, i).collect())) == whole
    assert len(small) > 8 and key(dc.contaminated(few, items)) == small
    assert dc.contaminated(odd_docs, i).count() == 0
    assert dc.contaminated(d, i.limit(0)).count() == 0 and dc.contaminated(d.limit(0), i).count() == 0


def test_odd_documents(spark, odd_docs, no_docs):
    i = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert dc.contaminated(odd_docs, i).count() == 0 and dc.contaminated(no_docs, i).count() == 0
