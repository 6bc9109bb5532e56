import random
import re

import numpy as np
import pytest

import corpus_pipeline
from quire.llm import shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def roots(texts):
    """The smallest index that each text reaches over pairs of similarity 0.8 or more."""
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def near_texts(seed, groups, members, most_edits):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    shared = [word() for _ in range(30)]  # boilerplate of all texts
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(60, 200))]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randint(0, most_edits)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own + shared))
    return [*texts, "a b", "A  b", "a b c", "", None]


@pytest.mark.parametrize(("groups", "members", "most_edits"), [(30, 4, 6), (1, 90, 4), (80, 1, 0)])
def test_components_like_all_pairs(spark, monkeypatch, groups, members, most_edits):
    monkeypatch.setattr(shingles, "ROUNDS", (2, 1 << 62))
    texts = near_texts(3, groups, members, most_edits)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in shingles.near_copies(df).collect()}
    assert [got[i] for i in range(len(texts))] == roots(texts)


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(300):
        common = rng.integers(0, 2**64, rng.integers(0, 3000), np.uint64)
        sets = [np.unique(np.concatenate((common, rng.integers(0, 2**64, rng.integers(0, 700), np.uint64)))) for _ in range(2)]
        made = shingles.sketches(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
        assert shingles.least_difference(*(np.frombuffer(x, np.uint8) for x in made)) <= len(np.setxor1d(*sets))


def test_stage_joins_similarity_of_four_fifths(spark):
    texts = near_texts(5, 40, 2, 4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    want = roots(texts)
    assert len(set(want)) < len(texts) - 10  # pairs of different texts are among them
    assert kept == set(want)


def test_odd_documents(odd_docs, no_docs):
    kept = shingles.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 3, 5, 7, 8, None}
    assert shingles.keep_one(no_docs).count() == 0


def test_a_row_without_id_links_others(spark):
    words = [f"w{i}" for i in range(100)]
    middle, left, right = list(words), list(words), list(words)
    left[20:23], right[70:73] = ["x", "y", "z"], ["x", "y", "z"]
    df = spark.createDataFrame([(2, " ".join(left)), (None, " ".join(middle)), (1, " ".join(right)), (1, "other")], "doc_id bigint, text string")
    assert roots([" ".join(left), " ".join(right)]) == [0, 1]
    assert {r.doc_id for r in shingles.keep_one(df).collect()} == {1, None}


def about_one_text(seed, members):
    """Copies of one text with up to 8 words replaced: those of 4 and more are apart from it, and mostly from each other."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    base, texts = [word() for _ in range(150)], []
    for i in range(members):
        own = list(base)
        for at in rng.sample(range(150), i % 9):
            own[at] = word()
        texts.append(" ".join(own))
    return texts


def test_pairs_grow_with_a_cluster_not_with_its_square(spark, monkeypatch):
    formed, stored = [], shingles.written
    monkeypatch.setattr(shingles, "DIRECT", 16, raising=False)

    def counted(df, name):
        out = stored(df, name)
        if name == "met":
            formed.append(out.count())
        return out

    monkeypatch.setattr(shingles, "written", counted)
    pairs = []
    for members in (300, 900):
        texts = about_one_text(members, members)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        got = {r.doc_id: r.component_id for r in shingles.near_copies(df).collect()}
        want = roots(texts)
        assert [got[i] for i in range(members)] == want and 0.2 * members < len(set(want)) < 0.8 * members
        pairs.append(sum(formed))
        formed.clear()
    assert pairs[1] < 5 * pairs[0]


def test_similar_sets_meet_by_their_differences():
    rng = np.random.default_rng(4)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    seen = 0
    for _ in range(60):
        pivot = np.unique(rng.integers(0, 2**64, rng.integers(20, 120), np.uint64))
        pool = rng.integers(0, 2**64, 25, np.uint64)
        sets = [np.unique(np.concatenate((rng.permutation(pivot)[rng.integers(0, 25) :], rng.permutation(pool)[: rng.integers(0, 25)]))) for _ in range(14)]
        apart = [shingles.difference(x, pivot, *none) for x in sets]
        near = [shingles.is_near(len(d), len(x), len(pivot)) for d, x in zip(apart, sets, strict=True)]
        count = [shingles.difference_prefix(len(d), len(x), len(pivot), c) for d, x, c in zip(apart, sets, near, strict=True)]
        columns = [[], [], [], [], [], [], [], []]
        for i, d in enumerate(apart):
            assert np.array_equal(np.sort(d), np.setxor1d(sets[i], pivot))
            for place, sh in enumerate(d[: count[i][0]].view(np.int64).tolist()):
                for column, x in zip(columns, (sh, i, len(sets[i]), place, len(d), int(near[i]), count[i][1], i), strict=True):
                    column.append(x)
        order = np.argsort(columns[0], kind="stable")
        columns = [np.array(x, np.int64)[order] for x in columns]
        edge = np.flatnonzero(np.concatenate(([True], columns[0][1:] != columns[0][:-1], [True])))
        met = {pair for a, b in shingles._meeting_by_difference(columns, edge) for pair in zip(a.tolist(), b.tolist(), strict=True)}
        for j in range(len(sets)):
            for i in range(j):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 5 * both >= 4 * len(np.union1d(sets[i], sets[j])) and not (near[i] and near[j]) and not np.array_equal(sets[i], sets[j]):
                    seen += 1
                    assert (i, j) in met
    assert seen > 50


def test_stage_links_by_simhash_first(spark, monkeypatch):
    asked, links = [], shingles.simhash.links

    def seen(prints, n, distance):
        found = links(prints, n, distance)
        asked.append((distance, found.count()))
        return found

    monkeypatch.setattr(shingles.simhash, "links", seen)
    texts = near_texts(6, 20, 3, 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == set(roots(texts))
    assert len(asked) == 1 and asked[0][0] == shingles.DISTANCE and asked[0][1] > 0
