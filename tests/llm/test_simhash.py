import random
import re

import numpy as np
import pytest
import xxhash

from quire.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def brute_components(prints, distance):
    n = len(prints)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("distance", "size"), [(4, 400), (2, 300), (6, 200)])
def test_links_connect_what_all_pairs_connect(spark, distance, size):
    rng = random.Random(distance)
    centers = [rng.getrandbits(64) for _ in range(size // 20)]
    prints = []
    for _ in range(size):
        p = rng.choice(centers)
        for b in rng.sample(range(64), rng.randint(0, 9)):
            p ^= 1 << b
        prints.append(p)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    from quire.llm.components import connected_components

    roots = dict(connected_components(simhash.links(df, len(prints), distance)).collect())
    want = brute_components(prints, distance)
    got = [roots.get(p, p) for p in signed]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_large_entries_are_connected_like_small_ones():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    members = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 30, 100).astype(np.uint64)) for b in base]))
    members = np.unique(np.concatenate((members, members ^ np.uint64(3 << 40))))
    a, b = simhash.entry_links(np.zeros(len(members), np.int64), members, 6, 4)
    assert len(a) < len(members)
    assert (np.bitwise_count(a ^ b) <= 4).all()
    roots = {int(m): int(m) for m in members}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        roots[find(x)] = find(y)
    want = brute_components(members.tolist(), 4)
    assert len({find(int(m)) for m in members}) == len(set(want))


def test_chains_never_prune_a_link():
    rng = random.Random(5)
    for distance in (2, 4, 8):
        diffs = np.array([sum(1 << b for b in rng.sample(range(64), rng.randint(0, distance))) for _ in range(500)], np.uint64)
        for m in range(distance + 1, distance + 5):
            assert simhash.chain_viable(diffs, m, distance).all()


def test_links_do_not_depend_on_the_size_of_the_index(spark, monkeypatch):
    rng = random.Random(8)
    prints = [0] + [sum(1 << b for b in rng.sample(range(64), n)) for n in (5, 6, 7, 7, 7, 7, 8, 8, 8, 8) for _ in range(4)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id bigint, fp bigint")
    monkeypatch.setattr(simhash, "with_fingerprint", lambda docs, *_: docs)
    kept = []
    for m in (9, 10, 11):
        monkeypatch.setattr(simhash, "segment_count", lambda n, distance, m=m: m)
        kept.append({r.doc_id for r in simhash.keep_one(df, text_col="fp").collect()})
    assert kept[0] == kept[1] == kept[2] == set(brute_components(prints, 6))


def test_odd_documents(spark, odd_docs, no_docs):
    found = simhash.near_duplicates(odd_docs).collect()
    texts = {(r.doc_id, r.text) for r in odd_docs.collect()}
    assert len(found) == odd_docs.count()
    by_id = {r.doc_id: r for r in found}
    for doc_id, text in texts:
        if doc_id is not None:
            assert by_id[doc_id].fp % (1 << 64) == fingerprint(text, 4)
    assert by_id[2].component_id == 1
    assert {by_id[i].component_id for i in (3, 4, 6, 9)} == {3}
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 3, 5, 7, 8, None}
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0
