import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_sum(lengths, room):
    reach = {0}
    for x in lengths:
        reach |= {r + x for r in reach if r + x <= room}
    return max(reach)


@pytest.mark.parametrize("seed", range(20))
def test_window_is_filled_as_closely_as_possible(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 60) for _ in range(rng.randint(0, 14))]
    counts, room = dict(collections.Counter(lengths)), rng.randint(0, 150)
    chosen = packing.fullest(counts, room)
    assert all(0 < n <= counts[x] for x, n in chosen.items())
    assert sum(x * n for x, n in chosen.items()) == best_sum(lengths, room)


def test_layout_places_every_piece_once():
    rng = random.Random(1)
    counts = dict(collections.Counter(rng.randint(1, 1024) for _ in range(3000)))
    used = collections.Counter()
    total = collections.Counter()
    for length, first, stop, each, sequence, at in packing.layout(counts):
        used[length] += stop - first
        for rank in range(stop - first):
            total[sequence + rank // each] += length
        assert at + each * length <= 1024
    assert used == counts and max(total.values()) <= 1024
    assert len(total) <= sum(k * n for k, n in counts.items()) / 1024 * 1.01 + 2


def test_ids_are_the_tokenizers(spark):
    slow = Tokenizer.from_file(PATH)
    fast = packing.encoder(PATH)
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["", " ", "a<|endoftext|>b", "<|endoftext|>", " <|endoftext|><|endoftext|> \n", "<|endoftext |>", "\U0001f600é\n\n  x", "don't 12 345", " " * 3000]
    for t in texts:
        assert fast.ids(t).tolist() == slow.encode(t, add_special_tokens=False).ids
    assert len(fast.ids(" " * 1_500_000)) == len(slow.encode(" " * 1_500_000, add_special_tokens=False).ids)


def check(spark, docs):
    rows = packing.pack(docs, PATH).collect()
    texts = docs.select("doc_id", "text").collect()
    encode = packing.encoder(PATH).ids
    want = collections.Counter()
    for r in texts:
        ids = np.append(encode(r.text or ""), 0).astype("<u4")
        for at in range(0, len(ids), 1024):
            want[r.doc_id, at, min(1024, len(ids) - at), zlib.crc32(ids[at : at + 1024].tobytes()), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(by) == list(range(len(by)))
    return len(by), sum(r.length for r in rows)


def test_packing_whole_tables(spark):
    n, tokens = check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert n <= tokens / 1024 * 1.02 + 2


def test_odd_documents(spark, odd_docs, no_docs):
    check(spark, odd_docs)
    assert packing.pack(no_docs, PATH).count() == 0
