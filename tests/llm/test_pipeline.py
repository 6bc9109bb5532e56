"""The pipeline against a plain version of its stages on a small table."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quire.llm import packing, quality, simhash
from quire.llm.queries import tokenizer_path
from tests.llm import test_decontaminate, test_quality, test_secrets, test_simhash


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    word = {k: ["".join(rng.choice(v) for _ in range(rng.randint(1, 3))) for _ in range(150)] for k, v in {"en": ["th", "an", "ing", "er"], "de": ["sch", "ei", "en", "un"]}.items()}
    text = lambda lang, n: " ".join(rng.choices(word[lang], k=n))
    items = [(i, text("en", 25)) for i in range(4)]
    rows = []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        rows.append((i, text(lang, rng.randint(40, 160)), lang))
    rows += [(60, rows[4][1], "en"), (61, rows[7][1] + " end", "en"), (62, rows[9][1].replace(" ", "\n", 3), "de")]
    rows += [(63, text("en", 30) + " " + items[1][1] + " " + text("en", 30), "en"), (64, " ".join(items[2][1].split()[12:]) + " " + text("en", 40) + " " + " ".join(items[2][1].split()[:12]), "en")]
    rows += [(65, text("en", 60) + ' token = "0123456789abcdef0123456789abcdef01234567" ' + text("en", 20), "en")]
    rows += [(66, "too short", "en"), (67, "again and " * 60, "en"), (68, None, "en"), (69, "", None), (70, "".join(rng.choice("qxzj#%kvw ") for _ in range(700)), "en")]
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.coalesce(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def plain_quality(rows):
    by_lang = collections.defaultdict(list)
    for _, t, lang in rows:
        by_lang[lang].append(t or "")
    scored = []
    for lang, texts in by_lang.items():
        grams = collections.Counter()
        order = quality.ORDER
        symbols = lambda t: [0] * (order - 1) + [int(quality.alphabet()[min(ord(c), 65535)]) for c in t]
        taught = [t for t in texts if 10 * sum(c in "#*$%&|<>" for c in t) <= len(test_quality.WORD.findall(t))]
        for t in set(taught if any(taught) else texts):
            s = symbols(t)
            grams.update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
        orders = {order: grams}
        for k in range(order - 1, 0, -1):
            orders[k] = collections.Counter(g[1:] for g in orders[k + 1])
        cut = {k: quality._discounts(quality.tallies(np.array(list(c.values())))) for k, c in orders.items() if c}
        total, left = collections.Counter(), collections.Counter()
        for k, c in orders.items():
            for g, n in c.items():
                total[k, g[:-1]] += n
                left[k, g[:-1]] += cut[k][min(n, 3)]

        def p(g, orders=orders, cut=cut, total=total, left=left):
            k = len(g)
            if not k:
                return 1 / 256
            t = total[k, g[:-1]]
            if not t:
                return p(g[1:])
            n = orders[k].get(g, 0)
            return (n - cut[k][min(n, 3)]) / t + left[k, g[:-1]] / t * p(g[1:])

        for i, t, own in rows:
            if own == lang:
                s = symbols(t or "")
                grams_of = [tuple(s[j : j + order]) for j in range(len(s) - order + 1)]
                ppl, low = (-sum(math.log(p(g[-n:])) for g in grams_of) / max(len(t or ""), 1) for n in (order, quality.LOWER))
                words, _, _, _, repeated = test_quality.statistics(t or "")
                scored.append((i, lang, len(t or ""), ppl, words < 20 or 100 * repeated > 30 * words, low))
    kept = set()
    for lang in by_lang:
        own = [x for x in scored if x[1] == lang and not x[4]]
        if not own:
            continue
        pick = lambda v, q, grid: np.percentile(np.floor(np.array(v) * grid) / grid, 100 * q)
        some = sorted({(x[2], round(x[3], 9), round(x[5], 9)) for x in own})
        reach = []
        for k, middle in ((1, pick([x[1] for x in some], 0.5, quality.PPL_GRID)), (2, pick([x[2] for x in some], 0.5, quality.PPL_GRID))):
            z = [(x[k] - middle) * math.sqrt(x[0]) for x in some]
            half = pick(z, 0.75, quality.Z_GRID) if k == 1 else -pick(z, 0.25, quality.Z_GRID)
            reach.append(8.0 * max(half, quality.LEAST_SPREAD / 2))
        high = pick([x[1] for x in some], 0.75, quality.PPL_GRID)
        kept |= {x[0] for x in own if x[5] >= middle - reach[1] / math.sqrt(x[2]) - 0.3 and x[3] <= high + reach[0] / math.sqrt(x[2]) + 0.3}
    return [r for r in rows if r[0] in kept]


def plain_dedup(rows):
    prints = [test_simhash.fingerprint(t, 5) for _, t, _ in rows]
    m = simhash.segment_count(len(set(prints)), 6)
    parts = [((1 << w) - 1) << s for s, w in simhash.segments(m)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        x = prints[i] ^ prints[j]
        if x.bit_count() <= 8 and sum(not x & part for part in parts) >= m - 6:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [r for i, r in enumerate(rows) if find(i) == i]


def test_stages_like_plain_ones(spark, tables):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        got[name] = docs
        assert name == "packing" or docs.columns == columns
    ids = lambda name: sorted(r.doc_id for r in got[name].collect())
    left = plain_quality(rows)
    assert ids("quality_rules") == sorted(r[0] for r in left)
    assert not {66, 67, 68, 69, 70} & set(ids("quality_rules")) and {60, 61, 63, 64, 65} <= set(ids("quality_rules"))
    left = plain_dedup(left)
    assert ids("near_dedup") == sorted(r[0] for r in left)
    assert not {60, 61, 62} & set(ids("near_dedup"))
    clean = []
    for r in left:
        t = re.findall(r"\w+", r[1].lower())
        if all(test_decontaminate.brute_tiles(re.findall(r"\w+", i.lower()), t, 5)[0] < 0.6 * len(i.split()) for _, i in items):
            clean.append(r)
    assert ids("decontaminate") == sorted(r[0] for r in clean) and not {63, 64} & set(ids("decontaminate"))
    want = {r[0]: test_secrets.redacted(r[1], test_secrets.brute(r[1])[1]) for r in clean}
    rows_ = got["secret_scan"].collect()
    assert {r.doc_id: r.text for r in rows_} == want and all(r.n_chars == len(r.text) for r in rows_)
    assert "0123456789abcdef" not in want[65]
    encode = packing.encoder(tokenizer_path()).ids
    pieces = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got["packing"].collect())
    tokens = {k: np.append(encode(t), 0).astype("<u4") for k, t in want.items()}
    assert pieces == {(k, at, len(x[at : at + 1024]), zlib.crc32(x[at : at + 1024].tobytes())): 1 for k, x in tokens.items() for at in range(0, len(x), 1024)}
    assert collections.Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == collections.Counter(map(tuple, got["packing"].collect()))


def test_odd_documents(spark, tables, odd_docs, no_docs):
    folder = tables[0]
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, folder).collect()
