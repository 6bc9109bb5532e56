import collections
import math
import random
import re

from quire.llm import secrets as s

ASSIGN = re.compile(s.PATTERNS["assign"][0], re.ASCII)


def brute(text):
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    more = []
    for m in re.finditer(s.CANDIDATE, text):
        v = m[0]
        if not (re.search("[0-9]", v) and re.search("[A-Za-z]", v)) or any(re.search(p, v) and not (n and re.search(n, v)) for p, n in s.ALLOWED):
            continue
        least = s.THRESHOLDS["hex" if re.fullmatch("[0-9a-fA-F]+", v) else "other"]
        high = [i for i in range(len(v) - 19) if -sum(c / 20 * math.log2(c / 20) for c in collections.Counter(v[i : i + 20]).values()) >= least - 1e-6]
        if high:
            more.append((m.start() + high[0], 3, m.start() + high[-1] + 20))
    return sorted(base), sorted(base + more)


def redacted(text, spans):
    out, at = "", 0
    for a, _, z in spans:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, z)
    return out + text[at:]


def test_spans_and_redaction_like_brute_force(spark):
    rng = random.Random(8)
    pieces = ["token=", "Secret: ", "api_key\" = \"", "password", "AKIA", "ABCDEFGH12345678", "deadbeef01234567", "é", " ", "\n", "\U0001f600", "x-y-12", "EXAMPLE", "0f", "kQ9zT3mVb7Xp2LwR5sYn8", "550e8400-e29b-41d4-a716-446655440000", "aaaaaaaaaaaaaaaaaaaaaaaa1"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    texts += ["", "token: secret: abcdefghijklmnop", "deadbeef01234567 " * 700, "a-b-1-" * 5000, "0a1b2c3d4e5f6a7b8c9d" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in s.find_secrets(df).collect():
        base, spans = brute(texts[r.doc_id])
        assert [tuple(x) for x in r.base] == base and [tuple(x) for x in r.spans] == spans
    for r in s.redact(df).collect():
        assert r.text == redacted(texts[r.doc_id], brute(texts[r.doc_id])[1])


def test_no_python_in_the_plan(spark, odd_docs):
    plan = s.redact(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_documents(odd_docs, no_docs):
    clean = s.redact(odd_docs)
    assert clean.columns == odd_docs.columns
    rows = {r.doc_id: r for r in clean.collect()}
    assert clean.count() == odd_docs.count()
    assert rows[3].text is None and rows[7].text == "[SECRET]\"" and rows[7].spans == 7
    assert s.redact(no_docs).count() == 0
