import pytest

WORDS = "der und die nicht the of and thing ion sol casa luz mar rue pont".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, extra columns with clashing names."""
    long = " ".join(WORDS[i * 7 % len(WORDS)] + str(i % 97) for i in range(30_000))
    copy = " ".join(WORDS[i % len(WORDS)] + str(i) for i in range(60))
    rows = [
        (1, copy, "en", "a", 3),
        (2, copy, "en", "a", 3),
        (2, copy, "en", "a", 3),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (None, copy + " end", "de", "b", 1),
        (5, long, "de", "b", 1),
        (6, " \n\t ", "de", "b", 1),
        (7, "token = \"0123456789abcdef0123456789abcdef01234567\"", "fr", "b", 1),
        (8, "\U0001f600 é ß   x", "fr", "b", 1),
        (9, " " * 50_000, None, "b", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clash = {c: df["doc_id"] for c in ("base", "spans", "fp", "root", "kept", "length", "rank", "start", "known", "chosen", "th", "id")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
