import datetime

import pytest
from pyspark.sql import functions as F

from quire.functions import expressions as ex
from quire.functions import pytext as py
from quire.functions.pagespec import parse_pages, single_page


def test_page_specs():
    assert parse_pages("2-5,9") == [1, 2, 3, 4, 8]
    assert parse_pages("5-2") == [4, 3, 2, 1]
    assert parse_pages("1,1, ,1") == [0, 0, 0]
    assert parse_pages("") is None and parse_pages(None) is None
    for bad in ("2-", "x", "1-2-3"):
        with pytest.raises(ValueError, match="malformed"):
            parse_pages("99," + bad, 3)
    with pytest.raises(ValueError, match="page 4 is out"):
        parse_pages("1-99", 3)
    with pytest.raises(ValueError, match="page 0 is out"):
        parse_pages("0")
    assert single_page(3, 3) == 2
    with pytest.raises(ValueError):
        single_page(4, 3)


def test_hit_patterns():
    assert py.hit_pattern("a b").findall("A\n b ab") == ["A\n b"]
    assert py.hit_pattern("[a b]c").findall("ac bc  c") == ["ac", "bc", " c"]
    assert py.hit_pattern("(?<=x )y").findall("x y x\ny") == ["y"]
    assert py.hit_pattern("ﬁnal").findall("FINAL") == ["FINAL"]
    assert py.hit_pattern("[^] ]x").findall("] x ax") == ["ax"]
    assert py.hit_pattern("(?#a b)c d").findall("c\td") == ["c\td"]
    assert py.hit_pattern(r"\N{LATIN SMALL LETTER A} b").findall("a\nb") == ["a\nb"]
    assert py.hit_pattern("(?x) a b").findall("ab a b") == ["ab"] and py.hit_pattern("(?i-x:a b)").findall("A\nb") == ["A\nb"]
    assert py.hit_pattern("(?<=(?:x y)) z").findall("x y\nz x\ny z") == ["\nz"]
    assert py.hit_pattern(r"a\ b").findall("a b a\tb") == ["a b"]
    assert py.hit_pattern("[[] a").findall("[\na") == ["[\na"]
    assert py.literal_pattern("  ") is None and py.literal_pattern("a.b c").search("A.B\tC")


def test_word_spans():
    words = ["needle", "hay", "needle"]
    assert py.word_spans(words, py.literal_pattern("needle")) == [(0, 1), (2, 3)]
    assert py.word_spans(words, py.literal_pattern("hay needle")) == [(1, 3)]
    assert py.word_spans(words, py.hit_pattern("e")) == [(0, 1), (2, 3)]  # a repeat of the words just before is left out
    assert py.word_spans(words, py.hit_pattern("^")) == [(0, 1), (1, 2), (2, 3)]
    assert py.word_spans([], py.literal_pattern("x")) == [] and py.word_spans(words, None) == []


def test_dates_slugs_and_parsers():
    d = datetime.date
    assert [py.parse_date(x) for x in ("2026-04-03", "20260403", "2026-W01-1", "4/3/2026", "April 3, 2026", "Apr 3, 2026", "x")] == [d(2026, 4, 3)] * 2 + [d(2025, 12, 29)] + [d(2026, 4, 3)] * 3 + [None]
    assert py.parse_pdf_date("D:20260403120000+02'30'") == (datetime.datetime(2026, 4, 3, 12), 150)
    assert py.parse_pdf_date("D:2026") == (datetime.datetime(2026, 1, 1), None) and py.parse_pdf_date("D:20261340") is None
    assert py.slugify("Été à Paris!") == "ete-a-paris"
    used = set()
    assert [py.unique_slug("a", used) for _ in range(3)] == ["a", "a_1", "a_2"]
    assert py.parse_color("#ff0000") == (1, 0, 0) and py.parse_rect("1,2,3,4,5") == (1, 2, 3, 4) and py.parse_points("1,2;3,4") == [(1, 2), (3, 4)]
    for bad in (lambda: py.parse_color("2,0,0"), lambda: py.parse_rect("1,2"), lambda: py.parse_point("1,2,3")):
        with pytest.raises(ValueError):
            bad()


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_expressions(spark):
    n = lambda x: F.lit(x)
    r = one(spark, ex.roman(n(1994)), ex.roman(n(4), False), ex.letters(n(28)), ex.letters(n(26), False), ex.human_size(n(1023)), ex.human_size(n(1536)), ex.bates("A", n(-5), 6), ex.bates("", n(42), 4))
    assert tuple(r) == ("MCMXCIV", "iv", "BB", "z", "1023B", "1.5KB", "A-00005", "0042")
    r = one(spark, ex.strip(n("\x1c  a b 　")), ex.is_blank(n("  \t")), ex.word_count(n("a b‪c d")), ex.text_lines(n(" a \r\n\x0b b")), ex.round_half_even_1(n(0.25)))
    assert tuple(r) == ("a b", True, 4, ["a", "b"], 0.2)
    r = one(spark, *[ex.link_unsafe(n(k), n(u)) for k, u in [("uri", "HTTP://x"), ("uri", "ftp://x"), ("uri", "nocolon"), ("launch", ""), ("internal", "x")]])
    assert tuple(r) == (False, True, True, True, False)


def test_python_udfs(spark):
    df = spark.createDataFrame([(0.15, 1, "Account: 123 café"), (2.675, 2, None)], "x double, d int, t string")
    rows = df.select(py.py_round("x", "d").alias("r"), py.mask_matches(r"(?<=Account: )\d+")("t").alias("m"), py.name_matches("A*[!x]")("t").alias("g"), py.nfc_key(F.lit("CAFÉ")).alias("k")).collect()
    assert [r.r for r in rows] == [0.1, 2.67]
    assert [r.m for r in rows] == ["Account: [REDACTED] café", None]
    assert [r.g for r in rows] == [True, False] and rows[0].k == "café"
