"""Behaviours of the operators on small inputs with known results."""

import pytest

from quire.operators import annotations, compare, intervals, layout, outline, pages, search, text, transcript
from quire.operators.paged import Box


def paged(spark, texts, doc="d"):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts)], "doc_id string, page bigint, text string")


def test_limited_search(spark):
    p = paged(spark, ["needle needle", "needle", "hay"])
    ask = lambda n, q=p: search.limited(q, "needle", n, "doc_id", "page").first()
    assert (ask(1).hits, ask(1).truncated) == (1, True)
    assert (ask(2).hits, ask(2).truncated) == (2, True)
    assert (ask(3).hits, ask(3).truncated) == (3, True)  # a page is left unvisited, though it has no hit
    assert (ask(9).hits, ask(9).truncated) == (3, False)
    assert ask(1, p.where("page = 1")).truncated is False
    with pytest.raises(ValueError, match="1 or more"):
        ask(0)
    assert search.hits(p, "  ").count() == 0


def test_needles_inside_words_and_short_ones(spark):
    p = spark.createDataFrame([(1, "xx alpha beta\ngamma deltaX tail"), (2, "one two"), (3, "zzonezz")], "doc_id bigint, text string")
    n = spark.createDataFrame([(1, "pha beta gamma delta"), (2, "one"), (3, "e tw"), (4, "beta  gamma delt"), (5, " ")], "item_id bigint, text string")
    assert sorted(map(tuple, search.many(p, n, "doc_id", "item_id").collect())) == [(1, 1), (1, 4), (2, 2), (2, 3), (3, 2)]


def words_of(spark, lines, left=40.0, top=70.0):
    rows, seq = [], 0
    for i, line in enumerate(lines):
        x = left
        for w in line.split():
            rows.append(("d", 0, seq, 0, i, w, x, top + 18 * i, x + 6.0 * len(w), top + 18 * i + 12))
            x += 6.0 * (len(w) + 1)
            seq += 1
    return spark.createDataFrame(rows, "doc_id string, page bigint, seq bigint, block bigint, line bigint, text string, x0 double, y0 double, x1 double, y1 double")


def test_phrase_across_lines_gives_a_rectangle_a_line(spark):
    found = search.word_hits(words_of(spark, ["revenue", "grew rapidly"]), "revenue grew").orderBy("line").collect()
    assert [(r.line, r.x0, r.x1) for r in found] == [(0, 40.0, 82.0), (1, 40.0, 64.0)]


def test_passages_split_when_a_block_comes_back(spark):
    rows = [("d", 0, i, b, i // 2, w, float(i), 0.0, float(i + 1), 1.0) for i, (b, w) in enumerate([(0, "a"), (0, "b"), (0, "c"), (1, "x"), (0, "d")])]
    df = spark.createDataFrame(rows, "doc_id string, page bigint, seq bigint, block bigint, line bigint, text string, x0 double, y0 double, x1 double, y1 double")
    assert [(r.island, r.text) for r in text.passages(df).orderBy("island").collect()] == [(1, "a b\nc"), (2, "x"), (3, "d")]


def test_block_cursor(spark):
    lines = spark.createDataFrame([("d", 0, "first"), ("d", 1, " "), ("d", 2, "second"), ("d", 3, "third")], "doc_id string, line bigint, text string")
    first = text.blocks(lines, [lines["line"]], 0, 2).orderBy("block").collect()
    assert [(r.text, r.next_block) for r in first] == [("first", 2), ("second", 2)]
    rest = text.blocks(lines, [lines["line"]], 2, 2).collect()
    assert [(r.text, r.next_block) for r in rest] == [("third", None)]


def test_best_match_and_diff(spark):
    left = paged(spark, ["alpha\nold 123\nomega", "other", " "])
    right = paged(spark, ["alpha\nnew 456\nomega", "other", "spare"])
    best = compare.best_match(left, right)
    assert sorted((r.page, r["match"], round(r.ratio, 3)) for r in best.collect()) == [(0, 0, 0.667), (1, 1, 1.0)]
    d = compare.diffs(left, right, best, 1, 20).orderBy("page").collect()
    assert (d[0].added, d[0].removed, d[0]["diff"][0][:2]) == (1, 1, "@@") and d[1].added == 0
    assert compare.diffs(left, right, best, 1, 0).orderBy("page").first().truncated
    gone = compare.unmatched(right.withColumnRenamed("page", "match"), best, ["doc_id", "match"])
    assert [r["match"] for r in gone.collect()] == [2]


def test_equal_page_elsewhere_wins_over_similar_one_in_place(spark):
    left = paged(spark, ["a\nb\nc", "x"])
    right = paged(spark, ["a\nb\nd", "y", "a\nb\nc", "a\nb\nc"])
    best = {r.page: (r["match"], r.ratio) for r in compare.best_match(left, right).collect()}
    assert best[0] == (2, 1.0) and best[1][1] == 0


def test_booklet_and_guards(spark):
    p = paged(spark, list("abcde"))
    assert [r.text for r in pages.booklet(p).orderBy("position").collect()] == [None, "a", "b", None, None, "c", "d", "e"]
    for bad in (lambda: pages.reorder(p, "1,1"), lambda: pages.reorder(p, ""), lambda: pages.blank(p, 0, 101), lambda: pages.rotate(p, 45), lambda: pages.nup(p, 3), lambda: pages.scale(p, 0), lambda: pages.set_box(p, "art", (0, 0, 1, 1)), lambda: text.inventory(p, 1, 101)):
        with pytest.raises(ValueError):
            bad()
    sized = p.selectExpr("*", "100D width", "100D height")
    with pytest.raises(Exception, match="inside the media box"):
        pages.crop(sized, (0, 0, 200, 50)).collect()


def test_outline_rules(spark):
    rows = spark.createDataFrame([("a", 0, 1, -1), ("a", 1, 3, 0), ("a", 2, 1, 99), ("a", 3, 2, 99), ("b", 0, 2, 0)], "doc_id string, ord bigint, level bigint, page bigint")
    counts = spark.createDataFrame([("a", 5), ("b", 5)], "doc_id string, page_count bigint")
    found = {(r.doc_id, r.ord): r.error for r in outline.validate(rows, counts).collect()}
    assert found == {("a", 0): None, ("a", 1): "bad hierarchy level", ("a", 2): "page number out of range", ("a", 3): None, ("b", 0): "hierarchy level of item 0 must be 1"}


def test_clusters_are_lag_based_and_merges_use_the_greatest_end(spark):
    v = spark.createDataFrame([("k", x) for x in (1.0, 3.0, 5.0, 9.0)], "k string, v double")
    assert sorted((r.v, r.cluster) for r in intervals.clustered(v, ["k"], "v", 2.0).collect()) == [(1.0, 1), (3.0, 1), (5.0, 1), (9.0, 2)]
    assert len({r.cluster for r in intervals.clustered(v, ["k"], "v", 0).collect()}) == 4
    i = spark.createDataFrame([("k", 0, 100), ("k", 10, 20), ("k", 110, 120), ("k", 145, 150)], "k string, low int, high int")
    assert sorted((r.low, r.high) for r in intervals.merged(i, ["k"], "low", "high", 24).collect()) == [(0, 120), (145, 150)]


def test_rows_follow_the_first_word_not_the_last():
    w = [Box(i, 0, 0, t, x, y, x + 5, y + 10) for i, (t, x, y) in enumerate([("a", 0, 0.0), ("b", 10, 2.5), ("c", 20, 5.0)])]
    assert [[b.text for b in r] for r in layout.anchored(w)] == [["a", "b"], ["c"]]


def test_reading_order_of_two_columns():
    rows = []
    for i in range(3):
        rows += [(f"L{i}", 40.0, 100.0 + 20 * i, 90.0), (f"R{i}", 350.0, 100.0 + 20 * i, 400.0)]
    rows += [(w, 40 + 60.0 * i, 130.0, 95 + 60.0 * i) for i, w in enumerate(["A", "wide", "line", "across", "the", "page", "here", "x"])]
    w = [Box(i, 0, 0, t, x0, y0, x1, y0 + 10) for i, (t, x0, y0, x1) in enumerate(rows)]
    assert [r[1] for r in layout.reading_order(w, 612)] == ["L0", "L1", "R0", "R1", "A wide line across the page here x", "L2", "R2"]


def test_ruled_table(spark):
    xs, ys = (72.0, 192.0, 312.0), (100.0, 140.0, 180.0)
    edges = [("d", 0, "v", x, 100.0, x, 180.0) for x in xs] + [("d", 0, "h", 72.0, y, 192.0, y) for y in ys] + [("d", 0, "h", 193.0, y + 1, 312.0, y + 1) for y in ys]
    words = [("d", 0, "a,b", 80.0, 110.0), ("d", 0, "quoted", 200.0, 110.0), ("d", 0, '"x"', 250.0, 110.0), ("d", 0, "3", 80.0, 150.0), ("d", 0, "4", 200.0, 150.0)]
    e = spark.createDataFrame(edges, "doc_id string, page bigint, orient string, x0 double, top double, x1 double, bottom double")
    w = spark.createDataFrame([(*x, x[3] + 20, x[4] + 10) for x in words], "doc_id string, page bigint, text string, x0 double, y0 double, x1 double, y1 double")
    out = layout.tables_csv(layout.table_cells(e, w)).collect()
    assert [(r.name, r.csv) for r in out] == [("p1_t1.csv", '"a,b","quoted ""x"""\r\n3,4\r\n')]


def test_transcript(spark):
    lines = ["OFFICIAL ACADEMIC TRANSCRIPT", "Issued: 2026-04-03", "Fall 2025", "CS 101 Intro to Computing A 4.00 16.00", "Term GPA: 4.00", "Transfer Credit: EXAMPLE COLLEGE", "HIST 100 World History B 3.00 9.00", "Spring 2026", "CS 102 Data Structures A- 4.00", "Fall 2025", "MA 1 Calculus P", "Cumulative GPA 3.9"]
    df = spark.createDataFrame([("d", 0, i, t) for i, t in enumerate(lines)], "doc_id string, page bigint, seq bigint, text string")
    got = [(r.name, r.course, r.title, r.grade, r.units, r.points) for r in transcript.courses(df).orderBy("seq").collect()]
    assert got[:3] == [("Fall 2025", "CS 101", "Intro to Computing", "A", 4.0, 16.0), ("EXAMPLE COLLEGE", "HIST 100", "World History", "B", 3.0, 9.0), ("Spring 2026", "CS 102", "Data Structures", "A-", 4.0, None)]
    fall = transcript.terms(df).where("name = 'Fall 2025'").collect()
    assert len(fall) == 1 and [c.course for c in fall[0].courses] == ["CS 101"]  # one digit is no course number
    assert {(r.term, r.gpa) for r in transcript.totals(df).collect()} == {("Fall 2025", 4.0), (None, 3.9)}
    ask = lambda day: transcript.freshness(df, day).first().verdict
    assert [ask(None), ask("2026-03-15"), ask("2026-06-15"), ask("2026-01-02"), ask("2025-07-01")] == ["not_checked", "current", "stale_before_conferral", "current", "stale_missing_terms"]


def test_metadata_and_forms(spark):
    from pyspark.sql import functions as F

    info = F.create_map(F.lit("title"), F.lit("t"), F.lit("author"), F.lit(""))
    row = spark.range(1).select(annotations.set_metadata(info, {"Title": "none", "subject": "s"}).alias("a"), annotations.metadata(info).alias("b")).first()
    assert row.a == {"author": "", "subject": "s"} and row.b == {"title": "t"}
    with pytest.raises(ValueError, match="shoe, size"):
        annotations.set_metadata(info, {"shoe": "1", "size": "2", "title": "x"})
    w = spark.createDataFrame([("a.b", "b", "1"), ("c.b", "b", "2"), ("d", "d", "3")], "qualified string, local string, value string")
    v = spark.createDataFrame([("b", "L"), ("a.b", "Q"), ("zz", "?")], "name string, new string")
    assert sorted((r.qualified, r.value) for r in annotations.fill(w, v).collect()) == [("a.b", "Q"), ("c.b", "L"), ("d", "3")]
    assert [r.name for r in annotations.unknown_names(w, v).collect()] == ["zz"]
