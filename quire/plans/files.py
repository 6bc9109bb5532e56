"""Queries over files and positioned words: PDF round trips, HTML nodes, layout, tables, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import annotations, layout, redact, search, text, transcript
from quire.plans.catalog import query
from quire.sources import html, pdf_tables, sinks
from quire.sources.adapters import conversation_pages, table


def latin_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation pages; their letters all exist in the standard Latin encoding."""
    p = conversation_pages(spark, sf_dir)
    return p.select("doc_id", "page", "text")


def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.rendered(latin_pages(spark, sf_dir), "pdf")


def form(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pdf_tables.sound(pdf_tables.parse(pdf_files(spark, sf_dir), name))


_SQUEEZED = "trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'))"


@query(f"select conv_id doc_id, turn page, trim({_SQUEEZED}, chr(10)) as text from conversations")
def pdf_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = form(spark, sf_dir, "pages")
    return pages.select(F.col("path").cast("bigint").alias("doc_id"), "page", "text")


@query("select conv_id doc_id, count(*) page_count, false encrypted, false repaired, conv_id::varchar title from conversations group by conv_id")
def pdf_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = form(spark, sf_dir, "documents")
    return docs.select(F.col("path").cast("bigint").alias("doc_id"), "page_count", "encrypted", "repaired", "title")


@query("select conv_id doc_id, turn as ord, 1::bigint as level, 'Page ' || (turn + 1) title, turn + 1 page from conversations")
def pdf_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = form(spark, sf_dir, "outline")
    return rows.select(F.col("path").cast("bigint").alias("doc_id"), "ord", "level", "title", "page")


@query("select conv_id doc_id, count(*) filter (length(text) >= 0) pages, 1::bigint fonts, count(*) * 2 + 3 + 1 + 1 + count(*) objects from conversations group by conv_id")
def pdf_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = form(spark, sf_dir, "objects")
    kinds = rows.groupBy(F.col("path").cast("bigint").alias("doc_id"))
    return kinds.agg(F.count_if(F.col("type") == "Page").alias("pages"), F.count_if(F.col("type") == "Font").alias("fonts"), F.count("*").alias("objects"))


@query("""with w as (select conv_id, turn, unnest(regexp_extract_all(text, '[^ \\t\\n]+')) w from conversations)
  select conv_id doc_id, turn page, count(*) words, sum(length(w))::bigint chars from w group by conv_id, turn""")
def pdf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = form(spark, sf_dir, "words")
    return rows.groupBy(F.col("path").cast("bigint").alias("doc_id"), "page").agg(F.count("*").alias("words"), F.sum(F.length("text").cast("bigint")).alias("chars"))


#: The words of the written pages and their places: 11 point letters half as wide, lines 14 points apart from (72, 72) on.
_PLACED = """with t as (select conv_id doc_id, turn page, string_split(replace(coalesce(text, ''), chr(9), ' '), chr(10)) ls from conversations),
  l as (select doc_id, page, unnest(ls) line, generate_subscripts(ls, 1) - 1 i from t),
  k as (select doc_id, page, i, unnest(string_split(line, ' ')) word, generate_subscripts(string_split(line, ' '), 1) k from l),
  o as (select *, 72 + 5.5 * coalesce(sum(length(word) + 1) over (partition by doc_id, page, i order by k rows between unbounded preceding and 1 preceding), 0) x from k),
  w as (select doc_id, page, dense_rank() over (partition by doc_id, page order by i) - 1 line, row_number() over (partition by doc_id, page order by i, k) - 1 seq, word as text,
    x::double x0, (72 + 14 * i)::double - 0.8::double * 11 y0, (x + 5.5 * length(word))::double x1, (72 + 14 * i)::double + 0.2::double * 11 y1 from o where word <> '')"""
#: Rectangles of the phrase ``of the``: one for each of the two words' lines.
_OF_THE = f"""{_PLACED}, n as (select *, lead(seq) over u next, lead(text) over u after from w window u as (partition by doc_id, page order by seq)),
  h as (select doc_id, page, seq a, next b, row_number() over (partition by doc_id, page order by seq) - 1 hit from n where text ilike '%of' and after ilike 'the%'),
  r as (select h.doc_id, h.page, hit, 0::bigint block, line, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from h join w on w.doc_id = h.doc_id and w.page = h.page and seq between a and b group by all)"""


@query(f"{_PLACED} select doc_id, page, seq, line, text, x0, y0, x1, y1 from w")
def pdf_word_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form(spark, sf_dir, "words").select(F.col("path").cast("bigint").alias("doc_id"), "page", "seq", "line", "text", "x0", "y0", "x1", "y1")


@query(f"{_OF_THE} select doc_id::varchar doc_id, page, hit, block, line, x0, y0, x1, y1 from r")
def search_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.word_hits(form(spark, sf_dir, "words").withColumnRenamed("path", "doc_id"), "of the", in_order=True)


@query(f"{_OF_THE} select doc_id::varchar doc_id, page, 'Highlight' subtype, x0, y0, x1, y1, [1.0, 1.0, 0.0]::double[] color from r")
def annotate_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.marks(search_rects(spark, sf_dir), "Highlight")


@query(f"{_PLACED} select doc_id::varchar doc_id, page, count(*) words_left from w where not regexp_matches(text, '(?i)\\bthe\\b') group by all")
def redact_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = form(spark, sf_dir, "words").withColumnRenamed("path", "doc_id")
    kept = redact.redacted_words(words, search.word_hits(words, r"\bthe\b", regex=True, in_order=True))
    return kept.groupBy("doc_id", "page").agg(F.count("*").alias("words_left"))


_LINES = f"{_PLACED}, s as (select doc_id, page, line, string_agg(text, ' ' order by seq) as text, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from w group by all)"


@query(f"{_LINES} select doc_id::varchar doc_id, page, 1::bigint island, 0::bigint block, string_agg(text, chr(10) order by line) as text, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from s group by doc_id, page")
def page_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.passages(form(spark, sf_dir, "words").withColumnRenamed("path", "doc_id"))


@query(f"{_LINES} select doc_id::varchar doc_id, page, line as seq, 1::bigint as column, text, round(x0, 2) x0, round(y0, 2) y0, round(x1, 2) x1, round(y1, 2) y1 from s")
def layout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.layout_rows(form(spark, sf_dir, "words").withColumnRenamed("path", "doc_id"), in_order=True)


def grids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ruled 5 x 3 tables of nations, one page a region: edges and words."""
    n = table(spark, sf_dir, "nation").withColumn("r", F.row_number().over(_by_region()) - 1)
    doc = [F.col("n_regionkey").cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("page")]
    cells = F.array(F.col("n_nationkey").cast("string"), F.col("n_name"), F.length("n_name").cast("string"))
    words = n.select(*doc, "r", F.posexplode(cells).alias("c", "text"))
    x, y = F.col("c") * 120.0 + 80, F.col("r") * 30.0 + 110
    words = words.select("doc_id", "page", F.row_number().over(_by_place()).cast("bigint").alias("seq"), "text", x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 12).alias("y1"))
    regions = n.select(*doc).distinct()
    h = regions.select("doc_id", "page", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).select("doc_id", "page", F.lit("h").alias("orient"), F.lit(72.0).alias("x0"), (F.col("i") * 30.0 + 100).alias("top"), F.lit(432.0).alias("x1"), (F.col("i") * 30.0 + 100).alias("bottom"))
    v = regions.select("doc_id", "page", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select("doc_id", "page", F.lit("v").alias("orient"), (F.col("i") * 120.0 + 72).alias("x0"), F.lit(100.0).alias("top"), (F.col("i") * 120.0 + 72).alias("x1"), F.lit(250.0).alias("bottom"))
    return h.unionByName(v), words


def _by_region():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("n_regionkey").orderBy("n_nationkey")


def _by_place():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy("r", "c")


@query("""with r as (select *, row_number() over (partition by n_regionkey order by n_nationkey) - 1 r from nation)
  select n_regionkey::bigint doc_id, 0::bigint page, 1::bigint as "table", r as "row", c.c::bigint col, case c.c when 0 then n_nationkey::varchar when 1 then n_name else length(n_name)::varchar end as text
  from r, (values (0), (1), (2)) c(c)""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.table_cells(*grids(spark, sf_dir))


@query("""select n_regionkey::bigint doc_id, 'p1_t1.csv' as name, string_agg(n_nationkey || ',' || n_name || ',' || length(n_name), chr(13) || chr(10) order by n_nationkey) || chr(13) || chr(10) csv from nation group by n_regionkey""")
def convert_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.tables_csv(layout.table_cells(*grids(spark, sf_dir)))


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcript for each customer: its orders as courses under the seasons of their dates."""
    o = table(spark, sf_dir, "orders")
    month, year = F.month("o_orderdate"), F.year("o_orderdate") + 10
    season = F.when(month <= 6, "Spring").when(month <= 7, "Summer").otherwise("Fall")
    term = o.select(F.col("o_custkey").alias("doc_id"), F.lit(0).alias("page"), (F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint") * 10_000_000 + F.col("o_orderkey") * 10).alias("seq"), season.alias("s"), year.alias("y"), "o_orderkey")
    header = term.select("doc_id", "page", "seq", F.concat_ws(" ", "s", "y").alias("text"))
    course = F.concat(F.lit("CS "), F.col("o_orderkey") % 900 + 100, F.lit(" Course number "), F.col("o_orderkey"), F.lit(" B+ 4.00 13.20"))
    return header.unionByName(term.select("doc_id", "page", (F.col("seq") + 1).alias("seq"), course.alias("text")))


@query("""with o as (select o_custkey doc_id, case when month(o_orderdate) <= 6 then 'Spring' when month(o_orderdate) <= 7 then 'Summer' else 'Fall' end || ' ' || (year(o_orderdate) + 10) term, o_orderkey from orders)
  select doc_id, term, count(*) courses, (count(*) * 4.0)::double units, min('CS ' || (o_orderkey % 900 + 100)) first_course from o group by doc_id, term""")
def transcript_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcript.courses(transcript_lines(spark, sf_dir))
    return rows.groupBy("doc_id", F.col("name").alias("term")).agg(F.count("*").alias("courses"), F.sum("units").alias("units"), F.min("course").alias("first_course"))


@query("select o_custkey doc_id, count(*) * 2 matched, count(*) * 2 \"lines\", 'high' confidence from orders group by 1")
def transcript_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.quality(transcript_lines(spark, sf_dir))


@query("""select c_custkey doc_id, 'OFFICIAL ACADEMIC TRANSCRIPT' title, 'University of ' || n_name institution, true student_name_present, c_custkey % 2 = 0 student_identifier_present,
  case when c_custkey % 5 <> 0 then 'Master of ' || c_mktsegment end degree, case c_custkey % 3 when 0 then 'awarded' when 1 then 'pending' else 'unknown' end degree_status,
  case when c_custkey % 3 = 0 then date '2026-06-15' end conferral_date, case when c_custkey % 4 < 3 then make_date(2026, 1 + c_custkey % 12, 1 + c_custkey % 28) end issue_date
  from customer join nation on n_nationkey = c_nationkey""")
def transcript_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    day = F.make_date(F.lit(2026), (1 + k % 12).cast("int"), (1 + k % 28).cast("int"))
    forms = [F.date_format(day, f) for f in ("yyyy-MM-dd", "M/d/yyyy", "MMMM d, yyyy")]
    issued = F.when(k % 4 == 0, forms[0]).when(k % 4 == 1, forms[1]).when(k % 4 == 2, forms[2]).otherwise("2026-02-31")
    said = F.array(
        F.lit("OFFICIAL ACADEMIC TRANSCRIPT"),
        F.concat(F.lit("University of "), F.col("n_name"), F.lit(" - ")),
        F.concat(F.lit("Student: "), F.col("c_name")),
        F.when(k % 2 == 0, F.lit("Student ID 12345")).otherwise("Level: graduate"),
        F.when(k % 5 != 0, F.concat(F.lit("Degree: Master of  "), F.col("c_mktsegment"))).otherwise("no degree named"),
        F.when(k % 3 == 0, F.lit("Awarded on June 15, 2026")).when(k % 3 == 1, F.lit("Candidate")).otherwise("nothing"),
        F.concat(F.lit("Issue Date: "), issued),
        F.lit("Transfer Credit: EXAMPLE COLLEGE"),
    )
    return transcript.identity(c.select(k.alias("doc_id"), F.lit(0).alias("page"), F.posexplode(said).alias("seq", "text")))


@query("""with o as (select o_custkey doc_id, year(o_orderdate) + 10 y, case when month(o_orderdate) <= 6 then 1 when month(o_orderdate) <= 7 then 2 else 3 end s, o_orderdate::date d, o_orderkey k from orders)
  select doc_id, null::date issue_date, ['Spring', 'Summer', 'Fall'][max(y * 10 + s)::int % 10] || ' ' || (max(y * 10 + s) // 10) latest_term, 'unknown_issue_date' verdict from o group by doc_id""")
def transcript_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.freshness(transcript_lines(spark, sf_dir), "2011-03-01").select("doc_id", "issue_date", "latest_term", "verdict")


@query("""select page_id, len(regexp_extract_all(html, '<a '))::bigint links, len(regexp_extract_all(html, '<h1'))::bigint headings, len(regexp_extract_all(html, '<script'))::bigint scripts from pages""")
def html_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = html.dom(table(spark, sf_dir, "pages"))
    return nodes.groupBy("page_id").agg(F.count_if(F.col("tag") == "a").alias("links"), F.count_if(F.col("tag") == "h1").alias("headings"), F.count_if(F.col("tag") == "script").alias("scripts"))


@query()
def html_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.outline(table(spark, sf_dir, "pages"))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.texts(table(spark, sf_dir, "pages"))


@query("select conv_id::varchar as path, count(*) pages from conversations group by conv_id")
def convert_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sinks.rendered(latin_pages(spark, sf_dir), "html")
    return made.select("path", (F.regexp_count(F.col("content").cast("string"), F.lit("<hr/>")) + 1).cast("bigint").alias("pages"))


@query()
def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.plans.catalog import QUERIES, SQL

    rows = [(k, f.__module__.rsplit(".", 1)[-1], k in SQL) for k, f in sorted(QUERIES.items())]
    return spark.createDataFrame(rows, "name string, family string, has_sql boolean")
