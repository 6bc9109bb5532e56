"""Transcripts: positioned lines to courses by term, with totals, freshness and parse quality.

Lines are classified by pattern, and what they belong to is carried forward by windows: the last term or transfer
header before a course (a transfer header ends a term, a term ends nothing of an earlier transfer's rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.intervals import season_bounds

# What the lines of a transcript look like.
TERM = r"(?i)\b(Fall|Spring|Summer|Winter)\s+(20\d{2})\b"
GRADE = r"A[+-]?|B[+-]?|C[+-]?|D[+-]?|F|P|NP|S|U|CR|NC|I|IP|W"
COURSE = rf"(?i)^([A-Z][A-Z0-9-]{{1,8}}\s+\d{{2,4}}[A-Z]?)\s+(.+?)\s+({GRADE})(?:\s+(\d+(?:\.\d+)?))?(?:\s+(\d+(?:\.\d+)?))?$"
TRANSFER = r"(?i)^transfer\s+(?:credit|institution)\s*[:\-]?\s*(.+)$"
TOTAL = r"(?i)\b(term|cumulative)\s+gpa\b\s*[:\-]?\s*(\d+(?:\.\d+)?)"
ISSUED = r"(?i)\b(?:issued|issue\s+date|transcript\s+date|date\s+issued)\b"
DATE = r"(?i)20\d{2}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/20\d{2}|(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2},?\s+20\d{2}"
CONFERRED = r"(?i)\b(?:conferred|conferral|awarded|degree\s+date)\b"
DEGREE = r"(?i)\b(?:degree|program)\s*[:\-]\s*(.+)$"
AWARDED = r"(?i)\b(?:awarded|conferred|graduated)\b"
PENDING = r"(?i)\b(?:pending|candidate|in progress)\b"
TITLE = r"(?i)\bofficial\b.*\btranscript\b|\bacademic\s+transcript\b"
INSTITUTION = r"(?i)\b(?:university|college|institute|school)\b|\buc\s+[a-z]+\b"
STUDENT_ID = r"(?i)\b(?:student\s+id|student\s+number|id\s*:)\b"
STUDENT_NAME = r"(?i)\b(?:student|name)\s*:"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def clean(text: Column) -> Column:
    """Outer blanks, colons and dashes off, inner white space squeezed."""
    return F.regexp_replace(F.regexp_replace(text, r"^[ :\-\t]+|[ :\-\t]+$", ""), r"\s+", " ")


def first_date(text: Column) -> Column:
    """The first date of a text that exists: year-month-day in full digits, month/day/year, or a month's name with day and year."""

    def read(v: Column) -> Column:
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(v, 1, 3)))
        named = F.concat_ws("-", F.regexp_extract(v, r"(\d{4})$", 1), month, F.regexp_extract(v, r"\s(\d{1,2}),?\s", 1))
        plain = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v).when(v.contains("/"), F.regexp_replace(v, r"^(\d+)/(\d+)/(\d+)$", "$3-$1-$2")).when(month > 0, named)
        return F.try_to_timestamp(plain, F.lit("yyyy-M-d")).cast("date")

    return F.get(F.filter(F.transform(F.regexp_extract_all(text, F.lit(DATE), F.lit(0)), read), lambda d: d.isNotNull()), F.lit(0))


def identity(lines: DataFrame) -> DataFrame:
    """What a transcript says of itself: title, institution, whether a student's name and id are given, degree, its status and
    date, and the date of issue. Each comes from the first line that has it; the status from the last."""
    text, place = F.col("text"), F.struct("page", "seq")
    first = lambda value, when: F.min_by(value, F.when(when & value.isNotNull(), place))
    status = F.when(text.rlike(AWARDED), "awarded").when(text.rlike(PENDING), "pending")
    school = text.rlike(INSTITUTION) & ~F.lower("text").startswith("transfer")
    return lines.groupBy("doc_id").agg(
        first(clean(text), text.rlike(TITLE)).alias("title"),
        first(clean(text), school).alias("institution"),
        F.bool_or(text.rlike(STUDENT_NAME)).alias("student_name_present"),
        F.bool_or(text.rlike(STUDENT_ID)).alias("student_identifier_present"),
        first(clean(F.regexp_extract("text", DEGREE, 1)), text.rlike(DEGREE)).alias("degree"),
        F.coalesce(F.max_by(status, F.when(status.isNotNull(), place)), F.lit("unknown")).alias("degree_status"),
        first(first_date(text), text.rlike(CONFERRED)).alias("conferral_date"),
        first(first_date(text), text.rlike(ISSUED)).alias("issue_date"),
    )


def classified(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page, seq, text) with ``kind``: term, transfer, total, course or other, and the current term
    and transfer institution of each."""
    text = F.col("text")
    kind = F.when(text.rlike(TERM), "term").when(text.rlike(TRANSFER), "transfer").when(text.rlike(TOTAL), "total").when(text.rlike(COURSE), "course").otherwise("other")
    rows = lines.where(F.trim("text") != "").withColumn("kind", kind)
    name = F.concat_ws(" ", F.initcap(F.lower(F.regexp_extract("text", TERM, 1))), F.regexp_extract("text", TERM, 2))
    header = F.when(F.col("kind") == "term", F.struct(F.lit("term").alias("of"), name.alias("name"))).when(F.col("kind") == "transfer", F.struct(F.lit("transfer").alias("of"), clean(F.regexp_extract("text", TRANSFER, 1)).alias("name")))
    w = Window.partitionBy("doc_id").orderBy("page", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("header", F.last(header, ignorenulls=True).over(w))


def courses(lines: DataFrame) -> DataFrame:
    """(doc_id, page, seq, of, name, course, title, grade, units, points) of each course under a header."""
    found = classified(lines).where("kind = 'course' and header is not null")
    part = lambda i: F.regexp_extract("text", COURSE, i)
    number = lambda i: F.nullif(part(i), F.lit("")).cast("double")
    return found.select("doc_id", "page", "seq", "header.of", "header.name", F.upper(part(1)).alias("course"), clean(part(2)).alias("title"), F.upper(part(3)).alias("grade"), number(4).alias("units"), number(5).alias("points"))


def terms(lines: DataFrame) -> DataFrame:
    """Each term or transfer institution with its courses in order; a term that comes back goes on with the first."""
    rows = courses(lines)
    item = F.struct("page", "seq", "course", "title", "grade", "units", "points")
    return rows.groupBy("doc_id", "of", "name").agg(F.array_sort(F.collect_list(item)).alias("courses"), F.sum("units").alias("units"))


def totals(lines: DataFrame) -> DataFrame:
    """(doc_id, term, gpa): the last figure of each term; a null term is the cumulative one."""
    rows = classified(lines).where("kind = 'total'")
    own = F.when((F.lower(F.regexp_extract("text", TOTAL, 1)) == "term") & (F.col("header.of") == "term"), F.col("header.name"))
    return rows.groupBy("doc_id", own.alias("term")).agg(F.max_by(F.regexp_extract("text", TOTAL, 2).cast("double"), F.struct("page", "seq")).alias("gpa"))


def quality(lines: DataFrame) -> DataFrame:
    """Share of lines that were understood and the confidence it gives."""
    rows = classified(lines)
    understood = (F.col("kind") != "other") & ~((F.col("kind") == "course") & F.col("header").isNull())
    counted = rows.groupBy("doc_id").agg(F.count_if(understood).alias("matched"), F.count("*").alias("lines"))
    ratio = F.col("matched") / F.col("lines")
    return counted.withColumn("confidence", F.when(ratio >= 0.8, "high").when(ratio >= 0.5, "medium").otherwise("low"))


def freshness(lines: DataFrame, conferred: str | None) -> DataFrame:
    """(doc_id, issue_date, latest_term, verdict) against an asserted conferral date."""
    rows = classified(lines)
    printed = first_date(F.col("text"))
    issue = F.min_by(printed, F.when(F.col("text").rlike(ISSUED) & printed.isNotNull(), F.struct("page", "seq")))
    name = F.when((F.col("kind") == "term"), F.col("header.name"))
    bounds = season_bounds(F.substring_index(name, " ", 1), F.substring_index(name, " ", -1))
    date = F.lit(conferred).cast("date")
    per = rows.withColumn("b", bounds).groupBy("doc_id").agg(
        issue.alias("issue_date"), F.max_by(name, F.struct(F.col("b.last"), (-F.col("page")).alias("p"), (-F.col("seq")).alias("s"))).alias("latest_term"), F.coalesce(F.bool_or(date.between(F.col("b.first"), F.col("b.last"))), F.lit(False)).alias("covered")
    )
    verdict = F.when(date.isNull(), "not_checked").when(F.col("issue_date").isNull(), "unknown_issue_date").when(F.col("issue_date") < date, "stale_before_conferral").when(~F.col("covered"), "stale_missing_terms").otherwise("current")
    return per.withColumn("verdict", verdict)


def ranked(rows: DataFrame, by: list[str], tie: str) -> DataFrame:
    """Transcripts by issue date, newest first (none counts as 0000-00-00), then by time of change, newest first."""
    dated = rows.withColumn("issue_date", F.coalesce("issue_date", F.lit("0000-00-00")))
    w = Window.partitionBy(*by).orderBy(F.desc("issue_date"), F.desc("modified"), tie)
    return dated.withColumn("rank", F.row_number().over(w).cast("bigint"))
