"""Findings: risk, links, accessibility, structure of HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.expressions import has_scheme, is_blank, link_unsafe, scheme


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, ord, href) of each link of an HTML page, in order."""
    found = F.regexp_extract_all(html_col, F.lit(r'(?i)<a [^>]*?href="([^"]*)"'), F.lit(1))
    return pages.select(id_col, F.posexplode(found).alias("ord", "href")).withColumn("ord", F.col("ord").cast("bigint"))


def classified(links_: DataFrame, uri: str = "href") -> DataFrame:
    """links with ``has_scheme``, ``scheme``, ``kind`` (uri or internal) and ``unsafe``."""
    kind = F.when(has_scheme(F.col(uri)) | F.col(uri).startswith("//"), "uri").otherwise("internal")
    return links_.withColumns({"has_scheme": has_scheme(F.col(uri)), "scheme": scheme(F.col(uri)), "kind": kind}).withColumn("unsafe", link_unsafe(F.col("kind"), F.col(uri)))


def risk(active: Column, unsafe: Column, attachments: Column, missing: Column) -> Column:
    """high with active content or attachments, medium with unsafe links or something missing, else low."""
    return F.when((active > 0) | (attachments > 0), "high").when((unsafe > 0) | (missing > 0), "medium").otherwise("low")


def issues(*named: tuple[str, Column]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named]))


def html_report(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Counts of scripts, links, images and their alternatives, title and language, and the findings from them."""
    h = F.col(html_col)
    count = lambda p: F.regexp_count(h, F.lit(p)).cast("bigint")
    out = pages.select(
        id_col,
        count("(?i)<script").alias("scripts"),
        count("(?i)<a ").alias("links"),
        count("(?i)<img").alias("images"),
        count('(?i)<img[^>]* alt="[^"]+"').alias("alternatives"),
        F.regexp_extract(h, "(?is)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract(h, '(?i)<html[^>]* lang="([^"]*)"', 1).alias("lang"),
        F.length(h).cast("bigint").alias("size"),
    )
    no_alt = F.greatest(F.col("images") - F.col("alternatives"), F.lit(0))
    found = issues(("no_title", is_blank(F.col("title"))), ("no_language", F.col("lang") == ""), ("images_without_alternative", no_alt > 0), ("many_links", F.col("links") > 8), ("short", F.col("size") < 1000))
    missing = (is_blank(F.col("title")) | (F.col("lang") == "")).cast("int")
    return out.withColumn("issues", F.array_join(found, ",")).withColumn("risk", risk(F.when(F.col("scripts") > 1, 1).otherwise(0), F.col("links") - 8, F.lit(0), missing))


def empty_pages(pages: DataFrame, fonts: DataFrame, images: DataFrame, on: list[str]) -> DataFrame:
    """Pages that declare neither a font nor an image."""
    return pages.join(fonts, on, "left_anti").join(images, on, "left_anti")


def first_pages(pages: DataFrame, doc_col: str = "doc_id", most: int = 100) -> DataFrame:
    """The first page numbers (from 1) of each document, at most ``most``."""
    return pages.groupBy(doc_col).agg(F.slice(F.array_sort(F.collect_list(F.col("page") + 1)), 1, most).alias("pages"))
