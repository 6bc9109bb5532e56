"""Per-page text: counts, reports, export, masking, blocks and passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.expressions import is_blank, word_count


def counts(pages: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """Pages, words and characters of each group."""
    return pages.groupBy(*keys).agg(
        F.count("*").alias("page_count"),
        F.coalesce(F.sum(word_count(F.col(text_col))), F.lit(0)).alias("word_count"),
        F.coalesce(F.sum(F.length(text_col).cast("bigint")), F.lit(0)).alias("char_count"),
    )


def inventory(pages: DataFrame, start_page: int = 1, limit: int = 25, doc_col: str = "doc_id") -> DataFrame:
    """One row a page from ``start_page`` on, at most ``limit`` (1 to 100) a document, with the cursor ``next_page``."""
    if not 1 <= limit <= 100 or start_page < 1:
        raise ValueError("pages start at 1, and the limit is 1 to 100")
    total = pages.groupBy(doc_col).agg(F.count("*").alias("page_count"))
    stop = start_page - 1 + limit
    rows = pages.where((F.col("page") >= start_page - 1) & (F.col("page") < stop)).join(total, doc_col)
    return rows.select(
        doc_col,
        (F.col("page") + 1).alias("page"),
        "label",
        F.length("text").cast("bigint").alias("text_chars"),
        word_count(F.col("text")).alias("word_count"),
        F.when(F.col("page_count") > stop, F.lit(stop + 1).cast("bigint")).alias("next_page"),
    )


def info(pages: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Page count, whether any page has text, size in bytes, and the distinct labels, sorted."""
    return pages.groupBy(doc_col).agg(
        F.count("*").alias("page_count"),
        F.bool_or(~is_blank(F.col("text"))).alias("has_text"),
        F.sum(F.octet_length("text").cast("bigint")).alias("size_bytes"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
    )


def export(pages: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """A document's pages in order, joined by line breaks; they count as characters."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy(doc_col).agg(ordered.alias("all"), F.sum(F.length("text").cast("bigint")).alias("n"), F.count("*").alias("k")).select(
        doc_col,
        F.array_join(F.transform("all", lambda p: F.coalesce(p.text, F.lit(""))), "\n").alias("text"),
        (F.col("n") + F.greatest(F.col("k") - 1, F.lit(0))).alias("char_count"),
    )


def mask(pages: DataFrame, pattern: str, marker: str = "[REDACTED]", text_col: str = "text") -> DataFrame:
    """Matches of a pattern that Java and Python read alike replaced by the marker, with their number ``masks``.

    For any other Python pattern there is ``quire.functions.pytext.mask_matches``.
    """
    literal = marker.replace("\\", "\\\\").replace("$", "\\$")
    return pages.withColumn("masks", F.regexp_count(text_col, F.lit(pattern)).cast("bigint")).withColumn(text_col, F.regexp_replace(text_col, pattern, literal))


def blocks(lines: DataFrame, order: list[Column], start: int = 0, most: int = 200, doc_col: str = "doc_id") -> DataFrame:
    """Non-blank blocks of each document in order, from the ``start``-th on, with the cursor ``next_block``."""
    ranked = lines.where(~is_blank(F.col("text"))).withColumn("block", F.row_number().over(Window.partitionBy(doc_col).orderBy(*order)).cast("bigint") - 1)
    seen = ranked.where((F.col("block") >= start) & (F.col("block") <= start + most))
    more = F.max("block").over(Window.partitionBy(doc_col)) == start + most
    return seen.withColumn("next_block", F.when(more, F.lit(start + most).cast("bigint"))).where(F.col("block") < start + most)


def islands(rows: DataFrame, partition: list[str], order: list[str], key: str) -> DataFrame:
    """rows with ``island``: consecutive rows of one key; a key that comes back opens a new island."""
    w = Window.partitionBy(*partition).orderBy(*order)
    before = F.lag(key).over(w)
    new = F.when(before.eqNullSafe(F.col(key)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_new")


def passages(words: DataFrame) -> DataFrame:
    """Consecutive words of one block: joined by a space in a line and a line break across lines, with their box.

    words has (doc_id, page, seq, block, line, text, x0, y0, x1, y1).
    """
    marked = islands(words, ["doc_id", "page"], ["seq"], "block")
    lines = marked.groupBy("doc_id", "page", "island", "block", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda w: w.text), " ").alias("text"),
        F.min("seq").alias("first"),
        *[F.min(c).alias(c) for c in ("x0", "y0")],
        *[F.max(c).alias(c) for c in ("x1", "y1")],
    )
    return lines.groupBy("doc_id", "page", "island", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda w: w.text), "\n").alias("text"),
        *[F.min(c).alias(c) for c in ("x0", "y0")],
        *[F.max(c).alias(c) for c in ("x1", "y1")],
    )
