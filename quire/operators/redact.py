"""Redaction and literal edits as table operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.expressions import words


def word_counts(pages: DataFrame, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Words of each text, and how many a pattern removes and keeps; texts without words are left out."""
    listed = pages.select(id_col, words(F.col("text")).alias("w")).where(F.size("w") > 0)
    gone = F.size(F.filter("w", lambda x: x.rlike(pattern)))
    return listed.select(id_col, F.size("w").cast("bigint").alias("word_count"), gone.cast("bigint").alias("redactions"), (F.size("w") - gone).cast("bigint").alias("kept"))


def redacted_words(words_: DataFrame, hits: DataFrame) -> DataFrame:
    """Positioned words outside every hit rectangle of their page; a word overlapping one goes."""
    h = hits.select("doc_id", "page", *[F.col(c).alias(f"h_{c}") for c in ("x0", "y0", "x1", "y1")])
    apart = (words_["doc_id"] == h["doc_id"]) & (words_["page"] == h["page"]) & (F.col("x0") < F.col("h_x1")) & (F.col("h_x0") < F.col("x1")) & (F.col("y0") < F.col("h_y1")) & (F.col("h_y0") < F.col("y1"))
    return words_.join(h, apart, "left_anti")


def by_name(rows: DataFrame, flagged: DataFrame, name: str) -> DataFrame:
    """Rows whose name any flagged row has: a field is cleared by its name, all its widgets together."""
    return rows.join(flagged, name, "left_semi")


def replace_text(pages: DataFrame, find: str, replacement: str, text_col: str = "text") -> DataFrame:
    """Case-sensitive literal replacement on the rows that hold the text, with the number of replacements."""
    if not find:
        raise ValueError("nothing to find")
    found = pages.where(F.contains(text_col, F.lit(find)))
    n = (F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit(find), F.lit("")))) / len(find)
    return found.withColumn("replacements", n.cast("bigint")).withColumn(text_col, F.replace(F.col(text_col), F.lit(find), F.lit(replacement)))
