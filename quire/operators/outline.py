"""Outlines and destinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validate(rows: DataFrame, page_counts: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """rows (doc, ord, level, title, page) with ``error``: the first must have level 1, a level rises by one at most,
    pages are -1 to the page count. The last row's page is not checked."""
    w = Window.partitionBy(doc_col).orderBy("ord")
    joined = rows.join(page_counts, doc_col)
    before, after = F.lag("level").over(w), F.lead("ord").over(w)
    error = (
        F.when(before.isNull() & (F.col("level") != 1), "hierarchy level of item 0 must be 1")
        .when(before.isNotNull() & ((F.col("level") < 1) | (F.col("level") > before + 1)), "bad hierarchy level")
        .when(after.isNotNull() & ((F.col("page") < -1) | (F.col("page") > F.col("page_count"))), "page number out of range")
    )
    return joined.withColumn("error", error)


def parents(rows: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """rows with ``parent``, the ord of the nearest row above of the level one less, whatever the level.

    Each row asks under its own level and answers under the next, so the nearest answer above is a last value.
    """
    asks = rows.withColumns({"_level": F.col("level").cast("bigint"), "_ask": F.lit(True), "_ord": F.lit(None).cast(rows.schema["ord"].dataType)})
    answers = rows.withColumns({"_level": F.col("level").cast("bigint") + 1, "_ask": F.lit(False), "_ord": F.col("ord")})
    above = Window.partitionBy(doc_col, "_level").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    found = asks.unionByName(answers).withColumn("parent", F.last("_ord", ignorenulls=True).over(above))
    return found.where("_ask").drop("_level", "_ask", "_ord")


def resolve(links: DataFrame, destinations: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """links with the page of their named destination; of entries with one name the last counts."""
    last = destinations.groupBy(F.col(doc_col).alias("_doc"), F.col("name").alias("_name")).agg(F.max_by("target", "ord").alias("resolved"))
    return links.join(last, (F.col(doc_col) == F.col("_doc")) & (F.col("name") == F.col("_name")), "left").drop("_doc", "_name")
