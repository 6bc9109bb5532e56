"""The supplied tables in the roles of the engine's model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-page documents: (doc_id, page, label, text), one row a turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.col("role").alias("label"), "text")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line, text): the lines of one-page documents."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.withColumn("line", F.col("line").cast("bigint"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run ledger: (id, ts, verb, user_id, duration, detail)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("verb"), "user_id", F.col("value").alias("duration"), F.col("props").alias("detail"))
