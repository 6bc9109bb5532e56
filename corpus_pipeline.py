"""The corpus pipeline: quality rules, near-dedup, decontamination, secret redaction and packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; all
but the last keep the columns of docs. Stages are written as Parquet in the shared folder and read again, so a
lost executor never costs more than the stage it worked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.decontaminate import contaminated
from quire.llm.packing import pack
from quire.llm.quality import judge
from quire.llm.queries import tokenizer_path
from quire.llm.scratch import small_side, written
from quire.llm.secrets import redact
from quire.llm.shingles import keep_one

#: SQL cannot express a language model's perplexity, a union of near copies, or a tokenizer.
ORACLE_SQL = None


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose id is in gone; rows with a null id stay."""
    return docs.join(small_side(written(gone.select("doc_id").distinct(), "gone")), "doc_id", "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their language's perplexity bands.

    Of rows that repeat an id, all go if one is rejected; rows with a null id cannot be told apart and stay.
    """
    rejected = judge(docs).where("not kept")
    return _without(docs, rejected)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Links are all pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    return keep_one(docs, k=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a marker; n_chars follows the text."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the training sequences."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
