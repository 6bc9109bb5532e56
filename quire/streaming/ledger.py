"""Structured Streaming over the run ledger and over folders where files land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ledger_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Ledger rows from Parquet files as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(folder)


def windowed(jobs: DataFrame, every: str = "1 hour", late: str = "10 minutes", at: str = "ts") -> DataFrame:
    """Runs and exact total duration of each verb in windows; rows later than ``late`` are dropped."""
    total = F.sum(F.col("duration").cast("decimal(18,2)")).alias("total")
    rows = jobs.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, every), "verb").agg(F.count("*").alias("runs"), total)
    return rows.select(F.col("window.start").alias("start"), "verb", "runs", "total")


def distinct_jobs(jobs: DataFrame, late: str = "10 minutes", at: str = "ts") -> DataFrame:
    """Each job once, as far as repeats come within the watermark."""
    return jobs.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(["id"])


def landed_files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """New files of a folder with their digest."""
    schema = spark.read.format("binaryFile").load(folder).schema
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.withColumn("digest", F.sha2("content", 256))


def upsert_by_digest(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append files whose digest the table at ``out`` lacks, one batch after the other."""

    def add(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(["digest"])
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(out)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.parquet(out).select("digest"), "digest", "left_anti")
        new.write.mode("append").parquet(out)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
