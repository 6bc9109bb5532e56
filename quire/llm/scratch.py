"""Tables written between steps, in the folder that the driver and all executors share.

The folder is ``spark.checkpoint.dir`` of the session; only where that is unset (tests, a laptop) is a local one
made and set. A written table cuts the lineage and survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_ROWS = 1000  # of texts that a worker gets at once: Spark's 10,000 are some 50 MB, held by the worker and by its executor
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"  # of long texts, 4,096 are arrays of tens of MB, copied whenever they grow
BROADCAST_ROWS = 1 << 20  # keys handed to every worker at most; more are joined by a shuffle
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}/{name}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextlib.contextmanager
def at_most(spark: SparkSession, setting: str, rows: int | None) -> Iterator[None]:
    """What runs within has that number of rows in a setting at most; None leaves the session's own number."""
    before = spark.conf.get(setting)
    if rows is None or 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(setting, rows)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def batches_of(spark: SparkSession, rows: int | None) -> contextlib.AbstractContextManager[None]:
    """What runs within hands workers batches of that many rows at most."""
    return at_most(spark, BATCH_ROWS, rows)


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, read again, and its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with batches_of(spark, batch_rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    return stored(df, name, batch_rows)[0]


def small_side(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of ids or keys, to be handed to every worker if it has few rows; a shuffle joins more of them."""
    return F.broadcast(keys) if keys.count() <= most else keys


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of finished jobs now, not whenever the heap next fills."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            remove(spark, path.rsplit("/", 1)[0])
