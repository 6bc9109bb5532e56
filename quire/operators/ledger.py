"""The run ledger and the derived-page cache as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.running import sum_before


def recent(jobs: DataFrame, limit: int = 20, id_col: str = "id") -> DataFrame:
    """Newest rows first; a negative limit lists all."""
    ordered = jobs.orderBy(F.desc(id_col))
    return ordered if limit < 0 else ordered.limit(limit)


def summary(jobs: DataFrame) -> DataFrame:
    """Runs, least, most and total duration of each verb; totals are exact decimals of two places."""
    d = F.col("duration").cast("decimal(18,2)")
    return jobs.groupBy("verb").agg(F.count("*").alias("runs"), F.min("duration").alias("least"), F.max("duration").alias("most"), F.sum(d).cast("decimal(38,2)").alias("total"))


def reduced(detail: Column) -> Column:
    """What the ledger keeps of a JSON object's members: numbers and booleans as they are, of strings, arrays and
    objects only the length."""
    members = F.from_json(detail, "map<string,string>")

    def keep(_: Column, v: Column) -> Column:
        inner = F.coalesce(F.json_array_length(v), F.size(F.map_keys(F.from_json(v, "map<string,string>"))))
        plain = v.rlike(r"^(-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null)$")
        return F.when(plain, v).when(v.rlike(r"^[\[{]"), inner.cast("string")).otherwise(F.length(v).cast("string"))

    return F.transform_values(members, keep)


def cache_sizes(pages: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    return pages.groupBy(doc_col).agg(F.sum("row_bytes").cast("bigint").alias("row_bytes"), F.count("*").alias("page_count"))


def evict(cache: DataFrame, cap: int, id_col: str = "id", buckets: int = 64) -> DataFrame:
    """Rows that stay in a least-recently-used cache of ``cap`` bytes, with the running size from the newest.

    Of rows with one last use, those of greater ids are the newer.
    """
    running = sum_before(cache, [], -F.col("last_used").cast("double"), [F.desc("last_used"), F.desc(id_col)], F.col("row_bytes"), "_newer", buckets)
    return running.withColumn("running_bytes", (F.col("_newer") + F.col("row_bytes")).cast("bigint")).where(F.col("running_bytes") <= cap).drop("_newer")


def upsert(cache: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new's rows over cache's of the same key."""
    return cache.join(new, key, "left_anti").unionByName(new)


def first_kept_last_wins(rows: DataFrame, key: list[str], order: str, values: list[str]) -> DataFrame:
    """Rows deduplicated by key: the last row's values at the first row's position."""
    latest = F.max_by(F.struct(*values), F.col(order))
    return rows.groupBy(*key).agg(F.min(order).alias("position"), latest.alias("v")).select(*key, "position", "v.*")


def newest_entry(rows: DataFrame, key: list[str], newest_first: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*newest_first))).where("_k = 1").drop("_k")


def status(expected: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status) of what should be there and what is: ready, changed, missing or extra, by digest."""
    a = expected.select(key, F.col(digest).alias("_want"))
    b = found.select(key, F.col(digest).alias("_have"))
    state = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "extra").when(F.col("_want") == F.col("_have"), "ready").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("status"))
