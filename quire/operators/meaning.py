"""Vector search: cosine scores, top-k and full ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.expressions import cosine
from quire.operators.running import sum_before


def scored(vectors: DataFrame, query: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """vectors with ``score``, the cosine to the query's one row (``query``), and ``score4``, ten-thousandths."""
    joined = vectors.crossJoin(F.broadcast(query.limit(1)))  # one row
    scored_ = joined.withColumn("score", cosine(F.col(vector_col), F.col("query")))
    return scored_.withColumn("score4", F.floor(F.col("score") * 10000 + 0.5).cast("bigint")).drop("query")


def top(scored_: DataFrame, n: int, *ties: str) -> DataFrame:
    """The n best by rounded score, ties by the given columns."""
    return scored_.orderBy(F.desc("score4"), *ties).limit(n)


def centroids(vectors: DataFrame, group: str, vector_col: str = "embedding") -> DataFrame:
    """Mean vector of each group, from per-position sums of millionths so that order does not matter."""
    flat = vectors.select(group, F.posexplode(vector_col).alias("i", "x"))
    means = flat.groupBy(group, "i").agg((F.sum(F.floor(F.col("x").cast("double") * 1_000_000 + 0.5).cast("bigint")) / F.count("*")).alias("x"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e.x).alias("query"))


def ranks(vectors: DataFrame, centers: DataFrame, group: str, id_col: str, vector_col: str = "embedding") -> DataFrame:
    """Rank of each vector among those of its group by score to the group's center, best first, ties by id."""
    joined = vectors.join(centers, group).withColumn("score4", F.floor(cosine(F.col(vector_col), F.col("query")) * 10000 + 0.5).cast("bigint"))
    better = sum_before(joined.drop("query"), [group], -F.col("score4"), [id_col], F.lit(1), "rank")
    return better.withColumn("rank", (F.col("rank") + 1).cast("bigint"))
