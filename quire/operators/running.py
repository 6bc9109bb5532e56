"""Running sums in an order, without one task for a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def sum_before(rows: DataFrame, by: list[str], order: Column, ties: list[str | Column], value: Column, name: str = "before", buckets: int = BUCKETS) -> DataFrame:
    """rows with the sum of ``value`` over those before each one in its group, by a number ``order`` and then ``ties``.

    Each group is cut into ranges of the order by approximate quantiles. The ranges' sums are added up first, a row a
    range, then the rows within a range, so a group of a third of all rows is many tasks' work. Only rows of one same
    order stay together; where many share it, put a tie-breaker into the order. Null groups are groups.
    """
    keyed = rows.withColumns({"_o": order.cast("double"), "_v": value})
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    edges = keyed.groupBy(*keys).agg(F.percentile_approx("_o", [i / buckets for i in range(1, buckets)], 1000).alias("_e"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    on = same[0] if same else F.lit(True)
    for s in same[1:]:
        on &= s
    names = [f"_k{i}" for i in range(len(by))]
    ranged = keyed.join(edges, on).withColumn("_bucket", F.size(F.filter("_e", lambda x: x <= F.col("_o")))).drop("_e", *names)
    sums = ranged.groupBy(*keys, F.col("_bucket").alias("_b")).agg(F.sum("_v").alias("_s"))
    earlier = sums.withColumn("_earlier", F.sum("_s").over(Window.partitionBy(*names).orderBy("_b")) - F.col("_s")).drop("_s")
    within = Window.partitionBy(*by, "_bucket").orderBy("_o", *ties).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("_own", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    joined = own.join(earlier, on & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(name, F.col("_own") + F.col("_earlier")).drop("_o", "_v", "_own", "_earlier", "_bucket", "_b", *names)
