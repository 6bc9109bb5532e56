"""Interval operators: as-of and band joins, containment, clusters and merged intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, rules: DataFrame, at: str, start: str, values: list[str], by: list[str]) -> DataFrame:
    """Each row with the rule of the greatest start not after it; nulls where there is none.

    rules apply to every group of ``by`` unless they carry those columns. They are spliced into the rows' order and
    carried forward, so no row meets more than one rule.
    """
    own = set(by) <= set(rules.columns)
    keyed = rules if own else rows.select(*by).distinct().crossJoin(F.broadcast(rules))  # an option's few rules
    rule = keyed.select(*by, F.col(start).alias("_at"), F.struct(F.col(start), *values).alias("_rule"), F.lit(0).alias("_side"))
    kept = F.struct(*[F.col(c) for c in rows.columns])
    mixed = rows.select(*by, F.col(at).alias("_at"), F.lit(None).cast(rule.schema["_rule"].dataType).alias("_rule"), F.lit(1).alias("_side"), kept.alias("_row"))
    both = mixed.unionByName(rule, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_last", F.last("_rule", ignorenulls=True).over(w)).where("_side = 1")
    return carried.select("_row.*", "_last.*")


def merged(rows: DataFrame, by: list[str], low: str, high: str, gap: float) -> DataFrame:
    """Intervals of each group merged while the next starts at most ``gap`` past the greatest end so far."""
    w = Window.partitionBy(*by).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(low) - reach > gap), 1).otherwise(0)
    marked = rows.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    return marked.groupBy(*by, "cluster").agg(F.min(low).alias(low), F.max(high).alias(high), F.count("*").alias("members"))


def clustered(rows: DataFrame, by: list[str], value: str, tolerance: float) -> DataFrame:
    """rows with ``cluster``: distinct values of a group in order, a new one when more than ``tolerance`` above the
    last; with tolerance 0 every value is its own."""
    values = rows.select(*by, value).distinct()
    w = Window.partitionBy(*by).orderBy(value)
    last = F.lag(value).over(w)
    new = F.when(last.isNull() | (F.lit(tolerance == 0) | (F.col(value) > last + tolerance)), 1).otherwise(0)
    numbered = values.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_new")
    return rows.join(numbered, [*by, value])


def band(left: DataFrame, right: DataFrame, by: list[str], condition: Column) -> DataFrame:
    """Pairs of one group that meet a condition on ranges."""
    return left.join(right, by).where(condition)


def band_buckets(left: DataFrame, right: DataFrame, a: str, b: str, width: float) -> DataFrame:
    """Pairs with |a - b| <= width and no key: values fall into bands of that width and meet their neighbours only."""
    l_ = left.withColumn("_band", F.floor(F.col(a) / width))
    r_ = right.withColumn("_band", F.explode(F.array(F.floor(F.col(b) / width) - 1, F.floor(F.col(b) / width), F.floor(F.col(b) / width) + 1)))
    return l_.join(r_, "_band").where(F.abs(F.col(a) - F.col(b)) <= width).drop("_band")


def season_bounds(season: Column, year: Column) -> Column:
    """First and last day of an academic season."""
    # The seasons' months and days.
    first = F.when(season == "Winter", "-01-01").when(season == "Spring", "-01-01").when(season == "Summer", "-06-01").when(season == "Fall", "-08-01")
    last = F.when(season == "Winter", "-03-31").when(season == "Spring", "-06-30").when(season == "Summer", "-08-31").when(season == "Fall", "-12-31")
    return F.struct(F.to_date(F.concat(year, first)).alias("first"), F.to_date(F.concat(year, last)).alias("last"))
