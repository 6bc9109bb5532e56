"""Comparison: structure by position, pages by text, and what has no counterpart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.expressions import text_lines
from quire.functions.pytext import line_ratio, ratio_bound, unified


def structure(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, left, right) of each field that differs at a position; a missing side is null."""
    a = left.select(key, F.lit(True).alias("_a"), *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    b = right.select(key, F.lit(True).alias("_b"), *[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    both = a.join(b, key, "full_outer")
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("left"), F.col(f"b_{c}").alias("right")) for c in columns])
    return both.select(key, F.explode(fields).alias("f")).select(key, "f.*").where(~F.col("left").eqNullSafe(F.col("right")))


def name_difference(left: Column, right: Column) -> Column:
    """(only_left, only_right), sorted."""
    return F.struct(F.array_sort(F.array_except(left, right)).alias("only_left"), F.array_sort(F.array_except(right, left)).alias("only_right"))


def with_lines(pages: DataFrame, text_col: str = "text") -> DataFrame:
    lines = text_lines(F.col(text_col))
    return pages.withColumn("lines", lines).withColumn("line_hash", F.sha2(F.array_join("lines", "\n"), 256))


def exact_pages(left: DataFrame, candidates: DataFrame, key: str, candidate: str) -> DataFrame:
    """(key, candidate) of each non-blank left page with the first candidate (by its id) of equal lines."""
    a = with_lines(left).where(F.size("lines") > 0).select(key, "line_hash")
    first = with_lines(candidates).groupBy("line_hash").agg(F.min(candidate).alias(candidate))
    return a.join(first, "line_hash").select(key, candidate)


def quick_ratio(left: DataFrame, right: DataFrame, key: str, candidate: str, least: float = 0.6) -> DataFrame:
    """Upper bound of the similarity of two texts' words, 2 * shared / (n + m), of the pairs that reach ``least``.

    A pair that does shares at least c = least * n / (2 - least) words with the text of n, so one of any n - c + 1 words
    of each. Texts meet on those, the words rarest on the right first (the k-th of equal words is one of its own), and
    only pairs that meet and fit by size are counted out.
    """
    if not 0 < least <= 1:
        raise ValueError("the least similarity lies above 0 and at most at 1")
    words = lambda df, k: df.select(k, F.explode(F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda w: w != "")).alias("word"))
    a = words(left, key).groupBy(key, "word").agg(F.count("*").alias("n"))
    b = words(right, candidate).groupBy(candidate, "word").agg(F.count("*").alias("m"))
    often = b.groupBy("word").agg(F.count("*").alias("often"))

    def filed(counts: DataFrame, k: str, n: str) -> DataFrame:
        """The words that a text is filed under, and its size; words unknown on the right come first and meet nothing."""
        ranked = counts.join(often, "word", "left").select(k, "word", F.explode(F.sequence(F.lit(1), F.col(n))).alias("copy"), F.coalesce("often", F.lit(0)).alias("often"))
        place = Window.partitionBy(k).orderBy("often", "word", "copy")
        ranked = ranked.withColumns({"place": F.row_number().over(place), "size": F.count("*").over(Window.partitionBy(k))})
        needed = F.ceil(F.col("size") * F.lit(least) / (2 - F.lit(least)) - F.lit(1e-9))
        return ranked.where((F.col("place") <= F.col("size") - needed + 1) & (F.col("often") > 0)).select(k, "word", "copy", "size")

    one, two = filed(a, key, "n"), filed(b, candidate, "m").withColumnRenamed("size", "size_b")
    fits = 2 * F.least("size", "size_b") >= F.lit(least) * (F.col("size") + F.col("size_b")) - F.lit(1e-9)
    pairs = one.join(two, ["word", "copy"]).where(fits).select(key, candidate).distinct()
    na, nb = a.groupBy(key).agg(F.sum("n").alias("na")), b.groupBy(candidate).agg(F.sum("m").alias("nb"))
    shared = pairs.join(a, key).join(b, [candidate, "word"]).groupBy(key, candidate).agg(F.sum(F.least("n", "m")).alias("shared"))
    scored = shared.join(na, key).join(nb, candidate)
    return scored.withColumn("ratio", 2 * F.col("shared") / (F.col("na") + F.col("nb"))).where(F.col("ratio") >= least)


def best_match(pages: DataFrame, others: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Each left page's best page anywhere in the other version of its document.

    Both have (doc_id, page, text). An equal page at the same index wins, then the first equal page, then the
    highest line similarity, where the page at the same index and then earlier ones win ties. A blank page has no
    match. Equal pages are found by a hash join; what is left of a document meets in one row, where a pair is compared
    line by line only if the lines that both have, whatever their order, could beat the best so far.
    """
    a, b = with_lines(pages).where(F.size("lines") > 0), with_lines(others).where(F.size("lines") > 0)
    place = F.when(F.col("b.page") == F.col("a.page"), -1).otherwise(F.col("b.page"))
    same = a.alias("a").join(b.alias("b"), [doc_col, "line_hash"]).groupBy(F.col(doc_col), F.col("a.page").alias("page")).agg(F.min(F.struct(place.alias("o"), F.col("b.page").alias("match"))).alias("m"))
    exact = same.select(doc_col, "page", F.col("m.match").alias("match"), F.lit(1.0).alias("ratio"))
    rest = a.join(exact, [doc_col, "page"], "left_anti").groupBy(doc_col).agg(F.collect_list(F.struct("page", "lines")).alias("rest"))
    whole = b.groupBy(doc_col).agg(F.array_sort(F.collect_list(F.struct("page", "lines"))).alias("others"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, x["page"], *best_of(x, other)) for k, rest_, other in zip(batch[doc_col], batch["rest"], batch["others"], strict=True) for x in rest_]
            yield pd.DataFrame(rows, columns=[doc_col, "page", "match", "ratio"])

    kind = pages.schema[doc_col].dataType.simpleString()
    return exact.unionByName(rest.join(whole, doc_col).mapInPandas(score, f"{doc_col} {kind}, page bigint, match bigint, ratio double"))


def best_of(page: dict, others: list[dict]) -> tuple[int, float]:
    """The most similar of some pages, in their order but for the one of the same index, which goes first."""
    match, best = -1, -1.0
    own = list(page["lines"])
    for other in sorted(others, key=lambda o: o["page"] != page["page"]):
        lines = list(other["lines"])
        if ratio_bound(own, lines) > best:
            ratio = line_ratio(own, lines)
            if ratio > best:
                match, best = int(other["page"]), ratio
    return match, best


def diffs(pages: DataFrame, others: DataFrame, matches: DataFrame, context: int = 1, most_lines: int = 20, doc_col: str = "doc_id") -> DataFrame:
    """Unified diff of each page with its match: lines added and removed, counted before it is cut to most_lines."""
    a = with_lines(pages).select(doc_col, "page", F.col("lines").alias("left"))
    b = with_lines(others).select(doc_col, F.col("page").alias("match"), F.col("lines").alias("right"))
    joined = matches.join(a, [doc_col, "page"]).join(b, [doc_col, "match"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x in batch.itertuples(index=False):
                lines = unified(list(x.left), list(x.right), context)
                added, removed = sum(t.startswith("+") for t in lines), sum(t.startswith("-") for t in lines)
                rows.append((getattr(x, doc_col), x.page, x.match, x.ratio, added, removed, lines[:most_lines], len(lines) > most_lines))
            yield pd.DataFrame(rows, columns=[doc_col, "page", "match", "ratio", "added", "removed", "diff", "truncated"])

    kind = pages.schema[doc_col].dataType.simpleString()
    return joined.mapInPandas(run, f"{doc_col} {kind}, page bigint, match bigint, ratio double, added bigint, removed bigint, diff array<string>, truncated boolean")


def unmatched(candidates: DataFrame, matches: DataFrame, on: list[str]) -> DataFrame:
    """Candidates that no page was mapped to."""
    return candidates.join(matches, on, "left_anti")
