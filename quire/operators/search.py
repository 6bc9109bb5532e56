"""Search: literal hits with positions, limits by running totals, many needles at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.expressions import literal_hits
from quire.functions.pytext import hit_pattern, literal_pattern, word_spans
from quire.operators.paged import Box, by_page, united
from quire.operators.running import sum_before

SHORT_BLOCK = 500  # needles tested in one scan
ANCHORS = 1 << 20  # anchors handed to every worker at most; more meet the pages in a shuffle


def hits(pages: DataFrame, query: str, text_col: str = "text") -> DataFrame:
    """The rows that an ASCII phrase occurs in, with the number of ``hits``; none for a blank phrase."""
    if not query.split():
        return pages.withColumn("hits", F.lit(0).cast("bigint")).where("false")
    first = query.split()[0].lower()
    return pages.where(F.contains(F.lower(text_col), F.lit(first))).withColumn("hits", literal_hits(F.col(text_col), query)).where("hits > 0")


def limited(pages: DataFrame, query: str, limit: int, partition: str, order: str) -> DataFrame:
    """Pages in order until ``limit`` hits are reached; ``truncated`` if there are more or pages were left unvisited."""
    if limit < 1:
        raise ValueError("--limit must be 1 or more")
    counted = pages.select(partition, order, literal_hits(F.col("text"), query).alias("hits"))
    visited = sum_before(counted, [partition], F.col(order), [order], F.col("hits")).withColumn("visited", F.col("before") < limit)
    return visited.groupBy(partition).agg(
        F.count_if("visited").alias("pages_visited"),
        F.least(F.sum(F.when(F.col("visited"), F.col("hits")).otherwise(0)), F.lit(limit)).cast("bigint").alias("hits"),
        ((F.sum(F.when(F.col("visited"), F.col("hits")).otherwise(0)) > limit) | F.bool_or(~F.col("visited"))).alias("truncated"),
    )


def many(pages: DataFrame, needles: DataFrame, id_col: str, needle_id: str, needle_text: str = "text", text_col: str = "text", anchor_words: int = 3) -> DataFrame:
    """(id, needle id) of every needle that a page holds, white space squeezed on both sides.

    A needle may begin and end inside a page's words, but the words between are whole. Up to ``anchor_words`` of
    those are hashed and joined to every run of as many words of a page, so the pairs looked at share an anchor, and
    containment is then tested. Needles of one or two words have none: they are tested in blocks of a scan.
    """
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"[ \t\n\r\f\x0b]+", " "))
    needle = needles.select(F.col(needle_id).alias("needle"), squeeze(F.col(needle_text)).alias("needle_text")).where("needle_text <> ''")
    needle = needle.distinct().withColumn("parts", F.split("needle_text", " "))
    page = pages.select(F.col(id_col).alias("page_id"), squeeze(F.col(text_col)).alias("page_text"))
    inner = F.size("parts") - 2
    long = needle.where(inner >= 1).withColumn("size", F.least(inner, F.lit(anchor_words)))
    anchor = long.select("needle", F.xxhash64("size", F.array_join(F.slice(F.col("parts"), F.lit(2), F.col("size")), " ")).alias("anchor"))
    parts = F.split("page_text", " ")
    sizes = sorted(r[0] for r in long.select("size").distinct().collect())  # anchor_words numbers at most

    def runs(all_: Column, size: int) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(all_) - size + 1, F.lit(1))), lambda i: i + size - 1 <= F.size(all_))
        return F.transform(at, lambda i: F.xxhash64(F.lit(size), F.array_join(F.slice(all_, i, size), " ")))

    bound = F.transform(F.array(parts), lambda all_: F.array_distinct(F.concat(*[runs(all_, k) for k in sizes or [1]])))
    spots = page.select("page_id", F.explode(F.get(bound, F.lit(0))).alias("anchor"))
    if anchor.count() <= ANCHORS:
        anchor = F.broadcast(anchor)
    pairs = spots.join(anchor, "anchor").select("page_id", "needle").distinct()
    found = pairs.join(long.select("needle", "needle_text"), "needle").join(page, "page_id").where(F.contains("page_text", "needle_text"))
    out = found.select("page_id", "needle")
    short = [(r[0], r[1]) for r in needle.where(inner < 1).select("needle", "needle_text").toLocalIterator()]
    kind = needle.schema["needle"].dataType
    for at in range(0, len(short), SHORT_BLOCK):
        block = F.array(*[F.struct(F.lit(k).cast(kind).alias("needle"), F.lit(t).alias("t")) for k, t in short[at : at + SHORT_BLOCK]])
        hit = page.select("page_id", F.explode(F.filter(block, lambda n: F.contains(F.col("page_text"), n.t))).alias("n"))
        out = out.unionByName(hit.select("page_id", F.col("n.needle").alias("needle")))
    return out.select(F.col("page_id").alias(id_col), F.col("needle").alias(needle_id))


def word_hits(words: DataFrame, query: str, regex: bool = False, in_order: bool = False) -> DataFrame:
    """Hit rectangles on positioned words: (doc_id, page, hit, block, line, x0, y0, x1, y1), one for each line a match touches.

    Matches are Python's, found page by page, and a line's boxes are united; words and in_order as in ``by_page``.
    """

    def fold(page: list[Box]) -> Iterator[tuple]:
        pattern = hit_pattern(query) if regex else literal_pattern(query)
        for i, (a, b) in enumerate(word_spans([w.text for w in page], pattern)):
            lines: dict[tuple[int, int], list[Box]] = {}
            for w in page[a:b]:
                lines.setdefault((w.block, w.line), []).append(w)
            for key, boxes in lines.items():
                yield i, *key, *united(boxes)

    return by_page(words, fold, "hit bigint, block bigint, line bigint, x0 double, y0 double, x1 double, y1 double", in_order)


def python_hits(pages: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, stop, match) of every match of a Python pattern, by code points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = hit_pattern(pattern)
        for batch in batches:
            rows = [(k, m.start(), m.end(), m[0]) for k, t in zip(batch[id_col], batch[text_col], strict=True) if t for m in compiled.finditer(t)]
            yield pd.DataFrame(rows, columns=[id_col, "start", "stop", "match"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, start bigint, stop bigint, match string")
