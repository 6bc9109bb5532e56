"""Page-set operators: a document is its rows (doc_id, page, ...), page being the zero-based index.

Each operator returns the rows of the new document with ``page`` renumbered and, where rows move, ``source_page``
keeping where they came from. Windows are partitioned by document. A specification is given in options and parsed
on the driver; whatever depends on a document's own page count is an expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.expressions import bates as bates_label
from quire.functions.expressions import template
from quire.functions.pagespec import parse_pages


def page_count(doc_col: str = "doc_id") -> Column:
    return F.count("*").over(Window.partitionBy(doc_col))


def renumbered(rows: DataFrame, *order: Column, doc_col: str = "doc_id") -> DataFrame:
    """Pages 0, 1, ... of each document in the given order; the old number is ``source_page``."""
    ranked = rows.withColumnRenamed("page", "source_page")
    return ranked.withColumn("page", F.row_number().over(Window.partitionBy(doc_col).orderBy(*order)).cast("bigint") - 1)


def spec_rows(pages: DataFrame, spec: str) -> Column:
    """(pos, page) structs of a specification."""
    found = parse_pages(spec) or []
    return F.array(*[F.struct(F.lit(i).cast("bigint").alias("pos"), F.lit(p).cast("bigint").alias("wanted")) for i, p in enumerate(found)])


def select_pages(pages: DataFrame, spec: str | None) -> DataFrame:
    """The pages of a specification in its order, repeats included, with their place ``pos``; all for a blank one."""
    if parse_pages(spec) is None:
        return pages.withColumn("pos", F.col("page"))
    rows = pages.sparkSession.range(1).select(F.explode(spec_rows(pages, spec)).alias("s")).select("s.*")
    return pages.join(F.broadcast(rows), pages["page"] == rows["wanted"]).drop("wanted")  # as long as the option's text


def merge(*documents: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """The pages of all inputs in argument order."""
    out = documents[0].withColumn("file", F.lit(0).cast("bigint"))
    for i, d in enumerate(documents[1:], 1):
        out = out.unionByName(d.withColumn("file", F.lit(i).cast("bigint")))
    return renumbered(out, F.col("file"), F.col("source_page"), doc_col=doc_col)


def split(pages: DataFrame, every: int = 1) -> DataFrame:
    """Chunks of ``every`` pages (at least 1), numbered ``part`` from 1, pages restarting in each."""
    every = max(every, 1)
    return pages.withColumn("part", F.floor(F.col("page") / every) + 1).withColumn("part_page", F.col("page") % every)


def extract(pages: DataFrame, spec: str, doc_col: str = "doc_id") -> DataFrame:
    return renumbered(select_pages(pages, spec), F.col("pos"), doc_col=doc_col)


def delete(pages: DataFrame, spec: str, doc_col: str = "doc_id") -> DataFrame:
    """All but the named pages; a document of which none would be left is an error."""
    wanted = set(parse_pages(spec) or [])
    kept = pages.where(~F.col("page").isin(*wanted)) if wanted else pages
    return renumbered(kept, F.col("source_page"), doc_col=doc_col)


def reorder(pages: DataFrame, spec: str, doc_col: str = "doc_id") -> DataFrame:
    """Named pages first, the rest in their order; no page may be named twice."""
    wanted = parse_pages(spec) or []
    if not wanted or len(set(wanted)) != len(wanted):
        raise ValueError("the order must name at least one page, and none twice")
    place = F.coalesce(*[F.when(F.col("source_page") == p, F.lit(i)) for i, p in enumerate(wanted)], F.lit(len(wanted)) + F.col("source_page"))
    return renumbered(pages, place, doc_col=doc_col)


def rotate(pages: DataFrame, degrees: int, spec: str | None = None) -> DataFrame:
    """(degrees + rotation + 360) % 360 on the selected pages; the remainder keeps its sign."""
    if degrees % 90:
        raise ValueError("pages rotate by multiples of 90 degrees")
    chosen = _chosen(spec)
    return pages.withColumn("rotation", F.when(chosen, (F.lit(degrees) + F.col("rotation") + 360) % 360).otherwise(F.col("rotation")))


def _chosen(spec: str | None) -> Column:
    wanted = parse_pages(spec)
    return F.lit(True) if wanted is None else F.col("page").isin(*sorted(set(wanted)))


def blank(pages: DataFrame, at: int, count: int = 1, doc_col: str = "doc_id") -> DataFrame:
    """1 to 100 blank pages before the zero-based page ``at`` (at the end beyond it), sized like their neighbour."""
    if not 1 <= count <= 100:
        raise ValueError("1 to 100 blank pages can be inserted")
    size = [c for c in ("width", "height") if c in pages.columns]
    n = page_count(doc_col)
    neighbour = pages.withColumn("n", n).where(F.col("page") == F.least(F.lit(max(at, 0)).cast("bigint"), F.col("n") - 1))
    rows = neighbour.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(count))))
    keep = {doc_col, "page", *size}
    rows = rows.select(*[F.col(c) if c in keep else F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in pages.columns], "copy", F.when(F.col("n") <= at, F.col("page") + 0.5).otherwise(F.col("page") - 0.5).alias("place"))
    both = pages.withColumns({"copy": F.lit(0), "place": F.col("page").cast("double")}).unionByName(rows).withColumn("blank", F.col("copy") > 0)
    return renumbered(both, F.col("place"), F.col("copy"), doc_col=doc_col).drop("copy", "place")


def duplicate(pages: DataFrame, spec: str, doc_col: str = "doc_id") -> DataFrame:
    """A copy after each named page, however often it is named."""
    copies = pages.withColumn("copy", F.explode(F.when(_chosen(spec), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return renumbered(copies, F.col("source_page"), F.col("copy"), doc_col=doc_col)


def insert(pages: DataFrame, source: DataFrame, at: int = 0, doc_col: str = "doc_id") -> DataFrame:
    """source's pages (of the same documents) before page ``at``; 0 is the end, negative counts from the end."""
    n = pages.groupBy(doc_col).agg(F.count("*").alias("n"))
    own = pages.join(n, doc_col).withColumn("from_source", F.lit(0))
    new = source.join(n, doc_col).withColumn("from_source", F.lit(1))
    place = F.when(F.lit(at) == 0, F.col("n")).when(F.lit(at) < 0, F.greatest(F.col("n") + at, F.lit(0))).otherwise(F.least(F.lit(at - 1), F.col("n")))
    both = own.unionByName(new).withColumn("before", F.when(F.col("from_source") == 1, place - 0.5).otherwise(F.col("page").cast("double")))
    return renumbered(both, F.col("before"), F.col("source_page"), doc_col=doc_col).drop("n", "before")


def replace(pages: DataFrame, source: DataFrame, spec: str, doc_col: str = "doc_id") -> DataFrame:
    """The named pages go, source's pages come where the first named page was."""
    wanted = parse_pages(spec) or []
    first = wanted[0] if wanted else 0
    own = pages.where(~F.col("page").isin(*set(wanted))).withColumn("from_source", F.lit(0)).withColumn("before", F.col("page").cast("double"))
    new = source.withColumn("from_source", F.lit(1)).withColumn("before", F.lit(first - 0.5))
    return renumbered(own.unionByName(new), F.col("before"), F.col("source_page"), doc_col=doc_col).drop("before")


def crop(pages: DataFrame, box: tuple[float, float, float, float], spec: str | None = None) -> DataFrame:
    """Set the crop box, which must lie inside the page's ``width`` by ``height``."""
    x0, y0, x1, y1 = box
    inside = (F.lit(x0) >= 0) & (F.lit(y0) >= 0) & (F.lit(x1) <= F.col("width")) & (F.lit(y1) <= F.col("height")) & F.lit(x0 < x1 and y0 < y1)
    crop_ = F.array(*map(F.lit, map(float, box)))
    whole = F.array(F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height"))
    checked = F.when(inside, crop_).otherwise(F.raise_error(F.lit("the crop box must lie inside the media box")))
    return pages.withColumn("crop_box", F.when(_chosen(spec), checked).otherwise(whole))


def set_box(pages: DataFrame, box: str, rect: tuple[float, float, float, float], spec: str | None = None) -> DataFrame:
    """Set the media, crop, trim or bleed box."""
    if box not in ("media", "crop", "trim", "bleed"):
        raise ValueError(f"no such box: {box}")
    name = f"{box}_box"
    old = F.col(name) if name in pages.columns else F.lit(None).cast("array<double>")
    return pages.withColumn(name, F.when(_chosen(spec), F.array(*map(F.lit, map(float, rect)))).otherwise(old))


def scale(pages: DataFrame, factor: float, spec: str | None = None) -> DataFrame:
    """Page size and content scaled by a positive factor."""
    if factor <= 0:
        raise ValueError("the factor must be positive")
    by = F.when(_chosen(spec), F.lit(float(factor))).otherwise(F.lit(1.0))
    return pages.withColumns({c: F.col(c) * by for c in ("width", "height", "x0", "y0", "x1", "y1") if c in pages.columns})


def nup(pages: DataFrame, n: int = 2) -> DataFrame:
    """Sheets of 2 or 4 pages: ``sheet``, ``slot``, and the slot's row and column."""
    if n not in (2, 4):
        raise ValueError("2 or 4 pages fit a sheet")
    slot = F.col("page") % n
    return pages.withColumns({"sheet": F.floor(F.col("page") / n), "slot": slot, "slot_row": F.floor(slot / 2), "slot_column": slot % 2})


def booklet(pages: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Pages in printing order of a folded booklet: padded to a multiple of 4; ``source_page`` is null for a blank.

    Each pair of sheets' sides takes the outermost pages left: high, low, low + 1, high - 1.
    """
    counts = pages.groupBy(doc_col).agg(F.count("*").alias("n"))
    total = F.ceil(F.col("n") / 4) * 4
    slots = counts.select(doc_col, total.cast("bigint").alias("total"), F.explode(F.sequence(F.lit(0).cast("bigint"), total.cast("bigint") - 1)).alias("position"))
    low = F.floor(F.col("position") / 4) * 2
    high = F.col("total") - 1 - low
    side = F.col("position") % 4
    slots = slots.select(doc_col, "position", F.when(side == 0, high).when(side == 1, low).when(side == 2, low + 1).otherwise(high - 1).alias("page"))
    return slots.join(pages, [doc_col, "page"], "left").withColumn("source_page", F.when(F.col("page") < 0, None).otherwise(F.col("page")))


def overlay(pages: DataFrame, stamp: DataFrame) -> DataFrame:
    """Each page with the stamp page of its index, or the last one; stamp has (stamp_page, ...)."""
    last = stamp.agg(F.max("stamp_page").alias("last_stamp"))
    stamped = pages.crossJoin(F.broadcast(last)).withColumn("stamp_page", F.least(F.col("page"), F.col("last_stamp"))).drop("last_stamp")  # one row
    return stamped.join(stamp, "stamp_page")


def header(pages: DataFrame, text: str, doc_col: str = "doc_id", name: str = "header") -> DataFrame:
    """The template with ``{page}`` from 1 and ``{pages}``."""
    return pages.withColumn(name, template(text, F.col("page") + 1, page_count(doc_col)))


def numbers(pages: DataFrame, form: str = "{page}", start: int = 1, doc_col: str = "doc_id") -> DataFrame:
    return pages.withColumn("number", template(form, F.col("page") + start, page_count(doc_col)))


def bates(pages: DataFrame, prefix: str = "", start: int = 1, digits: int = 6) -> DataFrame:
    return pages.withColumn("bates", bates_label(prefix, F.col("page") + start, digits))


def watermark(pages: DataFrame, text: str = "DRAFT", size: float = 72, opacity: float = 0.15, angle: float = 45) -> DataFrame:
    """The stamp of each page as a row of its own layer; line breaks and tabs in the text are spaces."""
    plain = F.regexp_replace(F.lit(text), r"[\r\n\t]", " ")
    stamp = F.struct(plain.alias("text"), F.lit(float(size)).alias("size"), F.lit(float(opacity)).alias("opacity"), F.lit(float(angle)).alias("angle"))
    return pages.withColumn("watermark", stamp)


def surviving_links(links: DataFrame, kept: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Links whose page and, for jumps inside, whose target are still there, with their new pages."""
    new = kept.groupBy(doc_col, "source_page").agg(F.min("page").alias("new_page"))
    at = links.join(new.withColumnRenamed("source_page", "page"), [doc_col, "page"])
    target = new.select(doc_col, F.col("source_page").alias("target_page"), F.col("new_page").alias("new_target"))
    moved = at.join(target, [doc_col, "target_page"], "left")
    return moved.where(F.col("target_page").isNull() | F.col("new_target").isNotNull())
