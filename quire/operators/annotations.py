"""Annotations, form fields, attachments and metadata as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Subtypes that a listing leaves out, fields of document information, stamps by number.
UNLISTED = ["Link", "Popup", "Widget"]
METADATA = ["title", "author", "subject", "keywords", "creator", "producer"]
DELETES = ["", "none", "null"]
STAMPS = ["Approved", "AsIs", "Confidential", "Departmental", "Experimental", "Expired", "Final", "ForComment", "ForPublicRelease", "NotApproved", "NotForPublicRelease", "Sold", "TopSecret", "Draft"]


def listed(annotations: DataFrame) -> DataFrame:
    """(doc_id, page from 1, type, contents, author) without links, popups and widgets; empty texts are null."""
    rows = annotations.where(~F.col("subtype").isin(UNLISTED))
    return rows.select("doc_id", "ord", (F.col("page") + 1).alias("page"), F.col("subtype").alias("type"), F.nullif("contents", F.lit("")).alias("contents"), F.nullif("author", F.lit("")).alias("author"))


def delete(annotations: DataFrame, kind: str | None = None, pages: list[int] | None = None) -> DataFrame:
    """What is left after deleting a type (any case) on some pages, with the popups of what goes."""
    hit = ~F.col("subtype").isin("Popup")
    if kind is not None:
        hit = hit & (F.lower("subtype") == kind.lower())
    if pages is not None:
        hit = hit & F.col("page").isin(*pages)
    gone = annotations.where(hit)
    ids = gone.select("doc_id", F.col("ord").alias("gone")).unionByName(gone.where("popup is not null").select("doc_id", F.col("popup").alias("gone")))
    return annotations.join(ids, (annotations["doc_id"] == ids["doc_id"]) & (annotations["ord"] == ids["gone"]), "left_anti")


def append(annotations: DataFrame, new: DataFrame) -> DataFrame:
    """new rows after each document's last."""
    last = annotations.groupBy("doc_id").agg((F.max("ord") + 1).alias("_next"))
    numbered = new.join(last, "doc_id", "left").withColumn("ord", F.coalesce("_next", F.lit(0)) + F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "x0", "y0")) - 1)
    return annotations.unionByName(numbered.drop("_next"), allowMissingColumns=True)


def marks(hits: DataFrame, kind: str, color: tuple[float, float, float] = (1.0, 1.0, 0.0)) -> DataFrame:
    """One highlight, underline or strikeout row for each hit rectangle."""
    if kind not in ("Highlight", "Underline", "StrikeOut"):
        raise ValueError(f"no such mark: {kind}")
    return hits.select("doc_id", "page", F.lit(kind).alias("subtype"), "x0", "y0", "x1", "y1", F.array(*map(F.lit, color)).alias("color"))


def drawn(page: int, kind: str, points: list[tuple[float, float]], contents: str = "", width: float = 1.5) -> dict:
    """The row of a note, text box, shape, line, ink, polygon, stamp or callout: its box is that of its points."""
    if not points:
        raise ValueError("an annotation needs a place")
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return {"page": page, "subtype": kind, "x0": min(xs), "y0": min(ys), "x1": max(xs), "y1": max(ys), "points": points, "contents": contents, "width": width}


def fill(widgets: DataFrame, values: DataFrame) -> DataFrame:
    """widgets (qualified, local, value) with the values given under either name; the qualified name goes first."""
    one = values.groupBy("name").agg(F.max("new").alias("new"))  # a name given twice counts once, by its greatest value
    by_full = one.select(F.col("name").alias("qualified"), F.col("new").alias("new_full"))
    by_local = one.select(F.col("name").alias("local"), F.col("new").alias("new_local"))
    joined = widgets.join(by_full, "qualified", "left").join(by_local, "local", "left")
    new = F.coalesce("new_full", "new_local")
    return joined.withColumn("filled", new.isNotNull()).withColumn("value", F.coalesce(new, F.col("value"))).drop("new_full", "new_local")


def unknown_names(widgets: DataFrame, values: DataFrame) -> DataFrame:
    """Names of values that no field has."""
    names = widgets.select(F.col("qualified").alias("name")).union(widgets.select("local"))
    return values.join(names, "name", "left_anti")


def exported(widgets: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """A document's field values as one JSON object, in field order."""
    pairs = F.array_sort(F.collect_list(F.struct("ord", "qualified", "value")))
    entries = F.transform(pairs, lambda p: F.struct(p.qualified, F.coalesce(p.value, F.lit(""))))
    return widgets.groupBy(doc_col).agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def xfdf(widgets: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """A document's field values as XFDF."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    field = F.concat(F.lit('<field name="'), safe(F.col("qualified")), F.lit('"><value>'), safe(F.coalesce("value", F.lit(""))), F.lit("</value></field>"))
    rows = widgets.withColumn("_f", field).groupBy(doc_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_f"))), lambda x: x["_f"]), "").alias("_x"))
    return rows.select(doc_col, F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><xfdf xmlns="http://ns.adobe.com/xfdf/"><fields>'), F.col("_x"), F.lit("</fields></xfdf>")).alias("xfdf"))


def qualified_names(fields: DataFrame) -> DataFrame:
    """fields (doc_id, id, parent, name) with ``qualified``: names from the root joined by dots.

    Each round joins every field's name so far with that of the field it starts below, which doubles the levels a name
    spans, so the rounds are the logarithm of the greatest depth. Fields above one another in a circle are an error.
    """
    rows = fields.withColumns({"qualified": F.col("name"), "_up": F.col("parent")})
    rounds = 0
    while rows.where("_up is not null").limit(1).count():
        rounds += 1
        if rounds > 40:
            raise ValueError("fields that are their own parents")
        rows = rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows
        above = rows.select(F.col("doc_id").alias("_doc"), F.col("id").alias("_id"), F.col("qualified").alias("_name"), F.col("_up").alias("_next"))
        joined = rows.join(above, (F.col("doc_id") == F.col("_doc")) & (F.col("_up") == F.col("_id")), "left")
        name = F.when(F.col("_name").isNotNull(), F.concat_ws(".", "_name", "qualified")).otherwise(F.col("qualified"))
        rows = joined.withColumn("qualified", name).withColumn("_up", F.col("_next")).drop("_doc", "_id", "_name", "_next")
    return rows.drop("_up")


def metadata(info: Column) -> Column:
    """The non-empty entries of a metadata map."""
    return F.map_filter(info, lambda _, v: F.coalesce(v, F.lit("")) != "")


def set_metadata(info: Column, changes: dict[str, str]) -> Column:
    """Entries changed; an empty text, none or null deletes; unknown keys are an error that names all of them."""
    unknown = [k for k in changes if k.lower() not in METADATA]
    if unknown:
        raise ValueError(f"unknown metadata keys: {', '.join(unknown)}")
    names = [k.lower() for k in changes]
    kept = F.map_filter(info, lambda k, _: ~k.isin(*names)) if names else info
    new = {k.lower(): v for k, v in changes.items() if v.lower() not in DELETES}
    if not new:
        return kept
    return F.map_concat(kept, F.create_map(*[F.lit(x) for kv in new.items() for x in kv]))


def detach(attachments: DataFrame, names: list[str], doc_col: str = "doc_id") -> DataFrame:
    """Each document's attachments without the named ones; ``missing`` lists names that it does not have."""
    wanted = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    have = attachments.groupBy(doc_col).agg(F.array_sort(F.collect_set("name")).alias("available"))
    return have.select(doc_col, F.array_except("available", wanted).alias("kept"), F.array_except(wanted, F.col("available")).alias("missing"))


def collisions(attachments: DataFrame, key: Column, doc_col: str = "doc_id") -> DataFrame:
    """Attachments whose names are one on a file system that folds case and composition."""
    return attachments.withColumn("_key", key).withColumn("same", F.count("*").over(Window.partitionBy(doc_col, "_key"))).where("same > 1").drop("_key")
