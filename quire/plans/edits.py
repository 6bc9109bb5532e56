"""Queries over the verbs that write documents: files are made, changed by a verb, and read again."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import documents, layout, ledger
from quire.plans.catalog import query
from quire.plans.files import _SQUEEZED, pdf_files
from quire.sources import convert, pdf_edit, pdf_tables, sinks
from quire.sources.adapters import conversation_pages, table
from quire.sources.pdf import Name
from quire.sources.pdf_edit import Draft
from quire.sources.pdf_write import text_pdf

#: The pages of all files, their words, and how many pages a file has.
_P = f"with p as (select conv_id doc_id, turn page, trim({_SQUEEZED}, chr(10)) as text, regexp_extract_all(text, '[^ \\t\\n]+') words, count(*) over (partition by conv_id) n from conversations)"
def doc() -> Column:
    return F.col("path").cast("bigint").alias("doc_id")


def other() -> bytes:
    return text_pdf(["inserted page"])


def changed(spark: SparkSession, sf_dir: str, change: Callable[[Draft, str], Any], form: str = "pages", password: str = "") -> DataFrame:
    """All conversation files after a change, read again in a form."""
    return pdf_tables.sound(pdf_tables.parse(documents.changed(pdf_files(spark, sf_dir), change), form, password))


def texts(rows: DataFrame) -> DataFrame:
    return rows.select(doc(), "page", "text")


@query(f"{_P} select doc_id % 7 doc_id, row_number() over (partition by doc_id % 7 order by doc_id, page) - 1 page, text from p")
def file_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = pdf_files(spark, sf_dir).withColumn("id", F.col("path").cast("bigint"))
    return texts(pdf_tables.sound(pdf_tables.parse(documents.merged(files, F.col("id") % 7, "id"))))


@query(f"{_P} select doc_id * 1000 + page // 2 doc_id, page % 2 page, text from p")
def file_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = documents.split(pdf_files(spark, sf_dir), 2).withColumn("path", (F.col("path").cast("bigint") * 1000 + F.col("part")).cast("string"))
    return texts(pdf_tables.sound(pdf_tables.parse(parts)))


@query(f"{_P} select doc_id, k::bigint page, text from p, (values (0), (1)) v(k) where page = 0")
def file_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(changed(spark, sf_dir, lambda d, _: pdf_edit.extract(d, "1,1")))


@query(f"{_P} select doc_id, page - 1 page, text from p where page > 0")
def file_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(changed(spark, sf_dir, lambda d, _: pdf_edit.delete(d, "1")))


@query(f"{_P} select doc_id, case page when 0 then 1 when 1 then 0 else page end page, text from p where n > 1")
def file_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(changed(spark, sf_dir, lambda d, _: pdf_edit.reorder(d, "2,1")))


@query(f"{_P} select doc_id, page, case when page = 0 then 270 else 0 end::bigint rotation, text from p")
def file_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(spark, sf_dir, lambda d, _: pdf_edit.rotate(d, -90, "1")).select(doc(), "page", "rotation", "text")


@query(f"{_P} select doc_id, case when page = 0 then 0 else page + 2 end page, text from p union all select doc_id, k, '' from p, (values (1), (2)) v(k) where page = 0")
def file_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(changed(spark, sf_dir, lambda d, _: pdf_edit.blank(d, 1, 2)))


@query(f"{_P} select doc_id, page + case when page > 0 then 1 else 0 end page, text from p union all select doc_id, 1, text from p where page = 0")
def file_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(changed(spark, sf_dir, lambda d, _: pdf_edit.duplicate(d, "1")))


@query(f"{_P} select doc_id, page, text from p union all select doc_id, n, 'inserted page' from p where page = 0")
def file_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(changed(spark, sf_dir, lambda d, _: pdf_edit.insert(d, other(), 0)))


@query(f"{_P} select doc_id, page, case when page = 0 then 'inserted page' else text end as text from p")
def file_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(changed(spark, sf_dir, lambda d, _: pdf_edit.replace(d, other(), "1")))


@query(f"{_P} select doc_id, page, case when page = 0 then [10.0, 392.0, 300.0, 772.0]::double[] end crop, [0.0, 0.0, 612.0, 792.0]::double[] media from p")
def file_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(spark, sf_dir, lambda d, _: pdf_edit.set_box(d, "Crop", (10, 20, 300, 400), "1"), "boxes").select(doc(), "page", "crop", "media")


@query(f"{_P} select doc_id, page, [1.0, 788.0, 3.0, 790.0]::double[] trim, [0.0, 0.0, 612.0, 792.0]::double[] bleed from p")
def file_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def change(d: Draft, _: str) -> None:
        pdf_edit.set_box(d, "Trim", (1, 2, 3, 4))
        pdf_edit.set_box(d, "Bleed", (0, 0, 612, 792))

    return changed(spark, sf_dir, change, "boxes").select(doc(), "page", "trim", "bleed")


@query(f"{_P} select doc_id, page, 306.0::double width, 396.0::double height, text from p")
def file_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(spark, sf_dir, lambda d, _: pdf_edit.scale(d, 0.5)).select(doc(), "page", "width", "height", "text")


def word_lists(rows: DataFrame) -> DataFrame:
    """The words of each page in their order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda w: w.text)
    return rows.groupBy(doc(), "page").agg(F.array_join(listed, " ").alias("words"))


def _sheets(order: str) -> str:
    return f"{_P}, s as ({order}) select doc_id, page, array_to_string(flatten(list(words order by slot)), ' ') words from s group by doc_id, page having len(flatten(list(words))) > 0"


@query(_sheets("select doc_id, page // 2 page, page % 2 slot, words from p"))
def file_nup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_lists(changed(spark, sf_dir, lambda d, _: pdf_edit.nup(d, 2), "words"))


@query(_sheets("select doc_id, least(page, (n + 3) // 4 * 4 - 1 - page) page, (page + 1) % 2 slot, words from p"))
def file_booklet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_lists(changed(spark, sf_dir, lambda d, _: pdf_edit.booklet(d), "words"))


@query(f"{_P} select doc_id, page, array_to_string(list_concat(words, ['inserted', 'page']), ' ') words from p")
def file_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_lists(changed(spark, sf_dir, lambda d, _: pdf_edit.overlay(d, other()), "words"))


_STAMPED = "{p} select doc_id, page, ltrim(text || chr(10) || {line}, chr(10)) as text from p"


@query(_STAMPED.format(p=_P, line="'Page ' || (page + 1) || ' of ' || n"))
def file_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(changed(spark, sf_dir, lambda d, _: pdf_edit.stamp(d, lambda i, n: f"Page {i} of {n}", "top")))


@query(_STAMPED.format(p=_P, line="(page + 1) || '/' || n"))
def file_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(changed(spark, sf_dir, lambda d, _: pdf_edit.stamp(d, lambda i, n: f"{i}/{n}")))


@query(_STAMPED.format(p=_P, line="'- ' || (page + 5) || ' -'"))
def file_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(changed(spark, sf_dir, lambda d, _: pdf_edit.stamp(d, lambda i, _n: f"- {i + 4} -")))


@query(_STAMPED.format(p=_P, line="printf('ACME%06d', page + 1)"))
def file_bates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(changed(spark, sf_dir, lambda d, _: pdf_edit.stamp(d, lambda i, _n: f"ACME{i:06d}")))


@query(_STAMPED.format(p=_P, line="'FOR REVIEW Жук'"))
def file_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(changed(spark, sf_dir, lambda d, _: pdf_edit.watermark(d, "FOR\tREVIEW Жук", angle=0)))


@query(_STAMPED.format(p=_P, line="case when page = 0 then 'placed here' || chr(10) || 'twice' else '' end").replace("ltrim(", "trim("))
def file_place_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(changed(spark, sf_dir, lambda d, _: pdf_edit.place_text(d, 0, 72, 700, "placed here\ntwice")))


@query(f"{_P} select doc_id, page, 2::bigint width, 1::bigint height, 'DeviceRGB' space, '010203040506' pixels from p where page = 0")
def file_place_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = b"P6 2 1 255 " + bytes(range(1, 7))
    rows = changed(spark, sf_dir, lambda d, _: pdf_edit.place_image(d, 0, (10, 10, 30, 20), image), "images")
    return rows.select(doc(), "page", "width", "height", "space", F.lower(F.hex("content")).alias("pixels"))


# outline, links, information


@query(f"{_P} select doc_id, 0 as ord, 1 as level, 'Top' title, 1 page from p where page = 0 union all select doc_id, 1 + page, 2, 'Page ' || page, page + 1 from p")
def file_outline_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    def change(d: Draft, _: str) -> None:
        pdf_edit.set_outline(d, [(1, "Top", 1), *((2, f"Page {i}", i + 1) for i in range(len(d.pages)))])

    return changed(spark, sf_dir, change, "outline").select(doc(), "ord", "level", "title", "page")


@query(f"{_P} select doc_id, n page_count, 0::bigint items from p where page = 0")
def file_outline_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = documents.changed(pdf_files(spark, sf_dir), lambda d, _: pdf_edit.clear_outline(d))
    left = pdf_tables.sound(pdf_tables.parse(made, "outline")).groupBy("path").count()
    docs = pdf_tables.sound(pdf_tables.parse(made, "documents")).join(left, "path", "left")
    return docs.select(doc(), "page_count", F.coalesce("count", F.lit(0)).alias("items"))


def link(d: Draft, path: str) -> None:
    pdf_edit.add_link(d, 0, (10, 20, 110, 40), uri=f"https://example.org/{path}")
    pdf_edit.add_link(d, 0, (10, 50, 110, 70), target=len(d.pages) - 1)


@query(f"""{_P} select doc_id, 0::bigint page, 10.0::double x0, (20 + k * 30)::double y0, 110.0::double x1, (40 + k * 30)::double y1,
  case when k = 0 then 'https://example.org/' || doc_id end uri, case when k = 1 then n - 1 end target_page from p, (values (0), (1)) v(k) where page = 0""")
def file_links_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(spark, sf_dir, link, "links").select(doc(), "page", "x0", "y0", "x1", "y1", "uri", "target_page")


@query(f"{_P} select doc_id, n - 1 target_page, null::varchar uri from p where page = 0")
def file_links_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    def change(d: Draft, path: str) -> None:
        link(d, path)
        pdf_edit.remove_links(d, external=True)

    return changed(spark, sf_dir, change, "links").select(doc(), "target_page", "uri")


@query(f"{_P} select doc_id, 'Данные' title, 'Ann' author from p where page = 0")
def file_meta_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changed(spark, sf_dir, lambda d, _: pdf_edit.set_information(d, {"title": "Данные", "Author": "Ann", "Subject": "none"}), "documents")
    return rows.select(doc(), "title", F.col("info")["author"].alias("author"))


@query(f"{_P} select doc_id, n page_count, null::varchar title, 0::int entries from p where page = 0")
def file_meta_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changed(spark, sf_dir, lambda d, _: pdf_edit.strip_information(d), "documents")
    return rows.select(doc(), "page_count", "title", F.size("info").alias("entries"))


@query(f"{_P} select doc_id, 'T' title, 'de' language, false tagged, 'low' risk, 'untagged' findings from p where page = 0")
def file_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changed(spark, sf_dir, lambda d, _: pdf_edit.set_access(d, "T", "de"), "preflight")
    return rows.select(doc(), "title", "language", "tagged", "risk", F.array_join("findings", ",").alias("findings"))


# annotations and fields

_MARKS = ["Highlight", "Underline", "StrikeOut", "Squiggly"]
_SHAPES = ["Square", "Circle", "Line", "Ink", "Polygon", "PolyLine"]


def annotated(kinds: list[str]) -> Callable[[Draft, str], None]:
    def change(d: Draft, path: str) -> None:
        for i, kind in enumerate(kinds):
            points = [[10.0, 20.0 + i, 60.0, 40.0, 90.0, 30.0][: 4 if kind == "Line" else 6]] if kind in ("Line", "Ink", "Polygon", "PolyLine", "FreeText") else None
            pdf_edit.annotate(d, 0, kind, (10, 20 + i, 110, 40 + i), f"note {path}", "Ann", points=points)

    return change


def _noted(kinds: list[str]) -> str:
    rows = ", ".join(f"({i}, '{k}')" for i, k in enumerate(kinds))
    return f"{_P} select doc_id, 0::bigint page, i::bigint as ord, k subtype, 'note ' || doc_id contents, 'Ann' author, 10.0::double x0, (20 + i)::double y0, 110.0::double x1, (40 + i)::double y1, false flat from p, (values {rows}) v(i, k) where page = 0"


def listed(spark: SparkSession, sf_dir: str, kinds: list[str]) -> DataFrame:
    rows = changed(spark, sf_dir, annotated(kinds), "annotations")
    return rows.select(doc(), "page", "ord", "subtype", "contents", "author", "x0", "y0", "x1", "y1", "flat")


@query(_noted(_MARKS))
def file_annotate_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir, _MARKS)


@query(_noted(_SHAPES))
def file_annotate_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir, _SHAPES)


@query(_noted(["Text", "FreeText", "Stamp"]))
def file_annotate_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir, ["Text", "FreeText", "Stamp"])


@query(f"{_P} select doc_id, k subtype from p, (values ('Text'), ('Stamp')) v(k) where page = 0")
def file_annotate_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    def change(d: Draft, path: str) -> None:
        annotated(["Text", "Square", "Stamp"])(d, path)
        pdf_edit.delete_annotations(d, "square")

    return changed(spark, sf_dir, change, "annotations").select(doc(), "subtype")


@query(f"{_P} select doc_id, page, array_to_string(case when page = 0 then list_concat(words, ['note', doc_id::varchar]) else words end, ' ') words from p")
def file_annotations_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    def change(d: Draft, path: str) -> None:
        annotated(["FreeText", "Square", "Text"])(d, path)
        pdf_edit.flatten_annotations(d)
        if any(pdf_edit.annotations(d, d.page(i)) for i in range(len(d.pages))):
            raise ValueError("an annotation is left")

    return word_lists(changed(spark, sf_dir, change, "words"))


def form(d: Draft, path: str) -> None:
    pdf_edit.add_field(d, 0, (10, 20, 110, 40), "name", value=f"value {path}")
    pdf_edit.add_field(d, 0, (10, 50, 30, 70), "agreed", "checkbox", "Yes")


def _fields(name: str, agreed: str) -> str:
    return f"{_P} select doc_id, k::bigint as ord, case k when 0 then 'name' else 'agreed' end qualified, case k when 0 then 'text' else 'button' end as type, case k when 0 then {name} else '{agreed}' end as value, 0::bigint page from p, (values (0), (1)) v(k) where page = 0"


def widgets(rows: DataFrame) -> DataFrame:
    return rows.select(doc(), "ord", "qualified", "type", "value", "page")


@query(_fields("'value ' || doc_id", "Yes"))
def file_fields_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widgets(changed(spark, sf_dir, form, "widgets"))


@query(_fields("'<é> Ж'", "Off"))
def file_form_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    def change(d: Draft, path: str) -> None:
        form(d, path)
        pdf_edit.fill(d, {"name": "<é> Ж", "agreed": "Off"})

    return widgets(changed(spark, sf_dir, change, "widgets"))


@query(_fields("'x & ' || doc_id", "Off"))
def file_form_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    def change(d: Draft, path: str) -> None:
        form(d, path)
        xfdf = f'<xfdf xmlns="http://ns.adobe.com/xfdf/"><fields><field name="name"><value>x &amp; {path}</value></field></fields></xfdf>'
        pdf_edit.fill(d, pdf_edit.field_values(xfdf) | pdf_edit.field_values('{"agreed": false}'))

    return widgets(changed(spark, sf_dir, change, "widgets"))


@query(f"{_P} select doc_id, page, array_to_string(case when page = 0 then list_concat(words, ['value', doc_id::varchar]) else words end, ' ') words from p")
def file_form_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    def change(d: Draft, path: str) -> None:
        form(d, path)
        pdf_edit.flatten_fields(d)

    return word_lists(changed(spark, sf_dir, change, "words"))


# text in content

_KEPT = "{p}, w as (select doc_id, page, {list} as l from p) select doc_id, page, array_to_string(l, ' ') words from w where len(l) > 0"


@query(_KEPT.format(p=_P, list="list_filter(words, lambda x: x <> 'the')"))
def file_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = re.compile(r"(?<!\S)the(?!\S)")
    return word_lists(changed(spark, sf_dir, lambda d, _: pdf_edit.rewrite_text(d, pattern), "words"))


@query(_KEPT.format(p=_P, list="list_transform(words, lambda x: case when x = 'the' then 'THE' else x end)"))
def file_edit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = re.compile(r"(?<!\S)the(?!\S)")
    return word_lists(changed(spark, sf_dir, lambda d, _: pdf_edit.rewrite_text(d, pattern, lambda m: m[0].upper()), "words"))


# protection and size


def encrypted(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    return documents.changed(pdf_files(spark, sf_dir), lambda d, _: d.save(user="u", owner="o", allow=("print", "copy"), method=method))


@query(f"{_P} select doc_id, page, text from p")
def file_encrypt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(pdf_tables.sound(pdf_tables.parse(encrypted(spark, sf_dir, "aes128"), password="u")))


@query(f"{_P} select doc_id, page, text from p")
def file_decrypt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(pdf_tables.sound(pdf_tables.parse(documents.changed(encrypted(spark, sf_dir, "rc4"), lambda d, _: None, password="o"))))


@query(f"{_P} select doc_id, true encrypted, 'copy,print' allowed, doc_id::varchar title from p where page = 0")
def file_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pdf_tables.sound(pdf_tables.parse(encrypted(spark, sf_dir, "rc4"), "documents", "o"))
    return rows.select(doc(), "encrypted", F.array_join(F.array_sort(F.map_keys(F.map_filter("permissions", lambda _, v: v))), ",").alias("allowed"), "title")


@query(f"{_P} select doc_id, 'ValueError: the file is encrypted and the password does not open it' error from p where page = 0")
def file_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf_tables.parse(encrypted(spark, sf_dir, "rc4"), "words").select(doc(), "error")


def active(d: Draft, path: str) -> None:
    d.catalog["OpenAction"] = {"S": Name("JavaScript"), "JS": "app.alert(1)"}
    pdf_edit.attach(d, "notes.txt", path.encode())


@query(f"{_P} select doc_id, 1::bigint javascript_actions, 1::bigint attachments, 'high' risk, 'active_content,attachments,untagged,missing_language' findings from p where page = 0")
def pdf_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changed(spark, sf_dir, active, "preflight")
    return rows.select(doc(), "javascript_actions", "attachments", "risk", F.array_join("findings", ",").alias("findings"))


@query(f"{_P} select doc_id, 0::bigint javascript_actions, 0::bigint attachments, 'low' risk, n pages from p where page = 0")
def file_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    def change(d: Draft, path: str) -> None:
        active(d, path)
        pdf_edit.sanitize(d)

    return changed(spark, sf_dir, change, "preflight").select(doc(), "javascript_actions", "attachments", "risk", "pages")


def padded(d: Draft, _: str) -> bytes:
    d.draw(d.page(0), b"")
    d.page(0)["Contents"] = [*d.contents(d.page(0)), d.add(pdf_edit.Stream({}, b"% padding\n" * 500))]
    return d.save()


@query(f"{_P} select doc_id, page, text, true smaller from p")
def file_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = documents.changed(pdf_files(spark, sf_dir), padded)
    small = documents.changed(large, lambda d, _: pdf_edit.compress(d))
    sizes = large.select("path", F.length("content").alias("before")).join(small.select("path", F.length("content").alias("after")), "path")
    rows = pdf_tables.sound(pdf_tables.parse(small)).join(sizes, "path")
    return rows.select(doc(), "page", "text", (F.col("after") < F.col("before") - 4000).alias("smaller"))


@query(f"{_P} select doc_id, page, text from p")
def file_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = pdf_files(spark, sf_dir).withColumn("content", F.expr("substring(content, 1, length(content) - 60)"))
    return texts(pdf_tables.sound(pdf_tables.parse(documents.changed(damaged, lambda d, _: None))))


@query(f"{_P} select doc_id, k::bigint as ord, case k when 0 then 'a.txt' else 'notes.txt' end as name, case k when 0 then 'é' else doc_id::varchar end as content from p, (values (0), (1)) v(k) where page = 0")
def file_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    def change(d: Draft, path: str) -> None:
        pdf_edit.attach(d, "notes.txt", path.encode())
        pdf_edit.attach(d, "a.txt", "é".encode())

    return changed(spark, sf_dir, change, "attachments").select(doc(), "ord", "name", F.col("content").cast("string").alias("content"))


@query(f"{_P} select doc_id, 'a.txt' as name from p where page = 0")
def file_detach(spark: SparkSession, sf_dir: str) -> DataFrame:
    def change(d: Draft, path: str) -> None:
        pdf_edit.attach(d, "notes.txt", path.encode())
        pdf_edit.attach(d, "a.txt", b"1")
        pdf_edit.detach(d, ["notes.txt", "none.txt"])

    return changed(spark, sf_dir, change, "attachments").select(doc(), "name")


# conversion


@query("select r_regionkey::bigint doc_id, (r_regionkey + 1)::double width, length(r_name)::double height, 'DeviceGray' space from region")
def file_from_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.concat_ws(" ", F.col("r_regionkey") + 1, F.length("r_name"))
    files = documents.written_from(table(spark, sf_dir, "region"), F.col("r_regionkey"), size, lambda s: convert.from_images([f"P5 {s} 255 ".encode() + bytes(int(s.split()[0]) * int(s.split()[1]))]))
    pages = pdf_tables.sound(pdf_tables.parse(files)).select("path", "width", "height")
    return pages.join(pdf_tables.sound(pdf_tables.parse(files, "images")).select("path", "space"), "path").select(doc(), "width", "height", "space")


@query("select n_nationkey::bigint doc_id, n_name || chr(10) || 'region ' || n_regionkey || ' Ω' as text from nation")
def file_from_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("# "), F.col("n_name"), F.lit("\n\n**region** "), F.col("n_regionkey"), F.lit(" Ω\n"))
    files = documents.written_from(table(spark, sf_dir, "nation"), F.col("n_nationkey"), said, convert.from_markdown)
    rows = pdf_tables.sound(pdf_tables.parse(files))
    return rows.select(doc(), F.regexp_replace("text", "\n+", "\n").alias("text"))


@query("select page_id doc_id, true same from pages")
def file_from_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.sources.html import plain_text

    p = table(spark, sf_dir, "pages")
    files = documents.written_from(p, F.col("page_id"), F.col("html"), lambda h: convert.from_html(h or ""))
    words = F.udf(lambda h: " ".join(plain_text(h or "").split()), "string")
    flat = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x.text)
    made = pdf_tables.sound(pdf_tables.parse(files)).groupBy(F.col("path").cast("bigint").alias("doc_id")).agg(F.array_join(flat, " ").alias("text"))
    both = made.join(p.select(F.col("page_id").alias("doc_id"), words("html").alias("want")), "doc_id")
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return both.select("doc_id", (squeezed("text") == squeezed("want")).alias("same"))


@query(f"{_P} select doc_id, sum(len(string_split(coalesce(c.text, ''), chr(10))))::bigint + max(n) - 1 paragraphs, max(n) pages from p join conversations c on c.conv_id = doc_id and c.turn = page group by doc_id")
def convert_docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.unpacked(sinks.rendered(conversation_pages(spark, sf_dir).select("doc_id", "page", "text"), "docx"), "word/document.xml").select(
        doc(), F.regexp_count("xml", F.lit("<w:p>")).cast("bigint").alias("paragraphs"), (F.regexp_count("xml", F.lit("<w:br ")) + 1).cast("bigint").alias("pages")
    )


@query("select n_regionkey::bigint doc_id, count(*) * 2 cells, string_agg(n_name, '|' order by n_nationkey) as names from nation group by 1")
def convert_xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    files = documents.written_from(n, F.col("n_regionkey"), F.col("rows"), lambda rows: sinks.xlsx({"nations": [[str(r["n_nationkey"]), r["n_name"]] for r in rows]}))
    xml = sinks.unpacked(files, "xl/worksheets/sheet1.xml")
    cells = F.regexp_extract_all("xml", F.lit('<t xml:space="preserve">([^<]*)</t>'))
    named = F.filter(cells, lambda c, i: i % 2 == 1)
    return xml.select(doc(), F.size(cells).cast("bigint").alias("cells"), F.array_join(named, "|").alias("names"))


# forms of the reader


@query(f"{_P} select doc_id, 'Helvetica' as name, 'Type1' subtype from p where page = 0")
def pdf_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf_tables.sound(pdf_tables.parse(pdf_files(spark, sf_dir), "fonts")).select(doc(), "name", "subtype")


@query(f"{_P} select doc_id, page, 612.0::double width, 792.0::double height, 0::bigint rotation, len(words)::bigint words, 0::bigint images, 0::bigint links, 0::bigint annotations, 0::bigint fields, 'p' || (page + 3) as label from p")
def pdf_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    def change(d: Draft, _: str) -> None:
        d.catalog["PageLabels"] = {"Nums": [0, {"S": Name("D"), "P": "p", "St": 3}]}

    rows = changed(spark, sf_dir, change)
    words = F.size(F.filter(F.split("text", r"[ \n]"), lambda w: w != "")).cast("bigint")
    return rows.select(doc(), "page", "width", "height", "rotation", words.alias("words"), "images", "links", "annotations", "fields", "label")


@query(f"""{_P} select doc_id, false encrypted, 8 permissions, 2::bigint field_count, false xfa, 0::bigint layer_count, bool_or(len(words) > 0) has_text, 612.0::double width, 792.0::double height
  from p group by doc_id""")
def pdf_info_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changed(spark, sf_dir, lambda d, path: form(d, path), "documents")
    allowed = F.size(F.map_filter("permissions", lambda _, v: v))
    size = F.col("page_sizes")[0]
    text = pdf_tables.sound(pdf_tables.parse(pdf_files(spark, sf_dir), "documents")).select("path", "has_text")
    rows = rows.drop("has_text").join(text, "path")
    return rows.select(doc(), "encrypted", allowed.alias("permissions"), "field_count", "xfa", "layer_count", "has_text", size["width"].alias("width"), size["height"].alias("height"))


@query(f"{_P} select doc_id, 1::bigint as ord, 1::bigint as level, 'P' role, 'alt ' || doc_id alt from p where page = 0 union all select doc_id, 0, 1, 'Document', null from p where page = 0")
def pdf_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    def change(d: Draft, path: str) -> None:
        d.catalog["StructTreeRoot"] = {"Type": Name("StructTreeRoot"), "RoleMap": {"Para": Name("P")}, "K": [{"S": Name("Document")}, {"S": Name("Para"), "Alt": f"alt {path}"}]}

    return changed(spark, sf_dir, change, "tags").select(doc(), "ord", "level", "role", "alt")


@query(f"{_P} select doc_id, '<</Type /Pages /Count ' || n || ' /' as body from p where page = 0")
def pdf_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pdf_tables.sound(pdf_tables.parse(pdf_files(spark, sf_dir), "objects")).where("num = 2")
    return rows.select(doc(), F.regexp_extract("body", "^[^K]*", 0).alias("body"))


def grid_file(rows: list) -> bytes:
    """A page with a ruled table: a row each, its cells' texts inside."""
    d = Draft(text_pdf([""]))
    page, n = d.page(0), len(rows)
    lines = [b"%g %g m %g %g l S" % (72, 692 - 30 * i, 432, 692 - 30 * i) for i in range(n + 1)]
    lines += [b"%g %g m %g %g l S" % (72 + 120 * i, 692, 72 + 120 * i, 692 - 30 * n) for i in range(3)]
    d.draw(page, b"\n".join([*lines, b"431 %d 2 %d re f" % (692 - 30 * n, 30 * n)]))
    for i, r in enumerate(rows):
        for j, cell in enumerate((str(r["n_nationkey"]), r["n_name"], str(len(r["n_name"])))):
            pdf_edit.place_text(d, 0, 80 + 120 * j, 120 + 30 * i, cell, 8)
    return d.save()


@query("""with r as (select *, row_number() over (partition by n_regionkey order by n_nationkey) - 1 r from nation)
  select n_regionkey::bigint doc_id, 0::bigint page, 1::bigint as "table", r as "row", c.c::bigint col,
  case c.c when 0 then n_nationkey::varchar when 1 then n_name else length(n_name)::varchar end as text from r, (values (0), (1), (2)) c(c)""")
def pdf_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    files = documents.written_from(n, F.col("n_regionkey"), F.col("rows"), grid_file)
    read = lambda name: pdf_tables.sound(pdf_tables.parse(files, name)).withColumn("doc_id", F.col("path").cast("bigint")).drop("path")
    return layout.table_cells(read("edges"), read("words"))


@query("""select page_id, case when page_id % 5 = 0 then 'missing' when page_id % 7 = 0 then 'changed' when page_id % 11 = 0 then 'extra' else 'ready' end status from pages""")
def setup_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    k = F.col("page_id")
    expected = p.where((k % 11 != 0) | (k % 5 == 0) | (k % 7 == 0))
    found = p.where(k % 5 != 0).withColumn("digest", F.when(k % 7 == 0, F.sha2("digest", 256)).otherwise(F.col("digest")))
    return ledger.status(expected, found, "page_id", "digest")
