"""Writers: a document's rows as PDF, workbook, text document or HTML bytes, one binary cell a document."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.pdf_write import text_pdf

CELL_LIMIT = 32_767  # fixed value: characters that a workbook's cell holds
_STAMP = (1980, 1, 1, 0, 0, 0)


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, _STAMP), text)
    return out.getvalue()


def _package(parts: dict[str, tuple[str, str]], main: str) -> dict[str, str]:
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    types = "".join(f'<Override PartName="/{n}" ContentType="{t}"/>' for n, (t, _) in parts.items())
    base = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
    return {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">{base}{types}</Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{kind}" Target="{main}"/></Relationships>',
    } | {n: head + x for n, (_, x) in parts.items()}


def column_name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, k = divmod(i - 1, 26)
        out = chr(65 + k) + out
    return out


def xlsx(sheets: dict[str, list[list[str | None]]]) -> bytes:
    """A workbook with a sheet of texts for each grid; texts are cut at the cell limit (``cut_cells`` tells how many), control characters refused."""
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    space = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {}
    for n, grid in enumerate(sheets.values(), 1):
        rows = []
        for i, row in enumerate(grid, 1):
            for c in row:
                if c and any(ord(x) < 32 and x not in "\t\n\r" for x in c):
                    raise ValueError("a cell holds a control character")
            cells = "".join(f'<c r="{column_name(j)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(c[:CELL_LIMIT])}</t></is></c>' for j, c in enumerate(row) if c is not None)
            rows.append(f'<row r="{i}">{cells}</row>')
        parts[f"xl/worksheets/sheet{n}.xml"] = (kind + "worksheet+xml", f'<worksheet xmlns="{space}"><sheetData>{"".join(rows)}</sheetData></worksheet>')
    listed = "".join(f'<sheet name="{escape(name)}" sheetId="{n}" r:id="s{n}"/>' for n, name in enumerate(sheet_names(list(sheets)), 1))
    parts["xl/workbook.xml"] = (kind + "sheet.main+xml", f'<workbook xmlns="{space}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
    links = "".join(f'<Relationship Id="s{n}" Type="{rel}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
    files = _package(parts, "xl/workbook.xml")
    files["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>'
    return _zip(files)


def cut_cells(grid: list[list[str | None]]) -> int:
    """How many cells of a grid a workbook would cut."""
    return sum(len(c or "") > CELL_LIMIT for row in grid for c in row)


def sheet_names(names: list[str]) -> list[str]:
    """Names of at most 31 characters that all differ."""
    out: list[str] = []
    for name in names:
        new, n = name[:31], 1
        while new.lower() in {x.lower() for x in out}:
            n += 1
            new = f"{name[: 30 - len(str(n))]}~{n}"
        out.append(new)
    return out


def unpacked(files: DataFrame, member: str) -> DataFrame:
    """(path, xml): one part of each package as text."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            texts = [zipfile.ZipFile(io.BytesIO(c)).read(member).decode() for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "xml": texts})

    return files.where("content is not null").select("path", "content").mapInPandas(run, "path string, xml string")


def docx(pages: list[str]) -> bytes:
    """A text document: a paragraph a line, pages on pages of their own."""
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    paragraph = lambda t: f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>'
    body = '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'.join("".join(map(paragraph, p.split("\n"))) for p in pages)
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    return _zip(_package({"word/document.xml": (kind, f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')}, "word/document.xml"))


def html_page(pages: list[str], title: str) -> bytes:
    """Pages as preformatted blocks between rules."""
    body = "<hr/>".join(f"<pre>{escape(p)}</pre>" for p in pages)
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body>{body}</body></html>'.encode()


WRITERS = {"pdf": lambda pages, name: text_pdf(pages, title=name, outline=True), "docx": lambda pages, _: docx(pages), "html": html_page}


def rendered(pages: DataFrame, form: str, doc_col: str = "doc_id") -> DataFrame:
    """(path, content): each document's pages (page, text) written in a form, named by its id."""
    write = WRITERS[form]
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: F.coalesce(p.text, F.lit("")))
    rows = pages.groupBy(F.col(doc_col).cast("string").alias("path")).agg(texts.alias("pages"))

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "content": [write(list(p), k) for k, p in zip(batch["path"], batch["pages"], strict=True)]})

    return rows.mapInPandas(run, "path string, content binary")
