"""PDF files as DataFrames, on any file system that Spark reads, and as a data source named ``pdf``.

Files come in through ``binaryFile``; each is parsed by the task that holds it, once for each derived form, and only
the form asked for is computed. A file that cannot be read gives one row of the ``documents`` form with its
error and none of the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.sources.pdf import Document, Name, Ref, Stream, page_edges, page_words
from quire.sources.pdf_crypt import ALLOW
from quire.sources.pdf_write import spelled

SCHEMAS = {
    "documents": "path string, size_bytes bigint, page_count bigint, encrypted boolean, repaired boolean, title string, info map<string,string>, permissions map<string,boolean>, field_count bigint, xfa boolean, layer_count bigint, has_text boolean, page_sizes array<struct<width:double,height:double>>",
    "pages": "path string, page bigint, width double, height double, rotation bigint, text string, images bigint, links bigint, label string, annotations bigint, fields bigint",
    "words": "path string, page bigint, seq bigint, block bigint, line bigint, text string, x0 double, y0 double, x1 double, y1 double",
    "edges": "path string, page bigint, orient string, x0 double, top double, x1 double, bottom double",
    "objects": "path string, num bigint, kind string, type string, keys array<string>, refs array<bigint>, body string",
    "outline": "path string, ord bigint, level bigint, title string, page bigint",
    "links": "path string, page bigint, ord bigint, x0 double, y0 double, x1 double, y1 double, uri string, target_page bigint",
    "annotations": "path string, page bigint, ord bigint, subtype string, contents string, author string, x0 double, y0 double, x1 double, y1 double, flat boolean",
    "widgets": "path string, ord bigint, qualified string, local string, type string, value string, page bigint",
    "fonts": "path string, num bigint, name string, subtype string",
    "images": "path string, page bigint, num bigint, width bigint, height bigint, space string, filter string, content binary",
    "attachments": "path string, ord bigint, name string, size_bytes bigint, content binary",
    "boxes": "path string, page bigint, media array<double>, crop array<double>, trim array<double>, bleed array<double>",
    "tags": "path string, ord bigint, level bigint, kind string, role string, alt string",
    "signatures": "path string, ord bigint, field string, filter string, sub_filter string, byte_range array<bigint>, covers_all boolean",
    "preflight": "path string, pages bigint, annotations bigint, form_fields bigint, signatures bigint, external_links bigint, unsafe_links bigint, attachments bigint, javascript_actions bigint, launch_actions bigint, xfa boolean, tagged boolean, title string, language string, empty_pages array<bigint>, risk string, findings array<string>",
}
# Schemes that links may have.
SAFE_SCHEMES = ("http", "https", "mailto")
BODY_BYTES = 4096  # of an object's own text in the ``objects`` form; a stream's bytes are not part of it
HELD_ROWS = 20_000


def _documents(path: str, doc: Document, size: int) -> list[tuple]:
    pages = doc.page_list()
    if doc.locked:
        return [(path, size, len(pages), True, doc.repaired, None, {}, {}, 0, False, 0, False, [])]
    info, form = doc.info(), doc.get(doc.root().get("AcroForm"))
    layers = doc.get(doc.root().get("OCProperties"))
    boxes = {tuple(round(v, 1) for v in (x1 - x0, y1 - y0)) for _, page in pages for x0, y0, x1, y1 in [doc.box(page)]}
    sizes = [{"width": w, "height": h} for w, h in sorted(boxes)]
    return [
        (path, size, len(pages), doc.encrypted, doc.repaired, info.get("title"), info, _permissions(doc), len(_widgets(path, doc, size)), isinstance(form, dict) and "XFA" in form)
        + (len(doc.get(layers.get("OCGs")) or []) if isinstance(layers, dict) else 0, any(page_words(doc, page) for _, page in pages), sizes)
    ]


def _permissions(doc: Document) -> dict[str, bool]:
    if not doc.encrypted:
        return dict.fromkeys(ALLOW, True)
    flags = int(doc.get(doc.get(doc.trailer["Encrypt"]).get("P")) or 0)
    return {k: bool(flags & bit) for k, bit in ALLOW.items()}


def _annots(doc: Document, page: dict) -> Iterator[dict]:
    for a in doc.get(page.get("Annots")) or []:
        if isinstance(d := doc.get(a), dict):
            yield d


def _pages(path: str, doc: Document, size: int) -> list[tuple]:
    rows, labels = [], doc.labels()
    for i, (_, page) in enumerate(doc.page_list()):
        x0, y0, x1, y1 = doc.box(page)
        lines = page_words(doc, page)
        resources = doc.get(page.get("Resources")) or {}
        images = [x for x in (doc.get(resources.get("XObject")) or {}).values() if isinstance(s := doc.get(x), Stream) and s.dict.get("Subtype") == "Image"]
        kinds = [a.get("Subtype") for a in _annots(doc, page)]
        other = sum(k not in ("Link", "Widget", "Popup") for k in kinds)
        rows.append((path, i, x1 - x0, y1 - y0, int(doc.get(page.get("Rotate")) or 0), "\n".join(" ".join(w.text for w in ln) for ln in lines), len(images), kinds.count("Link"), labels[i], other, kinds.count("Widget")))
    return rows


def _words(path: str, doc: Document, size: int) -> list[tuple]:
    rows = []
    for i, (_, page) in enumerate(doc.page_list()):
        seq = 0
        for n, line in enumerate(page_words(doc, page)):
            for w in line:
                rows.append((path, i, seq, 0, n, *w))
                seq += 1
    return rows


def _edges(path: str, doc: Document, size: int) -> list[tuple]:
    return [(path, i, *e) for i, (_, page) in enumerate(doc.page_list()) for e in page_edges(doc, page)]


def _references(value: object, depth: int = 0) -> Iterator[int]:
    if isinstance(value, Ref):
        yield value.num
    elif isinstance(value, Stream):
        yield from _references(value.dict, depth + 1)
    elif isinstance(value, dict | list) and depth < 64:
        for v in value.values() if isinstance(value, dict) else value:
            yield from _references(v, depth + 1)


def _objects(path: str, doc: Document, size: int) -> list[tuple]:
    rows = []
    for num in sorted({n for n, p in doc.places.items() if p} | set(doc.inside)):
        value = doc.get(Ref(num, 0))
        d = value.dict if isinstance(value, Stream) else value if isinstance(value, dict) else {}
        kind = {Stream: "stream", dict: "dict", list: "array", bytes: "string", Name: "name", bool: "bool", int: "integer", float: "real"}.get(type(value), "null")
        rows.append((path, num, kind, str(d["Type"]) if isinstance(d.get("Type"), Name) else None, list(d), list(_references(value)), spelled(d if isinstance(value, Stream) else value)[:BODY_BYTES].decode("latin-1")))
    return rows


def _outline(path: str, doc: Document, size: int) -> list[tuple]:
    index = {ref: i for i, (ref, _) in enumerate(doc.page_list()) if ref}
    names, rows, seen = doc.destinations(), [], set()

    def walk(item: object, level: int) -> None:
        while isinstance(item, Ref) and item not in seen and level <= 64:
            seen.add(item)
            d = doc.get(item)
            if not isinstance(d, dict):
                return
            action = doc.get(d.get("A"))
            target = d.get("Dest") or (action.get("D") if isinstance(action, dict) else None)
            page = doc.destination(target, index, names)
            rows.append((path, len(rows), level, doc.text(d.get("Title")), -1 if page is None else page + 1))
            walk(d.get("First"), level + 1)
            item = d.get("Next")

    top = doc.get(doc.root().get("Outlines"))
    walk(top.get("First") if isinstance(top, dict) else None, 1)
    return rows


def _links(path: str, doc: Document, size: int) -> list[tuple]:
    pages = doc.page_list()
    index, names, rows = {ref: i for i, (ref, _) in enumerate(pages) if ref}, doc.destinations(), []
    for i, (_, page) in enumerate(pages):
        left, _, _, top = doc.box(page)
        for n, a in enumerate(x for x in _annots(doc, page) if x.get("Subtype") == "Link"):
            action = doc.get(a.get("A"))
            action = action if isinstance(action, dict) else {}
            r = [float(doc.get(v)) for v in doc.get(a.get("Rect")) or [0, 0, 0, 0]]
            target = doc.destination(a.get("Dest") or action.get("D"), index, names)
            rows.append((path, i, n, min(r[0], r[2]) - left, top - max(r[1], r[3]), max(r[0], r[2]) - left, top - min(r[1], r[3]), doc.text(action.get("URI")) or None, None if target is None else target))
    return rows


def _place(doc: Document, page: dict, value: object) -> tuple[float, float, float, float]:
    """A rectangle from the top left corner of the page's box."""
    left, _, _, top = doc.box(page)
    r = [float(doc.get(v) or 0) for v in doc.get(value) or [0, 0, 0, 0]]
    return min(r[0], r[2]) - left, top - max(r[1], r[3]), max(r[0], r[2]) - left, top - min(r[1], r[3])


def _annotations(path: str, doc: Document, size: int) -> list[tuple]:
    rows = []
    for i, (_, page) in enumerate(doc.page_list()):
        for n, a in enumerate(_annots(doc, page)):
            look = doc.get(a.get("AP"))
            rows.append((path, i, n, str(a.get("Subtype") or ""), doc.text(a.get("Contents")), doc.text(a.get("T")), *_place(doc, page, a.get("Rect")), not isinstance(look, dict)))
    return rows


def _widgets(path: str, doc: Document, size: int) -> list[tuple]:
    rows: list[tuple] = []
    at = {id(a): i for i, (_, page) in enumerate(doc.page_list()) for a in _annots(doc, page)}
    kinds = {"Tx": "text", "Btn": "button", "Ch": "choice", "Sig": "signature"}

    def walk(field: object, above: str, given: dict, depth: int) -> None:
        d = doc.get(field)
        if not isinstance(d, dict) or depth > 128:
            return
        local = doc.text(d.get("T"))
        own = given | {k: d[k] for k in ("FT", "V") if k in d}
        full = ".".join(x for x in (above, local) if x)
        kids = [k for k in doc.get(d.get("Kids")) or [] if isinstance(c := doc.get(k), dict) and "T" in c]
        for kid in kids:
            walk(kid, full, own, depth + 1)
        if not kids:
            shown = [d, *(doc.get(k) for k in doc.get(d.get("Kids")) or [])]
            rows.append((path, len(rows), full, local, kinds.get(str(doc.get(own.get("FT"))), "other"), doc.text(own.get("V")), next((at[id(x)] for x in shown if id(x) in at), None)))

    form = doc.get(doc.root().get("AcroForm"))
    for field in (doc.get(form.get("Fields")) or []) if isinstance(form, dict) else []:
        walk(field, "", {}, 0)
    return rows


def _fonts(path: str, doc: Document, size: int) -> list[tuple]:
    found: dict[int, tuple] = {}
    for _, page in doc.page_list():
        resources = doc.get(page.get("Resources")) or {}
        for ref in (doc.get(resources.get("Font")) or {}).values():
            d = doc.get(ref)
            if isinstance(ref, Ref) and isinstance(d, dict):
                found[ref.num] = (path, ref.num, doc.text(d.get("BaseFont")), doc.text(d.get("Subtype")))
    return list(found.values())


def _attachments(path: str, doc: Document, size: int) -> list[tuple]:
    tree = doc.get(doc.root().get("Names"))
    rows = []
    for name, spec in doc.named(tree.get("EmbeddedFiles")) if isinstance(tree, dict) else ():
        d = doc.get(spec)
        files = doc.get(d.get("EF")) if isinstance(d, dict) else None
        body = doc.get(files.get("F")) if isinstance(files, dict) else None
        label = doc.text(d.get("UF")) or doc.text(d.get("F")) if isinstance(d, dict) else ""
        content = doc.decoded(body) if isinstance(body, Stream) else b""
        rows.append((path, len(rows), label or name, len(content), content))
    return rows


def _images(path: str, doc: Document, size: int) -> list[tuple]:
    rows: dict[int, tuple] = {}
    for i, (_, page) in enumerate(doc.page_list()):
        resources = doc.get(page.get("Resources")) or {}
        for ref in (doc.get(resources.get("XObject")) or {}).values():
            s = doc.get(ref)
            if isinstance(ref, Ref) and isinstance(s, Stream) and s.dict.get("Subtype") == "Image" and ref.num not in rows:
                space, filters = doc.get(s.dict.get("ColorSpace")), doc.get(s.dict.get("Filter"))
                space = doc.get(space[0]) if isinstance(space, list) and space else space
                last = doc.get(filters[-1]) if isinstance(filters, list) and filters else filters
                rows[ref.num] = (path, i, ref.num, int(doc.get(s.dict.get("Width")) or 0), int(doc.get(s.dict.get("Height")) or 0), str(space or ""), str(last or ""), doc.decoded(s))
    return list(rows.values())


def _boxes(path: str, doc: Document, size: int) -> list[tuple]:
    box = lambda page, k: [float(doc.get(v)) for v in doc.get(page[k])] if k in page else None
    return [(path, i, *(box(page, k) for k in ("MediaBox", "CropBox", "TrimBox", "BleedBox"))) for i, (_, page) in enumerate(doc.page_list())]


def _tags(path: str, doc: Document, size: int) -> list[tuple]:
    top = doc.get(doc.root().get("StructTreeRoot"))
    roles = doc.get(top.get("RoleMap")) if isinstance(top, dict) else None
    rows: list[tuple] = []
    todo = [(k, 1) for k in _kids(doc, top)] if isinstance(top, dict) else []
    seen: set[int] = set()
    while todo:
        d, level = todo.pop(0)
        if id(d) in seen or level > 256:
            continue
        seen.add(id(d))
        kind = str(doc.get(d.get("S")) or "")
        role = doc.get((roles or {}).get(kind)) if isinstance(roles, dict) else None
        rows.append((path, len(rows), level, kind, str(role or kind), doc.text(d.get("Alt")) or None))
        todo[:0] = [(k, level + 1) for k in _kids(doc, d)]
    return rows


def _kids(doc: Document, node: dict) -> list[dict]:
    kids = doc.get(node.get("K"))
    return [d for k in (kids if isinstance(kids, list) else [kids]) if isinstance(d := doc.get(k), dict) and "S" in d]


def _signatures(path: str, doc: Document, size: int) -> list[tuple]:
    rows = []
    for value in _dicts(doc):
        if value.get("FT") == "Sig" or (value.get("Type") == "Annot" and doc.get(value.get("FT")) == "Sig"):
            v = doc.get(value.get("V"))
            if isinstance(v, dict):
                r = [int(doc.get(x)) for x in doc.get(v.get("ByteRange")) or []]
                whole = len(r) == 4 and r[0] == 0 and r[1] <= r[2] and r[2] + r[3] == size
                rows.append((path, len(rows), doc.text(value.get("T")), str(doc.get(v.get("Filter")) or ""), str(doc.get(v.get("SubFilter")) or ""), r, whole))
    return rows


def _dicts(doc: Document) -> Iterator[dict]:
    """Every dictionary of the file, in objects and within them."""
    for num in sorted({n for n, p in doc.places.items() if p} | set(doc.inside)):
        todo = [doc.get(Ref(num, 0))]
        while todo:
            v = todo.pop()
            if isinstance(v, Stream):
                v = v.dict
            if isinstance(v, dict):
                yield v
                todo.extend(v.values())
            elif isinstance(v, list):
                todo.extend(v)


def _preflight(path: str, doc: Document, size: int) -> list[tuple]:
    pages, root = doc.page_list(), doc.root()
    kinds = [a.get("Subtype") for _, page in pages for a in _annots(doc, page)]
    schemes = [uri.split(":")[0].lower() if ":" in uri else "" for *_, uri, _ in _links(path, doc, size) if uri]
    unsafe = sum(s not in SAFE_SCHEMES for s in schemes)
    files = len(_attachments(path, doc, size)) + kinds.count("FileAttachment")
    script = launch = 0
    for d in _dicts(doc):
        action = doc.get(d.get("S"))
        script += action == "JavaScript"
        launch += action == "Launch"
    active = script + launch + ("OpenAction" in root and isinstance(doc.get(root["OpenAction"]), dict))
    form = doc.get(root.get("AcroForm"))
    xfa, tagged = isinstance(form, dict) and "XFA" in form, bool(_tags(path, doc, size))
    title, language = doc.info().get("title") or "", doc.text(root.get("Lang"))
    empty = []
    for i, (_, page) in enumerate(pages):
        resources = doc.get(page.get("Resources")) or {}
        images = [x for x in (doc.get(resources.get("XObject")) or {}).values() if isinstance(s := doc.get(x), Stream) and s.dict.get("Subtype") == "Image"]
        if not doc.get(resources.get("Font")) and not images:
            empty.append(i + 1)
    checks = {"active_content": active, "unsafe_links": unsafe, "attachments": files, "xfa": xfa, "untagged": not tagged, "missing_title": not title, "missing_language": not language, "empty_pages": empty}
    risk = "high" if active or unsafe else "medium" if files or xfa else "low"
    other = sum(k not in ("Link", "Widget", "Popup") for k in kinds)
    return [(path, len(pages), other, kinds.count("Widget"), len(_signatures(path, doc, size)), len(schemes), unsafe, files, script, launch, xfa, tagged, title or None, language or None, empty, risk, [k for k, v in checks.items() if v])]


FORMS: dict[str, Callable[[str, Document, int], list[tuple]]] = {
    "documents": _documents,
    "pages": _pages,
    "words": _words,
    "edges": _edges,
    "objects": _objects,
    "outline": _outline,
    "links": _links,
    "annotations": _annotations,
    "widgets": _widgets,
    "fonts": _fonts,
    "attachments": _attachments,
    "images": _images,
    "boxes": _boxes,
    "tags": _tags,
    "signatures": _signatures,
    "preflight": _preflight,
}


def rows_of(form: str, path: str, content: bytes, password: str = "") -> list[tuple]:
    try:
        doc = Document(content, password)
        if doc.locked and form != "documents":
            raise ValueError("the file is encrypted and the password does not open it")
        error = ("the file is encrypted and the password does not open it",) if doc.locked else (None,)
        return [row + error for row in FORMS[form](path, doc, len(content))]
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError) as e:
        return [(path, *[None] * SCHEMAS[form].count(", "), f"{type(e).__name__}: {e}")]


def schema_of(form: str) -> str:
    return SCHEMAS[form] + ", error string"


def parse(files: DataFrame, form: str = "pages", password: str = "") -> DataFrame:
    """A derived form of files given as (path, content)."""
    return files.select("path", "content").mapInArrow(_over_rows(form, password), schema_of(form))


def _over_rows(form: str, password: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = to_arrow_schema(StructType.fromDDL(schema_of(form)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows += rows_of(form, path.as_py(), content.as_py(), password)
                if len(rows) >= HELD_ROWS:
                    yield made()
                    rows = []
        if rows:
            yield made()

    return run


def sound(rows: DataFrame) -> DataFrame:
    """The rows of files that could be read."""
    return rows.where("error is null").drop("error")


def read_pdf(spark: SparkSession, path: str, form: str = "pages", glob: str = "*.pdf", password: str = "") -> DataFrame:
    """A derived form of all PDF files under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return parse(files, form, password)


class PdfSource(DataSource):
    """``spark.read.format("pdf").option("form", "pages").load(folder)`` over a folder that every node has mounted."""

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return schema_of(self.options.get("form", "pages"))

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.form, self.path = options.get("form", "pages"), options["path"].removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        top = Path(self.path)
        return [InputPartition(str(p)) for p in ([top] if top.is_file() else sorted(top.rglob("*.pdf")))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from rows_of(self.form, partition.value, Path(partition.value).read_bytes())
