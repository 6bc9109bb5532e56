"""Changing PDF files: a document as a draft of pages and objects, and the verbs that work on drafts.

A draft holds copies of all that its pages and its catalog reach. Verbs change the draft in place; saving writes a new
file of what is still reached, so what a verb takes away is in no byte of the result. Rectangles and points are given
as readers of this package give them: from the top left corner of the crop box, y running down.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from quire.functions.pagespec import parse_pages
from quire.sources.pdf import Document, Font, Keyword, Lexer, Name, Ref, Stream
from quire.sources.pdf_write import Letters, file_bytes, image_object

# Entries of a catalog that go with a document's pages.
CARRIED = ("Names", "Dests", "AcroForm", "Outlines", "Lang", "ViewerPreferences", "MarkInfo", "StructTreeRoot", "Metadata", "OCProperties", "PageLabels", "OpenAction", "AA")
MARKUPS = ("Highlight", "Underline", "StrikeOut", "Squiggly")
Rect = tuple[float, float, float, float]


class Draft:
    """A document that can be changed: ``pages`` are references to page dictionaries among ``objects``."""

    def __init__(self, data: bytes | None = None, password: str = "") -> None:
        self.catalog: dict[str, Any] = {"Type": Name("Catalog"), "Pages": Ref(2, 0)}
        self.objects: list[Any] = [self.catalog, {}]
        self.pages: list[Ref] = []
        self.info: dict[str, str] = {}
        self.copied: dict[tuple[int, int], Ref] = {}
        self.sources: list[Document] = []  # as long as they live, their ids are theirs alone
        self.letters: Letters | None = None
        if data is not None:
            doc = Document(data, password)
            if doc.locked:
                raise ValueError("the file is encrypted and the password does not open it")
            self.pages = self.take(doc)
            found = doc.get(doc.trailer.get("Info"))
            self.info = {k: doc.text(v) for k, v in found.items()} if isinstance(found, dict) else {}
            self.catalog.update({k: self.copy(doc, v) for k, v in doc.root().items() if k in CARRIED})

    def add(self, value: Any) -> Ref:
        self.objects.append(value)
        return Ref(len(self.objects), 0)

    def get(self, value: Any) -> Any:
        for _ in range(64):
            if not isinstance(value, Ref):
                return value
            value = self.objects[value.num - 1] if 0 < value.num <= len(self.objects) else None
        return None

    def put(self, ref: Ref, value: Any) -> None:
        self.objects[ref.num - 1] = value

    def page(self, index: int) -> dict:
        return self.get(self.pages[index])

    def copy(self, doc: Document, value: Any) -> Any:
        if isinstance(value, Ref):
            key = id(doc), value.num
            if key not in self.copied:
                found = doc.get(value)
                if isinstance(found, dict) and found.get("Type") in ("Page", "Pages", "Catalog"):
                    return None
                self.copied[key] = self.add(None)
                self.put(self.copied[key], self.copy(doc, found))
            return self.copied[key]
        if isinstance(value, Stream):
            return Stream(self.copy(doc, {k: v for k, v in value.dict.items() if k != "Length"}), value.raw)
        if isinstance(value, dict):
            return {k: self.copy(doc, v) for k, v in value.items()}
        return [self.copy(doc, v) for v in value] if isinstance(value, list) else value

    def take(self, doc: Document, which: Iterable[int] | None = None) -> list[Ref]:
        """Copies of a document's pages; links among them lead to the copies."""
        self.sources.append(doc)
        have = doc.page_list()
        chosen = list(range(len(have))) if which is None else list(which)
        refs = [self.add({}) for _ in chosen]
        for ref, i in zip(refs, chosen, strict=True):
            if have[i][0]:
                self.copied.setdefault((id(doc), have[i][0].num), ref)
        for ref, i in zip(refs, chosen, strict=True):
            page = {k: self.copy(doc, v) for k, v in have[i][1].items() if k not in ("Parent", "StructParents", "B")}
            self.put(ref, {**page, "MediaBox": page.get("MediaBox") or [0, 0, 612, 792], "Type": Name("Page")})
        return refs

    def again(self, ref: Ref) -> Ref:
        """A second page of the same contents; annotations stay with the first."""
        return self.add({k: v for k, v in self.get(ref).items() if k != "Annots"})

    def box(self, page: dict) -> list[float]:
        read = lambda v: [float(self.get(x)) for x in self.get(v)] if self.get(v) else None
        norm = lambda r: [min(r[0], r[2]), min(r[1], r[3]), max(r[0], r[2]), max(r[1], r[3])]
        media, crop = norm(read(page.get("MediaBox")) or [0, 0, 612, 792]), read(page.get("CropBox"))
        crop = norm(crop) if crop else media
        both = [max(media[0], crop[0]), max(media[1], crop[1]), min(media[2], crop[2]), min(media[3], crop[3])]
        return both if both[0] < both[2] and both[1] < both[3] else media

    def placed(self, page: dict, rect: Rect) -> list[float]:
        """A rectangle in the page's own coordinates."""
        left, _, _, top = self.box(page)
        return [left + rect[0], top - rect[3], left + rect[2], top - rect[1]]

    def resources(self, page: dict, kind: str) -> dict:
        """The page's own table of fonts, images or the like, to be added to."""
        own = dict(self.get(page.get("Resources")) or {})
        own[kind] = dict(self.get(own.get(kind)) or {})
        page["Resources"] = own
        return own[kind]

    def contents(self, page: dict) -> list[Any]:
        found = page.get("Contents")
        inner = self.get(found)
        return list(inner) if isinstance(inner, list) else [found] if inner is not None else []

    def draw(self, page: dict, body: bytes, under: bool = False) -> None:
        """More content on top of the page's own, or below it, in the page's plain coordinates."""
        new = self.add(Stream({"Filter": Name("FlateDecode")}, zlib.compress(body)))
        old = self.contents(page)
        fence = [self.add(Stream({}, b"q")), *old, self.add(Stream({}, b"Q"))] if old else []
        page["Contents"] = [new, *fence] if under else [*fence, new]

    def text(self, page: dict, text: str, x: float, y: float, size: float = 12, turn: bytes = b"1 0 0 1", paint: bytes = b"0 g") -> bytes:
        """Content that shows a line of text; the page gets the fonts it needs."""
        if self.letters is None:
            self.letters = Letters()
        name, shown = self.letters.line(text)
        fonts = self.resources(page, "Font")
        if ("QF" + name) not in fonts:
            fonts["QF" + name] = self.letters.ref(name, self.add)
        return b"q %s BT /QF%s %g Tf %s %g %g Tm %s Tj ET Q" % (paint, name.encode(), size, turn, x, y, shown)

    def form(self, ref: Ref) -> Ref:
        """A page as a form that other pages can draw, its corner at the origin."""
        page = self.get(ref)
        x0, y0, x1, y1 = self.box(page)
        doc = _Reading(self)
        body = b"\n".join(doc.decoded(s) for p in self.contents(page) if isinstance(s := self.get(p), Stream))
        return self.add(Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [x0, y0, x1, y1], "Matrix": [1, 0, 0, 1, -x0, -y0], "Resources": page.get("Resources") or {}, "Filter": Name("FlateDecode")}, zlib.compress(body)))

    def save(self, **security: Any) -> bytes:
        """The file's bytes; security (user, owner, allow, method) protects it."""
        if self.letters is not None:
            self.letters.close(self.put)
        for ref in self.pages:
            self.get(ref)["Parent"] = Ref(2, 0)
        self.objects[1] = {"Type": Name("Pages"), "Count": len(self.pages), "Kids": list(self.pages)}
        live = {ref.num for ref in self.pages}
        objects = [None if isinstance(v, dict) and v.get("Type") == "Page" and i not in live else v for i, v in enumerate(self.objects, 1)]
        objects, info = reached(objects), None
        if self.info:
            objects.append(dict(self.info))
            info = len(objects)
        if security:
            from quire.sources.pdf_crypt import protected

            return protected(objects, info, **security)
        return file_bytes(objects, info)


class _Reading(Document):
    """Reads a draft's objects as those of a document."""

    def __init__(self, draft: Draft) -> None:
        self.draft = draft

    def get(self, value: Any, depth: int = 0) -> Any:
        return self.draft.get(value)

    def text(self, value: Any) -> str:
        value = self.get(value)  # what a verb has put in is a text already
        return str(value) if isinstance(value, str) else super().text(value)


def reached(objects: list[Any]) -> list[Any]:
    """The objects that the first one leads to, renumbered in the order they are met."""
    order: dict[int, int] = {}
    todo: list[Any] = [Ref(1, 0)]
    while todo:
        v = todo.pop()
        if isinstance(v, Ref):
            if v.num not in order and 0 < v.num <= len(objects) and objects[v.num - 1] is not None:
                order[v.num] = len(order) + 1
                todo.append(objects[v.num - 1])
        elif isinstance(v, Stream):
            todo.extend(reversed(v.dict.values()))
        elif isinstance(v, dict):
            todo.extend(reversed(v.values()))
        elif isinstance(v, list):
            todo.extend(reversed(v))

    def moved(v: Any) -> Any:
        if isinstance(v, Ref):
            return Ref(order[v.num], 0) if v.num in order else None
        if isinstance(v, Stream):
            return Stream(moved(v.dict), v.raw)
        if isinstance(v, dict):
            return {k: moved(x) for k, x in v.items()}
        return [moved(x) for x in v] if isinstance(v, list) else v

    return [moved(objects[num - 1]) for num in order]


def chosen(draft: Draft, spec: str | None) -> list[int]:
    found = parse_pages(spec, len(draft.pages))
    return list(range(len(draft.pages))) if found is None else found


# pages


def extract(draft: Draft, spec: str | None) -> None:
    pages: list[Ref] = []
    for ref in (draft.pages[i] for i in chosen(draft, spec)):
        pages.append(draft.again(ref) if ref in pages else ref)
    draft.pages = pages


def delete(draft: Draft, spec: str) -> None:
    gone = set(chosen(draft, spec)) if spec and spec.strip() else set()
    if len(gone) == len(draft.pages):
        raise ValueError("no page would be left")
    draft.pages = [p for i, p in enumerate(draft.pages) if i not in gone]


def split(draft: Draft, every: int = 1) -> Iterator[Draft]:
    """Drafts of ``every`` pages each; they share objects with the first."""
    whole, every = draft.pages, max(every, 1)
    for at in range(0, len(whole), every):
        draft.pages = whole[at : at + every]
        yield draft
    draft.pages = whole


def reorder(draft: Draft, spec: str) -> None:
    first = parse_pages(spec, len(draft.pages)) or []
    if not first or len(set(first)) != len(first):
        raise ValueError("the order must name at least one page, and none twice")
    draft.pages = [draft.pages[i] for i in [*first, *(i for i in range(len(draft.pages)) if i not in first)]]


def rotate(draft: Draft, degrees: int, spec: str | None = None) -> None:
    if degrees % 90:
        raise ValueError("pages rotate by multiples of 90 degrees")
    for i in set(chosen(draft, spec)):
        draft.page(i)["Rotate"] = (degrees + int(draft.get(draft.page(i).get("Rotate")) or 0)) % 360


def blank(draft: Draft, at: int, count: int = 1) -> None:
    """Blank pages before page ``at`` (from 0; at the end beyond it), of their neighbour's size."""
    if not 1 <= count <= 100:
        raise ValueError("1 to 100 blank pages can be inserted")
    near = draft.page(min(at, len(draft.pages) - 1)) if draft.pages else {}
    draft.pages[at:at] = [draft.add({"Type": Name("Page"), "MediaBox": near.get("MediaBox") or [0, 0, 612, 792], "Resources": {}}) for _ in range(count)]


def duplicate(draft: Draft, spec: str | None) -> None:
    twice = set(chosen(draft, spec))
    draft.pages = [x for i, p in enumerate(draft.pages) for x in ([p, draft.again(p)] if i in twice else [p])]


def insert(draft: Draft, other: bytes, at: int = 0) -> None:
    """Another file's pages before page ``at`` (from 1); 0 is the end, negative counts from the end."""
    place = len(draft.pages) if at == 0 else max(0, len(draft.pages) + at) if at < 0 else min(at - 1, len(draft.pages))
    draft.pages[place:place] = draft.take(Document(other))


def replace(draft: Draft, other: bytes, spec: str) -> None:
    gone = chosen(draft, spec)
    before = sum(i not in gone for i in range(min(gone[0], len(draft.pages))))
    draft.pages = [p for i, p in enumerate(draft.pages) if i not in gone]
    draft.pages[before:before] = draft.take(Document(other))


def merge(files: Iterable[bytes]) -> Draft:
    out = Draft()
    for data in files:
        out.pages += out.take(Document(data))
    return out


def set_box(draft: Draft, box: str, rect: Rect, spec: str | None = None) -> None:
    if box not in ("Media", "Crop", "Trim", "Bleed", "Art"):
        raise ValueError(f"no such box: {box}")
    for i in set(chosen(draft, spec)):
        page = draft.page(i)
        place = draft.placed(page, rect)
        left, low, right, top = draft.box(page)
        if box == "Crop" and not (left <= place[0] < place[2] <= right and low <= place[1] < place[3] <= top):
            raise ValueError("the crop box must lie inside the page")
        page[box + "Box"] = place


def scale(draft: Draft, factor: float, spec: str | None = None) -> None:
    if factor <= 0:
        raise ValueError("the factor must be positive")
    for i in set(chosen(draft, spec)):
        page = draft.page(i)
        for key in [k for k in page if k.endswith("Box")]:
            page[key] = [float(draft.get(v)) * factor for v in draft.get(page[key])]
        page["Contents"] = [draft.add(Stream({}, b"q %g 0 0 %g 0 0 cm" % (factor, factor))), *draft.contents(page), draft.add(Stream({}, b"Q"))]
        for ref in draft.get(page.get("Annots")) or []:
            if isinstance(a := draft.get(ref), dict) and draft.get(a.get("Rect")):
                a["Rect"] = [float(draft.get(v)) * factor for v in draft.get(a["Rect"])]


def _sheet(draft: Draft, refs: list[Ref | None], n: int) -> Ref:
    first = draft.get(next(r for r in refs if r))
    x0, y0, x1, y1 = draft.box(first)
    w, h = x1 - x0, y1 - y0
    width, height, by = (h, w, min(h / 2 / w, w / h)) if n == 2 else (w, h, 0.5)
    forms, body = {}, []
    for slot, ref in enumerate(refs):
        if ref:
            forms[f"P{slot}"] = draft.form(ref)
            row, column = (0, slot) if n == 2 else divmod(slot, 2)
            body.append(b"q %g 0 0 %g %g %g cm /P%d Do Q" % (by, by, column * width / 2, height - (row + 1) * height / (1 if n == 2 else 2), slot))
    return draft.add({"Type": Name("Page"), "MediaBox": [0, 0, width, height], "Resources": {"XObject": forms}, "Contents": draft.add(Stream({}, b"\n".join(body)))})


def nup(draft: Draft, n: int = 2) -> None:
    if n not in (2, 4):
        raise ValueError("2 or 4 pages fit a sheet")
    draft.pages = [_sheet(draft, draft.pages[i : i + n], n) for i in range(0, len(draft.pages), n)]


def booklet(draft: Draft) -> None:
    """Two pages a side, in printing order of a folded booklet."""
    pages: list[Ref | None] = [*draft.pages, *[None] * (-len(draft.pages) % 4)]
    sides = [(len(pages) - 1 - i, i) if i % 2 == 0 else (i, len(pages) - 1 - i) for i in range(len(pages) // 2)]
    empty = {"Type": Name("Page"), "MediaBox": draft.page(0)["MediaBox"] if draft.pages else [0, 0, 612, 792], "Resources": {}}
    draft.pages = [_sheet(draft, [pages[a], pages[b]], 2) if pages[a] or pages[b] else draft.add(dict(empty)) for a, b in sides]


def overlay(draft: Draft, other: bytes, under: bool = False) -> None:
    """Each page with the other file's page of its place, or its last one, drawn over it."""
    stamps = [draft.form(r) for r in draft.take(Document(other))]
    for i in range(len(draft.pages) if stamps else 0):
        page = draft.page(i)
        draft.resources(page, "XObject")["QOver"] = stamps[min(i, len(stamps) - 1)]
        left, low, _, _ = draft.box(page)
        draft.draw(page, b"q 1 0 0 1 %g %g cm /QOver Do Q" % (left, low), under)


def stamp(draft: Draft, text: Callable[[int, int], str], where: str = "bottom", size: float = 10, spec: str | None = None) -> None:
    """A line on each page, text(page from 1, pages), in the middle of its ``top`` or ``bottom`` edge."""
    for i in sorted(set(chosen(draft, spec))):
        page, line = draft.page(i), text(i + 1, len(draft.pages))
        x0, y0, x1, y1 = draft.box(page)
        x = (x0 + x1 - 0.5 * size * len(line)) / 2
        draft.draw(page, draft.text(page, line, x, y1 - 36 if where == "top" else y0 + 28, size))


def watermark(draft: Draft, text: str = "DRAFT", size: float = 72, opacity: float = 0.15, angle: float = 45, spec: str | None = None) -> None:
    """Large translucent text across each page; line breaks and tabs are spaces."""
    import math

    plain, turned = re.sub(r"[\r\n\t]", " ", text), math.radians(angle)
    state = draft.add({"Type": Name("ExtGState"), "ca": opacity, "CA": opacity})
    for i in set(chosen(draft, spec)):
        page = draft.page(i)
        draft.resources(page, "ExtGState")["QFaint"] = state
        x0, y0, x1, y1 = draft.box(page)
        half = 0.25 * size * len(plain)
        turn = b"%.4f %.4f %.4f %.4f" % (math.cos(turned), math.sin(turned), -math.sin(turned), math.cos(turned))
        draft.draw(page, draft.text(page, plain, (x0 + x1) / 2 - half * math.cos(turned), (y0 + y1) / 2 - half * math.sin(turned), size, turn, b"/QFaint gs 0.5 g"))


def place_text(draft: Draft, index: int, x: float, y: float, text: str, size: float = 12) -> None:
    page = draft.page(index)
    at = draft.placed(page, (x, y, x, y))
    lines = [draft.text(page, line, at[0], at[1] - n * 1.2 * size, size) for n, line in enumerate(text.split("\n"))]
    draft.draw(page, b"\n".join(lines))


def place_image(draft: Draft, index: int, rect: Rect, image: bytes) -> None:
    page = draft.page(index)
    x0, y0, x1, y1 = draft.placed(page, rect)
    images = draft.resources(page, "XObject")
    name = f"QImage{len(images)}"
    images[name] = draft.add(image_object(image))
    draft.draw(page, b"q %g 0 0 %g %g %g cm /%s Do Q" % (x1 - x0, y1 - y0, x0, y0, name.encode()))


# outline, links, information, attachments


def set_outline(draft: Draft, rows: list[tuple[int, str, int]]) -> None:
    """(level from 1, title, page from 1 or -1) rows replace the outline."""
    above, seen = 0, []
    for i, (level, _, page) in enumerate(rows):
        if not 1 <= level <= above + 1:
            raise ValueError(f"bad hierarchy level of item {i}")
        if page != -1 and not 1 <= page <= len(draft.pages):
            raise ValueError(f"item {i}: page {page} is out of range")
        above = level
    top = draft.add({"Type": Name("Outlines")})
    stack: list[list[Ref]] = [[top]]  # of each open level its parent and the children so far
    for level, title, page in rows:
        item = {"Title": title, "Parent": stack[level - 1][0]} | ({"Dest": [draft.pages[page - 1], Name("Fit")]} if page != -1 else {})
        ref = draft.add(item)
        del stack[level:]
        kids = stack[level - 1]
        if len(kids) > 1:
            draft.get(kids[-1])["Next"] = ref
            item["Prev"] = kids[-1]
        parent = draft.get(kids[0])
        parent.setdefault("First", ref)
        parent |= {"Last": ref, "Count": parent.get("Count", 0) + 1}
        kids.append(ref)
        stack.append([ref])
        seen.append(ref)
    draft.catalog["Outlines"] = top


def clear_outline(draft: Draft) -> None:
    draft.catalog.pop("Outlines", None)


def annotations(draft: Draft, page: dict) -> list[tuple[Any, dict]]:
    return [(ref, d) for ref in draft.get(page.get("Annots")) or [] if isinstance(d := draft.get(ref), dict)]


def _annotate(draft: Draft, page: dict, value: dict) -> Ref:
    ref = draft.add({"Type": Name("Annot"), "P": next((p for p in draft.pages if draft.get(p) is page), None)} | value)
    page["Annots"] = [*(draft.get(page.get("Annots")) or []), ref]
    return ref


def _keep(draft: Draft, kept: Callable[[int, dict], bool]) -> int:
    """Only the annotations for which kept(page, annotation) holds stay, and popups only with what they belong to."""
    gone = 0
    for i in range(len(draft.pages)):
        page = draft.page(i)
        rows = annotations(draft, page)
        out = {id(d) for _, d in rows if not kept(i, d)}
        out |= {id(p) for _, d in rows if id(d) in out and isinstance(p := draft.get(d.get("Popup")), dict)}
        gone += len(out)
        page["Annots"] = [ref for ref, d in rows if id(d) not in out]
    return gone


def add_link(draft: Draft, index: int, rect: Rect, uri: str | None = None, target: int | None = None) -> None:
    """A link on a page to an address or to another page (both from 0)."""
    page = draft.page(index)
    to = {"A": {"S": Name("URI"), "URI": uri}} if uri is not None else {"Dest": [draft.pages[target or 0], Name("Fit")]}
    _annotate(draft, page, {"Subtype": Name("Link"), "Rect": draft.placed(page, rect), "Border": [0, 0, 0]} | to)


def remove_links(draft: Draft, external: bool | None = None) -> int:
    """Take away all links, or only those out of the document or inside it."""
    outside = lambda d: isinstance(a := draft.get(d.get("A")), dict) and draft.get(a.get("S")) in ("URI", "Launch", "GoToR")
    return _keep(draft, lambda _, d: d.get("Subtype") != "Link" or (external is not None and outside(d) != external))


def set_information(draft: Draft, changes: dict[str, str]) -> None:
    """Set entries; an empty text, none or null deletes one."""
    for key, value in changes.items():
        draft.info = {k: v for k, v in draft.info.items() if k.lower() != key.lower()}
        if value.lower() not in ("", "none", "null"):
            draft.info[key[:1].upper() + key[1:]] = value


def strip_information(draft: Draft) -> None:
    draft.info = {}
    draft.catalog.pop("Metadata", None)
    for value in draft.objects:
        if isinstance(value, dict) and "Metadata" in value:
            del value["Metadata"]
        if isinstance(value, Stream):
            value.dict.pop("Metadata", None)


def set_access(draft: Draft, title: str | None = None, language: str | None = None) -> None:
    """The document's title, shown in the window, and its language."""
    if title is not None:
        draft.info["Title"] = title
        draft.catalog["ViewerPreferences"] = dict(draft.get(draft.catalog.get("ViewerPreferences")) or {}) | {"DisplayDocTitle": True}
    if language is not None:
        draft.catalog["Lang"] = language


def attached(draft: Draft) -> dict[str, Any]:
    names = draft.get(draft.catalog.get("Names"))
    out: dict[str, Any] = {}

    def walk(node: Any) -> None:
        node = draft.get(node)
        if isinstance(node, dict):
            pairs = draft.get(node.get("Names")) or []
            out.update({_Reading(draft).text(k): v for k, v in zip(pairs[::2], pairs[1::2], strict=False)})
            for kid in draft.get(node.get("Kids")) or []:
                walk(kid)

    walk(names.get("EmbeddedFiles") if isinstance(names, dict) else None)
    return out


def _attach_all(draft: Draft, files: dict[str, Any]) -> None:
    names = dict(draft.get(draft.catalog.get("Names")) or {})
    names["EmbeddedFiles"] = {"Names": [x for k in sorted(files) for x in (k, files[k])]}
    draft.catalog["Names"] = names


def attach(draft: Draft, name: str, content: bytes) -> None:
    """One more attached file; a name that is taken is an error."""
    files = attached(draft)
    if name in files:
        raise ValueError(f"an attachment named {name} is there already")
    body = draft.add(Stream({"Type": Name("EmbeddedFile"), "Filter": Name("FlateDecode"), "Params": {"Size": len(content)}}, zlib.compress(content)))
    _attach_all(draft, files | {name: draft.add({"Type": Name("Filespec"), "F": name, "UF": name, "EF": {"F": body}})})


def detach(draft: Draft, names: Iterable[str]) -> list[str]:
    """Take attached files away; the names that are not there."""
    files, wanted = attached(draft), list(names)
    _attach_all(draft, {k: v for k, v in files.items() if k not in wanted})
    return [k for k in wanted if k not in files]


# annotations


def _ink(color: tuple[float, float, float], fill: bool = False) -> bytes:
    return b"%g %g %g %s" % (*color, b"rg" if fill else b"RG")


def _look(draft: Draft, kind: str, box: list[float], color: tuple, text: str, points: list[list[float]], width: float) -> Ref:
    """The appearance of an annotation, drawn in the page's coordinates."""
    x0, y0, x1, y1 = box
    holder: dict[str, Any] = {}
    path = lambda p: b" ".join(b"%g %g %s" % (x, y, b"l" if i else b"m") for i, (x, y) in enumerate(zip(p[::2], p[1::2], strict=True)))
    if kind == "Highlight":
        draft.resources(holder, "ExtGState")["M"] = {"BM": Name("Multiply")}
        body = b"/M gs %s %g %g %g %g re f" % (_ink(color, True), x0, y0, x1 - x0, y1 - y0)
    elif kind in ("Underline", "StrikeOut", "Squiggly"):
        y = y0 + (0.5 * (y1 - y0) if kind == "StrikeOut" else 1)
        body = b"%s %g w %g %g m %g %g l S" % (_ink(color), width, x0, y, x1, y)
    elif kind == "Square":
        body = b"%s %g w %g %g %g %g re S" % (_ink(color), width, x0, y0, x1 - x0, y1 - y0)
    elif kind == "Circle":
        mx, my, kx, ky = (x0 + x1) / 2, (y0 + y1) / 2, 0.2761 * (x1 - x0), 0.2761 * (y1 - y0)
        curve = [(x1, my + ky, mx + kx, y1, mx, y1), (mx - kx, y1, x0, my + ky, x0, my), (x0, my - ky, mx - kx, y0, mx, y0), (mx + kx, y0, x1, my - ky, x1, my)]
        body = b"%s %g w %g %g m " % (_ink(color), width, x1, my) + b" ".join(b"%g %g %g %g %g %g c" % c for c in curve) + b" S"
    elif kind in ("Line", "Ink", "PolyLine", "Polygon"):
        body = b"%s %g w " % (_ink(color), width) + b" ".join(map(path, points)) + (b" s" if kind == "Polygon" else b" S")
    else:  # texts in a box: FreeText, Stamp, and the mark of a note
        lines = text.split("\n") if kind in ("FreeText", "Stamp") else []
        size = 12.0
        shown = [draft.text(holder, line, x0 + 3, y1 - (n + 1) * 1.2 * size, size, paint=_ink(color, True)) for n, line in enumerate(lines)]
        frame = b"%s %g w %g %g %g %g re S" % (_ink(color), width, x0, y0, x1 - x0, y1 - y0)
        body = b"\n".join([frame, *map(path, points), b"S" if points else b"", *shown])
    return draft.add(Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": box, "Resources": holder.get("Resources", {})}, body))


def annotate(draft: Draft, index: int, kind: str, rect: Rect, contents: str = "", author: str = "", color: tuple[float, float, float] = (1.0, 0.8, 0.0), points: list[list[float]] | None = None, width: float = 1.0) -> None:
    """An annotation of any kind with its appearance: note (Text), FreeText, Highlight, Underline, StrikeOut, Squiggly, Square,
    Circle, Line, Ink, Polygon, PolyLine, Stamp; points are flat lists of x and y, a callout's line those of a FreeText."""
    page = draft.page(index)
    box = draft.placed(page, rect)
    left, _, _, top = draft.box(page)
    paths = [[v for x, y in zip(p[::2], p[1::2], strict=True) for v in (left + x, top - y)] for p in points or []]
    value: dict[str, Any] = {"Subtype": Name(kind), "Rect": box, "Contents": contents, "C": list(color), "F": 4} | ({"T": author} if author else {})
    if kind in MARKUPS:
        value["QuadPoints"] = [box[0], box[3], box[2], box[3], box[0], box[1], box[2], box[1]]
    if kind == "Line":
        value["L"] = paths[0][:4]
    elif kind == "Ink":
        value["InkList"] = paths
    elif kind in ("Polygon", "PolyLine"):
        value["Vertices"] = paths[0]
    elif kind == "FreeText":
        value |= {"DA": b"/Helv 12 Tf 0 g"} | ({"CL": paths[0], "IT": Name("FreeTextCallout")} if paths else {})
    elif kind == "Stamp":
        value["Name"] = Name("Draft")
    elif kind not in (*MARKUPS, "Text", "Square", "Circle"):
        raise ValueError(f"no annotation of this kind: {kind}")
    _annotate(draft, page, value | {"AP": {"N": _look(draft, kind, box, color, contents, paths, width)}})


def delete_annotations(draft: Draft, kind: str | None = None, spec: str | None = None) -> int:
    """Take away annotations of a kind (any, but links, widgets and popups) on some pages, with their popups."""
    pages = set(chosen(draft, spec))
    hit = lambda d: d.get("Subtype") not in ("Link", "Widget", "Popup") and (kind is None or str(d.get("Subtype")).lower() == kind.lower())
    return _keep(draft, lambda i, d: not (i in pages and hit(d)))


def _flatten(draft: Draft, which: Callable[[dict], bool]) -> int:
    done = 0
    for i in range(len(draft.pages)):
        page, body, names = draft.page(i), [], []
        rows = [(ref, d) for ref, d in annotations(draft, page) if which(d)]
        for _, d in rows:
            look = draft.get(draft.get(d.get("AP") or {}).get("N"))
            if isinstance(look, dict):  # a state of several
                look = draft.get(look.get(draft.get(d.get("AS")) or "Off"))
            hidden = int(draft.get(d.get("F")) or 0) & 2
            if isinstance(look, Stream) and not hidden:
                rect, box = ([float(draft.get(v)) for v in draft.get(x)] for x in (d["Rect"], look.dict.get("BBox") or d["Rect"]))
                sx, sy = ((rect[2] - rect[0]) / ((box[2] - box[0]) or 1), (rect[3] - rect[1]) / ((box[3] - box[1]) or 1))
                name = f"QA{len(names)}"
                names.append((name, draft.add(Stream({"Type": Name("XObject"), "Subtype": Name("Form")} | look.dict, look.raw))))
                body.append(b"q %g 0 0 %g %g %g cm /%s Do Q" % (sx, sy, rect[0] - sx * box[0], rect[1] - sy * box[1], name.encode()))
        if rows:
            draft.resources(page, "XObject").update(names)
            if body:
                draft.draw(page, b"\n".join(body))
            gone = {id(d) for _, d in rows}
            page["Annots"] = [ref for ref, d in annotations(draft, page) if id(d) not in gone]
            done += len(rows)
    return done


def flatten_annotations(draft: Draft) -> int:
    """Annotations become content; links, widgets and popups without a look of their own stay out of it."""
    done = _flatten(draft, lambda d: d.get("Subtype") not in ("Link", "Widget", "Popup"))
    _keep(draft, lambda _, d: d.get("Subtype") != "Popup")
    return done


def flatten_fields(draft: Draft) -> int:
    """Fields become content and the form goes."""
    done = _flatten(draft, lambda d: d.get("Subtype") == "Widget")
    draft.catalog.pop("AcroForm", None)
    return done


# fields


def add_field(draft: Draft, index: int, rect: Rect, name: str, kind: str = "text", value: str = "") -> None:
    """A text field or a check box (checked for the value ``Yes``); a name that is taken is an error."""
    form = draft.catalog.get("AcroForm")
    form = dict(draft.get(form) or {})
    if name in {full for full, _ in fields(draft)}:
        raise ValueError(f"a field named {name} is there already")
    page = draft.page(index)
    box = draft.placed(page, rect)
    d: dict[str, Any] = {"Subtype": Name("Widget"), "Rect": box, "T": name, "F": 4}
    if kind == "text":
        d |= {"FT": Name("Tx"), "V": value, "DA": b"/Helv 12 Tf 0 g"}
    elif kind == "checkbox":
        look = {"Yes": draft.add(Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": box}, b"%g %g m %g %g l S" % tuple(box))), "Off": draft.add(Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": box}, b""))}
        d |= {"FT": Name("Btn"), "V": Name(value or "Off"), "AS": Name(value or "Off"), "AP": {"N": look}}
    else:
        raise ValueError(f"no field of this kind: {kind}")
    ref = _annotate(draft, page, d)
    if kind == "text":
        _show_value(draft, draft.get(ref), value)
    draft.catalog["AcroForm"] = form | {"Fields": [*(draft.get(form.get("Fields")) or []), ref], "DA": b"/Helv 12 Tf 0 g"}


def _show_value(draft: Draft, d: dict, value: str) -> None:
    box, holder = [float(draft.get(v)) for v in draft.get(d["Rect"])], {}
    body = draft.text(holder, value, box[0] + 2, box[1] + 4, 12) if value else b""
    d["AP"] = {"N": draft.add(Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": box, "Resources": holder.get("Resources", {})}, body))}


def fields(draft: Draft) -> Iterator[tuple[str, dict]]:
    """(full name, dictionary) of each field that holds a value."""
    reading = _Reading(draft)

    def walk(ref: Any, above: str, depth: int) -> Iterator[tuple[str, dict]]:
        d = draft.get(ref)
        if not isinstance(d, dict) or depth > 128:
            return
        full = ".".join(x for x in (above, reading.text(d.get("T"))) if x)
        kids = [k for k in draft.get(d.get("Kids")) or [] if isinstance(c := draft.get(k), dict) and "T" in c]
        for kid in kids:
            yield from walk(kid, full, depth + 1)
        if not kids:
            yield full, d

    form = draft.get(draft.catalog.get("AcroForm"))
    for ref in (draft.get(form.get("Fields")) or []) if isinstance(form, dict) else []:
        yield from walk(ref, "", 0)


def fill(draft: Draft, values: dict[str, str]) -> list[str]:
    """Set fields by full or local name, the full one first; the names that no field has."""
    used = set()
    for full, d in fields(draft):
        local = full.rsplit(".", 1)[-1]
        name = full if full in values else local if local in values else None
        if name is None:
            continue
        used.add(name)
        if draft.get(d.get("FT")) == "Btn":
            d["V"] = d["AS"] = Name(values[name])
        else:
            d["V"] = values[name]
            if "Rect" in d:
                _show_value(draft, d, values[name])
    return [k for k in values if k not in used]


def field_values(text: str) -> dict[str, str]:
    """Names and values of an XFDF or JSON text; nested names are joined by points."""
    import json
    from xml.etree import ElementTree

    out: dict[str, str] = {}
    if text.lstrip()[:1] == "{":
        def flat(value: Any, above: str) -> None:
            if isinstance(value, dict):
                for k, v in value.items():
                    flat(v, f"{above}.{k}" if above else k)
            else:
                out[above] = "" if value is None else "Yes" if value is True else "Off" if value is False else str(value)

        flat(json.loads(text), "")
        return out
    if re.search(r"<!(DOCTYPE|ENTITY)", text):
        raise ValueError("no document types in form data")
    local = lambda e: e.tag.rsplit("}", 1)[-1]

    def walk(element: Any, above: str) -> None:
        for e in element:
            if local(e) == "field":
                name = f"{above}.{e.get('name')}" if above else e.get("name", "")
                for v in e:
                    if local(v) == "value":
                        out[name] = v.text or ""
                walk(e, name)
            elif local(e) == "fields":
                walk(e, above)

    walk(ElementTree.fromstring(text), "")
    return out


# text in content


def _strings(draft: Draft, page: dict, data: bytes, resources: Any) -> Iterator[tuple[int, int, bytes, Font]]:
    """(start, end, bytes, font) of each shown string of a content stream."""
    reading = _Reading(draft)
    fonts = draft.get((draft.get(resources) or {}).get("Font")) or {}
    lexer, stack, font, known = Lexer(data), [], None, {}
    while True:
        lexer.skip()
        start = lexer.at
        token = lexer.next()
        if token is None:
            return
        if not isinstance(token, Keyword):
            stack.append((start, lexer.at, token))
            continue
        if token == b"Tf" and len(stack) >= 2:
            name = stack[-2][2]
            if name not in known:
                known[name] = Font(reading, fonts.get(name))
            font = known[name]
        elif token in (b"Tj", b"'", b'"') and stack and font and isinstance(stack[-1][2], bytes):
            yield (*stack[-1], font)
        elif token == b"TJ" and stack and font and isinstance(stack[-1][2], list):
            inner, end = Lexer(data, stack[-1][0] + 1), stack[-1][1]
            while inner.at < end:
                inner.skip()
                at = inner.at
                if at >= end - 1:
                    break
                item = inner.next()
                if isinstance(item, bytes) and not isinstance(item, Keyword):
                    yield at, inner.at, item, font
        elif token == b"BI":
            end = re.compile(rb"\sEI(?=\s)").search(data, lexer.at)
            lexer.at = end.end() if end else len(data)
        stack.clear()


def rewrite_text(draft: Draft, pattern: re.Pattern, new: Callable[[re.Match], str] | None = None, spec: str | None = None) -> int:
    """Matches in the text that pages show are replaced in the content itself, or blanked out if new is None; how many.

    A match may run over several strings. A replacement needs a font that has its letters; else it is an error.
    """
    count = 0
    for i in sorted(set(chosen(draft, spec))):
        page = draft.page(i)
        reading = _Reading(draft)
        data = b"\n".join(reading.decoded(s) for p in draft.contents(page) if isinstance(s := draft.get(p), Stream))
        shown = list(_strings(draft, page, data, page.get("Resources")))
        codes = [(n, k, text) for n, (_, _, raw, font) in enumerate(shown) for k, (text, _) in enumerate(font.codes(raw))]
        text, place, last = [], [], 0
        for n, k, t in codes:
            if n != last:
                text.append("\n")
                place.append(None)
            last = n
            text.extend(t)
            place.extend([(n, k)] * len(t))
        gone: dict[tuple[int, int], str] = {}
        for m in pattern.finditer("".join(text)):
            at = [p for p in place[m.start() : m.end()] if p]
            if at:
                count += 1
                gone |= dict.fromkeys(at, "" if new else " ")
                if new:
                    gone[at[0]] = new(m)
        if not gone:
            continue
        out, done = [], 0
        for n, (start, end, raw, font) in enumerate(shown):
            if any(p[0] == n for p in gone):
                step = 2 if font.wide else 1
                kept = [font.spell(gone[n, k]) if (n, k) in gone else raw[k * step : (k + 1) * step] for k in range(len(raw) // step)]
                out += [data[done:start], b"<", b"".join(kept).hex().encode(), b">"]
                done = end
        body = b"".join([*out, data[done:]])
        page["Contents"] = draft.add(Stream({"Filter": Name("FlateDecode")}, zlib.compress(body)))
    return count


def compress(draft: Draft) -> None:
    """Streams without a filter are deflated, deflated ones anew, where that is shorter."""
    reading = _Reading(draft)
    for i, value in enumerate(draft.objects):
        if isinstance(value, Stream) and draft.get(value.dict.get("Filter")) in (None, "FlateDecode") and "DecodeParms" not in value.dict:
            new = zlib.compress(reading.decoded(value), 9)
            if len(new) + 20 < len(value.raw):
                draft.objects[i] = Stream({k: v for k, v in value.dict.items() if k != "Filter"} | {"Filter": Name("FlateDecode")}, new)


def sanitize(draft: Draft) -> int:
    """Scripts, automatic actions, attached files, metadata and thumbnails go from every object; how many entries."""
    # Keys of active content and of what carries files along.
    keys, removed = {"JS", "JavaScript", "OpenAction", "AA", "EmbeddedFiles", "EF", "Metadata", "Thumb"}, 0

    def clean(v: Any) -> Any:
        nonlocal removed
        if isinstance(v, Stream):
            return Stream(clean(v.dict), v.raw)
        if isinstance(v, dict):
            if v.get("S") in ("JavaScript", "Launch"):
                removed += 1
                return {}
            removed += sum(k in keys for k in v)
            return {k: clean(x) for k, x in v.items() if k not in keys}
        return [clean(x) for x in v] if isinstance(v, list) else v

    draft.objects = [clean(v) for v in draft.objects]
    draft.catalog = draft.objects[0]
    draft.info = {}
    return removed
