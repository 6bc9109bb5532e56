"""Writing PDF files: plain text pages, and new files from pages of read ones."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable
from typing import Any

from quire.sources.pdf import Name, Ref, Stream


def spelled(value: Any) -> bytes:
    """An object's bytes."""
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        return (f"{value:.6f}".rstrip("0").rstrip(".") or "0").encode()
    if isinstance(value, Ref):
        return b"%d %d R" % value
    if isinstance(value, Name):
        return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"#()<>[]{}/%" else b"#%02X" % c for c in value.encode("latin-1", "replace"))
    if isinstance(value, str):
        try:
            return spelled(value.encode("latin-1") if value.isascii() else b"\xfe\xff" + value.encode("utf-16-be"))
        except UnicodeEncodeError:
            return spelled(b"")
    if isinstance(value, bytes):
        return b"<" + value.hex().encode() + b">"
    if isinstance(value, list):
        return b"[" + b" ".join(map(spelled, value)) + b"]"
    if isinstance(value, dict):
        return b"<<" + b" ".join(spelled(Name(k)) + b" " + spelled(v) for k, v in value.items()) + b">>"
    if isinstance(value, Stream):
        return spelled(value.dict | {"Length": len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"
    raise TypeError(f"no PDF object: {type(value)}")


def file_bytes(objects: list[Any], info: int | None = None, more: dict | None = None) -> bytes:
    """A file of objects 1, 2, ..., of which the first is the catalog; more goes into the trailer."""
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
    for i, value in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + spelled(value) + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    trailer = {"Size": len(objects) + 1, "Root": Ref(1, 0)} | ({"Info": Ref(info, 0)} if info else {}) | (more or {})
    return bytes(out + b"trailer\n" + spelled(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % start)


class Letters:
    """The fonts of written lines: a standard one for Latin letters, a composite one that names every other letter."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}
        self.refs: dict[str, Ref] = {}
        self.map: Ref | None = None

    def line(self, text: str) -> tuple[str, bytes]:
        """The font of a line (L or U) and the line as a string in it."""
        try:
            return "L", b"<" + text.encode("cp1252").hex().encode() + b">"
        except UnicodeEncodeError:
            codes = [self.codes.setdefault(c, len(self.codes) + 1) for c in text]
            if len(self.codes) > 0xFFFF:
                raise ValueError("more letters than a font has codes for") from None
            return "U", b"<" + "".join(f"{c:04X}" for c in codes).encode() + b">"

    def ref(self, name: str, add: Callable[[Any], Ref]) -> Ref:
        """The font's object, made when it is first asked for."""
        if name not in self.refs:
            if name == "L":
                self.refs[name] = add(latin_font())
            else:
                self.map = add(None)
                kind = {"Registry": b"Adobe", "Ordering": b"Identity", "Supplement": 0}
                below = add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("Helvetica"), "CIDSystemInfo": kind, "DW": 500})
                self.refs[name] = add({"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Helvetica"), "Encoding": Name("Identity-H"), "DescendantFonts": [below], "ToUnicode": self.map})
        return self.refs[name]

    def close(self, put: Callable[[Ref, Any], None]) -> None:
        """Write the composite font's map of codes."""
        if self.map is not None:
            rows = [b"<%04X> <%s>" % (i, c.encode("utf-16-be", "surrogatepass").hex().encode()) for c, i in self.codes.items()]
            parts = [b"%d beginbfchar\n%s\nendbfchar" % (len(rows[i : i + 100]), b"\n".join(rows[i : i + 100])) for i in range(0, len(rows), 100)]
            put(self.map, Stream({"Filter": Name("FlateDecode")}, zlib.compress(b"1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n" + b"\n".join(parts))))


def latin_font() -> dict:
    return {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}


def text_stream(text: str, letters: Letters, size: float = 11, left: float = 72, top: float = 720, leading: float = 14) -> Stream:
    """A page's lines in the fonts F1 (Latin) and F2."""
    rows, last = [b"BT /F1 %g Tf %g TL %g %g Td" % (size, leading, left, top)], "L"
    for line in text.split("\n"):
        name, shown = letters.line(line)
        if name != last:
            rows.append(b"/F%d %g Tf" % (1 + (name == "U"), size))
            last = name
        rows.append(shown + b" Tj T*")
    return Stream({"Filter": Name("FlateDecode")}, zlib.compress(b"\n".join([*rows, b"ET"])))


def text_pdf(pages: list[str], title: str | None = None, labels: list[str] | None = None, outline: bool = False) -> bytes:
    """A document with a page for each text, its outline naming the labels."""
    n, letters = len(pages), Letters()
    catalog: dict = {"Type": Name("Catalog"), "Pages": Ref(2, 0)}
    objects: list[Any] = [catalog, {"Type": Name("Pages"), "Count": n, "Kids": [Ref(4 + 2 * i, 0) for i in range(n)], "MediaBox": [0, 0, 612, 792]}, latin_font()]
    fonts = {"F1": Ref(3, 0)}
    for i, text in enumerate(pages):
        objects.append({"Type": Name("Page"), "Parent": Ref(2, 0), "Resources": {"Font": fonts}, "Contents": Ref(5 + 2 * i, 0)})
        objects.append(text_stream(text, letters))

    def add(value: Any) -> Ref:
        objects.append(value)
        return Ref(len(objects), 0)

    if letters.codes:
        fonts["F2"] = letters.ref("U", add)
        letters.close(lambda ref, value: objects.__setitem__(ref.num - 1, value))
    info = add({"Title": title}).num if title is not None else None
    if outline and n:
        first = len(objects) + 1
        items = [{"Title": (labels or [])[i] if labels else f"Page {i + 1}", "Parent": Ref(first, 0), "Dest": [Ref(4 + 2 * i, 0), Name("Fit")]} for i in range(n)]
        for i, item in enumerate(items):
            if i + 1 < n:
                item["Next"] = Ref(first + i + 2, 0)
            if i:
                item["Prev"] = Ref(first + i, 0)
        objects.append({"Type": Name("Outlines"), "First": Ref(first + 1, 0), "Last": Ref(first + n, 0), "Count": n})
        objects.extend(items)
        catalog["Outlines"] = Ref(first, 0)
    return file_bytes(objects, info)


def jpeg_size(data: bytes) -> tuple[int, int, int]:
    """(width, height, components) of a JPEG file."""
    at = 2
    while at + 9 < len(data):
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width, parts = struct.unpack(">HHB", data[at + 5 : at + 10])
            return width, height, parts
        at += 2 + size
    raise ValueError("no JPEG image")


def image_object(data: bytes) -> Stream:
    """A JPEG image, or an 8-bit grey or coloured PNM one, as an object."""
    if m := re.match(rb"P([56])\s+(\d+)\s+(\d+)\s+255\s", data):
        width, height, parts = int(m[2]), int(m[3]), 1 if m[1] == b"5" else 3
        body, coding = zlib.compress(data[m.end() :]), "FlateDecode"
    else:
        (width, height, parts), body, coding = jpeg_size(data), data, "DCTDecode"
    space = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}[parts]
    return Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height, "ColorSpace": Name(space), "BitsPerComponent": 8, "Filter": Name(coding)}, body)
