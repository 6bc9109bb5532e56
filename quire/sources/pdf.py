"""PDF files as tables: a tolerant reader, a plain writer, and a Python data source named ``pdf``.

The reader knows cross-reference tables and streams, object streams, hybrid and incremental files (the newest entry
of an object wins) and damaged files (objects are found by scanning; ``repaired`` says so). It decodes Flate, LZW,
ASCII-85, ASCII-hex and run-length streams with their predictors, walks the page tree with inherited attributes,
and reads information, outlines, links, annotations, form fields, attachments and the text of simple fonts, with
positions. Encrypted files are reported as such. Rasterising, signatures and fonts' outlines are not its business.

Depths and sizes are bounded: page trees 64, references 32, nesting 256, a decoded stream 512 MiB.
"""

from __future__ import annotations

import contextlib
import re
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

MOST_DECODED = 512 << 20
PAGE_DEPTH, REFERENCE_DEPTH, NESTING = 64, 32, 256
DEFAULT_BOX = [0.0, 0.0, 612.0, 792.0]
_SPACE = b"\0\t\n\f\r "
_DELIMITER = b"()<>[]{}/%"
_TOKEN = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_NUMBER = re.compile(rb"[+-]?(\d+\.?\d*|\.\d+)$")


class Ref(NamedTuple):
    num: int
    gen: int


class Name(str):
    __slots__ = ()


class Stream(NamedTuple):
    dict: dict
    raw: bytes


class Keyword(bytes):
    __slots__ = ()


class Damaged(ValueError):
    """The file cannot be read as far as asked."""


class Lexer:
    """Objects and operators from bytes."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def skip(self) -> None:
        data, n = self.data, len(self.data)
        while self.at < n:
            c = data[self.at]
            if c in _SPACE:
                self.at += 1
            elif c == 37:
                ends = [e for e in (data.find(b"\n", self.at), data.find(b"\r", self.at)) if e >= 0]
                self.at = min(ends) if ends else n
            else:
                return

    def next(self, depth: int = 0) -> Any:
        """The next object; a Keyword for operators and words; None at the end."""
        self.skip()
        data, at = self.data, self.at
        if at >= len(data) or depth > NESTING:
            return None
        c = data[at : at + 1]
        if c == b"/":
            m = _TOKEN.match(data, at + 1)
            raw = m[0] if m else b""
            self.at = at + 1 + len(raw)
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw).decode("latin-1"))
        if data[at : at + 2] == b"<<":
            self.at += 2
            out: dict = {}
            while True:
                self.skip()
                if data[self.at : self.at + 2] == b">>" or self.at >= len(data):
                    self.at += 2
                    return out
                key = self.next(depth + 1)
                value = self.reference(depth + 1)
                if isinstance(key, Name):
                    out[str(key)] = value
                elif key is None:
                    return out
        if c == b"[":
            self.at += 1
            items = []
            while True:
                self.skip()
                if data[self.at : self.at + 1] in (b"]", b""):
                    self.at += 1
                    return items
                items.append(self.reference(depth + 1))
        if c == b"(":
            return self.literal()
        if c == b"<":
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        m = _TOKEN.match(data, at)
        if not m:
            self.at += 1
            return Keyword(c)
        self.at = m.end()
        word = m[0]
        if _NUMBER.match(word):
            return float(word) if b"." in word else int(word)
        return {b"true": True, b"false": False}.get(word, Keyword(word)) if word != b"null" else Keyword(b"null")

    def reference(self, depth: int) -> Any:
        """An object in which ``n g R`` is one."""
        first = self.next(depth)
        if isinstance(first, int) and not isinstance(first, bool) and first >= 0:
            back = self.at
            second = self.next(depth)
            if isinstance(second, int) and self.next(depth) == b"R":
                return Ref(first, second)
            self.at = back
        return None if isinstance(first, Keyword) and first == b"null" else first

    def literal(self) -> bytes:
        out, depth, data = bytearray(), 0, self.data
        at = self.at
        simple = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}
        while at < len(data):
            c = data[at]
            if c == 92:
                at += 1
                e = data[at] if at < len(data) else 0
                if m := re.match(rb"[0-7]{1,3}", data[at : at + 3]):
                    out.append(int(m[0], 8) & 255)
                    at += len(m[0])
                    continue
                if e in (10, 13):
                    at += 2 if data[at : at + 2] == b"\r\n" else 1
                    continue
                out.append(simple.get(e, e))
            elif c == 40:
                depth += 1
                if depth > 1:
                    out.append(c)
            elif c == 41:
                depth -= 1
                if not depth:
                    at += 1
                    break
                out.append(c)
            else:
                out.append(c)
            at += 1
        self.at = at
        return bytes(out)


def lzw(data: bytes, early: int = 1) -> bytes:
    out, table, width, bits, held, before = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        while bits >= width:
            code = held >> (bits - width) & ((1 << width) - 1)
            bits -= width
            if code == 256:
                table, width, before = table[:258], 9, b""
                continue
            if code == 257:
                return bytes(out)
            entry = table[code] if code < len(table) else before + before[:1]
            out += entry
            if before and len(table) < 4096:
                table.append(before + entry[:1])
            before = entry
            width = min(12, max(9, (len(table) + early).bit_length()))
            if len(out) > MOST_DECODED:
                return bytes(out)
    return bytes(out)


def run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.split(b"~")[0]:
        if c == 122 and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                value = 0
                for g in group:
                    value = value * 85 + g
                out += (value & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        value, n = 0, len(group)
        for g in group + [84] * (5 - n):
            value = value * 85 + g
        out += (value & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out)


def unpredicted(data: bytes, parms: dict) -> bytes:
    kind = parms.get("Predictor", 1)
    if kind < 2:
        return data
    colors, depth, columns = parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    step, row = max(1, colors * depth // 8), (colors * depth * columns + 7) // 8
    out, above = bytearray(), bytearray(row)
    size = row + (kind >= 10)
    for at in range(0, len(data), size):
        part = bytearray(data[at : at + size])
        tag = part.pop(0) if kind >= 10 else 1
        part += bytes(row - len(part))
        for i in range(row):
            left = part[i - step] if i >= step else 0
            up, corner = above[i], above[i - step] if i >= step else 0
            if tag == 1:
                add = left
            elif tag == 2:
                add = up
            elif tag == 3:
                add = (left + up) // 2
            elif tag == 4:
                guess = left + up - corner
                add = min((left, up, corner), key=lambda v: abs(guess - v))  # noqa: B023
            else:
                add = 0
            part[i] = (part[i] + add) & 255
        out += part
        above = part
    return bytes(out)


def inflate(raw: bytes) -> bytes:
    """As much as can be decompressed."""
    for bits in (15, -15):
        unzip, out = zlib.decompressobj(bits), bytearray()
        try:
            for at in range(0, len(raw), 1 << 16):
                out += unzip.decompress(raw[at : at + (1 << 16)], MOST_DECODED)
                if len(out) > MOST_DECODED:
                    break
            return bytes(out)
        except zlib.error:
            if out:
                return bytes(out)
    return b""


class Document:
    """A file's objects; lazily parsed, newest entries first."""

    def __init__(self, data: bytes, password: str = "") -> None:
        self.data, self.cache, self.places, self.trailer, self.repaired, self.security = data, {}, {}, {}, False, None
        self.inside: dict[int, tuple[int, int]] = {}
        try:
            self._chain()
            if not isinstance(self.get(self.trailer.get("Root")), dict) or not self.page_list():
                raise Damaged("no pages")
        except (ValueError, TypeError, IndexError, KeyError, AttributeError, RecursionError):
            if "Encrypt" not in self.trailer or not self.places:
                self._scan()
        if self.encrypted:
            from quire.sources.pdf_crypt import opened

            with contextlib.suppress(ValueError, TypeError, IndexError, KeyError, AttributeError):
                self.security = opened(self, password)
            self.cache = {}

    @property
    def encrypted(self) -> bool:
        return "Encrypt" in self.trailer

    @property
    def locked(self) -> bool:
        """Whether the password given does not open the file."""
        return self.encrypted and self.security is None

    def _chain(self) -> None:
        at = self.data.rfind(b"startxref")
        m = re.match(rb"startxref\s+(\d+)", self.data[at : at + 40]) if at >= 0 else None
        if not m:
            raise Damaged("no startxref")
        todo, seen = [int(m[1])], set()
        while todo and len(seen) < 4096:
            at = todo.pop(0)
            if at in seen or not 0 <= at < len(self.data):
                if not seen:
                    raise Damaged("bad offset")
                continue
            seen.add(at)
            trailer = self._table(at) if re.match(rb"\s*xref", self.data[at : at + 20]) else self._xref_stream(at)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            if isinstance(trailer.get("XRefStm"), int):
                todo.append(trailer["XRefStm"])
            if isinstance(trailer.get("Prev"), int | float):
                todo.append(int(trailer["Prev"]))

    def _table(self, at: int) -> dict:
        lexer = Lexer(self.data, self.data.index(b"xref", at) + 4)
        while True:
            first = lexer.next()
            if first == b"trailer":
                out = lexer.next()
                if not isinstance(out, dict):
                    raise Damaged("no trailer")
                return out
            count = lexer.next()
            if not isinstance(first, int) or not isinstance(count, int):
                raise Damaged("bad table")
            for i in range(count):
                offset, gen, kind = lexer.next(), lexer.next(), lexer.next()
                if kind == b"n" and offset:
                    self.places.setdefault(first + i, (offset, gen))
                elif kind not in (b"n", b"f"):
                    raise Damaged("bad entry")
                else:
                    self.places.setdefault(first + i, None)

    def _xref_stream(self, at: int) -> dict:
        s = self._object_at(at)[1]
        if not isinstance(s, Stream) or s.dict.get("Type") != "XRef":
            raise Damaged("no cross-reference stream")
        rows, w = self.decoded(s), s.dict["W"]
        index = s.dict.get("Index", [0, s.dict.get("Size", 0)])
        size, pos = sum(w), 0
        for first, count in zip(index[::2], index[1::2], strict=False):
            for i in range(count):
                f, at_ = [], pos
                for width in w:
                    f.append(int.from_bytes(rows[at_ : at_ + width], "big"))
                    at_ += width
                pos += size
                kind = f[0] if w[0] else 1
                num = first + i
                if num in self.places or num in self.inside:
                    continue
                if kind == 1:
                    self.places[num] = (f[1], f[2])
                elif kind == 2:
                    self.inside[num] = (f[1], f[2])
                else:
                    self.places[num] = None
        return s.dict

    def _scan(self) -> None:
        """Find objects where they stand; the last of a number wins."""
        self.repaired, self.cache, self.inside = True, {}, {}
        self.places = {int(m[1]): (m.start(1), int(m[2])) for m in re.finditer(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\b", self.data)}
        for m in re.finditer(rb"trailer\s*<<", self.data):
            found = Lexer(self.data, m.start() + 7).next()
            if isinstance(found, dict):
                self.trailer |= found
        for num in list(self.places):
            s = self.get(Ref(num, 0))
            if isinstance(s, Stream) and s.dict.get("Type") == "ObjStm":
                for i, inner in enumerate(self._numbers(s)):
                    self.inside.setdefault(inner, (num, i))
            elif isinstance(s, Stream) and s.dict.get("Type") == "XRef":
                self.trailer |= {k: v for k, v in s.dict.items() if k in ("Root", "Info", "Encrypt")}
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            for num in [*self.places, *self.inside]:
                d = self.get(Ref(num, 0))
                if isinstance(d, dict) and d.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(num, 0)

    def _object_at(self, at: int) -> tuple[int, Any]:
        lexer = Lexer(self.data, at)
        num, _, word = lexer.next(), lexer.next(), lexer.next()
        if word != b"obj":
            raise Damaged("no object")
        value = lexer.reference(0)
        lexer.skip()
        if isinstance(value, dict) and self.data[lexer.at : lexer.at + 6] == b"stream":
            start = lexer.at + 6
            start += 2 if self.data[start : start + 2] == b"\r\n" else 1
            length = value.get("Length")
            length = self.get(length) if isinstance(length, Ref) else length
            end = start + length if isinstance(length, int) else -1
            if end < start or not re.match(rb"\s*endstream", self.data[end : end + 12]):
                end = self.data.find(b"endstream", start)
                end = len(self.data) if end < 0 else end
            return num, Stream(value, self.data[start:end])
        return num, value

    def _numbers(self, s: Stream) -> list[int]:
        lexer = Lexer(self.decoded(s))
        return [[lexer.next(), lexer.next()][0] for _ in range(int(self.get(s.dict.get("N")) or 0))]

    def get(self, value: Any, depth: int = 0) -> Any:
        """The object behind references."""
        while isinstance(value, Ref):
            if depth > REFERENCE_DEPTH:
                return None
            depth += 1
            num = value.num
            if num not in self.cache:
                self.cache[num] = None
                self.cache[num] = self._load(num)
            value = self.cache[num]
        return value

    def _load(self, num: int) -> Any:
        try:
            if place := self.places.get(num):
                found, value = self._object_at(place[0])
                if found != num:
                    raise Damaged("another object stands there")
                return self.security.whole(value, num, place[1]) if self.security else value
            if num in self.inside:
                container = self.get(Ref(self.inside[num][0], 0))
                if isinstance(container, Stream):
                    body = self.decoded(container)
                    lexer, first = Lexer(body), int(self.get(container.dict["First"]))
                    heads = [(lexer.next(), lexer.next()) for _ in range(int(self.get(container.dict["N"])))]
                    at = dict(heads).get(num)
                    return None if at is None else Lexer(body, first + at).reference(0)
        except (IndexError, TypeError, KeyError):
            pass
        return None

    def decoded(self, s: Stream) -> bytes:
        """A stream's bytes after its filters, up to an image filter."""
        filters = self.get(s.dict.get("Filter")) or []
        parms = self.get(s.dict.get("DecodeParms")) or []
        filters, parms = (x if isinstance(x, list) else [x] for x in (filters, parms))
        data = s.raw
        for i, f in enumerate(filters):
            p = self.get(parms[i]) if i < len(parms) else None
            p = {k: self.get(v) for k, v in p.items()} if isinstance(p, dict) else {}
            f = self.get(f)
            if f in ("FlateDecode", "Fl"):
                data = unpredicted(inflate(data), p)
            elif f in ("LZWDecode", "LZW"):
                data = unpredicted(lzw(data, p.get("EarlyChange", 1)), p)
            elif f in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            elif f in ("ASCII85Decode", "A85"):
                data = ascii85(data)
            elif f in ("RunLengthDecode", "RL"):
                data = run_length(data)
            elif f != "Crypt":
                break
        return data

    def root(self) -> dict:
        found = self.get(self.trailer.get("Root"))
        return found if isinstance(found, dict) else {}

    def page_list(self) -> list[tuple[Ref | None, dict]]:
        """Pages in order with inherited attributes; a node that comes twice counts once."""
        out: list[tuple[Ref | None, dict]] = []
        seen: set[Ref] = set()

        def walk(node: Any, given: dict, depth: int) -> None:
            ref = node if isinstance(node, Ref) else None
            d = self.get(node)
            if depth > PAGE_DEPTH or not isinstance(d, dict) or (ref and ref in seen):
                return
            if ref:
                seen.add(ref)
            own = given | {k: d[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in d}
            kids = self.get(d.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    walk(kid, own, depth + 1)
            else:
                out.append((ref, own | d))

        walk(self.root().get("Pages"), {}, 0)
        return out

    def text(self, value: Any) -> str:
        """A text string: UTF-16 or UTF-8 by its mark, else Latin."""
        value = self.get(value)
        if isinstance(value, Name):
            return str(value)
        if not isinstance(value, bytes):
            return ""
        if value[:2] in (b"\xfe\xff", b"\xff\xfe"):
            return value.decode("utf-16", "replace")
        return value[3:].decode("utf-8", "replace") if value[:3] == b"\xef\xbb\xbf" else value.decode("cp1252", "replace")

    def info(self) -> dict[str, str]:
        found = self.get(self.trailer.get("Info"))
        return {k.lower(): t for k, v in found.items() if (t := self.text(v))} if isinstance(found, dict) else {}

    def box(self, page: dict) -> list[float]:
        """The crop box within the media box."""
        rect = lambda v: [float(self.get(x)) for x in r] if isinstance(r := self.get(v), list) and len(r) == 4 else None
        norm = lambda r: [min(r[0], r[2]), min(r[1], r[3]), max(r[0], r[2]), max(r[1], r[3])]
        media = norm(rect(page.get("MediaBox")) or DEFAULT_BOX)
        crop = rect(page.get("CropBox"))
        if crop is None:
            return media
        crop = norm(crop)
        both = [max(media[0], crop[0]), max(media[1], crop[1]), min(media[2], crop[2]), min(media[3], crop[3])]
        return both if both[0] < both[2] and both[1] < both[3] else media

    def contents(self, page: dict) -> bytes:
        c = self.get(page.get("Contents"))
        parts = c if isinstance(c, list) else [c]
        return b"\n".join(self.decoded(s) for p in parts if isinstance(s := self.get(p), Stream))

    def named(self, tree: Any, depth: int = 0) -> Iterator[tuple[str, Any]]:
        """Names and values of a name tree."""
        node = self.get(tree)
        if isinstance(node, dict) and depth < 64:
            names = self.get(node.get("Names")) or []
            yield from ((self.text(k), v) for k, v in zip(names[::2], names[1::2], strict=False))
            for kid in self.get(node.get("Kids")) or []:
                yield from self.named(kid, depth + 1)

    def destination(self, value: Any, index: dict[Ref, int], names: dict[str, Any]) -> int | None:
        """Zero-based page of an explicit or named destination."""
        for _ in range(4):
            value = self.get(value)
            if isinstance(value, bytes | Name):
                value = names.get(self.text(value))
            elif isinstance(value, dict):
                value = value.get("D")
            elif isinstance(value, list) and value:
                return index.get(value[0]) if isinstance(value[0], Ref) else value[0] if isinstance(value[0], int) else None
            else:
                return None
        return None

    def labels(self) -> list[str]:
        """The label of each page after the catalog's rules; empty texts without them."""
        rules: list[tuple[int, dict]] = []

        def walk(node: Any, depth: int) -> None:
            node = self.get(node)
            if isinstance(node, dict) and depth < 64:
                nums = self.get(node.get("Nums")) or []
                rules.extend((int(self.get(k)), r) for k, v in zip(nums[::2], nums[1::2], strict=False) if isinstance(r := self.get(v), dict))
                for kid in self.get(node.get("Kids")) or []:
                    walk(kid, depth + 1)

        walk(self.root().get("PageLabels"), 0)
        rules.sort(key=lambda r: r[0])
        out = []
        for i in range(len(self.page_list())):
            own = [r for r in rules if r[0] <= i]
            out.append(self._label(own[-1][1], i - own[-1][0]) if own else "")
        return out

    def _label(self, rule: dict, at: int) -> str:
        style, n = self.get(rule.get("S")), int(self.get(rule.get("St")) or 1) + at
        number = ""
        if style == "D":
            number = str(n)
        elif style in ("R", "r"):
            rest = n
            # Roman numerals.
            for value, letters in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
                number += letters * (rest // value)
                rest %= value
        elif style in ("A", "a"):
            number = chr(65 + (n - 1) % 26) * ((n - 1) // 26 + 1)
        return self.text(rule.get("P")) + (number.lower() if style in ("r", "a") else number)

    def destinations(self) -> dict[str, Any]:
        old = self.get(self.root().get("Dests"))
        found = dict(old) if isinstance(old, dict) else {}
        tree = self.get(self.root().get("Names"))
        return found | dict(self.named(tree.get("Dests"))) if isinstance(tree, dict) else found


class Word(NamedTuple):
    text: str
    x0: float
    y0: float
    x1: float
    y1: float


def _multiply(a: list[float], b: list[float]) -> list[float]:
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]


class Font:
    """Codes to text and widths for simple fonts, and for composite ones with a ToUnicode map."""

    def __init__(self, doc: Document, spec: Any) -> None:
        d = doc.get(spec)
        d = d if isinstance(d, dict) else {}
        self.wide = d.get("Subtype") == "Type0"
        self.first, self.widths = doc.get(d.get("FirstChar")) or 0, [doc.get(w) for w in doc.get(d.get("Widths")) or []]
        self.map: dict[int, str] = {}
        to = doc.get(d.get("ToUnicode"))
        if isinstance(to, Stream):
            self._read(doc.decoded(to))

    def _read(self, cmap: bytes) -> None:
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
            for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                self.map[int(a, 16)] = text(b)
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
            for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                for i in range(min(int(b, 16) - int(a, 16) + 1, 65536)):
                    start = text(c)
                    self.map[int(a, 16) + i] = start[:-1] + chr(ord(start[-1]) + i) if start else ""

    def spell(self, text: str) -> bytes:
        """The bytes that show a text; a blank that the font lacks is left out, any other letter is an error."""
        back, out = {v: k for k, v in self.map.items()}, b""
        for c in text:
            if c in back:
                out += back[c].to_bytes(2 if self.wide else 1, "big")
            elif not self.wide:
                out += c.encode("cp1252")
            elif c != " ":
                raise ValueError(f"the font lacks {c!r}")
        return out

    def codes(self, raw: bytes) -> Iterator[tuple[str, float]]:
        """(text, width in text units) of each code."""
        step = 2 if self.wide else 1
        for i in range(0, len(raw) - step + 1, step):
            code = int.from_bytes(raw[i : i + step], "big")
            k = code - self.first
            width = self.widths[k] if not self.wide and 0 <= k < len(self.widths) and isinstance(self.widths[k], int | float) else 500
            yield self.map.get(code) or (bytes([code]).decode("cp1252", "replace") if not self.wide else "\ufffd"), width / 1000


def page_words(doc: Document, page: dict) -> list[list[Word]]:
    """The page's words by line, in content order; y runs down from the top of the crop box."""
    x_min, _, _, y_max = doc.box(page)
    fonts: dict[int, Font] = {}
    lines: list[list[Word]] = [[]]
    pending: list[tuple[str, float, float, float]] = []

    def flush() -> None:
        if pending:
            size = max(p[3] for p in pending)
            y = y_max - pending[0][2]
            end = pending[-1][1]
            lines[-1].append(Word("".join(p[0] for p in pending), starts[0] - x_min, y - 0.8 * size, end - x_min, y + 0.2 * size))
            pending.clear()
            starts.clear()

    starts: list[float] = []
    pen: list[float] = [float("nan"), float("nan")]

    def show(raw: bytes, state: dict, resources: dict) -> None:
        font = state["font"]
        for text, width in font.codes(raw) if font else ():
            m = _multiply(state["tm"], state["ctm"])
            size = state["size"] * (abs(m[3]) or abs(m[1]) or 1)
            x, y = m[4], m[5] + state["rise"]
            if pen[0] == pen[0] and abs(y - pen[1]) > 0.5 * size:
                flush()
                if lines[-1]:
                    lines.append([])
            elif pen[0] == pen[0] and abs(x - pen[0]) > 0.2 * size:
                flush()
            move = (width * state["size"] + state["char"] + (state["word"] if text == " " else 0)) * state["scale"]
            state["tm"] = _multiply([1, 0, 0, 1, move, 0], state["tm"])
            after = _multiply(state["tm"], state["ctm"])[4]
            if text.strip() == "" or "\u202a" <= text <= "\u202e":
                flush()
            else:
                if not pending:
                    starts.append(x)
                pending.append((text, after, y, size))
            pen[:] = [after, y]

    def interpret(data: bytes, resources: dict, ctm: list[float], depth: int) -> None:
        state = {"ctm": ctm, "tm": [1, 0, 0, 1, 0, 0], "lm": [1, 0, 0, 1, 0, 0], "font": None, "size": 1.0, "lead": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "rise": 0.0}
        saved, stack, lexer = [], [], Lexer(data)
        own_fonts, forms = doc.get(resources.get("Font")) or {}, doc.get(resources.get("XObject")) or {}

        def line(x: float, y: float) -> None:
            state["lm"] = _multiply([1, 0, 0, 1, x, y], state["lm"])
            state["tm"] = state["lm"]

        while (token := lexer.next()) is not None:
            if not isinstance(token, Keyword):
                stack.append(token)
                if len(stack) > 4096:
                    stack.clear()
                continue
            op, n = bytes(token), [x for x in stack if isinstance(x, int | float)]
            if op == b"q":
                saved.append(dict(state))
            elif op == b"Q" and saved:
                state.update(saved.pop())
            elif op == b"cm" and len(n) >= 6:
                state["ctm"] = _multiply(n[-6:], state["ctm"])
            elif op == b"BT":
                state["tm"] = state["lm"] = [1, 0, 0, 1, 0, 0]
            elif op == b"Tf" and len(stack) >= 2 and isinstance(stack[0], Name) and n:
                spec = own_fonts.get(stack[0]) if isinstance(own_fonts, dict) else None
                key = id(spec) if not isinstance(spec, Ref) else spec.num
                state["font"] = fonts.get(key) or fonts.setdefault(key, Font(doc, spec))
                state["size"] = float(n[-1])
            elif op in (b"Td", b"TD") and len(n) >= 2:
                if op == b"TD":
                    state["lead"] = -n[-1]
                line(n[-2], n[-1])
            elif op == b"Tm" and len(n) >= 6:
                state["tm"] = state["lm"] = list(map(float, n[-6:]))
            elif op == b"T*":
                line(0, -state["lead"])
            elif op in (b"TL", b"Tc", b"Tw", b"Ts", b"Tz") and n:
                key = {b"TL": "lead", b"Tc": "char", b"Tw": "word", b"Ts": "rise", b"Tz": "scale"}[op]
                state[key] = n[-1] / 100 if op == b"Tz" else n[-1]
            elif op == b"Tj" and stack and isinstance(stack[-1], bytes):
                show(stack[-1], state, resources)
            elif op in (b"'", b'"') and stack and isinstance(stack[-1], bytes):
                if op == b'"' and len(n) >= 2:
                    state["word"], state["char"] = n[0], n[1]
                line(0, -state["lead"])
                show(stack[-1], state, resources)
            elif op == b"TJ" and stack and isinstance(stack[-1], list):
                for item in stack[-1]:
                    if isinstance(item, bytes):
                        show(item, state, resources)
                    elif isinstance(item, int | float):
                        state["tm"] = _multiply([1, 0, 0, 1, -item / 1000 * state["size"] * state["scale"], 0], state["tm"])
            elif op == b"Do" and stack and isinstance(stack[-1], Name) and depth < 16 and isinstance(forms, dict):
                form = doc.get(forms.get(stack[-1]))
                if isinstance(form, Stream) and form.dict.get("Subtype") == "Form":
                    matrix = [float(doc.get(v)) for v in doc.get(form.dict.get("Matrix")) or [1, 0, 0, 1, 0, 0]]
                    inner = doc.get(form.dict.get("Resources"))
                    flush()  # no word goes on from one form into another
                    interpret(doc.decoded(form), inner if isinstance(inner, dict) else resources, _multiply(matrix, state["ctm"]), depth + 1)
                    flush()
            elif op == b"BI":
                end = re.compile(rb"\sEI(?=[\s])").search(lexer.data, lexer.at)
                lexer.at = end.end() if end else len(lexer.data)
            stack.clear()

    resources = doc.get(page.get("Resources"))
    interpret(doc.contents(page), resources if isinstance(resources, dict) else {}, [1, 0, 0, 1, 0, 0], 0)
    flush()
    return [ln for ln in lines if ln]


class Edge(NamedTuple):
    """A straight line of a page, horizontal (h) or vertical (v)."""

    orient: str
    x0: float
    top: float
    x1: float
    bottom: float


THIN, STRAIGHT = 2.0, 0.5  # points: a painted box up to so thick is a line; a line may be so far from straight


def page_edges(doc: Document, page: dict) -> list[Edge]:
    """The straight lines that a page paints: strokes, sides of boxes, and boxes thin enough to be lines."""
    left, _, _, high = doc.box(page)
    out: list[Edge] = []

    def keep(x0: float, y0: float, x1: float, y1: float) -> None:
        x0, x1, top, bottom = min(x0, x1) - left, max(x0, x1) - left, high - max(y0, y1), high - min(y0, y1)
        if bottom - top <= STRAIGHT < x1 - x0:
            out.append(Edge("h", x0, (top + bottom) / 2, x1, (top + bottom) / 2))
        elif x1 - x0 <= STRAIGHT < bottom - top:
            out.append(Edge("v", (x0 + x1) / 2, top, (x0 + x1) / 2, bottom))

    def interpret(data: bytes, resources: dict, ctm: list[float], depth: int) -> None:
        saved, stack, lexer = [], [], Lexer(data)
        forms = doc.get(resources.get("XObject")) or {}
        lines: list[tuple[float, float, float, float]] = []
        boxes: list[tuple[float, float, float, float]] = []
        pen = start = (0.0, 0.0)
        at = lambda x, y: (x * ctm[0] + y * ctm[2] + ctm[4], x * ctm[1] + y * ctm[3] + ctm[5])
        while (token := lexer.next()) is not None:
            if not isinstance(token, Keyword):
                stack.append(token)
                if len(stack) > 4096:
                    stack.clear()
                continue
            op, n = bytes(token), [float(x) for x in stack if isinstance(x, int | float)]
            if op == b"q":
                saved.append(ctm)
            elif op == b"Q" and saved:
                ctm = saved.pop()
            elif op == b"cm" and len(n) >= 6:
                ctm = _multiply(n[-6:], ctm)
            elif op == b"m" and len(n) >= 2:
                pen = start = at(n[-2], n[-1])
            elif op == b"l" and len(n) >= 2:
                end = at(n[-2], n[-1])
                lines.append((*pen, *end))
                pen = end
            elif op in (b"c", b"v", b"y") and len(n) >= 4:
                pen = at(n[-2], n[-1])
            elif op in (b"h", b"s", b"b", b"b*") and pen != start:
                lines.append((*pen, *start))
                pen = start
            elif op == b"re" and len(n) >= 4:
                boxes.append((*at(n[-4], n[-3]), *at(n[-4] + n[-2], n[-3] + n[-1])))
            if op in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*"):
                if op in (b"S", b"s", b"B", b"B*", b"b", b"b*"):
                    for line in lines:
                        keep(*line)
                for x0, y0, x1, y1 in boxes:
                    if abs(y1 - y0) <= THIN:
                        keep(x0, (y0 + y1) / 2, x1, (y0 + y1) / 2)
                    elif abs(x1 - x0) <= THIN:
                        keep((x0 + x1) / 2, y0, (x0 + x1) / 2, y1)
                    else:
                        for side in ((x0, y0, x1, y0), (x0, y1, x1, y1), (x0, y0, x0, y1), (x1, y0, x1, y1)):
                            keep(*side)
            if op in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*", b"n"):
                lines, boxes = [], []
            elif op == b"Do" and stack and isinstance(stack[-1], Name) and depth < 16 and isinstance(forms, dict):
                form = doc.get(forms.get(stack[-1]))
                if isinstance(form, Stream) and form.dict.get("Subtype") == "Form":
                    matrix = [float(doc.get(v)) for v in doc.get(form.dict.get("Matrix")) or [1, 0, 0, 1, 0, 0]]
                    inner = doc.get(form.dict.get("Resources"))
                    interpret(doc.decoded(form), inner if isinstance(inner, dict) else resources, _multiply(matrix, ctm), depth + 1)
            elif op == b"BI":
                end = re.compile(rb"\sEI(?=[\s])").search(lexer.data, lexer.at)
                lexer.at = end.end() if end else len(lexer.data)
            stack.clear()

    resources = doc.get(page.get("Resources"))
    interpret(doc.contents(page), resources if isinstance(resources, dict) else {}, [1, 0, 0, 1, 0, 0], 0)
    return out
