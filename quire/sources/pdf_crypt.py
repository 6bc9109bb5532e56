"""The standard security handler: opening protected files with a password, and protecting new ones.

RC4 of 40 to 128 bits, AES of 128 bits and AES of 256 bits (revisions 2 to 6). Keys derive from a user or an owner
password as the format has it; the cipher tables are built from their field's rule.
"""

from __future__ import annotations

import hashlib
import os
import struct
from typing import Any

from quire.sources.pdf import Document, Name, Ref, Stream
from quire.sources.pdf_write import file_bytes

# Fixed value: what fills a password up to 32 bytes.
FILL = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")
# The bit of each permission.
ALLOW = {"print": 4, "modify": 8, "copy": 16, "annotate": 32, "fill_forms": 256, "extract": 512, "assemble": 1024, "print_high": 2048}


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        a = s[i]
        j = (j + a) & 255
        b = s[i] = s[j]
        s[j] = a
        out[n] = c ^ s[(a + b) & 255]
    return bytes(out)


def _double(x: int) -> int:
    return (x << 1) ^ (0x11B if x & 0x80 else 0)


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a, b = _double(a), b >> 1
    return out


def _boxes() -> tuple[list[int], list[int]]:
    """The substitution of bytes: the inverse in the field of 256 elements, then an affine map; and its inverse."""
    power, log, x = [0] * 255, [0] * 256, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= _double(x)
    box = []
    for v in range(256):
        q = power[-log[v] % 255] if v else 0
        box.append(q ^ 0x63 ^ (q << 1 | q >> 7) & 255 ^ (q << 2 | q >> 6) & 255 ^ (q << 3 | q >> 5) & 255 ^ (q << 4 | q >> 4) & 255)
    back = [0] * 256
    for i, v in enumerate(box):
        back[v] = i
    return box, back


_BOX, _BACK = _boxes()
_SHIFT = [0, 5, 10, 15, 4, 9, 14, 3, 8, 13, 2, 7, 12, 1, 6, 11]
_UNSHIFT = [_SHIFT.index(i) for i in range(16)]
_BY = {k: [_times(v, k) for v in range(256)] for k in (9, 11, 13, 14)}
_COLUMN = [_times(v, 2) << 24 | v << 16 | v << 8 | _times(v, 3) for v in _BOX]
_ROUND = [[(x >> 8 * i | x << 32 - 8 * i) & 0xFFFFFFFF for x in _COLUMN] for i in range(4)]


class Aes:
    """The block cipher under one key of 16 or 32 bytes."""

    def __init__(self, key: bytes) -> None:
        n, words, add = len(key) // 4, [list(key[i : i + 4]) for i in range(0, len(key), 4)], 1
        for i in range(n, 4 * (n + 7)):
            w = list(words[-1])
            if i % n == 0:
                w = [_BOX[b] for b in w[1:] + w[:1]]
                w[0] ^= add
                add = _double(add)
            elif n > 6 and i % n == 4:
                w = [_BOX[b] for b in w]
            words.append([a ^ b for a, b in zip(words[i - n], w, strict=True)])
        self.keys = [sum(words[4 * r : 4 * r + 4], []) for r in range(n + 7)]
        self.words = [struct.unpack(">4I", bytes(k)) for k in self.keys]

    def block(self, data: bytes) -> bytes:
        t0, t1, t2, t3 = _ROUND
        a, b, c, d = (x ^ k for x, k in zip(struct.unpack(">4I", data), self.words[0], strict=True))
        for k0, k1, k2, k3 in self.words[1:-1]:
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k0,
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k1,
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ k2,
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ k3,
            )
        s = struct.pack(">4I", a, b, c, d)
        return bytes(_BOX[s[i]] ^ k for i, k in zip(_SHIFT, self.keys[-1], strict=True))

    def unblock(self, data: bytes) -> bytes:
        nine, eleven, thirteen, fourteen = (_BY[k] for k in (9, 11, 13, 14))
        s = [a ^ b for a, b in zip(data, self.keys[-1], strict=True)]
        for key in self.keys[-2:0:-1]:
            t, s = [_BACK[s[i]] ^ k for i, k in zip(_UNSHIFT, key, strict=True)], []
            for c in (0, 4, 8, 12):
                a, b, d, e = t[c : c + 4]
                s += [fourteen[a] ^ eleven[b] ^ thirteen[d] ^ nine[e], nine[a] ^ fourteen[b] ^ eleven[d] ^ thirteen[e], thirteen[a] ^ nine[b] ^ fourteen[d] ^ eleven[e], eleven[a] ^ thirteen[b] ^ nine[d] ^ fourteen[e]]
        return bytes(_BACK[s[i]] ^ k for i, k in zip(_UNSHIFT, self.keys[0], strict=True))

    def chain(self, data: bytes, last: bytes) -> bytes:
        out = []
        for i in range(0, len(data), 16):
            last = self.block((int.from_bytes(data[i : i + 16]) ^ int.from_bytes(last)).to_bytes(16))
            out.append(last)
        return b"".join(out)

    def unchain(self, data: bytes, last: bytes) -> bytes:
        out = []
        for i in range(0, len(data) - 15, 16):
            block = data[i : i + 16]
            out.append(bytes(a ^ b for a, b in zip(self.unblock(block), last, strict=True)))
            last = block
        return b"".join(out)


def seal(key: bytes, data: bytes) -> bytes:
    start, pad = os.urandom(16), 16 - len(data) % 16
    return start + Aes(key).chain(data + bytes([pad]) * pad, start)


def unseal(key: bytes, data: bytes) -> bytes:
    if len(data) < 32:
        return b""
    out = Aes(key).unchain(data[16:], data[:16])
    return out[: -out[-1]] if out and 1 <= out[-1] <= 16 else out


def _padded(password: bytes) -> bytes:
    return (password + FILL)[:32]


def _file_key(password: bytes, owner: bytes, flags: int, ident: bytes, revision: int, size: int, plain_metadata: bool) -> bytes:
    seed = _padded(password) + owner[:32] + struct.pack("<i", flags) + ident + (b"\xff" * 4 if revision >= 4 and plain_metadata else b"")
    key = hashlib.md5(seed).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key[:size]).digest()
    return key[:size]


def _owner_key(password: bytes, revision: int, size: int) -> bytes:
    key = hashlib.md5(_padded(password)).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key).digest()
    return key[:size]


def _rounds(key: bytes, data: bytes, revision: int, back: bool = False) -> bytes:
    for i in range(20 if revision >= 3 else 1):
        n = 19 - i if back and revision >= 3 else i
        data = rc4(bytes(k ^ n for k in key), data)
    return data


def _user_entry(key: bytes, ident: bytes, revision: int) -> bytes:
    return rc4(key, FILL) if revision == 2 else _rounds(key, hashlib.md5(FILL + ident).digest(), 3) + bytes(16)


def hardened(password: bytes, salt: bytes, extra: bytes, revision: int) -> bytes:
    """The hash of a password for 256-bit keys; from revision 6 on in many rounds."""
    out = hashlib.sha256(password + salt + extra).digest()
    i = 0
    while revision >= 6:
        coded = Aes(out[:16]).chain((password + out + extra) * 64, out[16:32])
        out = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(coded[:16]) % 3](coded).digest()
        i += 1
        if i >= 64 and coded[-1] <= i - 32:
            break
    return out[:32]


class Handler:
    """Decrypts the objects of one file."""

    def __init__(self, key: bytes, strings: str, streams: str) -> None:
        self.key, self.strings, self.streams = key, strings, streams

    def _of(self, num: int, gen: int, method: str) -> bytes:
        if method == "AESV3":
            return self.key
        seed = self.key + struct.pack("<I", num)[:3] + struct.pack("<I", gen)[:2] + (b"sAlT" if method == "AESV2" else b"")
        return hashlib.md5(seed).digest()[: min(len(self.key) + 5, 16)]

    def turn(self, data: bytes, num: int, gen: int, method: str, on: bool) -> bytes:
        if method == "None":
            return data
        key = self._of(num, gen, method)
        return rc4(key, data) if method == "V2" else seal(key, data) if on else unseal(key, data)

    def whole(self, value: Any, num: int, gen: int, on: bool = False) -> Any:
        """An object with all its strings and its stream decrypted (or, with on, encrypted)."""
        if isinstance(value, Name):
            return value
        if isinstance(value, str):
            value = value.encode("latin-1") if value.isascii() else b"\xfe\xff" + value.encode("utf-16-be")
        if isinstance(value, bytes):
            return self.turn(value, num, gen, self.strings, on)
        if isinstance(value, Stream):
            if value.dict.get("Type") == "XRef":
                return value
            return Stream(self.whole(value.dict, num, gen, on), self.turn(value.raw, num, gen, self.streams, on))
        if isinstance(value, dict):
            return {k: self.whole(v, num, gen, on) for k, v in value.items()}
        return [self.whole(v, num, gen, on) for v in value] if isinstance(value, list) else value


def opened(doc: Document, password: str) -> Handler | None:
    """The handler that the password opens, as the user's or the owner's; None if it opens none."""
    e = {k: doc.get(v) for k, v in doc.get(doc.trailer["Encrypt"]).items()}
    if e.get("Filter") != "Standard":
        return None
    version, revision = int(e.get("V") or 0), int(e.get("R") or 0)
    ident = doc.get(doc.trailer.get("ID")) or [b""]
    ident = doc.get(ident[0]) or b""
    size = (int(e.get("Length") or 40) // 8) if version > 1 else 5
    methods = {"strings": "V2", "streams": "V2"}
    if version >= 4:
        filters = doc.get(e.get("CF")) or {}
        for to, key in (("strings", "StrF"), ("streams", "StmF")):
            own = doc.get(filters.get(e.get(key) or "Identity"))
            methods[to] = str(doc.get(own.get("CFM"))) if isinstance(own, dict) else "None"
        size = 16
    key = None
    if revision >= 5:
        word = password.encode()[:127]
        u, o = e["U"][:48], e["O"][:48]
        if hardened(word, u[32:40], b"", revision) == u[:32]:
            key = Aes(hardened(word, u[40:48], b"", revision)).unchain(e["UE"][:32], bytes(16))
        elif hardened(word, o[32:40], u, revision) == o[:32]:
            key = Aes(hardened(word, o[40:48], u, revision)).unchain(e["OE"][:32], bytes(16))
    else:
        plain = e.get("EncryptMetadata") is False
        word = password.encode("cp1252", "replace")
        for user in (word, _rounds(_owner_key(word, revision, size), e["O"][:32], revision, back=True)):
            made = _file_key(user, e["O"], int(e["P"]) - (1 << 32 if int(e["P"]) >= 1 << 31 else 0), ident, revision, size, plain)
            if _user_entry(made, ident, revision)[:16] == e["U"][:16]:
                key = made
                break
    return None if key is None else Handler(key, **methods)


def protected(objects: list[Any], info: int | None, user: str = "", owner: str = "", allow: tuple[str, ...] = tuple(ALLOW), method: str = "aes256") -> bytes:
    """A file of the objects that a password opens; without an owner's password the user's is it."""
    owner = owner or user
    flags = -4 & ~sum(ALLOW.values()) | sum(ALLOW[k] for k in set(allow))
    ident = os.urandom(16)
    if method == "aes256":
        key, salts = os.urandom(32), [os.urandom(8) for _ in range(4)]
        u, o = user.encode()[:127], owner.encode()[:127]
        eu = hardened(u, salts[0], b"", 6) + salts[0] + salts[1]
        eo = hardened(o, salts[2], eu, 6) + salts[2] + salts[3]
        perms = struct.pack("<i", flags) + b"\xff\xff\xff\xffTadb" + os.urandom(4)
        e = {"V": 5, "R": 6, "Length": 256, "O": eo, "U": eu, "UE": Aes(hardened(u, salts[1], b"", 6)).chain(key, bytes(16)), "OE": Aes(hardened(o, salts[3], eu, 6)).chain(key, bytes(16)), "Perms": Aes(key).block(perms)}
        kind = "AESV3"
    else:
        revision, kind = {"rc4": (3, "V2"), "aes128": (4, "AESV2")}[method]
        u, o = user.encode("cp1252"), owner.encode("cp1252")
        entry = _rounds(_owner_key(o, revision, 16), _padded(u), revision)
        key = _file_key(u, entry, flags, ident, revision, 16, False)
        e = {"V": 2 if revision == 3 else 4, "R": revision, "Length": 128, "O": entry, "U": _user_entry(key, ident, revision)}
    if kind != "V2":
        e |= {"CF": {"StdCF": {"CFM": Name(kind), "AuthEvent": Name("DocOpen"), "Length": len(key)}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    handler = Handler(key, kind, kind)
    sealed = [handler.whole(v, i, 0, on=True) for i, v in enumerate(objects, 1)]
    return file_bytes([*sealed, {"Filter": Name("Standard"), "P": flags} | e], info, {"Encrypt": Ref(len(objects) + 1, 0), "ID": [ident, ident]})
