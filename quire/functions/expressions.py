"""Spark expressions for text, geometry and labels that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What separates words, and what Python's strip() removes.
WORD = r"[^\x00-\x20\u00a0\u202a-\u202e]+"
PY_SPACE = r"\x09-\x0d\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
KNOWN_SCHEMES = ["http", "https", "mailto"]


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def strip(text: Column) -> Column:
    """Python's strip: wider than SQL trim."""
    return F.btrim(text, F.lit("".join(c for c in map(chr, range(0x3001)) if c.isspace())))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(rf"[^{PY_SPACE}]")


def text_lines(text: Column) -> Column:
    """Stripped lines without the blank ones, as comparison sees a page."""
    return F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda x: x != "")


def literal_hits(text: Column, query: str) -> Column:
    """How often an ASCII phrase occurs, any white space matching any."""
    return F.regexp_count(text, F.lit(phrase_pattern(query))).cast("bigint")


def phrase_pattern(query: str) -> str:
    """A case-insensitive pattern of the phrase's words; nothing matches for a blank phrase."""
    import re

    parts = [re.sub(r"([^A-Za-z0-9_])", r"\\\1", w) for w in query.split()]
    return "(?i)" + r"[ \t\n\r\f\x0b]+".join(parts) if parts else r"[^\x00-\x{10FFFF}]"


def replace_literal(text: Column, find: str, replacement: str) -> Column:
    return F.replace(text, F.lit(find), F.lit(replacement))


def scheme(uri: Column) -> Column:
    """Lower-case scheme, empty without a colon."""
    return F.when(F.contains(uri, F.lit(":")), F.lower(F.substring_index(uri, ":", 1))).otherwise("")


def has_scheme(uri: Column) -> Column:
    return uri.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")


def link_unsafe(kind: Column, uri: Column) -> Column:
    """URIs of other schemes than the known, launches and remote jumps are unsafe; jumps inside never are."""
    return ((kind == "uri") & ~scheme(uri).isin(KNOWN_SCHEMES)) | kind.isin("launch", "gotor")


def round_half_even_1(x: Column) -> Column:
    """One decimal through single precision, halves to even."""
    return F.rint(x.cast("float").cast("double") * 10) / 10


def rect_overlaps(a: Column, b: Column) -> Column:
    return (a.x0 < b.x1) & (b.x0 < a.x1) & (a.y0 < b.y1) & (b.y0 < a.y1)


def rect_union(x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    """Aggregates of the smallest rectangle around a group's."""
    return [F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1")]


def permissions(flags: Column) -> Column:
    """The permission booleans of a signed 32-bit mask, by bit."""
    # Bit of each permission.
    bits = {"print": 4, "modify": 8, "copy": 16, "annotate": 32, "fill_forms": 256, "extract": 512, "assemble": 1024, "print_high": 2048}
    return F.struct(*[(flags.bitwiseAND(F.lit(b)) != 0).alias(k) for k, b in bits.items()])


def human_size(n: Column) -> Column:
    """1023B, 1.5KB and so on up to TB."""
    out = F.concat(n.cast("string"), F.lit("B"))
    for power, unit in enumerate(["KB", "MB", "GB", "TB"], 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f{unit}", n / float(1024**power))).otherwise(out)
    return out


def roman(n: Column, upper: bool = True) -> Column:
    """Roman numeral of n from 1."""
    # The numerals of ones, tens and hundreds.
    ones = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]
    tens = ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"]
    hundreds = ["", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"]
    digit = lambda table, unit: F.get(F.array(*map(F.lit, table)), (F.floor(n / unit) % 10).cast("int"))
    out = F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), digit(hundreds, 100), digit(tens, 10), digit(ones, 1))
    return F.upper(out) if upper else out


def letters(n: Column, upper: bool = True) -> Column:
    """a to z, then aa, bb and so on: the letter repeats."""
    k = n.cast("int") - 1
    letter = F.char(F.pmod(k, F.lit(26)) + (65 if upper else 97))
    return F.repeat(letter, (F.floor(k / 26) + 1).cast("int"))


def label(style: Column, number: Column) -> Column:
    """A page label's number in its style: D, R, r, A, a, or none."""
    return (
        F.when(style == "D", number.cast("string"))
        .when(style == "R", roman(number, True))
        .when(style == "r", roman(number, False))
        .when(style == "A", letters(number, True))
        .when(style == "a", letters(number, False))
        .otherwise("")
    )


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles, in element order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; a zero vector scores 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 1e-12, dot(a, b) / norm).otherwise(F.lit(0.0))


def template(text: str, page: Column, pages: Column) -> Column:
    """``{page}`` and ``{pages}`` filled in."""
    return F.replace(F.replace(F.lit(text), F.lit("{page}"), page.cast("string")), F.lit("{pages}"), pages.cast("string"))


def bates(prefix: str, number: Column, digits: int) -> Column:
    """Zero-padded number; a minus sign counts inside the width."""
    return F.concat(F.lit(prefix), F.format_string(f"%0{digits}d", number))
