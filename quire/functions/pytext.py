"""Functions whose results are defined by Python: regular expressions, rounding, dates, slugs, parsing, diffs."""

from __future__ import annotations

import datetime
import difflib
import re
import unicodedata
from collections import Counter
from fnmatch import fnmatchcase

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Latin ligatures and what they stand for.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st"}


# The pieces of a pattern that decide what a blank in it means.
_PIECES = re.compile(
    r"""(?P<escape>\\N\{[^}]*\}|\\.)
      | (?P<class>\[\^?\]?(?:\\.|[^\]\\])*\])
      | (?P<comment>\(\?\#(?:\\.|[^)\\])*\))
      | (?P<flags>\(\?[aiLmsux]*(?:-[imsx]+)?\))
      | (?P<behind>\(\?<[=!])
      | (?P<open>\()
      | (?P<close>\))
      | (?P<blank>[ ]+)
      | (?P<other>.)""",
    re.VERBOSE | re.DOTALL,
)


def hit_pattern(pattern: str) -> re.Pattern:
    """A search pattern: ligatures spelled out, and runs of blanks match any white space.

    Blanks in classes, comments and names keep their meaning, those in lookbehinds their width; in a verbose pattern
    they have none.
    """
    spelled = "".join(LIGATURES.get(c, c) for c in pattern)
    out, groups = [], [False]  # of each open group whether it lies in a lookbehind
    for m in _PIECES.finditer(spelled):
        kind = m.lastgroup
        if kind in ("flags", "open") and re.match(r"\(\?[aiLmsu]*x", spelled[m.start() :]):
            return re.compile(spelled, re.IGNORECASE | re.MULTILINE)
        if kind in ("open", "behind"):
            groups.append(groups[-1] or kind == "behind")
        elif kind == "close" and len(groups) > 1:
            groups.pop()
        out.append(r"(?:\s+)" if kind == "blank" and not groups[-1] else m[0])
    return re.compile("".join(out), re.IGNORECASE | re.MULTILINE)


def literal_pattern(query: str) -> re.Pattern | None:
    """The pattern of a literal query; None, which never matches, for a blank one."""
    parts = query.split()
    return hit_pattern(r"\s+".join(map(re.escape, parts))) if parts else None


def word_spans(texts: list[str], pattern: re.Pattern | None) -> list[tuple[int, int]]:
    """[first, last) words of each match in a page's words, a repeat of the match just before left out."""
    if pattern is None or not texts:
        return []
    joined, starts, at = "\n".join(texts), [], 0
    for t in texts:
        starts.append(at)
        at += len(t) + 1
    import bisect

    out: list[tuple[int, int]] = []
    for m in pattern.finditer(joined):
        first = max(bisect.bisect_right(starts, m.start()) - 1, 0)
        if m.start() == m.end():
            last = first + 1
        else:
            end_of_word = starts[first + 1] - 1 if first + 1 < len(starts) else len(joined)
            first += m.start() == end_of_word
            last = bisect.bisect_left(starts, m.end())
        if not out or out[-1] != (first, last):
            out.append((first, last))
    return out


def slugify(title: str, separator: str = "-") -> str:
    plain = unicodedata.normalize("NFKD", title).encode("ascii", "ignore").decode("ascii")
    return re.sub(rf"[{separator}\s]+", separator, re.sub(r"[^\w\s-]", "", plain).strip().lower())


def unique_slug(slug: str, used: set[str]) -> str:
    """The slug, or with the first free suffix _1, _2, ...; it joins used."""
    while slug in used or not slug:
        m = re.fullmatch(r"(.*)_(\d+)", slug)
        slug = f"{m[1]}_{int(m[2]) + 1}" if m else f"{slug}_1"
    used.add(slug)
    return slug


def parse_date(text: str) -> datetime.date | None:
    """ISO in any of its forms, month/day/year, or a month name with day and year; the first valid one."""
    text = text.strip()
    try:
        return datetime.date.fromisoformat(text)
    except ValueError:
        pass
    for form in ("%m/%d/%Y", "%m-%d-%Y", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%B %d %Y"):
        try:
            return datetime.datetime.strptime(text, form).date()
        except ValueError:
            continue
    return None


def parse_pdf_date(text: str) -> tuple[datetime.datetime, int | None] | None:
    """D:YYYYMMDDHHmmSS with an optional zone: local time and minutes from UTC, None where no zone is given."""
    m = re.match(r"(?:D:)?(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(?:(Z)|([+-])(\d\d)'?(\d\d)?)?", text)
    if not m:
        return None
    try:
        local = datetime.datetime(int(m[1]), int(m[2] or 1), int(m[3] or 1), int(m[4] or 0), int(m[5] or 0), int(m[6] or 0))
    except ValueError:
        return None
    if m[7]:
        return local, 0
    return local, (1 if m[8] == "+" else -1) * (int(m[9]) * 60 + int(m[10] or 0)) if m[8] else None


def parse_color(text: str) -> tuple[float, float, float]:
    """#rrggbb, or three numbers from 0 to 1."""
    if m := re.fullmatch(r"#([0-9A-Fa-f]{6})", text.strip()):
        return tuple(int(m[1][i : i + 2], 16) / 255 for i in (0, 2, 4))  # type: ignore[return-value]
    parts = [float(x) for x in text.split(",")]
    if len(parts) != 3 or not all(0 <= x <= 1 for x in parts):
        raise ValueError(f"not a color: {text!r}")
    return parts[0], parts[1], parts[2]


def parse_rect(text: str) -> tuple[float, ...]:
    parts = [float(x) for x in text.split(",")]
    if len(parts) < 4:
        raise ValueError(f"a rectangle needs four numbers: {text!r}")
    return tuple(parts[:4])


def parse_point(text: str) -> tuple[float, float]:
    parts = [float(x) for x in text.split(",")]
    if len(parts) != 2:
        raise ValueError(f"a point needs two numbers: {text!r}")
    return parts[0], parts[1]


def parse_points(text: str) -> list[tuple[float, float]]:
    return [parse_point(p) for p in text.split(";") if p.strip()]


def line_ratio(left: list[str], right: list[str]) -> float:
    """Similarity of two pages' lines; scoring takes the left page as the second sequence."""
    return difflib.SequenceMatcher(None, right, left, autojunk=False).ratio()


def ratio_bound(left: list[str], right: list[str]) -> float:
    """What ``line_ratio`` cannot exceed: the lines that both have, in any order."""
    shared = sum((Counter(left) & Counter(right)).values())
    return 2 * shared / (len(left) + len(right)) if left or right else 1.0


def unified(left: list[str], right: list[str], context: int) -> list[str]:
    return list(difflib.unified_diff(left, right, lineterm="", n=context))[2:]


@F.pandas_udf(DoubleType())  # a type, not its name: workers import this without a session
def py_round(x: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounding of the binary value, halves to even, as Python has it."""
    return pd.Series([None if pd.isna(a) else round(float(a), int(d)) for a, d in zip(x, digits, strict=True)], dtype="float64")


def mask_matches(pattern: str, marker: str = "[REDACTED]"):  # noqa: ANN201
    """A pandas UDF that replaces each match of a Python pattern by the marker, taken literally."""

    @F.pandas_udf("string")
    def mask(text: pd.Series) -> pd.Series:
        compiled = hit_pattern(pattern)
        return text.map(lambda t: None if t is None else compiled.sub(lambda _: marker, t))

    return mask


def name_matches(pattern: str):  # noqa: ANN201
    """A pandas UDF for file-name globs: *, ?, [!...], case-sensitive, a leading dot is ordinary."""

    @F.pandas_udf("boolean")
    def matches(name: pd.Series) -> pd.Series:
        return name.map(lambda n: n is not None and fnmatchcase(n, pattern))

    return matches


@F.pandas_udf(StringType())
def nfc_key(name: pd.Series) -> pd.Series:
    """The key under which attachment names collide: composed form, lower case."""
    return name.map(lambda n: None if n is None else unicodedata.normalize("NFC", n).lower())
