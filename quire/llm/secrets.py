"""Secret scans with Spark expressions only.

Base patterns are found leftmost and non-overlapping; where they lie follows from the text between them, which a
lazy group in front of each pattern captures, so lengths add up to code-point positions. Texts in which a pattern
finds nothing (nearly all) skip that.

The method on top: candidate strings (runs of 20 or more letters, digits and ``+/_=-`` with at least one digit and
one letter) are read through a window of 20 characters. Counts per character are kept as the window slides: one
character comes in, one goes out, and the sum of c * log2(c) changes by two differences, taken from a table of
whole millionths so that sums are exact. Shannon entropy reaches a class's threshold where that sum is small
enough; classes are hexadecimal digits and all other candidates. The span reaches from the first such window to
the last. Candidates on the allow-list (UUIDs, words joined by marks, examples) give none.

A null text is an empty one. Rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.arrays import free_name, running_spans

# The base patterns, by kind in order; the group of the value and its least length.
KINDS = ["assign", "access", "hex", "entropy"]
PATTERNS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 3, 12),
    "access": (r"AKIA[A-Z0-9]+", 2, 18),
    "hex": (r"[0-9a-f]+", 2, 16),
}
# What a text must match to have any span of a kind.
PRESENT = {"assign": PATTERNS["assign"][0], "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
THRESHOLDS = {"hex": 2.9, "other": 3.6}
# A candidate is on the allow-list if it matches the first pattern and not the second.
ALLOWED = [
    (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", None),  # UUIDs
    (r"^[A-Za-z]", r"[-_/=+]{2}|[-_/=+]$|[A-Za-z][0-9]|[0-9][A-Za-z]"),  # words and numbers joined by single marks
    (r"(?i)example", None),
]
SPAN = "array<struct<start:int,stop:int,kind:int>>"
_UNIT = 1_000_000
_TABLE = [round(_UNIT * c * math.log2(c)) if c else 0 for c in range(WINDOW + 2)]


def limit(threshold: float) -> int:
    """The largest window sum whose entropy reaches the threshold."""
    return math.floor(_UNIT * WINDOW * (math.log2(WINDOW) - threshold))


def _located(text: Column, pattern: str, value_group: int, keep: Callable[[Column], Column]) -> Column:
    """(start, stop, value) of the pattern's matches whose value passes keep."""
    full = rf"(?s)\G(.*?)({pattern})"  # anchored where the last match ended: one pass over the text
    found = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(full), F.lit(i)).alias(n) for i, n in ((1, "before"), (2, "match"), (value_group, "value"))))
    make = lambda start, stop, m, _: F.struct(start.alias("start"), stop.alias("stop"), m["value"].alias("value"))
    start, stop = lambda m, at: at + F.length(m["before"]), lambda m, start: start + F.length(m["match"])
    return running_spans(found, start, stop, lambda m, _: keep(m["value"]), make, "struct<start:int,stop:int,value:string>")


def base_spans(text: Column, kind: str) -> Column:
    pattern, group, least = PATTERNS[kind]
    located = _located(text, pattern, group, lambda value: F.length(value) >= least)
    spans = F.transform(located, lambda s: F.struct(s.start.alias("start"), s.stop.alias("stop"), F.lit(KINDS.index(kind)).alias("kind")))
    return F.when(text.rlike(PRESENT[kind]), spans).otherwise(F.array()).cast(SPAN)


def high_windows(value: Column) -> Column:
    """(first, last): starts of the first and last window of high entropy; null if there is none."""
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    table = F.array(*map(F.lit, _TABLE))
    most = F.when(value.rlike("^[0-9a-fA-F]+$"), limit(THRESHOLDS["hex"])).otherwise(limit(THRESHOLDS["other"]))
    step = lambda all_: lambda c, i: F.struct(c.alias("new"), F.when(i >= WINDOW, F.get(all_, i - WINDOW)).otherwise(-1).alias("old"), i.alias("i"))
    # named once by a lambda, else the codes would be made again for each of their elements
    steps = F.get(F.transform(F.array(codes), lambda all_: F.transform(all_, step(all_))), F.lit(0))
    zero = F.struct(
        F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0).cast("bigint").alias("total"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")
    )

    def advance(s: Column, x: Column) -> Column:
        more = F.get(s.counts, x.new)
        fewer = F.get(s.counts, x.old) + F.when(x.new == x.old, 1).otherwise(0)
        total = s.total + F.get(table, more + 1) - F.get(table, more)
        total = total + F.when(x.old >= 0, F.get(table, fewer - 1) - F.get(table, fewer)).otherwise(0)
        counts = F.transform(s.counts, lambda n, k: n + F.when(k == x.new, 1).otherwise(0) - F.when(k == x.old, 1).otherwise(0))
        high = (x.i >= WINDOW - 1) & (total <= most)
        start = x.i - (WINDOW - 1)
        return F.struct(
            counts.alias("counts"), total.cast("bigint").alias("total"), F.when(high, F.coalesce(s["first"], start)).otherwise(s["first"]).alias("first"), F.when(high, start).otherwise(s["last"]).alias("last")
        )

    return F.aggregate(steps, zero, advance, lambda s: F.when(s["first"].isNotNull(), F.struct(s["first"].alias("first"), s["last"].alias("last"))))


def suspicious(value: Column) -> Column:
    """Whether a candidate has a digit and a letter and is not on the allow-list."""
    ok = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    for pattern, unless in ALLOWED:
        ok = ok & ~(value.rlike(pattern) & ~value.rlike(unless) if unless else value.rlike(pattern))
    return ok


def entropy_spans(text: Column) -> Column:
    located = _located(text, CANDIDATE, 2, suspicious)
    windows = F.transform(located, lambda s: F.struct(s.start.alias("start"), high_windows(s.value).alias("high")))
    windows = F.filter(windows, lambda s: s.high.isNotNull())
    spans = F.transform(windows, lambda s: F.struct((s.start + s.high["first"]).alias("start"), (s.start + s.high["last"] + WINDOW).alias("stop"), F.lit(3).alias("kind")))
    return F.when(text.rlike(CANDIDATE), spans).otherwise(F.array()).cast(SPAN)


def find_secrets(docs: DataFrame, text_col: str = "text", base_name: str = "base", spans_name: str = "spans") -> DataFrame:
    """docs with two new columns, arrays of (start, kind, stop) sorted by start, then kind (see ``KINDS``)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = {k: free_name(docs.columns, f"_{k}") for k in KINDS}
    found = docs.withColumns({names[k]: base_spans(text, k) for k in KINDS[:3]} | {names["entropy"]: entropy_spans(text)})
    key = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.stop.alias("stop"))))
    base = [names[k] for k in KINDS[:3]]
    found = found.withColumns({base_name: key(F.concat(*base)), spans_name: key(F.concat(*base, names["entropy"]))})
    return found.drop(*names.values())


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.stop.cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", marker: str = "[SECRET]") -> DataFrame:
    """docs with every span of text_col replaced by the marker, overlapping spans by one; null stays null."""
    base, spans, cut = (free_name(docs.columns, f"_{x}") for x in ("base", "spans", "cut"))
    text = F.col(text_col)
    # by start, a span begins a new cut unless an earlier one reaches past its start; cuts know where the last ended
    make = lambda start, stop, x, at: F.struct(at.alias("reach"), start.alias("start"))
    opened = running_spans(F.col(spans), lambda x, at: F.greatest(x.start, at), lambda x, start: F.greatest(x.stop, start), lambda x, at: x.start >= at, make, "struct<reach:int,start:int>")
    found = find_secrets(docs, text_col, base, spans).withColumn(cut, F.when(F.size(spans) > 0, opened))
    before = F.transform(cut, lambda x: F.concat(F.substring(text, x.reach + 1, x.start - x.reach), F.lit(marker)))
    last = F.array_max(F.transform(spans, lambda s: s.stop))
    clean = F.concat(F.array_join(before, ""), F.substring(text, last + 1, F.length(text)))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).drop(base, spans, cut)
