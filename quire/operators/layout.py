"""Page layout from positioned words: rows, columns and reading order; ruled tables from edges.

Rows gather words around the first word's top, which is a fold over ordered words and no lag: it is done page by
page.
"""

from __future__ import annotations

import csv
import io
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame

from quire.operators.paged import Box, by_page, united

# Fixed values, in points.
ROW_TOLERANCE, COLUMN_GAP, SPANNING_SHARE = 3.0, 24.0, 0.55
SNAP, JOIN, CROSS = 3.0, 3.0, 3.0

BOX = ["x0", "y0", "x1", "y1"]
Row = tuple[int, str, float, float, float, float]


def anchored(words: list[Box]) -> list[list[Box]]:
    """Words in rows: a word belongs to the last row if its top is within the tolerance of that row's first word."""
    rows: list[list[Box]] = []
    for w in sorted(words, key=lambda w: (w.y0, w.x0)):
        if rows and abs(w.y0 - rows[-1][0].y0) <= ROW_TOLERANCE:
            rows[-1].append(w)
        else:
            rows.append([w])
    return rows


def row_of(words: list[Box], column: int) -> Row:
    x0, _, x1, y1 = united(words)
    return column, " ".join(t for t in (w.text.strip() for w in words) if t), round(x0, 2), round(words[0].y0, 2), round(x1, 2), round(y1, 2)


def columns_of(words: list[Box]) -> list[tuple[float, float]]:
    """Horizontal extents that are more than the gap apart."""
    out: list[list[float]] = []
    for x0, x1 in sorted((w.x0, w.x1) for w in words):
        if out and x0 - out[-1][1] <= COLUMN_GAP:
            out[-1][1] = max(out[-1][1], x1)
        else:
            out.append([x0, x1])
    return [(a, b) for a, b in out]


def reading_order(words: list[Box], width: float) -> list[Row]:
    """The page's rows in reading order: column by column between the lines that span the page (column 0)."""
    words = [w for w in words if w.text.strip()]
    if not words:
        return []
    spanning, body = [], []
    for row in anchored(words):
        line = sorted(row, key=lambda w: w.x0)
        close = all(b.x0 - a.x1 <= COLUMN_GAP for a, b in zip(line, line[1:], strict=False))
        (spanning if close and line[-1].x1 - line[0].x0 > SPANNING_SHARE * width else body).extend(line)
    if not body:
        spanning, body = [], words
    bounds = columns_of(body)
    if len(bounds) <= 1:
        return [row_of(r, 1) for r in anchored(words)]
    rows = [[row_of(r, i + 1) for r in anchored([w for w in body if w.x0 >= a - 0.01 and w.x0 <= b + 0.01])] for i, (a, b) in enumerate(bounds)]
    cuts = [row_of(r, 0) for r in anchored(spanning)]
    out, low = [], float("-inf")
    for cut in [*cuts, None]:
        high = cut[3] if cut else float("inf")
        out += [r for column in rows for r in column if low <= r[3] < high]
        if cut:
            out.append(cut)
            low = high
    return out


def layout_rows(words: DataFrame, width: float = 612.0, in_order: bool = False) -> DataFrame:
    """(doc_id, page, seq, column, text, x0, y0, x1, y1) in reading order; in_order as in ``by_page``."""

    def fold(page: list[Box]) -> list[tuple]:
        return [(i, *row) for i, row in enumerate(reading_order(page, width))]

    return by_page(words, fold, "seq bigint, column bigint, text string, x0 double, y0 double, x1 double, y1 double", in_order)


def snapped(values: list[float], tolerance: float) -> dict[float, float]:
    """Each value's cluster mean, a cluster ending where the next distinct value is farther than the tolerance."""
    means, group = {}, []
    count = defaultdict(int)
    for v in values:
        count[v] += 1

    def close() -> None:
        total = sum(count[g] for g in group)
        means.update(dict.fromkeys(group, sum(g * count[g] for g in group) / total if total else 0))

    for v in sorted(count):
        if group and v > group[-1] + tolerance:
            close()
            group = []
        group.append(v)
    if group:
        close()
    return means


def joined_segments(segments: list[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """(position, from, to) segments on one line made one where the next begins at most the tolerance past the end."""
    out: list[list[float]] = []
    for at, a, b in sorted(segments):
        if out and out[-1][0] == at and a <= out[-1][2] + JOIN:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([at, a, b])
    return [(x[0], x[1], x[2]) for x in out]


def find_cells(vertical: list[tuple[float, float, float]], horizontal: list[tuple[float, float, float]]) -> list[tuple[float, float, float, float]]:
    """Smallest boxes whose corners are crossings and whose sides run along the lines."""
    corner: dict[tuple[float, float], tuple[set[int], set[int]]] = {}
    for i, (x, top, bottom) in enumerate(vertical):
        for j, (y, left, right) in enumerate(horizontal):
            if top - CROSS <= y <= bottom + CROSS and left - CROSS <= x <= right + CROSS:
                on = corner.setdefault((x, y), (set(), set()))
                on[0].add(i)
                on[1].add(j)
    by_x, by_y = defaultdict(list), defaultdict(list)
    for x, y in sorted(corner):
        by_x[x].append(y)
        by_y[y].append(x)
    along = lambda p, q, side: bool(corner[p][side] & corner[q][side])
    cells = []
    for x, y in sorted(corner):
        lower = [v for v in by_x[x] if v > y and along((x, y), (x, v), 0)]
        right = [v for v in by_y[y] if v > x and along((x, y), (v, y), 1)]
        box = next(((x, y, r, b) for b in lower for r in right if (r, b) in corner and along((r, b), (r, y), 0) and along((r, b), (x, b), 1)), None)
        if box:
            cells.append(box)
    return cells


def grouped_cells(cells: list[tuple[float, float, float, float]]) -> list[list[tuple[float, float, float, float]]]:
    """Cells that share corners, directly or through others; single cells are no table. Ordered by top, then left."""
    root = list(range(len(cells)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at: dict[tuple[float, float], int] = {}
    for i, (x0, y0, x1, y1) in enumerate(cells):
        for p in ((x0, y0), (x0, y1), (x1, y0), (x1, y1)):
            root[find(i)] = find(at.setdefault(p, i))
    groups = defaultdict(list)
    for i, c in enumerate(cells):
        groups[find(i)].append(c)
    return sorted((g for g in groups.values() if len(g) > 1), key=lambda g: min((c[1], c[0]) for c in g))


def page_tables(edges: pd.DataFrame, words: pd.DataFrame) -> list[list[list[str | None]]]:
    """The ruled tables of a page as grids: None where there is no cell, '' where one is empty."""
    v, h = edges[edges["orient"] == "v"], edges[edges["orient"] == "h"]
    sx, sy = snapped(v["x0"].tolist(), SNAP), snapped(h["top"].tolist(), SNAP)
    vertical = joined_segments([(sx[x], a, b) for x, a, b in zip(v["x0"], v["top"], v["bottom"], strict=True)])
    horizontal = joined_segments([(sy[y], a, b) for y, a, b in zip(h["top"], h["x0"], h["x1"], strict=True)])
    boxes = [Box(i, 0, 0, *w) for i, w in enumerate(zip(words["text"], *(words[c] for c in BOX), strict=True))]
    out = []
    for cells in grouped_cells(find_cells(vertical, horizontal)):
        tops, lefts = sorted({c[1] for c in cells}), sorted({c[0] for c in cells})
        grid: list[list[str | None]] = [[None] * len(lefts) for _ in tops]
        for x0, y0, x1, y1 in cells:
            inside = [b for b in boxes if x0 <= (b.x0 + b.x1) / 2 < x1 and y0 <= (b.y0 + b.y1) / 2 < y1]
            lines = (sorted(line, key=lambda b: b.x0) for line in anchored(inside))
            grid[tops.index(y0)][lefts.index(x0)] = "\n".join(" ".join(b.text for b in line) for line in lines)
        out.append(grid)
    return out


def table_cells(edges: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, page, table, row, col, text) of the ruled tables; a null text is no cell."""

    def run(key: tuple, e: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        rows = [(*key, t, i, j, text) for t, grid in enumerate(page_tables(e, w), 1) for i, line in enumerate(grid) for j, text in enumerate(line)]
        return pd.DataFrame(rows, columns=["doc_id", "page", "table", "row", "col", "text"])

    kind = words.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, page bigint, table bigint, row bigint, col bigint, text string"
    return edges.groupBy("doc_id", "page").cogroup(words.groupBy("doc_id", "page")).applyInPandas(run, schema)


def csv_text(grid: list[list[str | None]]) -> str:
    out = io.StringIO()
    csv.writer(out).writerows([["" if c is None else c for c in row] for row in grid])
    return out.getvalue()


def tables_csv(cells: DataFrame) -> DataFrame:
    """(doc_id, name, csv): each table as a file p{page}_t{table}.csv."""

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        grid = [g.sort_values("col")["text"].tolist() for _, g in t.sort_values("row").groupby("row")]
        return pd.DataFrame([(key[0], f"p{key[1] + 1}_t{key[2]}.csv", csv_text(grid))], columns=["doc_id", "name", "csv"])

    kind = cells.schema["doc_id"].dataType.simpleString()
    return cells.groupBy("doc_id", "page", "table").applyInPandas(run, f"doc_id {kind}, name string, csv string")
