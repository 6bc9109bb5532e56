"""HTML and Markdown as tables: nodes, headings with unique slugs, tables, plain text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from quire.functions.pytext import slugify, unique_slug

# Elements without content, elements whose text is not shown, elements that end a line.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = {"script", "style", "head", "title"}
BLOCK = set("address article aside blockquote dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul br".split())


class Nodes(HTMLParser):
    """Elements and texts in document order; an end tag closes what is open inside it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def _add(self, tag: str, attrs: dict, text: str | None) -> int:
        self.rows.append([len(self.rows), self.open[-1] if self.open else None, tag, attrs, text])
        return len(self.rows) - 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = self._add(tag, {k: v or "" for k, v in attrs}, None)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._add(tag, {k: v or "" for k, v in attrs}, None)

    def handle_endtag(self, tag: str) -> None:
        names = [self.rows[i][2] for i in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        self._add("#text", {}, data)


def nodes(text: str) -> list[list]:
    """[node, parent, tag, attributes, text] of a page."""
    parser = Nodes()
    parser.feed(text)
    parser.close()
    return parser.rows


def plain_text(text: str) -> str:
    """What a page shows, block elements on lines of their own."""
    rows, out = nodes(text), []
    hidden: set[int] = set()
    for node, parent, tag, _, data in rows:
        if tag in HIDDEN or parent in hidden:
            hidden.add(node)
        elif tag == "#text":
            out.append(re.sub(r"\s+", " ", data))
        if tag in BLOCK:
            out.append("\n")
    return "\n".join(line for line in (re.sub(r" +", " ", x).strip() for x in "".join(out).split("\n")) if line)


def headings(text: str) -> list[tuple[int, int, str, str]]:
    """(order, level, title, slug) of each heading; slugs are unique in the page."""
    rows, out, used = nodes(text), [], set()
    for node, _, tag, attrs, _ in rows:
        if re.fullmatch("h[1-6]", tag):
            within = {node}
            parts = []
            for n, p, t, _, data in rows[node + 1 :]:
                if p in within:
                    within.add(n)
                    if t == "#text":
                        parts.append(data)
            title = re.sub(r"\s+", " ", "".join(parts)).strip()
            out.append((len(out), int(tag[1]), title, unique_slug(attrs.get("id") or slugify(title), used)))
    return out


def table_rows(text: str) -> list[tuple[int, int, int, str]]:
    """(table, row, column, text) of each cell."""
    rows, out = nodes(text), []
    place: dict[int, tuple[int, int, int]] = {}
    tables, counts, cells = -1, {}, {}
    for node, parent, tag, _, data in rows:
        if tag == "table":
            tables += 1
            counts[tables] = -1
        elif tag == "tr" and tables >= 0:
            counts[tables] += 1
            cells[tables, counts[tables]] = -1
        elif tag in ("td", "th") and (tables, counts.get(tables)) in cells:
            cells[tables, counts[tables]] += 1
            place[node] = (tables, counts[tables], cells[tables, counts[tables]])
            out.append([*place[node], ""])
        elif parent in place:
            place[node] = place[parent]
            if tag == "#text":
                next(x for x in reversed(out) if tuple(x[:3]) == place[node])[3] += data
    return [(a, b, c, re.sub(r"\s+", " ", t).strip()) for a, b, c, t in out]


def markdown_html(text: str) -> str:
    """Markdown's headings, lists, quotes, code, rules, emphasis and links as HTML; ``[TOC]`` lists the headings."""
    out, used, toc, kind, code = [], set(), [], None, None

    def inline(s: str) -> str:
        s = html.escape(s, quote=False)
        s = re.sub(r"`([^`]+)`", r"<code>\1</code>", s)
        s = re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', s)
        s = re.sub(r"(\*\*|__)(.+?)\1", r"<strong>\2</strong>", s)
        return re.sub(r"(?<!\w)([*_])(.+?)\1(?!\w)", r"<em>\2</em>", s)

    def close() -> None:
        nonlocal kind
        if kind:
            out.append(f"</{kind}>")
        kind = None

    for line in [*text.split("\n"), ""]:
        if line.startswith("```"):
            if code is None:
                close()
                code = []
            else:
                out.append("<pre><code>" + html.escape("\n".join(code), quote=False) + "</code></pre>")
                code = None
        elif code is not None:
            code.append(line)
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line):
            close()
            slug = unique_slug(slugify(m[2]), used)
            toc.append((len(m[1]), m[2], slug))
            out.append(f'<h{len(m[1])} id="{slug}">{inline(m[2])}</h{len(m[1])}>')
        elif re.fullmatch(r"\s*([-*_])(\s*\1){2,}\s*", line):
            close()
            out.append("<hr/>")
        elif m := re.match(r"\s*(?:([-*+])|\d+\.)\s+(.*)", line):
            want = "ul" if m[1] else "ol"
            if kind != want:
                close()
                kind = want
                out.append(f"<{want}>")
            out.append(f"<li>{inline(m[2])}</li>")
        elif line.startswith(">"):
            if kind != "blockquote":
                close()
                kind = "blockquote"
                out.append("<blockquote>")
            out.append(inline(line[1:].strip()))
        elif not line.strip():
            close()
        elif kind == "p":
            out.append(inline(line))
        else:
            close()
            kind = "p"
            out.append("<p>")
            out.append(inline(line))
    listing = "<ul>" + "".join(f'<li class="l{n}"><a href="#{s}">{html.escape(t)}</a></li>' for n, t, s in toc) + "</ul>"
    return "\n".join(out).replace("<p>\n[TOC]\n</p>", listing)


def _mapped(pages: DataFrame, rows_of, schema: str, names: list[str], id_col: str, html_col: str) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *r) for k, t in zip(batch[id_col], batch[html_col], strict=True) for r in rows_of(t or "")]
            yield pd.DataFrame(rows, columns=[id_col, *names])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {kind}, {schema}")


def dom(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row a node: (id, node, parent, tag, attrs, text)."""
    names = ["node", "parent", "tag", "attrs", "text"]
    return _mapped(pages, nodes, "node bigint, parent bigint, tag string, attrs map<string,string>, text string", names, id_col, html_col)


def outline(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    return _mapped(pages, headings, "ord bigint, level bigint, title string, slug string", ["ord", "level", "title", "slug"], id_col, html_col)


def tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    return _mapped(pages, table_rows, "table bigint, row bigint, col bigint, text string", ["table", "row", "col", "text"], id_col, html_col)


def texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    return _mapped(pages, lambda t: [(plain_text(t),)], "text string", ["text"], id_col, html_col)
