"""Every registered query beside its SQL, and the others for rows."""

import difflib
import re
import shutil
import subprocess
import sys
from collections import defaultdict
from html.parser import HTMLParser
from pathlib import Path

import pytest

from quire.plans import all_queries, all_sql
from tests.compare import difference

DATA = "/root/testdata/sf0.01"
QUERIES, SQL = all_queries(), all_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, name):
    assert difference(spark, QUERIES[name], SQL[name], DATA) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_text_ratio_like_plain_difflib(spark):
    from quire.operators.compare import with_lines
    from quire.plans.pagesets import versions

    pages = [defaultdict(dict), defaultdict(dict)]
    for side, df in zip(pages, versions(spark, DATA), strict=True):
        for r in with_lines(df).collect():
            if r.lines:
                side[r.doc_id][r.page] = list(r.lines)
    want = set()
    for doc, own in pages[0].items():
        for page, lines in own.items():
            ratio = lambda m: difflib.SequenceMatcher(None, pages[1][doc][m], lines, autojunk=False).ratio()
            match = max(pages[1][doc], key=lambda m: (ratio(m), m == page, -m))
            diff = list(difflib.unified_diff(lines, pages[1][doc][match], lineterm="", n=1))[2:]
            want.add((doc, page, match, round(ratio(match), 9), sum(x[0] == "+" for x in diff), sum(x[0] == "-" for x in diff), tuple(diff[:20])))
    got = QUERIES["compare_text_ratio"](spark, DATA).collect()
    assert {(r.doc_id, r.page, r.match, round(r.ratio, 9), r.added, r.removed, tuple(r.diff)) for r in got} == want and len(got) == len(want)


class Page(HTMLParser):
    """Headings, and all text that a page shows, by the standard library."""

    def __init__(self, text):
        super().__init__()
        self.headings, self.words, self.inside, self.hidden = [], [], None, 0
        self.feed(text)

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title")
        if re.fullmatch("h[1-6]", tag):
            self.inside = [int(tag[1]), ""]

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title")
        if self.inside and tag == f"h{self.inside[0]}":
            self.headings.append((self.inside[0], " ".join(self.inside[1].split())))
            self.inside = None

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()
            if self.inside:
                self.inside[1] += data


def test_html_like_the_standard_parser(spark):
    pages = {r.page_id: Page(r.html) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    found = defaultdict(list)
    for r in QUERIES["html_outline"](spark, DATA).orderBy("page_id", "ord").collect():
        found[r.page_id].append((r.level, " ".join(r.title.split())))
    assert {k: v for k, v in found.items()} == {k: p.headings for k, p in pages.items() if p.headings}
    texts = {r.page_id: "".join(r.text.split()) for r in QUERIES["html_text"](spark, DATA).collect()}
    assert texts == {k: "".join(p.words) for k, p in pages.items()}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_works_without_the_optional_package(tmp_path):
    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'doc_count' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
