"""PDF, HTML, Markdown, sinks and streams."""

import io
import re
import zipfile

import pytest

from quire.sources import html, pdf, pdf_crypt, pdf_edit, pdf_tables, sinks
from quire.sources.pdf_edit import Draft
from quire.sources.pdf_write import file_bytes, text_pdf


def made():
    return text_pdf(["Account: 123\ncafé is (open)", "two words", ""], title="Tést", labels=["a", "b", "c"], outline=True)


def test_text_and_reports():
    rows = lambda form, data=None: pdf_tables.rows_of(form, "x", data or made())
    assert [r[5] for r in rows("pages")] == ["Account: 123\ncafé is (open)", "two words", ""]
    assert rows("documents")[0][2:6] == (3, False, False, "Tést")
    assert [(r[2], r[3], r[4]) for r in rows("outline")] == [(1, "a", 1), (1, "b", 2), (1, "c", 3)]
    assert [r[5] for r in rows("words")][:3] == ["Account:", "123", "café"]
    assert rows("fonts") == [("x", 3, "Helvetica", "Type1", None)]


@pytest.mark.parametrize("spoil", [lambda b: b.replace(b"startxref", b"startxxxx"), lambda b: b.replace(b"xref\n0", b"xxxx\n0"), lambda b: b"junk\n" + b, lambda b: b[: b.rindex(b"xref\n0")]])
def test_damaged_files_are_read_by_scanning(spoil):
    found = pdf_tables.rows_of("documents", "x", spoil(made()))[0]
    assert found[2] == 3 and found[4] is True
    assert pdf_tables.rows_of("pages", "x", spoil(made()))[1][5] == "two words"


def test_hopeless_files_give_an_error_row():
    for form in pdf_tables.SCHEMAS:
        rows = pdf_tables.rows_of(form, "x", b"no pdf")
        if form in ("documents", "preflight"):
            assert rows and rows[0][0] == "x"
        assert len(rows) <= 1 and all(len(r) == pdf_tables.schema_of(form).count(", ") + 1 for r in rows)
    broken = text_pdf(["a"]).replace(b"/Contents", b"/Rotate /No /Contents")
    row = pdf_tables.rows_of("pages", "x", broken)
    assert len(row) == 1 and row[0][1] is None and row[0][-1].startswith("ValueError")


def test_letters_of_all_scripts_come_back():
    pages = ["Привет мир", "日本語 text\nplain \x81", "a😀b é", "plain"]
    assert [r[5] for r in pdf_tables.rows_of("pages", "x", text_pdf(pages))] == ["Привет мир", "日本語 text\nplain \x81", "a😀b é", "plain"]


@pytest.mark.parametrize("method", ["rc4", "aes128", "aes256"])
def test_protected_files(method):
    data = Draft(made()).save(user="ü" if method != "rc4" else "u", owner="own", allow=("print",), method=method)
    assert pdf_tables.rows_of("documents", "x", data)[0][3] and pdf_tables.rows_of("documents", "x", data)[0][-1]
    assert [r[-1] for r in pdf_tables.rows_of("pages", "x", data, "wrong")] == ["ValueError: the file is encrypted and the password does not open it"]
    for word in ("ü" if method != "rc4" else "u", "own"):
        assert [r[5] for r in pdf_tables.rows_of("pages", "x", data, word)] == ["Account: 123\ncafé is (open)", "two words", ""]
        info = pdf_tables.rows_of("documents", "x", data, word)[0]
        assert info[5] == "Tést" and [k for k, v in info[7].items() if v] == ["print"]
    assert b"Account" not in data and pdf_tables.rows_of("pages", "x", Draft(data, "own").save()) == pdf_tables.rows_of("pages", "x", made())
    open_ = Draft(made()).save(owner="own", method=method)
    assert pdf_tables.rows_of("pages", "x", open_)[0][5] == "Account: 123\ncafé is (open)"


def test_ciphers_against_published_vectors():
    key = bytes(range(32))
    assert pdf_crypt.Aes(key[:16]).block(bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert pdf_crypt.Aes(key).block(bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert pdf_crypt.Aes(key).unblock(bytes.fromhex("8ea2b7ca516745bfeafc49904b496089")).hex() == "00112233445566778899aabbccddeeff"
    assert pdf_crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def test_what_is_removed_is_in_no_byte():
    import zlib

    draft = Draft(made())
    pdf_edit.delete(draft, "1")
    data = draft.save()
    assert len(pdf_tables.rows_of("pages", "x", data)) == 2
    streams = [zlib.decompress(s.raw) for s in (pdf.Document(data).get(pdf.Ref(i, 0)) for i in range(1, 30)) if isinstance(s, pdf.Stream)]
    assert not any(b"Account".hex().encode() in s for s in streams)
    draft = Draft(text_pdf(["a secret word", "Привет мир"]))
    assert pdf_edit.rewrite_text(draft, re.compile("secret|мир")) == 2
    assert [r[5] for r in pdf_tables.rows_of("pages", "x", draft.save())] == ["a word", "Привет"]
    with pytest.raises(ValueError, match="no page"):
        pdf_edit.delete(Draft(made()), "1-3")


def test_newest_entry_wins():
    data = made()
    start = len(data)
    new = b"3 0 obj\n<</Type /Font /Subtype /TrueType /BaseFont /New>>\nendobj\n"
    more = data + new + b"xref\n3 1\n%010d 00000 n \ntrailer\n<</Size 20 /Root 1 0 R /Prev %d>>\nstartxref\n%d\n%%%%EOF\n" % (start, int(data.split(b"startxref\n")[1].split(b"\n")[0]), start + len(new))
    assert pdf_tables.rows_of("fonts", "x", more) == [("x", 3, "New", "TrueType", None)]


def test_object_streams_and_xref_streams():
    import zlib

    inner = [(1, b"<</Type /Catalog /Pages 2 0 R>>"), (2, b"<</Type /Pages /Kids [3 0 R] /Count 1>>"), (3, b"<</Type /Page /Parent 2 0 R /MediaBox [0 0 100 200] /Rotate 90>>")]
    heads, body = b"", b""
    for num, text in inner:
        heads += b"%d %d " % (num, len(body))
        body += text + b" "
    packed = zlib.compress(heads + body)
    out = b"%PDF-1.7\n"
    at4 = len(out)
    out += b"4 0 obj\n<</Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d>>\nstream\n" % (len(heads), len(packed)) + packed + b"\nendstream\nendobj\n"
    at5 = len(out)
    entries = [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at4, 0), (1, at5, 0)]
    table = b"".join(bytes([0, k]) [1:] + a.to_bytes(2, "big") + bytes([b]) for k, a, b in entries)
    rows = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(table[i : i + 4], table[i - 4 : i] if i else b"\0\0\0\0", strict=True)) for i in range(0, len(table), 4))
    packed = zlib.compress(rows)
    out += b"5 0 obj\n<</Type /XRef /Size 6 /W [1 2 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms <</Predictor 12 /Columns 4>> /Length %d>>\nstream\n" % len(packed) + packed + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % at5
    doc = pdf.Document(out)
    assert not doc.repaired and pdf_tables.rows_of("pages", "x", out)[0][2:5] == (100.0, 200.0, 90)


def test_filters():
    assert pdf.ascii85(b'87cURD]i,"Ebo80~>') == b"Hello World!"
    assert pdf.run_length(bytes([2, 65, 66, 67, 254, 68, 128])) == b"ABCDDD"
    assert pdf.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"
    assert pdf.inflate(__import__("zlib").compress(b"x" * 1000)[:-6]) != b""


def test_assembled_files():
    d = Draft(made())
    pdf_edit.extract(d, "2,1,2")
    pdf_edit.rotate(d, 90, "2")
    pdf_edit.stamp(d, lambda i, n: "DRAFT")
    d.info = {"Title": "n"}
    new = d.save()
    rows = pdf_tables.rows_of("pages", "y", new)
    assert [(r[4], r[5]) for r in rows] == [(0, "two words\nDRAFT"), (90, "Account: 123\ncafé is (open)\nDRAFT"), (0, "two words\nDRAFT")]
    assert pdf_tables.rows_of("documents", "y", new)[0][5] == "n"


def test_links_and_fields():
    name = pdf.Name
    objects = [
        {"Type": name("Catalog"), "Pages": pdf.Ref(2, 0), "AcroForm": {"Fields": [pdf.Ref(4, 0)]}, "Dests": {"top": [pdf.Ref(3, 0), name("Fit")]}},
        {"Type": name("Pages"), "Kids": [pdf.Ref(3, 0)], "Count": 1},
        {"Type": name("Page"), "Parent": pdf.Ref(2, 0), "MediaBox": [0, 0, 100, 100], "CropBox": [10, 10, 90, 90], "Annots": [{"Subtype": name("Link"), "Rect": [20, 20, 30, 40], "A": {"S": name("URI"), "URI": b"http://x"}}, {"Subtype": name("Link"), "Rect": [0, 0, 1, 1], "Dest": name("top")}, {"Subtype": name("Text"), "Contents": b"hi"}]},
        {"T": b"person", "FT": name("Tx"), "Kids": [pdf.Ref(5, 0)]},
        {"T": b"name", "V": b"Ann", "Parent": pdf.Ref(4, 0)},
    ]
    data = file_bytes(objects)
    links = pdf_tables.rows_of("links", "x", data)
    assert [(r[3:7], r[7], r[8]) for r in links] == [((10.0, 50.0, 20.0, 70.0), "http://x", None), ((-10.0, 89.0, -9.0, 90.0), None, 0)]
    assert pdf_tables.rows_of("widgets", "x", data) == [("x", 0, "person.name", "name", "text", "Ann", None, None)]
    assert [r[3] for r in pdf_tables.rows_of("annotations", "x", data)] == ["Link", "Link", "Text"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made())
    (tmp_path / "b.txt").write_bytes(b"x")
    assert pdf_tables.read_pdf(spark, str(tmp_path)).count() == 3
    spark.dataSource.register(pdf_tables.PdfSource)
    found = spark.read.format("pdf").option("form", "outline").load(str(tmp_path))
    assert [r.title for r in found.orderBy("ord").collect()] == ["a", "b", "c"]


def test_html():
    page = '<html><head><title>t</title><style>p{}</style></head><body><h1>A  <b>b</b></h1><p>x &amp; y<br>z</p><h1>A b</h1><table><tr><th>1</th><td>2 <i>3</i></td></tr><tr><td></td></tr></table><script>var a="<p>";</script></body></html>'
    assert html.headings(page) == [(0, 1, "A b", "a-b"), (1, 1, "A b", "a-b_1")]
    assert html.plain_text(page) == "A b\nx & y\nz\nA b\n12 3" or html.plain_text(page).startswith("A b\nx & y\nz\nA b\n")
    assert html.table_rows(page) == [(0, 0, 0, "1"), (0, 0, 1, "2 3"), (0, 1, 0, "")]


def test_markdown():
    out = html.markdown_html("[TOC]\n\n# One\n\ntext **b** and `c`\n\n- x\n- y\n\n# One\n\n```\n<a>\n```\n")
    assert '<h1 id="one">One</h1>' in out and '<h1 id="one_1">One</h1>' in out and '<a href="#one_1">' in out
    assert "<strong>b</strong>" in out and "<li>x</li>" in out and "&lt;a&gt;" in out


def test_office_files():
    book = zipfile.ZipFile(io.BytesIO(sinks.xlsx({"t": [["a<b", None], ["x" * 40_000, ""]]})))
    sheet = book.read("xl/worksheets/sheet1.xml").decode()
    assert "a&lt;b" in sheet and "x" * 32_767 + "<" in sheet and 'r="B2"' in sheet and 'r="B1"' not in sheet
    with pytest.raises(ValueError):
        sinks.xlsx({"t": [["\x01"]]})
    assert b"two" in zipfile.ZipFile(io.BytesIO(sinks.docx(["one", "two"]))).read("word/document.xml")
    assert [sinks.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_streams(spark, tmp_path):
    from quire.streaming import ledger

    jobs = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id id", "ts", "event_type verb", "value duration")
    jobs.write.parquet(f"{tmp_path}/in")
    stream = ledger.windowed(ledger.ledger_stream(spark, f"{tmp_path}/in", jobs.schema), "1 day")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(runs) from w").first()[0] == jobs.count()
    (tmp_path / "land").mkdir()
    for n in ("a", "b"):
        (tmp_path / "land" / f"{n}.pdf").write_bytes(made())
    for _ in range(2):
        ledger.upsert_by_digest(ledger.landed_files(spark, f"{tmp_path}/land"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
        (tmp_path / "land" / "c.pdf").write_bytes(made()[:-1])
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_conversions():
    from quire.sources import convert

    rows = lambda form, data: pdf_tables.rows_of(form, "x", data)
    page = rows("pages", convert.from_html("<title>T</title><h1>Head</h1><p>a &lt; b</p>"))
    assert page[0][5] == "Head\na < b"
    assert "One" in rows("pages", convert.from_markdown("# One\n\n" + "word " * 1500))[0][5]
    assert len(rows("pages", convert.from_markdown("word " * 3000))) > 1
    grey = b"P5 2 3 255\n" + bytes(6)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x03\x01\x11\x00" + bytes(12)
    assert [(r[2], r[3], r[6]) for r in rows("pages", convert.from_images([grey, jpeg]))] == [(2.0, 3.0, 1), (32.0, 16.0, 1)]
    broken = made().replace(b"startxref", b"startxxxx")
    fixed = convert.repaired(broken)
    assert rows("documents", fixed)[0][2:6] == (3, False, False, "Tést")
    small, ratio = convert.compressed(made())
    assert len(small) <= len(made()) and ratio <= 1


def test_attachments_information_and_sanitising():
    from quire.sources import convert

    data = convert.with_attachment(convert.with_attachment(made(), "b.txt", b"12345"), "a.txt", b"1")
    listed = pdf_tables.rows_of("attachments", "x", data)
    assert [(r[2], r[3]) for r in listed] == [("a.txt", 1), ("b.txt", 5)]
    with pytest.raises(ValueError, match="a.txt"):
        convert.with_attachment(data, "a.txt", b"")
    clean, removed = convert.sanitized(data)
    assert removed >= 1 and pdf_tables.rows_of("attachments", "x", clean) == [] and len(pdf_tables.rows_of("pages", "x", clean)) == 3
    assert len(pdf_tables.rows_of("outline", "x", clean)) == 3
    new = convert.with_information(made(), {"Author": "Ann", "title": "none"})
    assert pdf_tables.rows_of("documents", "x", new)[0][6] == {"author": "Ann"}
